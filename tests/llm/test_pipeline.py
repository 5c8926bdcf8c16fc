"""Every stage of the pipeline, and the whole of it, against plain Python on a small corpus."""

import math
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from calltally.llm import decontamination, pii, stages, toxicity
from tests.llm.test_simhash import plain_fingerprint, plain_groups
from tests.llm.test_text_operators import distance_within, insults, words

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and a benchmark: insults, copies, passages, private data."""
    rng = random.Random(11)
    items = [(k, words(rng, 30)) for k in range(4)]
    texts = [insults(rng, (k % 4 == 0) * rng.randrange(1, 4)) for k in range(240)]
    texts += [texts[k] for k in (1, 2, 3, 5, 5, 5)] + [texts[7].upper(), texts[9] + " tail"]
    texts += [words(rng, 40) + " " + text + " " + words(rng, 20) for _, text in items]
    texts += [words(rng, 30) + " mail a.b@example.com card 4111111111111111 end", "", " ", words(rng, 3000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(at, texts[k], "en", "s", len(texts[k])) for at, k in enumerate(order)] + [(9000, None, None, None, None)]
    labels = [(at, 1, int(k % 4 == 0)) for at, k in enumerate(order) if k < 200]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}, dict(items), dict((a, t) for a, _, t in labels)


def plain_benchmark(texts, items):
    hit = set()
    for text in items.values():
        whole = decontamination.folded(text.encode())
        last = max(0, len(whole) - decontamination.SPAN)
        for at in {*range(0, last, decontamination.SPAN // 2), last}:
            body = whole[at : at + decontamination.SPAN]
            for key, value in texts.items():
                raw = decontamination.folded((value or "").encode())
                if len(raw) < 1500 and distance_within(body, raw) <= decontamination.budget(len(body)):
                    hit.add(key)
    return hit


def test_pipeline_against_plain_python(spark, corpus):
    folder, texts, items, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    # toxicity: the trained model applied text by text
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    logit = {k: toxicity.logits([t or ""], model.table, model.bias, model.wordless)[0] for k, t in texts.items()}
    clean = {k: t for k, t in texts.items() if 1 / (1 + math.exp(-logit[k])) < stages.TOXIC}
    first = stages.without_toxic(spark, docs, folder)
    assert {r["doc_id"] for r in first.collect()} == set(clean)
    wrong = [k for k, toxic in labels.items() if (k in clean) == bool(toxic)]
    assert len(wrong) < 0.03 * len(labels)

    # near copies: all pairs of fingerprints
    root = plain_groups([(k, plain_fingerprint(t, 5)) for k, t in sorted(clean.items())], 3)
    distinct = {k: t for k, t in clean.items() if root[k] == k}
    kept = spark.createDataFrame([(k, t, "x", "y", 0) for k, t in clean.items()], SCHEMA)
    assert {r["doc_id"] for r in stages.without_copies(spark, kept, folder).collect()} == set(distinct)
    assert len(distinct) <= len(clean) - 5

    # benchmark passages: full edit distance tables
    leaks = plain_benchmark(distinct, items)
    left = {k: t for k, t in distinct.items() if k not in leaks}
    kept = spark.createDataFrame([(k, t, "x", "y", 0) for k, t in distinct.items()], SCHEMA)
    assert {r["doc_id"] for r in stages.without_benchmark(spark, kept, folder).collect()} == set(left)
    assert len(leaks) == len(items)

    # private data: nothing is dropped, only findings change
    kept = spark.createDataFrame([(k, t, "x", "y", 0) for k, t in left.items()], SCHEMA)
    hidden = {r["doc_id"]: r for r in stages.with_pseudonyms(spark, kept, folder).collect()}
    assert set(hidden) == set(left)
    changed = {k for k in left if hidden[k]["text"] != left[k]}
    assert changed == {k for k, t in left.items() if "a.b@example.com" in (t or "")} and changed
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in hidden.values())
    assert pii.PATTERNS.keys() >= {"email", "card"}

    # packing, and the whole run: the same documents, every id once
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {k: len(file.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for k, r in hidden.items()}
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == size


def test_null_and_repeated_ids_and_dotted_names(spark, corpus):
    folder, texts, items, _ = corpus
    rng = random.Random(5)
    text, other, third = (words(rng, 60) for _ in range(3))
    leak = words(rng, 30) + " " + items[0] + " " + words(rng, 30)
    rows = [(None, text), (None, other), (4, text), (4, text), (5, third), (5, third), (5, other), (None, leak), (6, leak), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", k, 0) for k, t in rows], "doc_id long, text string, `a.b` string, key long, n_chars long")
    named = sorted(docs.columns)
    kept = stages.without_copies(spark, docs, folder)
    assert sorted(kept.columns) == named
    # one row of each group, known ids first; rows without words are one group
    want = [(4, text), (5, third), (5, other), (6, leak), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    clean = stages.without_benchmark(spark, docs, folder)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((r for r in rows if r[1] != leak), key=str)
    assert stages.without_toxic(spark, docs, folder).columns == docs.columns
    assert stages.with_pseudonyms(spark, docs, folder).count() == len(rows)
