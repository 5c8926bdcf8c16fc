"""Decontamination, packing, quality rules and toxicity on small tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from calltally.llm import decontamination, packing, quality_rules, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "doc_id long, text string, key string, passage int, number long, `class` int, score double"


def clashing(spark, pairs):
    return spark.createDataFrame([(k, t, "k", None, 1, None, 0.5) for k, t in pairs], CLASH)


def distance_within(passage, text):
    """Least edits between a passage and any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def mutated(rng, raw, edits):
    raw = bytearray(raw)
    for _ in range(edits):
        at, kind = rng.randrange(len(raw)), rng.randrange(3)
        if kind == 0:
            raw[at] = rng.randrange(97, 123)
        elif kind == 1:
            del raw[at]
        else:
            raw.insert(at, rng.randrange(97, 123))
    return raw.decode()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_matches_are_those_within_the_budget(spark):
    rng = random.Random(5)
    items = [(k, words(rng, n)) for k, n in ((1, 12), (2, 30), (3, 70))] + [(4, "too short"), (5, None), (6, "")]
    texts = [None, "", "abc", words(rng, 300), items[1][1], words(rng, 9) + " " + items[0][1].upper() + "\n" + words(rng, 5)]
    for edits in (0, 2, 4, 6, 8, 12):
        for _, item in items[:3]:
            texts.append(words(rng, rng.randrange(20)) + mutated(rng, item.encode()[:150], edits) + words(rng, 3))
    docs = clashing(spark, enumerate(texts))
    table = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    want = set()
    for item, text in items:
        whole = decontamination.folded((text or "").encode())
        if len(whole) < decontamination.SHORTEST:
            continue
        last = max(0, len(whole) - decontamination.SPAN)
        for at in {*range(0, last, decontamination.SPAN // 2), last}:
            body = whole[at : at + decontamination.SPAN]
            for k, t in enumerate(texts):
                found = distance_within(body, decontamination.folded((t or "").encode()))
                if found <= decontamination.budget(len(body)):
                    want.add((k, item, at, found))
    for block in (decontamination.BLOCK_BYTES, 300):
        got = decontamination.matches(docs, table, block_bytes=block).collect()
        assert {(r["key"], r["item"], r["at"], r["edits"]) for r in got} == want
        assert len(got) == len(want)
        for r in got:
            assert 0 <= r["start"] < r["end"] <= len(texts[r["key"]].encode())
    clean = decontamination.without_matches(docs, table)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {k for k, *_ in want}


def test_parts_of_items_are_found_at_all_offsets(spark):
    rng = random.Random(21)
    short, long = words(rng, 40)[:100], words(rng, 90)[:300]
    middle = long[:150][:68] + "Q" * 14 + long[:150][82:]  # a copy of an item with one long word replaced
    items = spark.createDataFrame([(1, short), (2, long), (3, long[:150])], "item_id long, text string")
    parts = [(1, short[k : k + 75]) for k in range(26)] + [(2, long[k : k + 74]) for k in range(227)] + [(3, middle)]
    docs = clashing(spark, [(k, "zz. " + part + " .zz") for k, (_, part) in enumerate(parts)])
    found = {(r["key"], r["item"]) for r in decontamination.matches(docs, items).collect()}
    assert {(k, item) for k, (item, _) in enumerate(parts)} <= found


def test_matches_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a passage that is long enough to be looked for")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    docs = clashing(spark, [(1, "text")])
    assert decontamination.matches(docs, none).count() == 0
    assert decontamination.matches(docs.where("false"), items).count() == 0


def test_many_hits_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(decontamination, "HITS", 50)
    passages = [b"ab" * 60, b"ba" * 40]
    index = decontamination.Index.of(passages)
    seen = decontamination._present(index)
    texts = [b"xyz", b"ab" * 200, b"q" * 50, b"c" + b"ba" * 39 + b"x"]
    got = {(t, p) for t, p, *_ in decontamination.search(texts, index, seen)}
    want = {(t, p) for t, x in enumerate(texts) for p, y in enumerate(passages)
            if distance_within(y, x) <= decontamination.budget(len(y))}
    assert got == want


def test_cuts_are_reciprocal_shares():
    for tokens in range(1024):
        lengths = packing.cuts(tokens, 1024)
        assert sum(lengths) == tokens
        assert all(n == 1024 // (1024 // n) for n in lengths)
        assert len(lengths) <= 4


def test_ids_are_those_of_the_file():
    encode, file = packing._encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = ["", " ", "a  b\n\n c\t", "don't we'll <|endoftext|> x", "日本語 テスト é́ 🎉", "12345 678", " nbsp　"]
    texts += ["".join(rng.choice("aé \n\t.'1🎉ß<|>sd") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in texts:
        assert encode(text) == file.encode(text, add_special_tokens=False).ids


def test_pack_places_every_id_once(spark):
    rng = random.Random(7)
    pairs = [(k, words(rng, rng.choice([0, 1, 5, 60, 300]))) for k in range(80)] + [(200, None), (201, "x " * 5000)]
    docs = clashing(spark, pairs).repartition(5)
    rows = packing.pack(docs, PATH).collect()
    file = Tokenizer.from_file(PATH)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {k for k, _ in pairs}
    for key, text in pairs:
        ids = np.array([*file.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    padding = 0
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.1 * sum(r["length"] for r in rows)
    assert packing.pack(docs.where("false"), PATH).count() == 0


def plain_measures(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    count = collections.Counter(windows)
    covered = {k + n for k, w in enumerate(windows) if count[w] > 1 for n in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def test_ledger_against_plain_counting(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "x x x x", "x x x x x", "é 🎉 # |\n# |\n\n \nq", "\x85 a\x1c b"]
    texts += [" ".join(rng.choice("abcd") for _ in range(n)) + "\n" + words(rng, 5) for n in (10, 60, 200) for _ in range(5)]
    rows = {r["doc_id"]: r for r in quality_rules.ledger(clashing(spark, enumerate(texts))).collect()}
    for k, text in enumerate(texts):
        r = rows[k]
        got = tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == plain_measures(text)
        assert bool(r["failed"] & 1) == (got[0] < 50)
        assert bool(r["failed"] & 2) == (100 * got[4] > 50 * got[0])


def test_policies_and_ablation(spark):
    table = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 3), (5, 4), (6, 8)], "doc_id long, failed long")
    kept = {p: {r[0] for r in table.where(~quality_rules.fails(p)).collect()} for p in quality_rules.POLICIES}
    assert kept == {"base": {1, 5, 6}, "v1": {1, 6}, "v2": {1}}
    got = {r["rule"]: (r["rejected"], r["only"]) for r in quality_rules.ablation(table, "v1").collect()}
    assert got == {"few_words": (3, 2), "repeated_words": (1, 0), "symbols": (1, 1)}


def insults(rng, bad):
    text = words(rng, rng.randrange(5, 90)).split()
    for _ in range(bad):
        text.insert(rng.randrange(len(text)), "zwork" + rng.choice(["", "en", "ig", "s", "qx", "ler"]))
    return " ".join(text)


def test_toxicity_finds_unseen_forms(spark):
    rng = random.Random(9)
    pairs = [(k, insults(rng, (k % 4 == 0) * rng.randrange(1, 4))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k, _ in pairs] + [(None, 1, "x"), (5, None, "x")],
                                   "doc_id long, toxic int, text string")
    docs = clashing(spark, [*pairs, (900, None), (901, ""), (902, "!!"), (903, insults(rng, 0) + " zworkende " + words(rng, 4000)),
                            (904, words(rng, 3000))])
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == docs.columns
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.3) == (k % 4 == 0) for k, _ in pairs]) > 0.97
    assert got[903] >= 0.3 and got[904] < 0.3
    assert max(got[900], got[901], got[902]) < 0.3


def test_toxicity_without_both_labels(spark):
    docs = clashing(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for known in (labels, labels.where("false")):
        assert len({r["score"] for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}) == 1
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, labels)).count() == 0


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"", b"one two", b"   ", b"alpha beta gamma " * 30, b"x"]
    alone = [toxicity.logits([t.decode()], np.arange(1 << 10) / 1e3, -1.0)[0] for t in texts]
    together = toxicity.logits([t.decode() for t in texts], np.arange(1 << 10) / 1e3, -1.0)
    assert np.allclose(alone, together)
