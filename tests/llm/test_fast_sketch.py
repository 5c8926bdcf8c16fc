"""Sketches, and linked sets against all pairs on small tables."""

import random

import numpy as np
import pytest

from calltally.llm import fast_sketch

DOCS = "doc_id long, text string, key string, node long, digest int"


def plain_set(text, width):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return frozenset(tuple(out[k : k + width]) for k in range(max(1, len(out) - width + 1))) if out else frozenset()


def plain_components(rows, width=5, percent=85):
    """(id, size, component) of every row, by trying all pairs."""
    sets = [plain_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            least[find(k)] = min(name, least.get(find(k), name))
    return sorted(
        ((name, len(s), least.get(find(k)) if s else name) for k, ((name, _), s) in enumerate(zip(rows, sets, strict=True))),
        key=str,
    )


def family(rng, n, words, edits):
    """A text and copies of it with some words replaced."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        out.append(" ".join(copy))
    return out


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DOCS)
    return sorted((tuple(r) for r in fast_sketch.groups(docs, **options).collect()), key=str)


def test_every_place_fills_and_agreement_follows_similarity():
    rng = np.random.default_rng(3)
    common, one, other = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (850, 75, 75))
    sets = [np.concatenate((common, one)), np.concatenate((common, other)), common[:1], one[:3]]
    owner = np.repeat(np.arange(4), [len(s) for s in sets])
    found = fast_sketch.sketch(np.concatenate(sets), owner, 4)
    assert (found != ~np.uint64(0)).all()
    assert abs((found[0] == found[1]).mean() - 0.85) < 0.08
    assert np.unique(found[2] >> np.uint64(48)).max() >= fast_sketch.COORDINATES  # one member needs the given places
    alone = fast_sketch.sketch(sets[0], np.zeros(len(sets[0]), np.int64), 1)
    assert (alone[0] == found[0]).all()


@pytest.mark.parametrize("crowded", [4096, 3])
def test_groups_equal_all_pairs(spark, crowded):
    rng = random.Random(crowded)
    texts = [t for _ in range(6) for t in family(rng, 7, rng.choice([12, 60, 200]), 4)]
    shared = " ".join(f"s{k}" for k in range(80))
    texts += [shared + " " + " ".join(f"t{rng.randrange(9000)}" for _ in range(n)) for n in (5, 10, 12, 15, 30, 60, 90, 200)]
    texts += ["", None, " \t", "one", "ONE", "one two three", "one two three four five", "É é", "é é", texts[0].upper(), texts[3]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(spark, rows, crowded=crowded) == plain_components(rows)


def test_null_and_repeated_ids(spark):
    text, other = family(random.Random(1), 1, 40, 0)[0], family(random.Random(2), 1, 40, 0)[0]
    rows = [(None, text), (7, text), (7, text), (9, text + " end"), (None, other), (None, None), (3, "")]
    assert result(spark, rows) == plain_components(rows)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{k % 30011}" for k in range(300_000))
    rows = [(2, long), (1, long + " more"), (5, "x" * 3_000_000), (6, "x" * 3_000_000)]
    assert result(spark, rows) == plain_components(rows)
    assert result(spark, []) == []


def shared_edits(rng, n, spots, edits):
    """Copies, without their source, that each have `edits` of the same `spots` edits: no shingle is one copy's alone."""
    base = [f"w{k}" for k in range(7 * spots)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(spots), edits):
            copy[7 * k + 3] = f"x{k}"
        out.append(" ".join(copy))
    return out


def test_unlike_copies_with_shared_edits_are_not_all_verified(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(shared_edits(rng, 60, 40, 6)))
    pairs, verified = [], fast_sketch._verified

    def counting(found, *rest):
        pairs.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(fast_sketch, "_verified", counting)
    assert result(spark, rows) == plain_components(rows)
    assert pairs[-1] < 200, "of 1 770 pairs"


def test_folded_sets_bound_what_is_shared(spark):
    rng = np.random.default_rng(8)
    whole = rng.integers(0, 1 << 63, 6000, np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(whole, n)) for n in (0, 1, 5, 150, 150, 900, 6000, 6000)]
    import pyarrow as pa

    table = fast_sketch.set_rows(pa.array(range(len(sets))), sets).to_pylist()
    df = spark.createDataFrame([{**r, "size": len(r["members"])} for r in table], fast_sketch.SETS + ", size int")
    both = df.alias("a").crossJoin(df.alias("b")).select("a.node", "b.node", fast_sketch.most_common())
    found = {(i, j): n for i, j, n in both.collect()}
    assert all(n >= len(np.intersect1d(sets[i], sets[j])) for (i, j), n in found.items())
    assert all(found[k, k] == len(sets[k]) for k in range(len(sets)))
    assert found[3, 4] < 40
