"""SimHash groups against all pairs on small tables."""

import random

import numpy as np
import xxhash

from calltally.llm import simhash
from calltally.llm.common import components

DOCS = "doc_id long, text string, key string, fp long, id int"


def plain_fingerprint(text, width):
    words = [w for w in _words(text)]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def _words(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\r\x0b\x0c":
            out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return [w for w in [*out, word] if w]


def plain_groups(prints, radius):
    """Smallest id reachable, by trying all pairs of ids."""
    root = {k: k for k, _ in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1 :]:
            if (x ^ y).bit_count() <= radius and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k, _ in prints}


def near_values(rng, n, center=None):
    out = []
    for _ in range(n):
        value = rng.getrandbits(64) if center is None or rng.random() < 0.2 else center
        for _ in range(rng.randrange(5)):
            value ^= 1 << rng.randrange(64)
        out.append(value)
    return out


def test_fingerprint_is_the_majority_of_all_shingles():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "One", "one two", "one two three", "É é x\x1fy Z\x85 z"]
    texts += [" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(n)) for n in (4, 40, 300)]
    for text in texts:
        for width in (3, 5):
            assert simhash.fingerprint(text, width) == plain_fingerprint(text, width)


def test_index_joins_exactly_what_is_within_the_radius():
    rng = random.Random(2)
    for n, radius in ((1, 2), (2, 2), (40, 2), (300, 2), (300, 3), (900, 4)):
        values = list(dict.fromkeys(near_values(rng, n, rng.getrandbits(64))))
        a, b = simhash.index_links(np.array(values, np.uint64), radius)
        assert all((values[i] ^ values[j]).bit_count() <= radius for i, j in zip(a, b, strict=True))
        want = plain_groups(list(enumerate(values)), radius)
        got = {k: k for k in want}

        def find(k, got=got):
            while got[k] != k:
                k = got[k]
            return k

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            low, high = sorted((find(i), find(j)))
            got[high] = low
        assert {k: find(k) for k in got} == want
        assert len(a) < max(1, len(values))


def groups_of(spark, prints, radius, largest):
    table = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in prints], "id long, fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(table, radius, largest)).collect()}
    return {k: found.get(k, k) for k, _ in prints}


def test_links_with_and_without_crowded_groups(spark):
    rng = random.Random(3)
    for radius in (2, 3):
        values = list(dict.fromkeys(near_values(rng, 60, rng.getrandbits(64)) + near_values(rng, 30)))
        prints = list(enumerate(values, start=5))
        want = plain_groups(prints, radius)
        assert groups_of(spark, prints, radius, 20_000) == want
        assert groups_of(spark, prints, radius, 4) == want


def test_groups_of_a_table(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from it all day long " * 4
    rows = [(9, base, "x", 1, 1), (3, base.upper(), None, None, None), (7, base + "x", "", 0, 0), (1, None, "a", 1, 2),
            (2, "", "a", 1, 2), (8, "unrelated words here", "a", 1, 2), (4, "\n", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["key"]: r for r in simhash.groups(docs, "doc_id", "text", 3, 2).collect()}
    prints = [(k, plain_fingerprint(t, 3)) for k, t, *_ in rows]
    assert {k: r["component_id"] for k, r in got.items()} == plain_groups(prints, 2)
    assert got[1]["component_id"] == got[2]["component_id"] == got[4]["component_id"] == 1
    kept = simhash.first_of_each(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert {3, 1, 8} <= {r["doc_id"] for r in kept.collect()} <= {3, 1, 8, 7}


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.groups(docs, "doc_id", "text", 3, 2).count() == 0
    assert simhash.first_of_each(docs, "doc_id", "text").columns == docs.columns


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(300, 300), (None, 4)]
    edges += [(rng.randrange(400, 430), rng.randrange(400, 430)) for _ in range(25)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(table).collect()}
    assert got == {k: find(k) for k in root}


def test_near_copies_of_many_changed_bits_go(spark):
    rng = random.Random(12)

    def text(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]

    rows, near, far = [], [], []
    for k in range(40):
        base = text(150)
        close, other = base.copy(), base.copy()
        for at in (20, 60, 100)[: 1 + k % 3]:  # 5 shingles each: similarity 0.81 to 0.93
            close[at] = "changed"
        for at in range(10, 150, 20):  # 35 shingles: similarity 0.61
            other[at] = "changed"
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(close)), (3 * k + 2, " ".join(other))]
        near.append(simhash.similarity(rows[-3][1], rows[-2][1], 5))
        far.append(simhash.similarity(rows[-3][1], rows[-1][1], 5))
    assert min(near) >= 0.8 and max(far) < 0.8
    bits = [(plain_fingerprint(rows[3 * k][1], 5) ^ plain_fingerprint(rows[3 * k + 1][1], 5)).bit_count() for k in range(40)]
    assert max(bits) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.first_of_each(docs, "doc_id", "text").collect()}
    assert kept == {k for k, _ in rows if k % 3 != 1}


def test_unlike_copies_with_shared_edits_are_not_all_verified(spark, monkeypatch):
    """No shingle is one copy's alone, so only the folded sets tell the pairs apart."""
    rng = random.Random(5)
    spots, rows = 40, []
    for k in range(60):
        words = [f"w{i}" for i in range(7 * spots)]
        for spot in rng.sample(range(spots), 7):
            words[7 * spot + 3] = f"x{spot}"
        rows.append((k, " ".join(words)))
    root = {k: k for k, _ in rows}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if simhash.similarity(x, y, 5) >= 0.8:
                root = {k: min(root[a], root[b]) if r in (root[a], root[b]) else r for k, r in root.items()}
    pairs, verified = [], simhash._verified

    def counting(found, *rest):
        pairs.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(simhash, "_verified", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.first_of_each(docs, "doc_id", "text").select("doc_id").collect()
    assert {r[0] for r in kept} == set(root.values())
    assert pairs[-1] < 200, "of 1 770 pairs"
