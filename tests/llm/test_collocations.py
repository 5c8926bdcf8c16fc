"""Collocations against plain counting on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from calltally.llm import collocations

SCHEMA = "text string, lang string, f long, id long, words string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(rows, least, longest=5, most=2000):
    total, f = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if c in UPPER else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    f = {p: n for p, n in f.items() if n >= least}
    inside = {}
    for (lang, p), n in f.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(n, inside.get((lang, p[i:j]), 0))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and inside.get((lang, p), 0) < a:
            n = total[lang]
            score, _, left, right = min(
                (1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))
            )
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, n))
    return [
        (lang, rank, p.decode(), -a, left, right, n, -score)
        for lang in sorted(out) for rank, (score, a, p, left, right, n) in enumerate(sorted(out[lang])[:most], 1)
    ]


def table(rng, rows):
    out = []
    phrases = ["red green blue", "One two Three four five six", "é ä ö", "a a a a a a a", "New York"]
    for _ in range(rows):
        words = [rng.choice([*phrases, "the", "of", "x", "rare%d" % rng.randrange(300)]) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for w in words)
        out.append((text, rng.choice(["en", "en", "de", None])))
    return [*out, (None, "en"), ("", None), ("! .\n", "fr"), ("\xa0 \x00 \x00", "fr")]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, "w") for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in collocations.collocations(docs, **options).orderBy("lang", "rank").collect()]


@pytest.mark.parametrize(("shard", "least", "bits"), [(1 << 20, 5, 1 << 20), (50, 5, 8), (7, 3, 64)])
def test_equals_plain_counting(spark, shard, least, bits):
    rows = table(random.Random(shard), 120)
    assert result(spark, rows, shard=shard, least=least, bits=bits)  # few bits: chance hits == plain(rows, least)


def test_limit_and_tables_without_phrases(spark):
    rows = table(random.Random(9), 80)
    assert result(spark, rows, least=4, most=3) == plain(rows, 4, most=3)
    assert result(spark, rows, least=10_000) == []
    assert result(spark, [], least=1) == []


def test_long_texts_without_breaks(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["p", "q", "r s t", "u"]) for _ in range(30_000))
    rows = [(text, "en"), ("y" * 3_000_000 + " p q", "en")]
    assert result(spark, rows, shard=10_000) == plain(rows, 100)


def test_both_directions_meet():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 400).astype(np.int32)
    joined = (ids[:-1] > 0) & (ids[1:] > 0)
    found = collocations.build(*collocations.chained(ids, np.zeros(400, bool), joined, 2), 5)
    prefix, suffix, count = collocations.grow(np.array([10, 20, 30], np.uint64), *found, [], 2)
    want = Counter((10 * int(a), 10 * int(b)) for a, b in zip(ids, ids[1:], strict=False) if a and b)
    assert Counter({(int(p), int(s)): int(c) for p, s, c in zip(prefix, suffix, count, strict=True)}) == want


def drawn(words, size, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 1 << 64, words, np.uint64)
    return ids, rng.integers(0, words + 1, size).astype(np.int32), rng.random(size) < 0.1


def counted(ids, text, alien, length):
    name, there = collocations.windows(ids, text, [np.full(1, 255, np.uint8)] * (length - 2), length)
    return Counter(name[there & ~alien[: len(name)]].tolist())


def test_places_are_sent_packed_and_summed_over_tasks():
    tasks = [drawn(3000, 150_000, 7), drawn(3000, 100_000, 7)]  # the same words
    sent = [list(collocations._places(iter([t]), [], 2)) for t in tasks]
    want = Counter()
    for task, batches in zip(tasks, sent, strict=True):
        found = counted(*task, 2)
        for k, n in found.items():
            want[k & 0xFFFFFFFF] += n
        # no row and no more than four bytes for a pair, however many there are
        assert sum(b.num_rows for b in batches) <= 1 << collocations.PARTS
        assert sum(b.column(c).nbytes for b in batches for c in (1, 2)) < 4.5 * len(found)
    rows = collocations.pa.Table.from_batches([b for batches in sent for b in batches])
    got = set()
    for part in set(rows["part"].to_pylist()):
        one = rows.filter(collocations.pa.compute.equal(rows["part"], part))
        got |= set(collocations._likely(one, 2)["id"].to_pylist())
    assert got == {k for k, n in want.items() if n >= 2}


def test_windows_and_transforms_name_the_same_phrases():
    ids, text, alien = drawn(4, 500, 3)
    kept = [np.full(1, 255, np.uint8)] * 4
    found = collocations.levels(ids, *collocations.build(text, alien, 5), kept, 5)
    for length, (prefix, suffix, count) in enumerate(found, 2):
        name = collocations._turned(prefix, collocations.TURNS[length - 2]) ^ suffix
        assert Counter(dict(zip(name.tolist(), count.tolist(), strict=True))) == counted(ids, text, alien, length)


def test_phrases_meet_over_tasks():
    ids, text, alien = drawn(5, 400, 5)
    kept = [np.full(1, 255, np.uint8)] * 2
    batches = [b for _ in range(2) for b in collocations._phrases(iter([(ids, text, alien)] * 2), kept, 3)]
    rows = collocations.pa.Table.from_batches(batches)
    got = {}
    for part in set(rows["part"].to_pylist()):
        one = rows.filter(collocations.pa.compute.equal(rows["part"], part))
        got |= {(r["length"], r["prefix"], r["suffix"]): r["f"] for r in collocations._frequent(one, 8).to_pylist()}
    want = {}
    for length, found in enumerate(collocations.levels(ids, *collocations.build(text, alien, 3), kept, 3), 2):
        for prefix, suffix, n in zip(*(x.view(np.int64).tolist() for x in found), strict=True):
            if 4 * n >= 8:
                want[length, prefix, suffix] = 4 * n
    assert got == want


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, 5], np.int64)
    parts = collocations.packed(values, np.array([0, 3, 3, 8, 9]))
    back = [collocations.unpacked(np.frombuffer(x.as_buffer(), np.uint8)).tolist() for x in parts]
    assert back == [[0, 1, 127], [], [128, 300, 16383, 16384, 1 << 40], [5]]
    assert len(collocations.packed(values[:0], np.zeros(1, np.int64))) == 0
