"""Removal of repeated strings against counting every string."""

import collections
import random

import numpy as np
import pytest

from calltally.llm import suffix_dedup


def plain_removed(texts, length):
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("length", [1, 2, 8, 9, 16, 31])
def test_expansion_marks_repeated_strings(length):
    rng = random.Random(length)
    for _ in range(40):
        base = bytes(rng.choice(b"ab\x00\xfe") for _ in range(60))
        segments = []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(40)
            segments.append(base[a : a + length + rng.randrange(30)] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(12))))
        segments = list(dict.fromkeys(s for s in segments if len(s) >= length))
        copies = [rng.choice([1, 1, 2, 5]) for _ in segments]
        count = collections.Counter()
        for s, n in zip(segments, copies, strict=True):
            count.update({w: m * min(n, 2) for w, m in collections.Counter(s[k : k + length] for k in range(len(s) - length + 1)).items()})
        want = [[count[s[k : k + length]] > 1 for k in range(len(s) - length + 1)] for s in segments]
        assert [x.tolist() for x in suffix_dedup.repeated(segments, np.array(copies), length)] == want


def test_every_start_is_in_one_segment_with_one_anchor_for_equal_strings(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcd ") for _ in range(260))
    texts = [b"", b"short", shared, b"xy" + shared + b"zz", b"a" * 900, shared * 4]
    anchor_of, starts = {}, collections.Counter()
    for raw, ends, where in suffix_dedup._parts(texts, 200):
        begins = [0, *ends.tolist()]
        for lo, n, anchor, h in zip(*(x.tolist() for x in suffix_dedup.anchors(raw, ends, 200)), strict=True):
            part = next(k for k, e in enumerate(ends.tolist()) if lo < e)
            text, offset = where[part]
            for k in range(lo, lo + n):
                starts[text, k - begins[part] + offset] += 1
                assert anchor_of.setdefault(raw[k : k + 200], (h, anchor - k)) == (h, anchor - k)
    assert starts == {(i, k): 1 for i, t in enumerate(texts) for k in range(len(t) - 199)}


def documents(seed):
    rng = random.Random(seed)

    def prose(n):
        return " ".join(rng.choice(["lorem", "ipsum", "dolor", "été", "größe", "x"]) + str(rng.randrange(900)) for _ in range(n))

    passage, line = prose(60), prose(30)
    texts = [prose(80), None, "", "short", passage, passage, line * 8, "a" * 700]
    texts += [prose(rng.randrange(1, 30)) + passage + prose(rng.randrange(1, 30)) for _ in range(12)]
    texts += [prose(10) + passage[rng.randrange(80) : 230 + rng.randrange(60)] + prose(5) for _ in range(6)]
    return [*texts, texts[0]]


@pytest.mark.parametrize("crowded", [2000, 3])
def test_remove_against_counting(spark, crowded, monkeypatch):
    texts = documents(crowded)
    rows = [(k * 3, t, "n", None) for k, t in enumerate(texts)] + [(None, "lost", "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, start int")
    got = {r["key"]: r for r in suffix_dedup.remove(docs, length=200, crowded=crowded).collect()}
    raw = [(t or "").encode() for t in texts]
    assert len(got) == len(texts)
    for k, (text, gone) in enumerate(zip(raw, plain_removed(raw, 200), strict=True)):
        row = got[k * 3]
        assert row["n_bytes"] == len(text)
        assert bytes(row["kept"]) == bytes(b for b, g in zip(text, gone, strict=True) if not g)
        mask = bytearray(len(text))
        for span in row["spans"]:
            mask[span["from"] : span["to"]] = b"\x01" * (span["to"] - span["from"])
        assert bytes(mask) == gone
        assert all(a["to"] < b["from"] for a, b in zip(row["spans"], row["spans"][1:], strict=False))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove(docs).count() == 0
