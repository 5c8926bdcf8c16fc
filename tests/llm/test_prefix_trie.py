"""The prefix trie against a trie of dictionaries."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from calltally.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, words int"


def words_of(text):
    out = [""]
    for c in text:
        out = [*out, ""] if c in " \t\n\r\x0b\x0c" else [*out[:-1], out[-1] + c]
    return sum(1 for w in out if w)


def plain_rebuilt(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        base = convs.get(c - int(math.fmod(c, 20)), []) if c is not None else []  # % as in SQL
        out[c] = base[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted((c for c in m if len(convs[c]) == len(p)), key=lambda c: (c is not None, c))
        out.append((
            least[p], len(p), least[p[:-1]] if p else None, len(m), len(children[p]), sum(not children[q] for q in under),
            sum((len(members[q]) - 1) * words_of(q[-1][1]) for q in under if q),
            hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(spark, rows, **options):
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(table), **options).collect()), key=str)


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 40, 1])
def test_equals_plain_trie(spark, block):
    rng = random.Random(block)
    said = ["", "a", "b c", "dd e\tf", "ä\nö  ü", None]
    rows = []
    for conv in range(-3, 130):
        if conv == 40:
            continue  # a first conversation that is absent
        depth = rng.choice([1, 2, 2, 3, 4, 9])
        rows += [(conv, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(said)) for t in range(depth)]
    rows += [(200 + k, t, "user", f"same {t}") for k in range(40) for t in range(5)]
    rows += [(None, 0, "user", "a"), (None, 1, "user", "b c")]
    rng.shuffle(rows)
    assert result(spark, rows, block=block) == plain_trie(plain_rebuilt(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    # 1 has h = 3 and no first conversation, so its two turns go
    assert zlib.crc32(b"1") % 4 == 3
    rows = [(1, 0, "user", "x"), (1, 1, "user", "y")]
    assert result(spark, rows) == plain_trie(plain_rebuilt(rows))
    assert result(spark, []) == []


def test_long_conversation_and_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(1000 + 20 * k, t, "user", f"t{t}") for k in range(30) for t in range(3)]
    rows += [(20 * 900, t, "user", f"t{t} long") for t in range(3000)]
    found = result(spark, rows, block=500)
    assert len(found) == 1 + 3 + 3000
    assert max(r[1] for r in found) == 3000
    ids = ",".join(str(1000 + 20 * k) for k in range(30))
    assert [r for r in found if r[1] == 3 and r[3] == 30][0][7] == hashlib.sha256(ids.encode()).hexdigest()


def test_sparse_table_answers_every_stretch():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 6, 70)
    table = prefix_trie.RangeMin(values)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(70), np.arange(1, 71)))
    a, b = a[a < b], b[a < b]
    assert (table.within(a, b) == [values[i:j].min() for i, j in zip(a, b, strict=True)]).all()
    at, depth = (x.ravel() for x in np.meshgrid(np.arange(70), np.arange(7)))
    for i, d, low, high in zip(at, depth, table.left(at, depth), table.right(at, depth), strict=True):
        while i > low:
            assert values[i] >= d
            i -= 1
        assert low == 0 or values[low] < d
        assert high == 69 or values[high + 1] < d
