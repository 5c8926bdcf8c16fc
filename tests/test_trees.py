"""Span trees against a plain walk to the root."""

import random
from datetime import datetime, timedelta

from calltally.operators import trees

T0 = datetime(2024, 5, 1)
SCHEMA = "id string, parent_trace_id string, start_time timestamp_ntz, end_time timestamp_ntz"


def plain(spans):
    """id → (root, depth, self, path, kind)."""
    parent = {i: p for i, p, _ in spans}
    own = {i: max(0.0, ms - sum(m for j, p, m in spans if p == i and j != i)) for i, _, ms in spans}
    out = {}
    for i in parent:
        walk, at = [], i
        while at in parent and at not in walk:
            walk.append(at)
            at = parent[at]
        if at in walk:
            out[i] = (None, None, own[i], None, "cycle")
        else:
            kind = "span" if len(walk) > 1 else "root" if parent[i] is None else "orphan"
            out[i] = (walk[-1], len(walk) - 1, own[i], sum(own[w] for w in walk), kind)
    return out


def table(spark, spans):
    rows = [(i, p, T0, T0 + timedelta(milliseconds=ms)) for i, p, ms in spans]
    return spark.createDataFrame(rows, SCHEMA)


def test_random_forest(spark):
    rng = random.Random(6)
    spans = [("r", None, 500), ("alone", "gone", 20), ("self", "self", 7), ("c1", "c3", 1), ("c2", "c1", 2), ("c3", "c2", 3), ("under", "c2", 4)]
    for k in range(150):
        spans.append((f"s{k}", rng.choice([i for i, _, _ in spans]), rng.randrange(1, 60)))
    got = {r["id"]: (r["root_id"], r["depth"], r["self_ms"], r["path_ms"], r["kind"]) for r in trees.span_paths(table(spark, spans)).collect()}
    want = plain(spans)
    assert got == want

    found = {r["root_id"]: r for r in trees.trace_trees(table(spark, spans)).collect()}
    for root in {w[0] for w in want.values()}:
        mine = {i: w for i, w in want.items() if w[0] == root}
        row = found.pop(root)
        assert (row["spans"], row["self_ms"]) == (len(mine), sum(w[2] for w in mine.values()))
        if root is None:
            assert (row["kind"], row["depth"], row["critical_ms"], row["critical_end"]) == ("cycle", None, None, None)
        else:
            longest = max(w[3] for w in mine.values())
            assert row["depth"] == max(w[1] for w in mine.values()) and row["critical_ms"] == longest
            assert row["critical_end"] == min(i for i, w in mine.items() if w[3] == longest)
            assert row["kind"] == want[root][4]
    assert not found


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    stored = []
    real = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: stored.append(1) or real(df))
    spans = [("n0", None, 1)] + [(f"n{k}", f"n{k - 1}", 1) for k in range(1, 200)]
    rows = trees.span_paths(table(spark, spans)).collect()
    assert {r["id"]: r["depth"] for r in rows} == {f"n{k}": k for k in range(200)}
    assert len(stored) <= 5 + 8  # five tables before the rounds, and 8 rounds for a depth under 256


def test_empty_and_missing_cells(spark):
    assert trees.span_paths(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trees.trace_trees(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([("a", None, None, T0), (None, "a", T0, T0), ("b", "a", T0, T0 + timedelta(seconds=1))], SCHEMA)
    got = {r["id"]: (r["depth"], r["self_ms"], r["path_ms"]) for r in trees.span_paths(rows).collect()}
    assert got == {"a": (0, 0.0, 0.0), "b": (1, 1000.0, 1000.0)}


def test_childless_spans_take_no_part_in_rounds(spark, monkeypatch):
    rounds = []
    real = trees.cut_lineage

    def stored(df):
        kept = real(df)
        if {"root", "at"} <= set(kept.columns):
            rounds.append(kept.count())
        return kept

    monkeypatch.setattr(trees, "cut_lineage", stored)
    spans = [("n0", None, 9)] + [(f"n{k}", f"n{k - 1}", 9) for k in range(1, 20)]
    spans += [(f"leaf{k}_{n}", f"n{k}", 1) for k in range(20) for n in range(6)] + [("own", "own", 3), ("below", "own", 2)]
    rows = trees.span_paths(table(spark, spans)).collect()
    assert {r["id"]: (r["root_id"], r["depth"], r["self_ms"], r["path_ms"], r["kind"]) for r in rows} == plain(spans)
    assert rounds and max(rounds) <= 20


def test_sorted_joins_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(trees, "HASHED_ROWS", 0)
    test_random_forest(spark)
