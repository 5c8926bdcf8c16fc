"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally.session import cut_lineage


class Rolling:
    """Hashes of byte ranges of an array: equal ranges have equal hashes, wherever they lie."""

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        for name, base in (("_powers", self._BASE), ("_inverse", pow(self._BASE, -1, 1 << 64))):
            have = getattr(self, name)
            while len(have) < n:
                step = np.uint64(pow(base, len(have), 1 << 64))
                have = np.concatenate((have, have * step))
            setattr(self, name, have)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._powers[: len(raw)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self._inverse[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = len(prefix) - size
        return mixed((prefix[size:] - prefix[:n]) * self._inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """The same values spread over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(texts: Iterable, limit: int = 1 << 20) -> Iterator[list]:
    """Lists of neighbouring texts of about `limit` characters, so that arrays over them stay small."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_slices(values: pa.Array, function, kind: pa.DataType, rows: int = 256) -> pa.Array:
    """One array of what `function` makes of each slice's Python values."""
    parts = [pa.array(function(values.slice(at, rows).to_pylist()), kind) for at in range(0, len(values), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def columns(docs: DataFrame) -> list:
    """All columns by quoted name, so that a dot in a name is no field access."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in docs.columns]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of `edges` (a, b).

    Large-star and small-star steps until nothing changes. Every step folds neighbours to their
    smallest one and stores that before it joins, so that adaptive execution can split the links of a
    node that has very many: an aggregate right below a join would keep them in one task. The number
    of rows stays that of the edges. Null ends are ignored; an empty table gives none.
    """
    pairs = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    before = None
    while True:
        # large star: every larger neighbour of a node links to the smallest of its neighbourhood
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # small star: smaller neighbours, and the node itself, link to the smallest
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = cut_lineage(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        )
        now = pairs.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(pairs.select("v", "v")).distinct()
