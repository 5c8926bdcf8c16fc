"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document is cut into pieces whose lengths are reciprocal shares of the capacity: capacity // k for
some k. The longest such length that fits is taken again and again, which leaves at most a handful of
pieces after the full sequences. A piece of class k goes to a bin that takes exactly k of them, so a
bin is full by its count alone: no bin is ever searched for, and every task fills bins on its own.

Tasks number their pieces per class; the counts per task and class (a table that grows with tasks and
classes, not with pieces) turn these into numbers over all tasks, so a class leaves one unfinished
bin in all, and not one per task. Those last bins hold fewer than `classes * capacity` pieces however
large the input is; they are filled first-fit by decreasing length in one task.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calltally.llm.common import slices
from calltally.session import cut_lineage

PIECES = "key {}, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, number long"


def _bytes_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Ids of a text under a byte-level BPE file.

    The file's ranks and merges are one order, so a rank-based encoder gives the same ids several
    times faster; a text that it can't take (its pattern gives up on very long runs of white space)
    goes to the file's own library.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    stands = _bytes_of()
    ranks = {bytes(stands[c] for c in word): rank for word, rank in whole["model"]["vocab"].items() if word not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # large, and hardly ever needed

    def ids(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except Exception:  # the pattern engine's own limit; the other library has none
            return slow().encode(text, add_special_tokens=False).ids

    return ids


@lru_cache(maxsize=1 << 14)
def cuts(tokens: int, capacity: int) -> tuple[int, ...]:
    """Lengths that a rest of `tokens` below the capacity is cut into: each the longest capacity // k that fits."""
    out = []
    while tokens:
        out.append(capacity // (capacity // (tokens + 1) + 1))
        tokens -= out[-1]
    return tuple(out)


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document, numbered per task and class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(path), TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        for batch in slices(batches):
            columns: list[list[int]] = [[] for _ in range(7)]
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(value or ""), end_id], "<u4")
                total = len(ids)
                start = 0
                for length in [capacity] * (total // capacity) + list(cuts(total % capacity, capacity)):
                    share = capacity // length
                    number = numbers.get(share, 0)
                    numbers[share] = number + 1
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, x in zip(columns, (row, start, length, crc, total, share, number), strict=True):
                        column.append(x)
                    start += length
            row, start_, length_, crc_, total_, share_, number_ = columns
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(start_, pa.int64()),
                    pa.array(length_, pa.int64()), pa.array(crc_, pa.int64()), pa.array(total_, pa.int64()),
                    pa.array(share_, pa.int32()), pa.array([task] * len(row), pa.int32()), pa.array(number_, pa.int64()),
                ],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "number"],
            )

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(cut, PIECES.format(chosen.schema["key"].dataType.simpleString()))


def _first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins for the pieces that fill none of their own class, by decreasing length."""
    rows = rows.sort_values(["length", "task", "number"], ascending=[False, True, True])
    fill: list[int] = []
    bins, offsets = [], []
    for length in rows["length"].tolist():
        at = next((k for k, used in enumerate(fill) if used + length <= capacity), len(fill))
        if at == len(fill):
            fill.append(0)
        bins.append(at)
        offsets.append(fill[at])
        fill[at] += length
    return rows.assign(sequence_id=np.array(bins, np.int64) * (capacity + 1), offset=np.array(offsets, np.int64))


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece and its place.

    Ids are those of the tokenizer file at `path` without special tokens added, then `end_id`. A null
    or empty text is `end_id` alone. An empty table gives no rows; a repeated key is packed each time.
    Sequence ids are unique, not consecutive: bin times (capacity + 1) plus class, class 0 for bins of
    mixed lengths.
    """
    cut = cut_lineage(pieces(docs, key, text, path, capacity, end_id))
    up_to = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("class")
    counts = (
        cut.groupBy("class", "task").agg(F.count("*").alias("n"))
        .select(
            "class", "task", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"),
            F.sum("n").over(every).alias("all"),
        )
    )
    numbered = cut.join(counts, ["class", "task"]).withColumn("number", F.col("number") + F.col("before"))
    share = F.col("class")
    full = F.col("number") < F.expr("all - all % class")
    columns = [F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    done = numbered.where(full).withColumns({
        "sequence_id": F.expr("number div class") * (capacity + 1) + share,
        "offset": (F.col("number") % share) * F.col("length"),
    })
    rest = numbered.where(~full).drop("before", "all", "class")
    kind = rest.schema["key"].dataType.simpleString()
    mixed = rest.groupBy().applyInPandas(
        lambda rows: _first_fit(rows, capacity)[
            ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        ],
        f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return done.select(*columns).unionAll(mixed.select(*columns))
