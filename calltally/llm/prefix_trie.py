"""The trie of conversation prefixes, from member intervals in sorted order.

Conversations are sequences of turns. Distinct sequences are sorted, and each keeps the number of
turns it shares with the one before it (its LCP). The conversations that start with a prefix are
neighbours then: from any one of them, the interval reaches left and right as long as no LCP on the
way is below the depth of the prefix. A sparse table answers the smallest LCP of any stretch, so each
candidate prefix searches its two ends by itself, and no stack is kept.

Sorted sequences are spread by range and worked on in blocks of bounded size. A prefix that begins and
ends inside its block is done. One that reaches the edge of a block gives a partial row there; these,
at most one a depth and block edge, are added up afterwards. A sequence that very many conversations
have is one row with a count, and a turn that very many start with is split among blocks like any
other, so no task holds more than its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltally.llm.common import mixed
from calltally.session import cut_lineage, scratch_path

BLOCK = 1 << 17  # turns of a block
PIECE = 4096  # ids that are joined to one string before they are hashed
DIGITS = 32
NOBODY = hashlib.sha256(b"").hexdigest()
_NO_ID = np.iinfo(np.int64).max
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NODE = (
    "h1 long, h2 long, depth long, p1 long, p2 long, first long, parent_first long, n long, children long, "
    "leaves long, saved long, sequence string, complete boolean, placed boolean"
)


class RangeMin:
    """Smallest value of any stretch of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def within(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Smallest of values[start:end]; no stretch is empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            row = self.levels[k]
            out[at] = np.minimum(row[start[at]], row[end[at] - (1 << int(k))])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last place that `at` reaches over values of `depth` or more, each standing before its place."""
        end, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            row, step = self.levels[k], 1 << k
            fits = end + step < n
            fits[fits] = row[end[fits] + 1] >= depth[fits]
            end[fits] += step
        return end

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First place that reaches `at` in the same way."""
        start = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row, step = self.levels[k], 1 << k
            fits = start - step >= 0
            fits[fits] = row[start[fits] - step + 1] >= depth[fits]
            start[fits] -= step
        return start


def shared_turns(a: str, b: str) -> int:
    """Leading turns that two sequences of `DIGITS`-digit turns share."""
    x, y = (np.frombuffer(s.encode(), f"S{DIGITS}") for s in (a, b))
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


def _prefix_hashes(keys: list[str], lengths: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every prefix, the empty one included, laid out by `offset`."""
    longest = int(lengths.max(initial=0))
    powers = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(longest, b, np.uint64)))) for b in _BASES]
    out = [np.zeros(int((lengths + 1).sum()), np.uint64) for _ in _BASES]
    for key, n, at in zip(keys, lengths.tolist(), offset.tolist(), strict=True):
        turns = np.frombuffer(bytes.fromhex(key), "<u8").reshape(n, 2)
        for k in range(2):
            np.cumsum(turns[:, k] * powers[k][:n], out=out[k][at + 1 : at + n + 1])
    depth = np.arange(len(out[0])) - np.repeat(offset, lengths + 1)
    return tuple(np.where(depth == 0, np.int64(0), mixed(h + depth.astype(np.uint64)).view(np.int64)) for h in out)


def block_nodes(
    keys: list[str], weights: np.ndarray, firsts: np.ndarray, words: list[list[int]], names: list[str],
    before: int, after: int,
) -> dict[str, np.ndarray | list]:
    """Nodes of a block of sorted distinct sequences, as columns of `NODE`.

    `weights` conversations have each sequence, the smallest id among them in `firsts`. `before` and
    `after` are the turns that the first and last sequence share with their neighbours outside the
    block, -1 if there are none.
    """
    n = len(keys)
    lengths = np.array([len(k) // DIGITS for k in keys], np.int64)
    offset = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    h1, h2 = _prefix_hashes(keys, lengths, offset)
    said = np.zeros(int((lengths + 1).sum()), np.int64)  # words up to each depth
    for w, at in zip(words, offset.tolist(), strict=True):
        said[at + 1 : at + len(w) + 1] = np.cumsum(np.array(w, np.int64))
    total = said[offset + lengths]
    lcp = np.array([before] + [shared_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)], np.int64)
    search, least = RangeMin(lcp), RangeMin(firsts)

    # candidates: the depths that a sequence does not share with the one before; all depths of the first
    low = lcp.copy()
    low[0] = -1
    counts = lengths - low
    place = np.concatenate(([0], np.cumsum(counts)))[:-1]
    row = np.repeat(np.arange(n), counts)
    depth = np.arange(len(row)) - np.repeat(place, counts) + low[row] + 1
    left, right = search.left(row, depth), search.right(row, depth)
    began = depth > lcp[left]
    ended = (right < n - 1) | (after < depth)
    complete = began & ended

    def over(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[end] - sums[start]

    members = over(weights, left, right + 1)
    prior = np.where(depth > 0, said[offset[row] + np.maximum(depth - 1, 0)], 0)  # words above the node
    fresh = total - said[offset + np.maximum(lcp, 0)]  # words of the nodes that begin with a sequence
    spread = np.where(began, total[left] - prior + over(fresh, left + 1, right + 1), over(fresh, left, right + 1))
    saved = over(weights * total, left, right + 1) - members * prior - spread
    leaf = np.append(lcp[1:], after) < lengths
    # the parent of each candidate, found from its own place
    up = np.maximum(depth - 1, 0)
    above = search.left(row, up)
    parent = place[above] + up - (low[above] + 1)
    children = np.bincount(parent[began & (depth > 0)], minlength=len(row))
    first = least.within(left, right + 1)
    here = offset[row] + depth
    over_here = offset[row] + up
    placed = (depth == 0) | complete[parent]
    ends = began & (depth == lengths[left])
    return {
        "h1": h1[here], "h2": h2[here], "depth": depth, "p1": h1[over_here], "p2": h2[over_here],
        "first": first, "parent_first": np.where(depth == 0, _NO_ID, first[parent]), "n": members,
        "children": children, "leaves": over(leaf.astype(np.int64), left, right + 1), "saved": saved,
        "sequence": [names[k] if e else None for k, e in zip(left.tolist(), ends.tolist(), strict=True)],
        "complete": complete, "placed": placed,
    }


def _batch(found: dict) -> pa.RecordBatch:
    columns = []
    for name, values in found.items():
        if name in ("first", "parent_first"):
            columns.append(pa.array(values, pa.int64(), mask=values == _NO_ID))
        elif name == "sequence":
            columns.append(pa.array(values, pa.string()))
        else:
            columns.append(pa.array(values))
    return pa.record_batch(columns, names=list(found))


def _nodes(batches: Iterator[pa.RecordBatch], edges: dict[int, tuple[int, int]], block: int) -> Iterator[pa.RecordBatch]:
    """Nodes of one partition, a block at a time; each block knows the sequence after it."""
    before, after = edges.get(TaskContext.get().partitionId(), (-1, -1))
    held: list[tuple] = []
    turns = 0

    def close(rows: list[tuple], start: int, end: int) -> pa.RecordBatch:
        keys, names, weights, firsts, words = (list(c) for c in zip(*rows, strict=True))
        ids = np.array([_NO_ID if f is None else f for f in firsts], np.int64)
        return _batch(block_nodes(keys, np.array(weights, np.int64), ids, words, names, start, end))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for one in zip(*(batch.slice(at, 256).column(k).to_pylist() for k in range(5)), strict=True):
                if turns >= block:
                    common = shared_turns(held[-1][0], one[0])
                    yield close(held, before, common)
                    held, turns, before = [], 0, common
                held.append(one)
                turns += len(one[4]) + 1
    if held:
        yield close(held, before, after)


def _ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last sequence of each partition, as arrays of turns."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column(0)[0].as_py() if first is None else first
            last = batch.column(0)[batch.num_rows - 1].as_py()
    if first is not None:
        cut = [[s[k : k + DIGITS] for k in range(0, len(s), DIGITS)] for s in (first, last)]
        kind = pa.list_(pa.string())
        yield pa.record_batch(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([cut[0]], kind), pa.array([cut[1]], kind)],
            names=["part", "head", "tail"],
        )


def _shared(a: str, b: str) -> Column:
    """Leading elements that two arrays share; -1 if one is null."""
    same = F.transform(F.zip_with(a, b, lambda x, y: x == y), lambda v: F.coalesce(v, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.coalesce(F.when(at == 0, F.size(a)).otherwise(at - 1), F.lit(-1)).cast("int")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to `PIECE` ids of one sequence, as one comma-joined string, from rows in order."""
    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows: list[tuple] = []
        at = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[at] or k - at == PIECE:
                rows.append((names[at], ids[at], ",".join("" if i is None else str(i) for i in ids[at:k])))
                at = k
        if rows:
            name, low, text = zip(*rows, strict=True)
            yield pa.record_batch(
                [pa.array(name, pa.string()), pa.array(low, pa.int64()), pa.array(text, pa.string())],
                names=["sequence", "low", "ids"],
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a sequence over its strings in order; only the state of the digest is held."""
    name, state = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            done: list[tuple] = []
            part = batch.slice(at, 256)
            for sequence, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if sequence != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = sequence, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["sequence", "ends_sha256"])
    if state is not None:
        yield pa.record_batch([pa.array([name]), pa.array([state.hexdigest()])], names=["sequence", "ends_sha256"])


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words): the turns of each conversation in order, as digests and word counts.

    Turns are ordered by `turn`, null first; equal ones by their digest. Null roles and texts are empty.
    Rows with a null `conv_id` are one conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): the first h turns of the first conversation of its group, then its own after h.

    h is the CRC-32 of the decimal id modulo `most`, the group's first id is conv_id - conv_id % group. A
    null id keeps its own turns.
    """
    own = cut_lineage(sequences(conversations))
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.lit(0)).cast("int")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return rows.select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
        ).alias("turns"),
    )


def trie(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix of `convs` (conv_id, turns of digest and words), the empty one included.

    conv_id is the smallest member, null if only a conversation with a null id is one. Conversations
    without turns are members of the empty prefix. Without conversations there are no rows. The turns
    of one conversation are held by one task, like a document.
    """
    spark = convs.sparkSession
    key = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    path = scratch_path(spark, "sequences")
    convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn(
        "sequence", F.md5(F.col("key").cast("binary"))
    ).write.parquet(path)
    stored = spark.read.parquet(path)
    distinct = stored.groupBy("key", "sequence").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("words").alias("words")
    )
    ordered = cut_lineage(cut_lineage(distinct).repartitionByRange("key").sortWithinPartitions("key"))
    edges = ordered.select("key").mapInArrow(_ends_of, "part int, head array<string>, tail array<string>")
    beside = Window.orderBy("part")  # one row a partition
    near = cut_lineage(edges).withColumn("prior", F.lag("tail").over(beside)).withColumn("next", F.lead("head").over(beside))
    known = {r["part"]: (r["before"], r["after"]) for r in near.select(
        "part", _shared("head", "prior").alias("before"), _shared("tail", "next").alias("after")
    ).collect()}
    path = scratch_path(spark, "trie-nodes")
    ordered.select("key", "sequence", "n", "first", "words").mapInArrow(lambda b: _nodes(b, known, block), NODE).write.parquet(path)
    found = spark.read.parquet(path)

    # prefixes that reach the edge of a block: the parts add up
    split = cut_lineage(
        found.where("not complete").groupBy("h1", "h2", "depth", "p1", "p2").agg(
            F.min("first").alias("first"), F.max("sequence").alias("sequence"),
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        )
    )
    columns = ["h1", "h2", "depth", "first", "n", "children", "leaves", "saved", "sequence"]
    parents = split.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("first").alias("parent_first"), (F.col("depth") + 1).alias("depth"))
    below = split.where("depth > 0").select("p1", "p2", *columns)
    below = below.unionByName(found.where("complete and not placed").select("p1", "p2", *columns)).join(parents, ["p1", "p2", "depth"])
    top = split.where("depth = 0").select(*columns, F.lit(None).cast("long").alias("parent_first"))
    whole = found.where("complete and placed").select(*columns, "parent_first")
    nodes = whole.unionByName(below.select(*columns, "parent_first")).unionByName(top)

    pieces = stored.select("sequence", F.col("conv_id").cast("long").alias("conv_id")).repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    pieces = cut_lineage(pieces.mapInArrow(_joined, "sequence string, low long, ids string"))
    digests = pieces.repartition("sequence").sortWithinPartitions("sequence", "low").mapInArrow(_hashed, "sequence string, ends_sha256 string")
    ending = nodes.where("sequence is not null").join(cut_lineage(digests), "sequence")
    passing = nodes.where("sequence is null").withColumn("ends_sha256", F.lit(NOBODY))
    return ending.unionByName(passing).select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
