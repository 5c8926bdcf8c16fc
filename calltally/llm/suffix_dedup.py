"""Removal of repeated byte strings by bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if some string of `length` bytes that covers it also starts anywhere else. To find these
strings without a transform over the whole corpus, every string is dealt by its content: its anchor is
the leftmost place of the smallest hash among its `GRAM`-byte grams, so equal strings have equal
anchors at equal offsets. Neighbouring strings mostly share their anchor; such a run of starts is a
segment, and each start lies in exactly one. Segments whose anchor hash occurs once are dropped, equal
segments become one with a count, and those of one hash come together in one task. There the
transform of the segments is extended backwards breadth first: ranks are split into intervals by
their first symbols, and one step adds symbols in front of all intervals at once through the
transform, which gives the boundaries whose common prefix is the next larger value. The search stops
at `length`; intervals that are left then and hold two or more occurrences, each rank counting as
often as its segment has copies, are the repeated strings.

A hash with more than `CROWDED` different segments (a passage that very many documents share in
different surroundings) is dealt anew by smaller runs of starts and the bytes that all strings of the
run share, in the end by whole strings, which leave one member to a group. So no group grows with the
corpus. Texts are moved by document id only, and only once; copies travel as digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltally.llm.common import Rolling, slices
from calltally.session import cut_lineage, scratch_path

GRAM = 40
PIECE = 1 << 18  # bytes that are hashed together
BATCH = 1 << 18  # bytes of a transform; a larger group is one by itself
CROWDED = 2000
RUNS = (16, 1)  # starts of a segment when a crowded hash is dealt anew
STEP = 8
_ROLL = Rolling()
_PLACE_BITS = np.uint64(20)


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def anchors(raw: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, count, anchor, hash) of the segments of texts that lie one after the other in `raw`."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(np.uint64)
    h = _ROLL.windows(_ROLL.prefix(np.frombuffer(raw, np.uint8)), GRAM)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    anchor = (key & low).astype(np.int64)
    start = np.arange(len(anchor))
    owner = np.searchsorted(ends, start, side="right")
    valid = start + length <= ends[owner]
    begins = valid & np.concatenate(([True], ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    lo = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(np.diff(valid.astype(np.int8)) == -1) + 1, len(valid))
    hi = np.minimum(np.append(lo[1:], len(valid)), stops[np.searchsorted(stops, lo, side="right")])
    return lo, hi - lo, anchor[lo], h[anchor[lo]]


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """Texts joined to pieces; of each the ends, and (text, offset) of what lies there.

    A long text is cut so that its parts overlap by length - 1 bytes: each start is in one part.
    """
    held, where, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            held.append(part)
            where.append((k, at))
            size += len(part)
            if size >= PIECE:
                yield b"".join(held), np.cumsum([len(x) for x in held]), where
                held, where, size = [], [], 0
    if held:
        yield b"".join(held), np.cumsum([len(x) for x in held]), where


def repeated(segments: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, whether the string of `length` bytes at each start occurs again in them.

    Byte 255, which UTF-8 never has, stands between segments. A rank counts as often as its segment
    has copies, so an interval of one rank can be repeated too.
    """
    if not segments:
        return []
    raw = b"\xff" + b"\xff".join(segments) + b"\xff"
    n = len(raw)
    padded = raw + b"\xff" * (2 * length + 2 * STEP)
    first = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    suffix = np.argsort(first)
    sorted_first = first[suffix]
    new = np.concatenate(([True], sorted_first[1:] != sorted_first[:-1]))
    rank = np.empty(n + length + STEP, np.uint64)
    rank[n:] = n  # beyond the end only separators follow
    rank[suffix] = np.cumsum(new) - 1
    sorted_to = STEP
    while sorted_to < length and not new.all():
        # within runs of equal ranks only: order by the rank of what follows
        key = (rank[:n] << np.uint64(32)) | rank[sorted_to : n + sorted_to]
        open_ = ~(new & np.append(new[1:], True))
        at = np.flatnonzero(open_)
        members = suffix[at]
        values = key[members]
        arranged = np.argsort(values)
        suffix[at] = members[arranged]
        values = values[arranged]
        changed = np.concatenate(([True], values[1:] != values[:-1]))
        new[at] |= changed
        rank[suffix] = np.cumsum(new) - 1
        sorted_to *= 2
    # the transform, and the rank that follows each rank: symbols in front, in stable order
    text = np.frombuffer(raw, np.uint8)
    transform = text[suffix - 1]
    follow = np.argsort(transform, kind="stable")
    cut = np.empty(n, bool)
    cut[0] = True
    symbol = transform[follow]
    cut[1:] = symbol[1:] != symbol[:-1]
    inner = np.flatnonzero(~cut)
    far = follow
    for _ in range(STEP.bit_length() - 1):
        far = far[far]
    depth = 1
    while depth < length and len(inner):
        # a boundary of a value up to depth is known: put one symbol, or STEP of them, in front of all
        stride, ahead = (STEP, far) if STEP <= depth <= length - STEP else (1, follow)
        between = np.cumsum(cut, dtype=np.int32)
        split = between[ahead[inner]] != between[ahead[inner - 1]]
        cut[inner[split]] = True
        inner = inner[~split]
        depth += stride
    again = np.zeros(n, bool)
    again[inner] = True
    again[inner - 1] = True
    found = np.zeros(n, bool)
    found[suffix] = again
    out, at = [], 1
    for segment, count in zip(segments, copies, strict=True):
        out.append(found[at : at + len(segment) - length + 1] | (count > 1))
        at += len(segment) + 1
    return out


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2].tolist(), edges[1::2].tolist()


def _segments_of(docs: DataFrame, length: int, digests: bool) -> DataFrame:
    """Segments of every text: anchor hash, and if wanted key, start, count, anchor and digest."""
    kind = docs.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for raw, ends, where in _parts(texts, length):
                lo, count, anchor, h = anchors(raw, ends, length)
                if not digests:
                    yield pa.record_batch([pa.array(h.view(np.int64))], names=["hash"])
                    continue
                part = np.searchsorted(ends, lo, side="right")
                begin = np.concatenate(([0], ends[:-1]))[part]
                text, offset = (np.array(x, np.int64)[part] for x in zip(*where, strict=True))
                stops = (lo + count + length - 1).tolist()
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(text)), pa.array(lo - begin + offset),
                        pa.array(count.astype(np.int32)), pa.array((anchor - lo).astype(np.int32)),
                        pa.array(h.view(np.int64)),
                        pa.array([_digest(raw[a:b]) for a, b in zip(lo.tolist(), stops, strict=True)], pa.binary()),
                    ],
                    names=["key", "start", "count", "anchor", "hash", "digest"],
                )

    if not digests:
        return docs.mapInArrow(scan, "hash long")
    return docs.mapInArrow(scan, f"key {kind}, start long, count int, anchor int, hash long, digest binary")


def _expand(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(digest, from, to): runs of repeated starts, from rows (hash, digest, body, copies) in order of hash."""
    held: list[tuple[bytes, bytes, int]] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        found = repeated([b for _, b, _ in held], np.array([c for _, _, c in held]), length)
        names, lows, highs = [], [], []
        for (digest, _, _), flags in zip(held, found, strict=True):
            a, b = _runs(flags)
            names += [digest] * len(a)
            lows += a
            highs += b
        return pa.record_batch(
            [pa.array(names, pa.binary()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())],
            names=["digest", "from", "to"],
        )

    for batch in slices(batches):
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for h, digest, body, copies in zip(*columns, strict=True):
            if h != last and size >= BATCH:
                yield flush()
                held, size = [], 0
            held.append((digest, body, copies))
            size += len(body)
            last = h
    if held:
        yield flush()


def _pieces(batches: Iterator[pa.RecordBatch], length: int, run: int) -> Iterator[pa.RecordBatch]:
    """Segments of crowded hashes cut at every `run`-th start before the anchor, dealt by what the run shares."""
    for batch in slices(batches):
        rows = []
        for h, digest, body, copies, anchor in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            starts = len(body) - length + 1
            for turn in range(max(0, anchor - starts + 1) // run, anchor // run + 1):
                low, high = max(0, anchor - turn * run - run + 1), min(starts - 1, anchor - turn * run)
                if low > high:
                    continue
                shared = body[anchor - turn * run : anchor - turn * run - run + 1 + length]
                key = int.from_bytes(_digest(shared + b"%d %d" % (h, turn))[:8], "little", signed=True)
                own = body[low : high + length]
                rows.append((digest, low, key, _digest(own), own, copies, anchor - low))
        if rows:
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
            yield pa.record_batch(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["whole", "shift", "hash", "digest", "body", "copies", "anchor"],
            )


def _resolve(segments: DataFrame, length: int, crowded: int, runs: tuple[int, ...], busy: bool) -> DataFrame:
    """(digest, from, to): runs of repeated starts of distinct segments.

    `segments` has hash, digest, body, copies, anchor and members, the number of segments of the hash;
    busy: whether any hash may have more than `crowded` of them.
    """
    calm = segments.where(F.col("members") <= crowded) if busy and runs else segments
    found = (
        calm.select("hash", "digest", "body", "copies").repartition("hash").sortWithinPartitions("hash")
        .mapInArrow(lambda batches: _expand(batches, length), "digest binary, `from` int, `to` int")
    )
    if not busy or not runs:
        return found
    pieces = (
        segments.where(F.col("members") > crowded).select("hash", "digest", "body", "copies", "anchor")
        .mapInArrow(
            lambda batches: _pieces(batches, length, runs[0]),
            "whole binary, shift int, hash long, digest binary, body binary, copies long, anchor int",
        )
    )
    distinct = pieces.groupBy("hash", "digest", "body", "anchor").agg(F.sum("copies").alias("copies"))
    sizes = distinct.groupBy("hash").agg(F.count("*").alias("members"), F.sum("copies").alias("all"))
    inner = _resolve(
        distinct.join(sizes.where("all > 1").drop("all"), "hash"), length, crowded, runs[1:], True
    )
    back = pieces.select("whole", "shift", "digest").join(inner, "digest")
    return found.unionAll(
        back.select(
            F.col("whole").alias("digest"), (F.col("from") + F.col("shift")).alias("from"),
            (F.col("to") + F.col("shift")).alias("to"),
        )
    )


def _bodies(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that each text stands for, from rows (text, segments)."""
    for batch in slices(batches):
        rows = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in wanted:
                body = text[x["start"] : x["start"] + x["count"] + length - 1]
                rows.append((x["hash"], x["digest"], body, x["copies"], x["anchor"], x["members"]))
        if rows:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["hash", "digest", "body", "copies", "anchor", "members"],
            )


def spans(covers: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["from"], min(x["to"], size)) for x in covers):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, removed, kept = [], [], []
        for text, covers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = text or b""
            gone = spans(covers or [], len(text))
            sizes.append(len(text))
            removed.append([{"from": a, "to": b} for a, b in gone])
            edges = [0, *(x for span in gone for x in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        yield pa.record_batch(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())],
            names=["key", "n_bytes", "spans", "kept"],
        )


def remove(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, crowded: int = CROWDED
) -> DataFrame:
    """(key, n_bytes, spans, kept): the removed runs of each text's UTF-8 bytes, and the bytes that stay.

    `key` is distinct; rows with a null key are left out. Null texts count as empty; texts under
    `length` bytes stay whole. Every other copy of a text counts, the first included, so equal texts of
    `length` bytes or more go altogether. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where("key is not null")
    # stored, as are the sizes below, so that adaptive execution can split a hash with very many segments
    again = cut_lineage(_segments_of(texts, length, False).groupBy("hash").count().where("count > 1").select("hash"))
    path = scratch_path(spark, "segments")
    _segments_of(texts, length, True).join(again, "hash").write.parquet(path)
    found = spark.read.parquet(path)
    distinct = found.groupBy("hash", "digest", "count", "anchor").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "start")).alias("first")
    )
    sizes = cut_lineage(distinct.groupBy("hash").agg(F.count("*").alias("members")))
    busy = not sizes.where(F.col("members") > crowded).isEmpty()
    wanted = distinct.join(sizes, "hash").groupBy(F.col("first.key").alias("key")).agg(
        F.collect_list(
            F.struct("hash", "digest", F.col("first.start").alias("start"), "count", "anchor", "copies", "members")
        ).alias("segments")
    )
    segments = texts.join(wanted, "key").select("text", "segments").mapInArrow(
        lambda batches: _bodies(batches, length),
        "hash long, digest binary, body binary, copies long, anchor int, members long",
    )
    ranges = _resolve(segments, length, crowded, RUNS, busy)
    covers = (
        found.select("key", "start", "digest").join(ranges, "digest")
        .select("key", F.struct(
            (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + (length - 1)).alias("to")
        ).alias("cover"))
        .groupBy("key").agg(F.collect_list("cover").alias("covers"))
    )
    kind = texts.schema["key"].dataType.simpleString()
    return texts.join(covers, "key", "left").mapInArrow(
        _cut, f"key {kind}, n_bytes long, spans array<struct<`from`: long, `to`: long>>, kept binary"
    )
