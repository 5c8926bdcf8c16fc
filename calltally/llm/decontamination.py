"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Items are cut into overlapping passages. A passage of m bytes that occurs with at most e edits shares
m - q + 1 - q*e q-grams with the place, and their diagonals (place in the text minus place in the
passage) lie within e of each other. So the shared q-grams are counted in diagonal bands of 2(e + 1)
that overlap by half; only bands with enough of them are kept, and an alignment restricted to the
band decides. The filter loses no occurrence within the budget, so a verbatim stretch of 74 bytes of an
item is found wherever it begins: passages have 50 bytes and start at every 25.

Texts are compared as UTF-8 bytes with A-Z in lower case and white space as blanks, which keeps
offsets. Passages are sent to the tasks in blocks of bounded size; every block is matched against all
documents where these lie, so documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltally.llm.common import chunks, slices

Q = 8  # a q-gram is read as one 64-bit number
SPAN = 50  # any SPAN + SPAN // 2 - 1 bytes of an item hold a whole passage
SHORTEST = 32
ERRORS = 0.08
BLOCK_BYTES = 8 << 20
HITS = 1 << 21
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def folded(text: bytes | None) -> bytes:
    return (text or b"").translate(_FOLD)


def budget(length: int) -> int:
    """Edits allowed in a passage: the rate, and few enough that the lemma asks for a q-gram."""
    return min(int(ERRORS * length), (length - Q) // Q)


def _grams(raw: bytes) -> np.ndarray:
    n = max(0, len(raw) - Q + 1)
    return np.ndarray((n,), "<u8", raw, strides=(1,)).astype(np.uint64) if n else np.zeros(0, np.uint64)


def _slot(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


@dataclass
class Index:
    """Passages and where each of their q-grams occurs."""

    passages: list[bytes]
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram in the two below
    passage: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(passages: list[bytes]) -> Index:
        grams = [_grams(p) for p in passages]
        value = np.concatenate(grams)
        passage = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])
        order = np.argsort(value, kind="stable")
        distinct, first = np.unique(value[order], return_index=True)
        return Index(passages, distinct, np.append(first, len(value)), passage[order], offset[order])


def _present(index: Index) -> np.ndarray:
    seen = np.zeros(1 << 22, bool)
    seen[_slot(index.grams)] = True
    return seen


def _candidates(raw: bytes, owner_end: np.ndarray, index: Index, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, passage, band): bands that hold as many shared q-grams as the lemma asks for."""
    value = _grams(raw)
    at = np.flatnonzero(seen[_slot(value)])
    value = value[at]
    place = np.searchsorted(index.grams, value)
    place[place == len(index.grams)] = 0
    hit = index.grams[place] == value
    at, place = at[hit], place[hit]
    owner = np.searchsorted(owner_end, at, side="right")
    whole = at + Q <= owner_end[owner]  # not across the end of a text
    at, place, owner = at[whole], place[whole], owner[whole]
    many = index.first[place + 1] - index.first[place]
    lengths = np.array([len(p) for p in index.passages])
    edits = np.minimum((ERRORS * lengths).astype(np.int64), (lengths - Q) // Q)
    width = edits + 1
    needed = lengths - Q + 1 - Q * edits
    # the band numbers of a text and passage are made non-negative and unique by a common stride
    stride = len(raw) + int(lengths.max()) + 2
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), HITS)) if many.sum() else []
    for a, b in zip(cuts, [*cuts[1:], len(many)], strict=False):
        n = many[a:b]
        entry = np.repeat(index.first[place[a:b]] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        passage, spot = index.passage[entry].astype(np.int64), np.repeat(at[a:b], n)
        band = (spot - index.offset[entry] + lengths.max()) // width[passage]
        group = np.repeat(owner[a:b], n) * len(lengths) + passage
        key = np.concatenate((group * stride + band, group * stride + band - 1))
        key, count = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(count)
        if len(keys) > 64:
            keys, counts = _folded_counts(keys, counts)
    keys, counts = _folded_counts(keys, counts)
    key, count = keys[0], counts[0]
    group, band = key // stride, key % stride
    passage = group % len(lengths)
    keep = count >= needed[passage]
    return group[keep] // len(lengths), passage[keep], band[keep] * width[passage[keep]] - lengths.max()


def _folded_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list, list]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return [key], [np.bincount(inverse, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)]


def align(passages: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of each passage (c, m) to a stretch of its text (c, m + w), and that stretch.

    Row i of the table holds the w places i .. i + w - 1 of the text, which is the band; -1 in a text
    never matches. Start and end in the text are free. Returns distance, start and end in the text.
    """
    count, m = passages.shape
    w = texts.shape[1] - m
    at = np.arange(w)
    cost = np.zeros((count, w), np.int32)  # passage prefix of 0 bytes, text prefix of `at` bytes
    start = np.broadcast_to(at, (count, w)).copy()
    big = np.int32(1 << 20)
    for i in range(m):
        same = cost + (texts[:, i : i + w] != passages[:, i : i + 1])
        skip = np.concatenate((cost[:, 1:] + 1, np.full((count, 1), big, np.int32)), 1)
        from_skip = np.concatenate((start[:, 1:], start[:, -1:]), 1)
        best = np.minimum(same, skip)
        origin = np.where(same <= skip, start, from_skip)
        slope = (best - at).astype(np.int64) * w + at  # ties: the earliest
        lowest = np.minimum.accumulate(slope, axis=1)
        source = lowest % w
        cost = (lowest // w + at).astype(np.int32)
        start = np.take_along_axis(origin, source, 1)
    last = cost.argmin(1)
    rows = np.arange(count)
    return cost[rows, last], start[rows, last], m + last


def search(texts: list[bytes], index: Index, seen: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, passage, start, end, edits) of the occurrences within the budget, once per band."""
    raw = b"".join(texts)
    if len(raw) < Q:
        return
    end = np.cumsum([len(t) for t in texts])
    owner, passage, low = _candidates(raw, end, index, seen)
    lengths = np.array([len(p) for p in index.passages])
    for m in np.unique(lengths[passage]):
        for part in np.array_split(of := np.flatnonzero(lengths[passage] == m), -(-len(of) // 2048)):
            w = 2 * (budget(int(m)) + 1)
            begin = np.concatenate(([0], end[:-1]))[owner[part]]
            spots = (low[part])[:, None] + np.arange(m + w)
            inside = (spots >= begin[:, None]) & (spots < end[owner[part]][:, None])
            flat = np.frombuffer(raw, np.uint8)
            windows = np.where(inside, flat[np.clip(spots, 0, len(raw) - 1)], -1).astype(np.int16)
            wanted = np.stack([np.frombuffer(index.passages[p], np.uint8) for p in passage[part]]).astype(np.int16)
            cost, first, last = align(wanted, windows)
            for k in np.flatnonzero(cost <= budget(int(m))):
                shift = int(low[part][k] - begin[k])
                size = int(end[owner[part][k]] - begin[k])
                yield (
                    int(owner[part][k]), int(passage[part][k]),
                    min(max(0, int(first[k]) + shift), size), min(max(0, int(last[k]) + shift), size), int(cost[k]),
                )


def passages(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, at, body): folded passages of `SPAN` bytes at every half span, the last one ending with its item.

    Items of at most one span are one passage. Items under `SHORTEST` bytes, empty or null have none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, body = [], [], []
            for k, item in enumerate(batch.column(1).to_pylist()):
                whole = folded(item)
                if len(whole) < SHORTEST:
                    continue
                last = max(0, len(whole) - SPAN)
                for begin in [*range(0, last, SPAN // 2), last]:
                    rows.append(k)
                    at.append(begin)
                    body.append(whole[begin : begin + SPAN])
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(body, pa.binary())],
                names=["item", "at", "body"],
            )

    chosen = items.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("text"))
    kind = chosen.schema["item"].dataType.simpleString()
    return chosen.mapInArrow(cut, f"item {kind}, at int, body binary")


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, item, at, start, end, edits): passages of items found in documents; bytes, end excluded.

    A document's passage is reported once per item passage, at its best place. Null and empty texts
    and items give nothing; equal items are each reported; key columns of any type are passed on.
    """
    cut = passages(items, item_key, item_text)
    total = cut.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    schema = f"key {docs.schema['key'].dataType.simpleString()}, passage int, start long, end long, edits int"
    found = None
    for block in range(blocks):
        mine = cut.where(F.pmod(F.xxhash64("item", "at"), F.lit(blocks)) == block).distinct().collect()
        if not mine and block:
            continue
        part = _block_matches(docs, [bytes(r["body"]) for r in mine], schema)
        names = docs.sparkSession.createDataFrame(
            [(k, r["item"], r["at"]) for k, r in enumerate(mine)],
            f"passage int, item {cut.schema['item'].dataType.simpleString()}, at int",
        )
        part = part.join(names, "passage").select("key", "item", "at", "start", "end", "edits")
        found = part if found is None else found.unionAll(part)
    return found


def _block_matches(docs: DataFrame, bodies: list[bytes], schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(bodies)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(sent.value) if sent.value else None
        seen = _present(index) if index else None
        for batch in slices(batches, 2048):
            best: dict[tuple[int, int], tuple] = {}
            done = 0
            texts = (folded(t) for t in batch.column(1).to_pylist()) if index else ()
            for part in chunks(texts, 1 << 18):
                for owner, passage, start, end, edits in search(part, index, seen):
                    place, value = (done + owner, passage), (edits, start, end)
                    best[place] = min(best.get(place, value), value)
                done += len(part)
            rows = sorted(best)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array([r for r, _ in rows], pa.int64())),
                    pa.array([p for _, p in rows], pa.int32()),
                    pa.array([best[r][1] for r in rows], pa.int64()),
                    pa.array([best[r][2] for r in rows], pa.int64()),
                    pa.array([best[r][0] for r in rows], pa.int32()),
                ],
                names=["key", "passage", "start", "end", "edits"],
            )

    return docs.mapInArrow(scan, schema)


def without_matches(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` in which no passage of an item is found; columns as they are.

    Rows are told apart by their texts, so null and repeated keys make no difference.
    """
    bodies = docs.select(F.md5(F.col(text).cast("binary")).alias("body"), F.col(text).alias("text"))
    found = matches(bodies, items, "body", "text").select(F.col("key").alias("__body")).distinct()
    return docs.join(found, F.md5(F.col(text).cast("binary")) == F.col("__body"), "left_anti")
