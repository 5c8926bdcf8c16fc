"""Phrase collocations from FM-indexes over word ids.

Texts are cut into pieces at punctuation and into words, and gathered into shards of `SHARD` words of
one language. A shard becomes the Burrows-Wheeler transforms of its word ids in both directions. A
phrase is an interval in each: the transform of the text extends it by a word on its left, that of the
reversed text by a word on its right, and intervals in sorted order are kept in step, so that the same
phrase reached from both sides is recognised by its interval. All phrases of a length are extended at
once.

Only phrases that can be frequent enough over the whole corpus are extended: a phrase has no more
occurrences than its parts, nor than all phrases that share its place, the lower 32 bits of its hash.
So length by length, shards count places first. A task sums its shards, sorts the places and sends
steps and counts, 7 bits a byte, in `PARTS` ranges that are summed over all tasks; a place takes about
three bytes, and no phrase is a row. Shards learn which places go on from a bitmap of `BITS` of them,
whatever the corpus is like; a chance hit there costs an entry that the sum removes. So shards are
never joined with anything and never move. Rare words become breaks before pairs are counted, and
joints of rare pairs before the transforms are built. Those then count the phrases that are left, all
lengths in one go, by their parts; the sums over all tasks decide.

Phrases are known by their prefix and suffix, one word shorter each. Counts of all their parts follow
along these, and so do their extensions: a phrase lies in a longer one if it is the prefix or the
suffix of one, since a phrase in between is at least as frequent as the longer. Words are 64-bit
hashes in the shards, phrases are told apart by those of prefix and suffix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltally.llm.common import slices
from calltally.session import cut_lineage, scratch_path

SHARD = 1 << 20  # words
BITS = 1 << 26  # places of the bitmap of frequent phrases
PARTS = 10  # bits of a place, or of a phrase's hash, that name the range it is summed in
HELD = 1 << 20  # places or phrases that a task sums before it sends them
TURNS = (7, 13, 22, 37, 45, 53)  # one for each length, so that no word cancels out of a hash
PIECE = 1 << 20  # bytes of a text that are split into words together
_BREAK = b"\xff"  # no byte of UTF-8
_SPLIT = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")


def _translation() -> bytes:
    out = bytearray(c + 32 if 65 <= c <= 90 else c for c in range(256))
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        out[c] = 255
    out[9] = 32
    return bytes(out)


_PLAIN = _translation()


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, a part at a time; a break ends it."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _SPLIT.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].translate(_PLAIN).replace(_BREAK, b" \xff ").split()
        at = end
    yield [_BREAK]


def _shards(batches: Iterator[pa.RecordBatch], depth: int, size: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, counts, body, counted) from rows (lang, text).

    The body has word numbers, 0 for a break. Where a shard ends inside a piece, the `depth - 1` words
    that follow are in it too, so that every phrase can be read from its start; starts from `counted` on
    belong to the next shard.
    """
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    ahead = depth - 1

    def close(lang: str, last: bool) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_arrays(held[lang])
        at = 0
        while at < len(whole):
            stop = len(whole) if last else min(len(whole) - ahead, at + size)
            if stop - at < (1 if last else size):
                break
            stop = min(stop, at + size)
            coded = whole.slice(at, stop - at + ahead).dictionary_encode()
            names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32) + 1
            breaks = names.index(_BREAK) + 1 if _BREAK in names else 0
            renumber = np.arange(len(names) + 1, dtype=np.int32)
            if breaks:
                renumber[breaks:] -= 1
                renumber[breaks] = 0
                del names[breaks - 1]
            ids = renumber[ids]
            counts = np.bincount(ids[: stop - at], minlength=len(names) + 1)[1:]
            yield pa.record_batch(
                [
                    pa.array([lang]),
                    pa.array([[n.decode() for n in names]], pa.list_(pa.string())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([ids.tobytes()], pa.binary()), pa.array([stop - at], pa.int64()),
                ],
                names=["lang", "words", "counts", "body", "counted"],
            )
            at = stop
        held[lang] = [whole.slice(at)]
        sizes[lang] = len(whole) - at

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in tokens(text):
                held.setdefault(lang, []).append(pa.array(part, pa.binary()))
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= size + ahead:
                    yield from close(lang, False)
        if sum(sizes.values()) > 2 * size:  # many languages at once
            for lang in sorted(sizes):
                yield from close(lang, True)
            held, sizes = {}, {}
    for lang in sorted(sizes):
        yield from close(lang, True)


def ordered(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts in the order of the `depth` symbols that follow each, wrapping round."""
    n = len(ids)
    rank, reach = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
        rank, reach = np.unique(key, return_inverse=True)[1].astype(np.int64), reach + step
    return np.argsort(rank, kind="stable") if n else np.zeros(0, np.int64)


class Transform:
    """A Burrows-Wheeler transform with the places of every symbol."""

    def __init__(self, bwt: np.ndarray, symbols: int) -> None:
        self.bwt = bwt
        self.first = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=symbols + 1))))
        self._keys = np.sort(bwt.astype(np.int64) << 32 | np.arange(len(bwt)))

    def before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Row where `symbol` put in front of what is at `row` or later begins."""
        return np.searchsorted(self._keys, symbol.astype(np.int64) << 32 | row)

    def extensions(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(interval, symbol, count, smaller): symbols in front of each interval, and how many rows have a smaller one."""
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        key, count = np.unique(owner << 32 | self.bwt[rows].astype(np.int64), return_counts=True)
        owner, symbol = key >> 32, key & 0xFFFFFFFF
        running = np.cumsum(count) - count
        new = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
        start = running[np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))] if len(owner) else running
        return owner, symbol, count, running - start


def chained(ids: np.ndarray, alien: np.ndarray, joined: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `least` words or more, a break (0) in front of each, and which starts belong to another shard.

    `joined` tells for every word but the last whether it and the next can be in one phrase.
    """
    run = np.concatenate(([0], np.cumsum(~joined))) if len(ids) else np.zeros(0, np.int64)
    keep = (ids > 0) & (np.bincount(run)[run] >= least) if len(ids) else np.zeros(0, bool)
    first = keep & np.concatenate(([True], ~joined)) if len(ids) else keep
    at = np.cumsum(1 + first[keep]) - 1
    text, strange = np.zeros(len(at) + int(first.sum()), np.int32), np.zeros(len(at) + int(first.sum()), bool)
    text[at], strange[at] = ids[keep], alien[keep]
    return text, strange


def build(text: np.ndarray, alien: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transforms of the text and of the reversed text, and the rows whose starts belong to another shard."""
    pad = np.zeros(depth, np.int32)
    text, alien = np.concatenate((text, pad)), np.concatenate((alien, pad > 0))
    order = ordered(text, depth)
    back = text[::-1]
    mirrored = ordered(back, depth)
    return text[order - 1], back[mirrored - 1], np.flatnonzero(alien[order])


def _turned(value: np.ndarray, by: int) -> np.ndarray:
    return value << np.uint64(by) | value >> np.uint64(64 - by)


def _named(prefix: Column, suffix: Column, by: int) -> Column:
    """The hash of a phrase from those of its parts, as `grow` makes it."""
    turned = F.shiftleft(prefix, by).bitwiseOR(F.shiftrightunsigned(prefix, 64 - by))
    return turned.bitwiseXOR(suffix)


def has(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = (ids & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return bitmap[place >> 3] >> (place & 7) & 1 > 0


def levels(
    ids: np.ndarray, forward: np.ndarray, backward: np.ndarray, alien: np.ndarray, bitmaps: list[np.ndarray], length: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(prefix, suffix, count) of the phrases of 2 words, 3 and so on to `length`.

    `bitmaps` has the phrases to keep and extend, from 2 words on; lengths without a bitmap are kept whole.
    """
    ahead, behind = Transform(forward, len(ids)), Transform(backward, len(ids))
    symbol = np.arange(1, len(ids) + 1)
    low, mirror = ahead.first[symbol], behind.first[symbol]
    size = ahead.first[symbol + 1] - low
    for k in range(2, length + 1):
        # to the left through the transform of the text, to the right through that of the reversed text
        of, word, _, _ = ahead.extensions(low, size)
        of, word = of[word > 0], word[word > 0]
        start, end, width, smaller = behind.extensions(mirror, size)
        begins = low[start] + smaller
        _, a, b = np.intersect1d(ahead.before(word, low[of]), begins, assume_unique=True, return_indices=True)
        prefix, suffix = start[b], of[a]
        name = _turned(ids[prefix], TURNS[k - 2]) ^ ids[suffix]
        some = has(bitmaps[k - 2], name) if len(bitmaps) > k - 2 else np.ones(len(name), bool)
        mirror = behind.before(end[b], mirror[prefix])[some]
        low, size, parts = begins[b][some], width[b][some], (ids[prefix][some], ids[suffix][some])
        ids = name[some]
        count = size - (np.searchsorted(alien, low + size) - np.searchsorted(alien, low))
        own = count > 0
        yield parts[0][own], parts[1][own], count[own]


def grow(
    ids: np.ndarray, forward: np.ndarray, backward: np.ndarray, alien: np.ndarray, bitmaps: list[np.ndarray], length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, suffix, count) of the phrases of `length` words; `bitmaps` has the shorter ones to extend, from 2 on."""
    *_, longest = levels(ids, forward, backward, alien, bitmaps, length)
    return longest


def windows(ids: np.ndarray, text: np.ndarray, bitmaps: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of `length` words from every start on, as `levels` makes it, and where it is one of a phrase.

    That is where no break comes between and all shorter phrases inside are in `bitmaps`, from 2 words on.
    """
    name, there = np.concatenate((np.zeros(1, np.uint64), ids))[text], text > 0
    for k in range(2, length + 1):
        name, there = _turned(name[:-1], TURNS[k - 2]) ^ name[1:], there[:-1] & there[1:]
        if k < length:
            there &= has(bitmaps[k - 2], name)
    return name, there


def summed(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in ascending order, the first array counting most, and the sum of each one's counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = tuple(k[order] for k in keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return tuple(k[first] for k in keys), np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _cut(raw: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes between neighbouring cuts, one value each."""
    buffers = [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers)


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers from 0 on, 7 bits a byte, lowest first; the top bit says that more follow. One value between two cuts."""
    values, width, most = values.astype(np.int64), np.ones(len(values), np.int64), int(values.max(initial=0))
    for k in range(7, most.bit_length(), 7):
        width += values >= 1 << k
    ends = np.concatenate(([0], np.cumsum(width)))
    raw = np.zeros(ends[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > k)
        raw[ends[some] + k] = values[some] >> 7 * k & 127 | (width[some] > k + 1) << 7
    return _cut(raw, ends[cuts])


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        some = np.flatnonzero(ends - starts >= k)
        values[some] |= (raw[starts[some] + k] & 127).astype(np.int64) << 7 * k
    return values


def _starts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of a sorted array begins, and the same with its end."""
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return first, np.append(first, len(part))


PLACES = "part int, places binary, counts binary"
PHRASES = "part int, length int, prefixes binary, suffixes binary, counts binary"


def _place_rows(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of `PLACES` from (places, counts): a row for each range, steps from place to place."""
    (place,), count = summed((np.concatenate([x[0] for x in found]),), np.concatenate([x[1] for x in found]))
    if not len(place):
        return
    part = place >> 32 - PARTS
    first, cuts = _starts(part)
    step = np.diff(place, prepend=place[:1])
    step[first] = place[first] & (1 << 32 - PARTS) - 1
    columns = [pa.array(part[first], pa.int32()), packed(step, cuts), packed(count, cuts)]
    yield pa.record_batch(columns, names=["part", "places", "counts"])


def _places(shards: Iterator[tuple[np.ndarray, ...]], bitmaps: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of `PLACES`: how often the places of phrases of `length` words come in shards (ids, text, alien)."""
    held, size = [], 0
    for ids, text, alien in shards:
        name, there = windows(ids, text, bitmaps, length)
        name = name[there & ~alien[: len(name)]]
        held.append(np.unique((name & np.uint64((1 << 32) - 1)).astype(np.uint32), return_counts=True))
        size += len(held[-1][0])
        if size >= HELD:
            yield from _place_rows(held)
            held, size = [], 0
    if size:
        yield from _place_rows(held)


def _likely(rows: pa.Table, least: int) -> pa.Table:
    """The places of one range with `least` occurrences or more over all tasks."""
    places, counts = (
        [unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in rows[c]] for c in ("places", "counts")
    )
    (place,), count = summed((np.concatenate([np.cumsum(x) for x in places]),), np.concatenate(counts))
    return pa.table({"id": place[count >= least] + (rows["part"][0].as_py() << 32 - PARTS)})


def _phrase_rows(length: int, found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of `PHRASES` from (prefix, suffix, count) of phrases of `length` words."""
    prefix, suffix, count = (np.concatenate(x) for x in zip(*found, strict=True))
    part = (_turned(prefix, TURNS[length - 2]) ^ suffix) >> np.uint64(64 - PARTS)
    (part, prefix, suffix), count = summed((part, prefix, suffix), count)
    if not len(part):
        return
    first, cuts = _starts(part)
    yield pa.record_batch(
        [
            pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), length, np.int32)),
            *(_cut(x.view(np.uint8), 8 * cuts) for x in (prefix, suffix)), packed(count, cuts),
        ],
        names=["part", "length", "prefixes", "suffixes", "counts"],
    )


def _phrases(shards: Iterator[tuple[np.ndarray, ...]], bitmaps: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    """Rows of `PHRASES`: phrases of 2 to `longest` words that are in `bitmaps`, from shards (ids, text, alien)."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        for length in sorted(held):
            yield from _phrase_rows(length, held[length])

    for ids, text, alien in shards:
        for length, found in enumerate(levels(ids, *build(text, alien, longest), bitmaps, longest), 2):
            held.setdefault(length, []).append(found)
            size += len(found[0])
        if size >= HELD:
            yield from close()
            held, size = {}, 0
    yield from close()


def _frequent(rows: pa.Table, least: int) -> pa.Table:
    """(length, prefix, suffix, f) of the phrases of one range with `least` occurrences or more over all tasks."""
    prefix, suffix = (
        np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows[c]]) for c in ("prefixes", "suffixes")
    )
    counts = [unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in rows["counts"]]
    length = np.repeat(rows["length"].to_numpy(), [len(x) for x in counts])
    keys, f = summed((length, prefix, suffix), np.concatenate(counts))
    return pa.table([k[f >= least] for k in (*keys, f)], names=["length", "prefix", "suffix", "f"])


def _dense(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the words that occur, and the text in their numbers; 0 stays a break."""
    used = np.unique(text)
    used = used[used > 0]
    number = np.zeros(len(ids) + 1, np.int32)
    number[used] = np.arange(1, len(used) + 1)
    return ids[used - 1], number[text]


def frequent_words(lang: str, words: list[str], body: np.ndarray, counted: int, bitmap: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, text, alien): the shard with a break for every rare word, in runs of two words or more."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    ids = np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))
    keep = np.concatenate(([False], has(bitmap, ids)))
    text = np.where(keep[body], body, 0)
    text, alien = chained(text, np.arange(len(text)) >= counted, (text[:-1] > 0) & (text[1:] > 0), 2)
    return (*_dense(ids, text), alien)


def _read(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for k in range(batch.num_rows):
            lang, words, body, counted = (batch.column(c)[k] for c in range(4))
            yield frequent_words(
                lang.as_py(), words.as_py(), np.frombuffer(body.as_buffer(), np.int32), counted.as_py(), bitmap
            )


def _chains(batches: Iterator[pa.RecordBatch], words: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(ids, text, alien) of chains of frequent pairs, from rows (lang, words, body, counted)."""
    for ids, text, alien in _read(batches, words):
        name, joined = windows(ids, text, [], 2)
        text, alien = chained(text, alien, joined & has(pairs, name), 2)
        ids, text = _dense(ids, text)
        yield pa.record_batch(
            [
                pa.array([ids.view(np.int64)], pa.list_(pa.int64())), pa.array([text.tobytes()], pa.binary()),
                pa.array([np.flatnonzero(alien)], pa.list_(pa.int64())),
            ],
            names=["ids", "text", "alien"],
        )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, text, alien = (batch.column(c)[k] for c in range(3))
            text = np.frombuffer(text.as_buffer(), np.int32)
            strange = np.zeros(len(text), bool)
            strange[alien.values.to_numpy()] = True
            yield ids.values.to_numpy().view(np.uint64), text, strange


def _bitmap(level: DataFrame, bits: int) -> np.ndarray:
    """Which of `bits` places the ids of a level take; at most bits / 8 bytes come to the driver."""
    place = F.col("id").bitwiseAND(F.lit(bits - 1))
    rows = level.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(32767)).alias("bit"))
    out = np.zeros((-(-bits // 32768), 4096), np.uint8)
    for r in rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out.ravel()[: bits // 8]


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, shard: int = SHARD,
    bits: int = BITS,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): frequent phrases of 1 to `longest` words, and all words of each language.

    phrases: lang, length, id, prefix, suffix (ids of the phrases one word shorter), words, f, and
    heads and tails, the counts of its first and last 1, 2, … words. A-Z count as a-z; pieces end at
    `.,;:!?` and line ends, words at blanks and tabs. A null language is `und`, a null text empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    def stored(name: str, frame: DataFrame) -> DataFrame:
        where = scratch_path(spark, name)
        frame.write.parquet(where)
        return spark.read.parquet(where)

    shards = stored("shards", rows.mapInArrow(
        lambda batches: _shards(batches, longest, shard),
        "lang string, words array<string>, counts array<long>, body binary, counted long",
    ))
    totals = cut_lineage(shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
                         .groupBy("lang").agg(F.sum("n").alias("n")))
    listed = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counts = listed.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least)
    none = F.lit(None).cast("long")
    level = stored("phrases-1", counts.select(
        "lang", F.lit(1).alias("length"), F.xxhash64("lang", "word").alias("id"), none.alias("prefix"), none.alias("suffix"),
        F.array("word").alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"),
    ))
    found, bitmaps, chains = level, [spark.sparkContext.broadcast(_bitmap(level, bits))], None
    bodies = shards.select("lang", "words", "body", "counted")
    for length in range(2, longest + 1):
        sent = tuple(bitmaps)
        if length == 2:
            places = bodies.mapInArrow(lambda batches, sent=sent: _places(_read(batches, sent[0].value), [], 2), PLACES)
        else:
            if chains is None:
                # only chains of frequent pairs can hold longer phrases
                chains = stored("chains", bodies.mapInArrow(
                    lambda batches, sent=sent: _chains(batches, sent[0].value, sent[1].value),
                    "ids array<long>, text binary, alien array<long>",
                ))
            places = chains.mapInArrow(
                lambda batches, sent=sent, length=length: _places(_chained(batches), [b.value for b in sent[1:]], length),
                PLACES,
            )
        likely = places.groupBy("part").applyInArrow(lambda rows: _likely(rows, least), "id long")
        bitmaps.append(spark.sparkContext.broadcast(_bitmap(likely, bits)))
    if longest > 1:
        if chains is None:
            chains = bodies.mapInArrow(
                lambda batches, sent=tuple(bitmaps): _chains(batches, sent[0].value, sent[1].value),
                "ids array<long>, text binary, alien array<long>",
            )
        counted = chains.mapInArrow(
            lambda batches, sent=tuple(bitmaps): _phrases(_chained(batches), [b.value for b in sent[1:]], longest), PHRASES
        )
        sums = stored("sums", counted.groupBy("part").applyInArrow(
            lambda rows: _frequent(rows, least), "length int, prefix long, suffix long, f long"
        ))
    for length in range(2, longest + 1):
        left = level.select("lang", F.col("id").alias("prefix"), "words", "heads")
        right = level.select(F.col("id").alias("suffix"), F.element_at("words", -1).alias("end"), "tails")
        grown = sums.where(F.col("length") == length).drop("length").join(left, "prefix").join(right, "suffix")
        level = stored(f"phrases-{length}", grown.select(
            "lang", F.lit(length).alias("length"), _named(F.col("prefix"), F.col("suffix"), TURNS[length - 2]).alias("id"),
            "prefix", "suffix", F.concat("words", F.array("end")).alias("words"), "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
        ))
        found = found.unionAll(level)
    for sent in bitmaps:
        sent.unpersist()
    return found, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5,
                 absorb: int = 100, most: int = 2000, shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` best-scoring phrases of 2 to `longest` words of each language.

    The score is the smallest of floor(1000 a n / (l r)) over all cuts in two, the first cut of those
    that share it. A phrase inside a longer one with at least `absorb` % of its count is left out. Ties of the
    score go by count, then by phrase. Repeated rows count as often as they occur; an empty table, or one
    without a frequent phrase, gives no rows.
    """
    found, totals = mine(docs, text, lang, least, longest, shard, bits)
    up = F.col("length") - 1
    longer = found.where("length > 1").select(up.alias("length"), F.explode(F.array(F.struct(F.col("prefix").alias("id"), "f"), F.struct(F.col("suffix").alias("id"), "f"))).alias("x"))
    longer = longer.groupBy("length", F.col("x.id").alias("id")).agg(F.max("x.f").alias("more"))
    cuts = F.expr("""transform(sequence(1, length - 1), k -> named_struct(
        'score', (1000 * cast(f as decimal(19,0)) * cast(n as decimal(19,0)))
                 div (cast(heads[k - 1] as decimal(19,0)) * cast(tails[length - k - 1] as decimal(19,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[length - k - 1]))""")
    scored = (
        found.where("length > 1").join(longer, ["length", "id"], "left")
        .where(F.col("more").isNull() | (100 * F.col("more") < absorb * F.col("f")))
        .join(totals, "lang").withColumn("cut", F.array_min(cuts))
        .select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
