"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its `width`-word shingles. A sketch has `COORDINATES` places. In each round
every shingle is hashed to one place and leaves the smallest value there, with the round above the
hash, so that a later round never undercuts an earlier one. Rounds go on until no place is empty: a
large set needs one or two, and from round `COORDINATES` on each round fills one given place, so any
set is done after twice as many. Two sets agree in a place with the probability of their similarity,
and the number of agreeing places keeps close to its mean.

Sketches are cut into `BANDS` of `ROWS` places. Sets that share a band are candidates, their full sets
decide. At a similarity of 0.85 all bands miss one pair in four million.

Work is on distinct word sequences, so copies cost nothing further. The members of a bucket are not
paired with each other at first, but with one head: in the first round its smallest node, in the
second the one with most links, which in a family of copies is the text that they were made from.
Members that are in different components after that are compared, as the bucket may hold texts that
the heads do not join. There the shingles that only one set has, a bit of every place, and the sets folded
onto `FOLD` places tell most unlike pairs apart before any set moves. Members of a bucket over `CROWDED`
are first dealt anew by a second band that they share, since pairs above the limit share several. No pair
is passed over for the size of its bucket.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally.llm.common import components, mixed, slices
from calltally.session import cut_lineage, scratch_path

BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
CROWDED = 4096
PIECE = 1 << 20  # bytes of a text that are split into words together
HELD = 1 << 18  # shingles that are sketched together
FOLD = 2048  # places that a set is folded onto
_EMPTY = ~np.uint64(0)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_RANDOM = np.random.default_rng(11)
_PLACES = _RANDOM.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.integers(0, 1 << 63, BANDS, np.uint64)
_STEP = 0x9E3779B97F4A7C15


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of every word, in order; A-Z count as a-z."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        words = text[at:end].translate(_LOWER).split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes in order; fewer words than `width` make one shingle, no word none."""
    size = min(width, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    value = np.full(n, size, np.uint64)
    for k in range(size):
        value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    return np.unique(value)


def sketch(hashes: np.ndarray, owner: np.ndarray, n: int, places: int = COORDINATES) -> np.ndarray:
    """Sketches of `n` sets, given as hashes with the set each belongs to; every set has a member at least."""
    table = np.full(n * places, _EMPTY, np.uint64)
    for turn in range(2 * places):
        x = mixed(hashes + np.uint64((turn + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        if turn < places:
            place = ((x >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
        else:
            place = turn - places
        value = np.uint64(turn << 48) | (mixed(x) >> np.uint64(16))
        np.minimum.at(table, owner * places + place, value)
        still = (table.reshape(n, places) == _EMPTY).any(axis=1)[owner]
        if not still.any():
            break
        hashes, owner = hashes[still], owner[still]
    return table.reshape(n, places)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    bands = sketches.reshape(len(sketches), BANDS, ROWS)
    return mixed((mixed(bands) * _PLACES).sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)


def place_bits(sketches: np.ndarray) -> np.ndarray:
    """A bit of every place, packed."""
    return np.packbits((sketches & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


_BITS = COORDINATES // 64
SETS = "node long, members array<long>, fold array<long>, spare long"


def set_rows(names: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of `SETS`: every set with the places, one a shingle, that its shingles take, and how many share theirs."""
    taken = np.zeros((len(sets), FOLD), np.uint8)
    for row, members in zip(taken, sets, strict=True):
        row[members >> np.uint64(64 - (FOLD - 1).bit_length())] = 1
    spare = np.array([len(members) for members in sets], np.int64) - taken.sum(axis=1, dtype=np.int64)
    kind = pa.list_(pa.int64())
    return pa.record_batch(
        [
            names, pa.array([members.view(np.int64) for members in sets], kind),
            pa.array(list(np.packbits(taken, axis=1).view(np.int64)), kind), pa.array(spare),
        ],
        names=["node", "members", "fold", "spare"],
    )


def most_common() -> Column:
    """No fewer than the shingles that the sets of `a` and `b` share.

    A place that only one set takes holds a shingle, at least, that the other has not.
    """
    both = F.zip_with("a.fold", "b.fold", lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda total, n: total + n) + F.least("a.spare", "b.spare")


def _sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = [word_hashes(t or b"") for t in batch.column(1).to_pylist()]
        sets = [shingle_set(w, width) for w in words]
        digests = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words]
        at = 0
        while at < len(sets):
            end, held = at, 0
            while end < len(sets) and (end == at or held + len(sets[end]) <= HELD):
                held += len(sets[end])
                end += 1
            part = sets[at:end]
            sizes = np.array([len(s) for s in part])
            some = np.flatnonzero(sizes)
            keys: list = [None] * len(part)
            bits = np.zeros((len(part), _BITS), np.int64)
            if len(some):
                owner = np.repeat(np.arange(len(some)), sizes[some])
                found = sketch(np.concatenate([part[k] for k in some]), owner, len(some))
                for k, row in zip(some, band_keys(found), strict=True):
                    keys[k] = row
                bits[some] = place_bits(found)
            yield pa.record_batch(
                [
                    batch.column(0).slice(at, end - at), pa.array(digests[at:end], pa.binary()),
                    pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                    *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(_BITS)),
                ],
                names=["key", "digest", "size", "keys", *(f"bits{k}" for k in range(_BITS))],
            )
            at = end


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text): texts under the digest of their words."""
    for batch in slices(batches):
        texts = batch.column(0)
        digests = [hashlib.blake2b(word_hashes(t or b"").tobytes(), digest_size=16).digest() for t in texts.to_pylist()]
        yield pa.record_batch([pa.array(digests, pa.binary()), texts], names=["digest", "text"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield set_rows(batch.column(0), [shingle_set(word_hashes(t), width) for t in batch.column(1).to_pylist()])


def _may_link(percent: int) -> Column:
    """Whether two members of a bucket can reach the limit, by sizes, own shingles and the bits of their places.

    Shingles that only one set has are in no intersection, which bounds it. Bits of a pair at the limit
    differ in (1 - limit) / 2 of the places on average; all up to six standard deviations above that are
    left to the full sets.
    """
    share = (100 - percent) / 200
    most = COORDINATES * share + 6 * sqrt(COORDINATES * share * (1 - share))
    apart = sum(F.bit_count(F.col(f"a.bits{k}").bitwiseXOR(F.col(f"b.bits{k}"))) for k in range(_BITS))
    common = F.least(F.col("a.size") - F.col("a.own"), F.col("b.size") - F.col("b.own"))
    return (
        (100 * F.least("a.size", "b.size") >= percent * F.greatest("a.size", "b.size"))
        & (100 * common >= percent * (F.col("a.size") + F.col("b.size") - common)) & (apart <= F.lit(most))
    )


def _ordered() -> list[Column]:
    return [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes whose full sets reach the limit."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b").withColumn("common", common)
        .where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")
    )


def _roots(links: DataFrame) -> DataFrame:
    return components(links).select("node", "root")


def linked(nodes: DataFrame, texts: DataFrame, width: int, percent: int, crowded: int) -> DataFrame:
    """(node, root) of the nodes that have a link; `texts` is (digest, text) of all rows."""
    spark = nodes.sparkSession
    dealt = nodes.select("node", F.explode("keys").alias("bucket"))
    shared = cut_lineage(dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"))
    described = nodes.select("node", "size", *[f"bits{k}" for k in range(_BITS)])
    members = cut_lineage(dealt.join(shared, "bucket").join(described, "node"))

    # sets of what can be compared at all; a text stands for all that have its words
    wanted = cut_lineage(members.select("node").distinct().join(nodes.select("node", "digest"), "node"))
    path = scratch_path(spark, "shingle-sets")
    (
        texts.join(wanted, "digest").groupBy("node").agg(F.min("text").alias("text"))
        .mapInArrow(lambda batches: _sets(batches, width), SETS).write.parquet(path)
    )
    sets = spark.read.parquet(path)
    once = sets.select("node", F.explode("members").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = cut_lineage(once.where("n = 1").groupBy("node").agg(F.count("*").alias("own")))
    described = described.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    members = cut_lineage(members.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))))

    def star(heads: DataFrame) -> DataFrame:
        """Links of members with the head of their bucket."""
        told = described.withColumnRenamed("node", "head").join(heads.select("head").distinct(), "head").select(
            "head", F.struct(F.col("head").alias("node"), *[c for c in described.columns if c != "node"]).alias("a")
        )
        around = heads.join(cut_lineage(told), "head")
        rows = members.select("bucket", F.struct(*described.columns).alias("b")).join(around, "bucket")
        pairs = rows.where("a.node <> b.node").where(_may_link(percent)).select(*_ordered()).distinct()
        return cut_lineage(_verified(cut_lineage(pairs), sets, percent))

    links = star(shared.select("bucket", "head"))
    placed = members.join(cut_lineage(_roots(links)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_up = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    popular = (
        members.join(cut_lineage(mixed_up.select("bucket")), "bucket", "left_semi").join(cut_lineage(degrees), "node")
        .groupBy("bucket").agg(F.max(F.struct("links", (-F.col("node")).alias("minus"))).alias("top"))
        .select("bucket", (-F.col("top.minus")).alias("head"))
    )
    links = cut_lineage(links.unionAll(star(cut_lineage(popular))).distinct())
    found = cut_lineage(_roots(links))

    # members of one bucket that are still apart
    placed = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_up = cut_lineage(
        placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    )
    placed = cut_lineage(placed.join(mixed_up, "bucket").join(sets.select("node", "fold", "spare"), "node"))
    again = placed.where(F.col("n") > crowded).join(nodes.select("node", "keys"), "node").withColumn("second", F.explode("keys"))
    again = again.where("second <> bucket").withColumn("bucket", F.xxhash64("bucket", "second")).drop("keys", "second")
    rows = placed.where(F.col("n") <= crowded).unionByName(again)
    body = F.struct("root", *described.columns, "fold", "spare")
    rest = (
        rows.select("bucket", body.alias("a")).join(rows.select("bucket", body.alias("b")), "bucket")
        .where("a.node < b.node and a.root <> b.root").where(_may_link(percent))
        .where((100 + percent) * most_common() >= percent * (F.col("a.size") + F.col("b.size")))
        .select(*_ordered()).distinct()
    )
    more = cut_lineage(_verified(cut_lineage(rest), sets, percent))
    return found if more.isEmpty() else _roots(links.unionAll(more))


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, crowded: int = CROWDED
) -> DataFrame:
    """(key, n_shingles, component_id) of every row of `docs`.

    Words are runs without ASCII white space, A-Z as a-z. Sets are linked if a hundred times their
    intersection is at least `percent` times their union, and links are followed. `component_id` is the
    smallest key reachable, itself included. Null, empty and wordless texts have no shingles and no
    link. A row with a null key takes part like any other; null is the component of rows that only
    reach null keys. Rows that repeat a key or a text each give a row. An empty table gives no rows;
    other columns are not read. `percent` is 85 or more: the bands are laid out for that.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    path = scratch_path(spark, "sketches")
    rows.mapInArrow(
        lambda batches: _sketched(batches, width),
        f"key {kind}, digest binary, size long, keys array<long>, " + ", ".join(f"bits{k} long" for k in range(_BITS)),
    ).write.parquet(path)
    sketched = spark.read.parquet(path)

    path = scratch_path(spark, "sketch-nodes")
    same = F.struct("size", "keys", *[f"bits{k}" for k in range(_BITS)])
    (
        sketched.where("size > 0").groupBy("digest").agg(F.min("key").alias("least"), F.first(same).alias("s"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "least", "s.*").write.parquet(path)
    )
    nodes = spark.read.parquet(path)
    named = rows.select("text").mapInArrow(_named, "digest binary, text binary")
    found = cut_lineage(linked(nodes, named, width, percent, crowded))

    placed = nodes.select("node", "digest", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named_ids = cut_lineage(placed.join(ids, "root").select("digest", "component_id", F.lit(True).alias("worded")))
    return sketched.select("key", "digest", F.col("size").alias("n_shingles")).join(named_ids, "digest", "left").select(
        "key", "n_shingles", F.when(F.col("worded"), F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    )
