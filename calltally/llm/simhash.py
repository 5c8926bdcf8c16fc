"""SimHash near-duplicates through a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint; texts whose fingerprints differ in at most `radius` bits are
linked, and links are followed transitively.

Work is on distinct fingerprints, each known by its smallest id, so copies cost nothing further. The
64 bits are cut into `radius + 2` runs; two fingerprints within the radius agree on two runs at
least, so each fingerprint goes to one group for every pair of runs, keyed by their bits. A group is
sorted by Gray rank and becomes a hierarchy: neighbours share most bits, a node keeps the mask of the
bits that all its members share and their values. Two nodes are compared by the bits that both share;
once these differ in more than the radius, all their members are dropped together, otherwise the
search descends. Only links that join two parts of a group leave it, so a group gives fewer links
than it has members.

Groups over `largest` members are not held in one task. Their members are spelled out with every
change of up to half the radius, rounded up; two fingerprints within the radius meet at one of these
strings at least, and those that meet are joined through the smallest by plain aggregation.

`first_of_each` removes near copies by similarity: SimHash links and MinHash buckets give candidates,
and the shingles of the two texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally.llm.common import columns, components, in_slices, mixed, slices
from calltally.llm.fast_sketch import SETS, most_common, set_rows, shingle_set, word_hashes
from calltally.session import cut_lineage, discard, scratch_path

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAF = 16
LARGEST = 20_000
BANDS, ROWS = 20, 5
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_BITS = -(-BANDS * ROWS // 64)


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all `width`-word shingles, repeats included.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words than `width` make one
    shingle; no word gives 0.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_digest, len(starts)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        raw = b"".join(
            [digest(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        )
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield in_slices(batch, lambda texts: [_signed(fingerprint(t, width)) for t in texts], pa.int64())

    return docs.select(F.col(key).alias("key"), value(F.col(text)).alias("fp"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def index_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in `values` (distinct, uint64) that join everything within the radius.

    Level 0 has runs of `LEAF` values in Gray order, each further level has runs of `LEAF` nodes.
    Every node has the bits its members share and a mask of them. Node pairs are visited from the
    top; a pair whose shared bits differ in more than the radius is pruned with all its members.
    """
    order = np.argsort(gray_rank(values), kind="stable")
    value = values[order]
    levels = [(np.full(len(value), ~np.uint64(0)), value)]
    while len(levels[-1][0]) > 1:
        mask, bits = levels[-1]
        at = np.arange(0, len(mask), LEAF)
        every = np.bitwise_and.reduceat(mask, at)
        some = np.bitwise_or.reduceat(bits, at)
        all_ = np.bitwise_and.reduceat(bits | ~mask, at)
        shared = every & ~(some ^ (some & all_))
        levels.append((shared, all_ & shared))
    parent = np.arange(len(value))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    left, right = [], []

    def descend(a: np.ndarray, b: np.ndarray, level: int) -> None:
        """a <= b: pairs of nodes of `level` that may hold linked members, in slices of bounded size."""
        size = len(levels[level - 1][0])
        for at in range(0, len(a), 4096):
            i, j = a[at : at + 4096, None], b[at : at + 4096, None]
            child = np.arange(LEAF * LEAF)
            x, y = i * LEAF + child // LEAF, j * LEAF + child % LEAF
            keep = (x < size) & (y < size) & ((x < y) if level == 1 else (x <= y))
            x, y = x[keep], y[keep]
            mask, bits = levels[level - 1]
            near = np.bitwise_count((bits[x] ^ bits[y]) & mask[x] & mask[y]) <= radius
            x, y = x[near], y[near]
            if level > 1:
                descend(x, y, level - 1)
                continue
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p0, q0 = root(p), root(q)
                if p0 != q0:
                    parent[max(p0, q0)] = min(p0, q0)
                    left.append(p)
                    right.append(q)

    if len(levels) > 1:
        descend(np.zeros(1, np.int64), np.zeros(1, np.int64), len(levels) - 1)
    return order[np.array(left, np.int64)], order[np.array(right, np.int64)]


def _runs(radius: int) -> list[int]:
    """A mask of the bits of each run."""
    n = radius + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _changes(radius: int) -> tuple[list[int], int]:
    """Masks of up to half the radius bits, rounded up, by number of bits; how many are not rounded up."""
    bits = [1 << k for k in range(64)]
    some = [[_signed(sum(c)) for c in combinations(bits, n)] for n in range(-(-radius // 2) + 1)]
    return [m for ms in some for m in ms], sum(len(ms) for ms in some[: radius // 2 + 1])


def links(prints: DataFrame, radius: int, largest: int = LARGEST) -> DataFrame:
    """(a, b): ids that join all distinct fingerprints of `prints` (id, fp) within the radius."""
    masks = [_signed(x | y) for x, y in combinations(_runs(radius), 2)]
    dealt = prints.select(
        "id", "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                            for k, m in enumerate(masks)])).alias("g"),
    ).select("id", "fp", "g.way", "g.bits")
    sizes = cut_lineage(dealt.groupBy("way", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = dealt.join(sizes, ["way", "bits"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [], []
            for ids, fps in zip(batch["ids"], batch["fps"], strict=True):
                ids = np.asarray(ids, np.int64)
                a, b = index_links(np.asarray(fps, np.int64).view(np.uint64), radius)
                left.append(ids[a])
                right.append(ids[b])
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    small = dealt.where(F.col("n") <= largest).groupBy("way", "bits").agg(F.collect_list(F.struct("id", "fp")).alias("m"))
    found = small.select(F.col("m.id").alias("ids"), F.col("m.fp").alias("fps")).mapInPandas(search, "a long, b long")
    # members that meet at a string are within the radius if one of the two changed no more than half, rounded down
    crowded = dealt.where(F.col("n") > largest).select("id", "fp").distinct()
    changes, close = _changes(radius)
    met = crowded.select("id", "fp", F.posexplode(F.lit(changes))).select(
        "id", F.col("fp").bitwiseXOR(F.col("col")).alias("met"), (F.col("pos") < close).alias("close")
    )
    first = met.where("close").groupBy("met").agg(F.min("id").alias("a"))
    pairs = met.join(first, "met").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    return found.unionAll(pairs)


def groups(docs: DataFrame, key: str, text: str, width: int, radius: int, largest: int = LARGEST) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links, itself included.

    `docs` needs a distinct non-null integer `key`; null texts count as empty, all texts without a
    word share fingerprint 0. Equal texts always share a component. An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, key, text, width))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("id")))
    found = components(links(distinct, radius, largest))
    roots = distinct.join(found, distinct["id"] == found["node"], "left").select(
        "fp", F.coalesce("root", "id").alias("component_id")
    )
    return prints.join(roots, "fp").select("key", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingles(text: str | None, width: int) -> set[bytes]:
    """All `width`-word shingles; fewer words than `width` make one, no word makes none."""
    words = _words(text)
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def similarity(a: str | None, b: str | None, width: int) -> float:
    """Jaccard similarity of the shingle sets; 1 if both are empty."""
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y) if x or y else 1.0


def _hashes(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "replace"))


def _named(words: np.ndarray) -> int:
    """The node of a text from the hashes of its words."""
    return _signed(xxhash.xxh64_intdigest(words.tobytes(), 42))


def buckets(text: str | None, width: int) -> tuple[int, int, list[int], list[int]]:
    """(node, size, keys, bits): hash of the words, number of shingles, one MinHash key a band (none without
    a word), a bit of every MinHash value, packed.

    Texts of similarity s share a band with probability s ** `ROWS`; at 0.8 all `BANDS` miss one pair in 2 800.
    """
    words = _hashes(text)
    node, hashes = _named(words), shingle_set(words, width)
    if not len(hashes):
        return node, 0, [], [0] * _BITS
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at : at + (1 << 13), None] * _FACTORS + _TERMS
        least = np.minimum(least, part.min(axis=0))
    keys = [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    bits = np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8))
    return node, len(hashes), keys, np.pad(bits, (0, 8 * _BITS - len(bits))).view(np.int64).tolist()


def nodes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, node, fp, size, keys, bits) of every row; rows of equal words have one node."""

    kind = pa.struct([
        ("node", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())),
        ("bits", pa.list_(pa.int64())),
    ])

    def of(texts: list[str | None]) -> list[dict]:
        found = ((_signed(fingerprint(t, width)), *buckets(t, width)) for t in texts)
        return [{"node": node, "fp": fp, "size": size, "keys": keys, "bits": bits} for fp, node, size, keys, bits in found]

    @F.arrow_udf("node long, fp long, size long, keys array<long>, bits array<long>")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield in_slices(batch, of, kind)

    return docs.select(F.col(key).alias("key"), value(F.col(text)).alias("v")).select("key", "v.*")


def _node(text: Column) -> Column:
    def of(texts: list[str | None]) -> list[int]:
        return [_named(_hashes(t)) for t in texts]

    @F.arrow_udf("long")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield in_slices(batch, of, pa.int64())

    return value(text)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield set_rows(batch.column(0), [shingle_set(_hashes(t), width) for t in batch.column(1).to_pylist()])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a similarity of at least `least`."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("common")
    return cut_lineage(both.where((union == 0) | (F.col("common") >= F.lit(least) * union)).select("a", "b"))


def _may_reach(least: float) -> Column:
    """Whether `a` and `b` can reach the limit, by sizes and the bits of their MinHash values.

    Bits of a pair at the limit differ in (1 - limit) / 2 of the places on average; all up to six standard
    deviations above that are left to the full sets.
    """
    share, places = (1 - least) / 2, BANDS * ROWS
    most = places * share + 6 * sqrt(places * share * (1 - share))
    apart = sum(F.bit_count(F.col("a.bits")[k].bitwiseXOR(F.col("b.bits")[k])) for k in range(_BITS))
    return (F.least("a.size", "b.size") >= F.lit(least) * F.greatest("a.size", "b.size")) & (apart <= F.lit(most))


def _ordered() -> list[Column]:
    return [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]


def near_copies(docs: DataFrame, rows: DataFrame, text: str, width: int, radius: int, least: float) -> DataFrame:
    """(node, root): components over pairs of similarity `least` or more, for nodes that have one.

    Candidates are the SimHash links within `radius` bits and the nodes that share a MinHash bucket; each
    pair is decided by its shingles. A bucket is first compared with its smallest node, then with the one
    that has most links, which in a family of copies is the text that they were made from. Members that
    are in different components after that are compared with each other, unless the shingles that only one
    of them has, or the places that their folded sets take, rule the pair out, so nothing in a bucket is passed
    over and a large family of copies takes a number of pairs that grows with its size.
    """
    spark = docs.sparkSession
    whole = [F.first(c).alias(c) for c in ("fp", "size", "keys", "bits")]
    known = cut_lineage(rows.groupBy("node").agg(*whole))
    body = F.struct("node", "size", "bits")
    dealt = known.select("node", "size", "bits", F.explode("keys").alias("bucket"))
    heads = dealt.groupBy("bucket").agg(F.min(body).alias("a"), F.count("*").alias("n")).where("n > 1")
    heads = cut_lineage(heads.drop("n"))
    members = cut_lineage(dealt.join(heads.select("bucket"), "bucket"))

    def star(heads: DataFrame) -> DataFrame:
        """Pairs of members with the head `a` of their bucket."""
        around = members.select("bucket", body.alias("b")).join(heads, "bucket")
        return around.where("a.node <> b.node").where(_may_reach(least)).select(*_ordered())

    prints = cut_lineage(known.groupBy("fp").agg(F.min("node").alias("id")))
    same = known.join(prints, "fp").where("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    linked = same.unionAll(links(prints, radius)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut_lineage(star(heads).unionAll(linked).distinct())
    wanted = cut_lineage(members.select("node").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct())
    path = scratch_path(spark, "near-copies")
    (
        docs.select(_node(F.col(text)).alias("node"), F.col(text).alias("body")).join(wanted, "node", "left_semi")
        .groupBy("node").agg(F.min("body").alias("body"))
        .mapInArrow(lambda batches: _sets(batches, width), SETS).write.parquet(path)
    )
    sets = spark.read.parquet(path)
    found = _verified(pairs, sets, least)

    degrees = cut_lineage(found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links")))
    popular = (
        members.join(degrees, "node").groupBy("bucket")
        .agg(F.max(F.struct("links", (-F.col("node")).alias("minus"), body.alias("a"))).alias("top")).select("bucket", "top.a")
    )
    second = star(cut_lineage(popular)).distinct().join(pairs, ["a", "b"], "left_anti")
    found = cut_lineage(found.unionAll(_verified(cut_lineage(second), sets, least)))
    roots = cut_lineage(components(found))

    # members of buckets that hold several components
    placed = cut_lineage(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart = cut_lineage(placed.join(several.select("bucket"), "bucket"))
    once = sets.join(apart.select("node").distinct(), "node", "left_semi").select("node", F.explode("members").alias("shingle"))
    once = once.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = cut_lineage(once.groupBy("node").agg(F.count("*").alias("own")))
    apart = cut_lineage(apart.join(own, "node", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
                        .join(sets.select("node", "fold", "spare"), "node"))
    member = F.struct("node", "size", "bits", "root", "shared", "fold", "spare")
    common = F.least("a.shared", "b.shared")
    rest = (
        apart.select("bucket", member.alias("a")).join(apart.select("bucket", member.alias("b")), "bucket")
        .where("a.node < b.node and a.root <> b.root").where(_may_reach(least))
        .where(common >= F.lit(least) * (F.col("a.size") + F.col("b.size") - common))
        .where(F.lit(1 + least) * (most_common() + F.lit(0.001)) >= F.lit(least) * (F.col("a.size") + F.col("b.size")))
        .select(*_ordered()).distinct()
    )
    more = _verified(cut_lineage(rest), sets, least)
    if not more.isEmpty():
        roots = cut_lineage(components(found.unionAll(more)))
    discard(spark, path)
    return roots


def first_of_each(
    docs: DataFrame, key: str, text: str, width: int = 5, radius: int = 3, least: float = 0.8
) -> DataFrame:
    """One row of `docs` of each group of near copies, that with the smallest `key`; columns as they are.

    Near copies have a shingle similarity of `least` or more, directly or through others. A null key comes
    after all others; of rows that are equal in key and words one stays.
    """
    rows = cut_lineage(nodes(docs, key, text, width))
    found = near_copies(docs, rows, text, width, radius, least)
    rooted = rows.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "node")).alias("b"))
    kept = cut_lineage(best.select("b.key", "b.node"))
    unsure = rows.where("key is null").select("key").limit(1).unionAll(
        rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 and key is not null").select("key")
    )
    unsure = cut_lineage(unsure)
    plain = docs.join(kept.join(unsure, "key", "left_anti").select(F.col("key").alias(key)), key, "left_semi")
    # keys that don't tell rows apart: rows go by key and text, and one of equal ones stays
    same = F.col("u.key").eqNullSafe(F.col(f"d.{key}"))
    some = docs.alias("d").join(unsure.alias("u"), same, "left_semi").withColumn("__node", _node(F.col(text)))
    chosen = kept.alias("u").select("key", "node")
    some = some.alias("d").join(
        chosen.alias("u"), (F.col("d.__node") == F.col("u.node")) & same, "left_semi"
    ).dropDuplicates(["__node", key]).select(*columns(docs))
    return plain.select(*columns(docs)).unionAll(some)
