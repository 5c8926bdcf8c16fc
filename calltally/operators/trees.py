"""Span trees of any depth, by pointer doubling over parent links.

Every span points at an ancestor, its parent at first. A round lets each unfinished span take over the
pointer of the span it points at, so distances double and a tree of depth d is done after log2(d)
rounds. Steps and times along the way are summed with the pointers. A round finishes some span as
long as any can still reach a root; when one finishes none, the rest lie on or below a cycle. Spans
without children are nobody's ancestor and take their parent's result once, after the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltally.functions import times
from calltally.session import scratch_path

# Up to this many spans per shuffle partition, joins hash the side with one row an id instead of sorting both.
HASHED_ROWS = 1_500_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written once as a table and read from there; a checkpoint would compute it twice."""
    path = scratch_path(df.sparkSession, "trees")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def span_paths(traces: DataFrame) -> DataFrame:
    """(id, root_id, depth, duration_ms, self_ms, path_ms, kind) of every span.

    self_ms is the duration without that of the direct children, at least zero; path_ms adds it up from
    the root to the span. A span whose parent is not there is a root of kind `orphan`, other spans are
    `span` or `root`; those on or below a cycle are `cycle` and have no root, depth or path. Ids are
    distinct; spans without an id are left out. Children are folded before the join, so a parent with
    very many of them arrives as one row; tables are stored before they are joined, so that adaptive
    execution can split the pointers to one span.
    """
    timed = traces.where(F.col("id").isNotNull()).select(
        "id", F.col("parent_trace_id").alias("parent"),
        F.coalesce(times.elapsed_ms(F.col("start_time"), F.col("end_time")), F.lit(0.0)).alias("duration_ms"),
    )
    timed = cut_lineage(timed)
    share = timed.count() / int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(right: DataFrame) -> DataFrame:
        return right.hint("shuffle_hash") if share <= HASHED_ROWS else right

    # of a span that is its own parent only its other children count, but it stays a parent
    below = timed.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.sum(F.when(F.col("parent") != F.col("id"), F.col("duration_ms"))).alias("child_ms"), F.lit(True).alias("inner")
    )
    own = F.greatest(F.col("duration_ms") - F.coalesce("child_ms", F.lit(0.0)), F.lit(0.0))
    spans = cut_lineage(timed.join(keyed(below), "id", "left").withColumn("self_ms", own).drop("child_ms"))
    there = spans.where("inner").select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    linked = cut_lineage(spans.join(keyed(there), "parent", "left").select(
        "id", "duration_ms", "self_ms", "inner", F.when(F.col("known"), F.col("parent")).alias("at"),
        F.when(F.col("parent").isNull(), "root").when(F.col("known"), "span").otherwise("orphan").alias("kind"),
    ))
    # root: the span is done; otherwise `at` is the ancestor it points at, with steps and time up to there
    done = linked.where("at is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("steps"), F.col("self_ms").alias("ms"))
    below_root = linked.where("at is not null").select("id", "at", F.lit(1).cast("long").alias("steps"), F.col("self_ms").alias("ms"), "inner")
    open_, leaves = below_root.where("inner").drop("inner"), below_root.where("inner is null").drop("inner")
    left = open_.count()
    while left:
        ends = done.select(F.col("id").alias("at"), "root", F.lit(None).cast("string").alias("next"), F.col("steps").alias("s"), F.col("ms").alias("m"))
        hops = open_.select(F.col("id").alias("at"), F.lit(None).cast("string").alias("root"), F.col("at").alias("next"), F.col("steps").alias("s"), F.col("ms").alias("m"))
        moved = cut_lineage(open_.join(keyed(ends.unionByName(hops)), "at").select(
            "id", "root", F.col("next").alias("at"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("ms") + F.col("m")).alias("ms")
        ))
        fresh, open_ = moved.where("root is not null"), moved.where("root is null").select("id", "at", "steps", "ms")
        done = done.unionByName(fresh.select("id", "root", "steps", "ms"))
        before, left = left, open_.count()
        if left == before:
            break
    tops = done.select(F.col("id").alias("at"), "root", F.col("steps").alias("s"), F.col("ms").alias("m"))
    done = done.unionByName(leaves.join(keyed(tops), "at").select(
        "id", "root", (F.col("steps") + F.col("s")).alias("steps"), (F.col("ms") + F.col("m")).alias("ms")
    ))
    return linked.join(keyed(done), "id", "left").select(
        "id", F.col("root").alias("root_id"), F.col("steps").alias("depth"), "duration_ms", "self_ms", F.col("ms").alias("path_ms"),
        F.when(F.col("root").isNull(), "cycle").otherwise(F.col("kind")).alias("kind"),
    )


def trace_trees(traces: DataFrame) -> DataFrame:
    """One row for each tree: spans, depth, total and critical time, and the span that ends the critical path.

    The critical path is the one from the root whose own times add up to most; of several, that with the
    smallest last id. Spans on or below cycles are one row without a root.
    """
    paths = span_paths(traces)
    deepest = F.max(F.struct("path_ms", "depth")).alias("_far")
    sums = paths.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("spans"), F.max("depth").alias("depth"), F.sum("self_ms").alias("self_ms"), deepest,
        F.min(F.struct((-F.col("path_ms")).alias("far"), "id")).alias("_end"),
        F.max(F.when(F.col("kind") == "orphan", 1).otherwise(0)).alias("orphan"),
    )
    rooted = F.col("root_id").isNotNull()
    return sums.select(
        "root_id", "spans", "depth", "self_ms", F.col("_far.path_ms").alias("critical_ms"),
        F.when(rooted, F.col("_end.id")).alias("critical_end"),
        F.when(~rooted, "cycle").when(F.col("orphan") == 1, "orphan").otherwise("root").alias("kind"),
    )
