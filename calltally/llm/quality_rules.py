"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text; the ledger keeps the measurements and one bit per failed rule.
A policy is a named version: the rules that reject. Policies are applied to stored ledgers with a
bitwise and, so changing a policy reads no text again, and an ablation (what would change if a rule
were left out) is an aggregation over the few distinct masks. All of it is DataFrame expressions
inside each row, without a shuffle; an ablation shuffles one row per mask and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice.

    Windows are compared by a 64-bit hash of their three words. Texts whose windows all differ stop
    there; otherwise hashes are sorted with their places, places of equal neighbours are marked, and
    the marked windows' union is counted from left to right.
    """

    def count(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def marked(order: Column) -> Column:
            n = F.size(order)
            same = F.zip_with(
                F.slice(order, F.lit(1), n - 1), F.slice(order, F.lit(2), n - 1), lambda a, b: a["h"] == b["h"]
            )
            before, after = F.concat(F.array(F.lit(False)), same), F.concat(same, F.array(F.lit(False)))
            either = F.zip_with(before, after, lambda a, b: a | b)
            found = F.zip_with(order, either, lambda x, m: F.when(m, x["i"]))
            return F.array_sort(F.filter(found, lambda i: i.isNotNull()))

        def union(at: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
            return F.reduce(
                at, start,
                lambda s, i: F.struct(
                    (s["n"] + i + 3 - F.greatest(s["to"], i.cast("long"))).alias("n"), (i.cast("long") + 3).alias("to")
                ),
            )["n"]

        total = _let(F.array_sort(places), lambda order: _let(marked(order), union))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0).cast("long"))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - 2)
        return F.transform(at, lambda k: F.xxhash64(F.element_at(w, k), F.element_at(w, k + 1), F.element_at(w, k + 2)))

    return _let(words, lambda w: F.when(F.size(w) >= 4, _let(windows(w), count)).otherwise(F.lit(0).cast("long")))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements of `text`; see `ledger`."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(value)
    return docs.withColumns({
        "__words": words, "__lines": lines, "__bare": F.regexp_replace(value, BLANK, ""), "__text": value,
    }).withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length("__bare").cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
    }).drop("__words", "__lines", "__bare", "__text")


# Every rule has a fixed bit; a rule that is no longer wanted keeps its bit and leaves the policies.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "10 * n_dup_lines > 5 * n_lines and n_lines > 3"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 25 * n_words"),
}
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols"],
    "v2": ["few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"],
}


def mask(rules: list[str]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, failed): one row per row of `docs`, `failed` has the bit of each failed rule.

    Null and empty texts, and texts of white space, have no words and fail by the rules' own
    comparisons. Repeated rows stay repeated.
    """
    measured = measures(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__source")), "__source").drop("__source")
    failed = F.lit(0).cast("long")
    for bit, rule in RULES.values():
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def fails(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablation(ledgers: DataFrame, policy: str) -> DataFrame:
    """(rule, rejected, only): texts that fail each rule of a policy, and those that no other rule rejects."""
    masks = ledgers.groupBy(F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("m")).count()
    rules = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy]
    ])
    return (
        masks.select("m", "count", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only"),
        )
    )
