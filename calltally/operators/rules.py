"""Named regex rules with weights, turned into plain columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Case-insensitive, dot matches line ends, Unicode case folding and character classes.
_FLAGS = "(?isuU)"


@dataclass
class RuleSet:
    """Rules in the order they were added: (name, regex, weight)."""

    rules: list[tuple[str, str, float]] = field(default_factory=list)

    def add(self, name: str, regex: str, weight: float = 1.0) -> RuleSet:
        self.rules.append((name, regex, float(weight)))
        return self

    def hits(self, text: Column) -> Column:
        """One character per rule, '1' where it matched; a missing text matches nothing.

        Kept as text because the planner copies array elements into every place that uses them,
        and each copy would run its pattern again.
        """
        if not self.rules:
            return F.lit("")
        return F.concat(
            *[
                F.when(text.rlike(_FLAGS + regex), "1").otherwise("0")
                for _, regex, _ in self.rules
            ]
        )

    def matches(self, hits: Column) -> Column:
        """Map from rule name to whether the rule matched."""
        if not self.rules:
            return F.create_map().cast("map<string,boolean>")
        entries = []
        for at, (name, _, _) in enumerate(self.rules):
            entries += [F.lit(name), _hit(hits, at)]
        return F.create_map(*entries)

    def score(self, hits: Column) -> Column:
        """Matched weight over total weight, 4 decimals; no weight gives 0."""
        total = sum(weight for _, _, weight in self.rules)
        if total <= 0:
            return F.lit(0.0)
        matched = F.lit(0.0)
        for at, (_, _, weight) in enumerate(self.rules):
            matched = matched + F.when(_hit(hits, at), weight).otherwise(0.0)
        return F.round(matched / total, 4)


def _hit(hits: Column, at: int) -> Column:
    return F.substring(hits, at + 1, 1) == "1"


def evaluate_rules(df: DataFrame, rules: RuleSet, text: str) -> DataFrame:
    """Add `rule_matches` and `weighted_score`; every pattern runs once per row."""
    flagged = df.withColumn("_hits", rules.hits(F.col(text)))
    return flagged.withColumns(
        {
            "rule_matches": rules.matches(F.col("_hits")),
            "weighted_score": rules.score(F.col("_hits")),
        }
    ).drop("_hits")


def rule_hit_rates(df: DataFrame, rules: RuleSet, text: str) -> DataFrame:
    """Per rule: matched rows and their share; one scan, no row leaves as more than a flag."""
    names = [name for name, _, _ in rules.rules]
    flagged = df.select(rules.hits(F.col(text)).alias("_hits"))
    counted = flagged.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(_hit(F.col("_hits"), at), 1)).alias(n) for at, n in enumerate(names)],
    )
    return counted.unpivot(["_rows"], names, "rule", "hits").select(
        "rule",
        "hits",
        F.round(F.when(F.col("_rows") == 0, 0.0).otherwise(
            F.col("hits") / F.nullif(F.col("_rows"), F.lit(0))
        ), 4).alias("hit_rate"),
    )
