"""URL verdicts from rules and from a tree of path templates.

Rules name a host with its subdomains and a path prefix; the longest that fits decides, and its
verdict also labels the url. The rest is decided by templates learnt from these labels, per host:

1. A path becomes a chain of segments; numbers, hex strings, dates and such become wildcards by their form.
2. From the root downwards, a node with many different children, none of them frequent, has a variable
   segment there: its children become one wildcard.
3. Sibling branches whose share of blocked labels doesn't differ significantly from that of all their
   siblings' together are merged into one branch.
4. A template (merged branch) is rejected if the blocked share of its labels, smoothed towards a low
   prior, reaches `purity`. A template without labels stays.

Everything is DataFrame expressions. Urls are first folded to distinct (host, path form) with counts, so
a host with very many pages costs one row per form afterwards; per level there is one aggregation over
forms. Nothing is collected, and nothing is broadcast beyond what the planner's own threshold allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally.session import cut_lineage

DEPTH = 4
MANY = 12  # different children that make a node's next segment variable
FREQUENT = 0.2  # a child with this share of its node's urls stays a literal
Z = 1.96
PRIOR_BLOCKED, PRIOR_ALLOWED = 1.0, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    A rule `example.net/en/` fits the host, or a subdomain, and paths that start with `/en/`.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def form_of(segment: Column) -> Column:
    """A segment with what varies by form as a wildcard; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(ending))
    shape = (
        F.when(stem.rlike(r"^\d+$"), "{n}")
        .when(stem.rlike(r"^\d{1,4}-\d{1,2}(-\d{1,4})?$"), "{date}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike(r"\d"), "{hex}")
        .when(stem.rlike(r"\d{3,}"), F.regexp_replace(stem, r"\d{3,}", "{n}"))
        .when(F.length(stem) > 60, "{long}")
        .otherwise(stem)
    )
    return F.concat(shape, ending)


def forms(path: Column, depth: int = DEPTH) -> Column:
    """The first `depth` segments by form; what lies deeper is one more wildcard."""
    parts = F.array_remove(F.split(path, "/"), "")
    head = F.transform(F.slice(parts, 1, depth), form_of)
    return F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("{rest}")))).otherwise(head)


def templates(folded: DataFrame, depth: int = DEPTH, many: int = MANY, frequent: float = FREQUENT) -> DataFrame:
    """`folded` (host, form, n, blocked, allowed) with its `template`: variable and merged segments replaced."""
    tree = folded.withColumn("template", F.lit("").cast("string"))
    for level in range(1, depth + 1):
        child = F.when(F.size("form") >= level, F.element_at("form", level))
        here = tree.withColumn("child", child)
        branches = here.groupBy("host", "template", "child").agg(
            F.sum("n").alias("cn"), F.sum("blocked").alias("cb"), F.sum("allowed").alias("ca")
        )
        # the node's totals; a branch counts as frequent by its share of the node
        nodes = branches.groupBy("host", "template").agg(
            F.sum("cn").alias("nn"), F.sum("cb").alias("nb"), F.sum("ca").alias("na"),
            F.count("child").alias("children"),
        )
        labelled = F.col("cb") + F.col("ca")
        share = F.col("nb") / (F.col("nb") + F.col("na"))
        spread = F.sqrt(share * (1 - share) / labelled)
        alike = (labelled > 0) & (F.abs(F.col("cb") / labelled - share) <= Z * spread + 1e-9)
        variable = (F.col("children") >= many) & (F.col("cn") < frequent * F.col("nn"))
        step = (
            F.when(F.col("child").isNull(), F.lit(""))
            .when(variable, F.lit("/*"))
            .when(alike, F.lit("/~"))
            .otherwise(F.concat(F.lit("/"), F.col("child")))
        )
        # nulls mark paths that ended above; they meet under an empty step
        chosen = branches.join(nodes, ["host", "template"]).select(
            "host", "template", F.coalesce("child", F.lit("")).alias("key"), step.alias("step")
        )
        tree = cut_lineage(
            here.withColumn("key", F.coalesce("child", F.lit("")))
            .join(chosen, ["host", "template", "key"])
            .select("host", "form", "n", "blocked", "allowed", F.concat("template", "step").alias("template"))
        )
    return tree


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", purity: float = 0.5,
) -> DataFrame:
    """`pages` with host, path, rule, template, score and verdict (columns of these names are replaced).

    Null urls and urls without `://` have an empty host and path. A verdict is the rule's, else block
    if the template's smoothed purity reaches `purity`, else allow. An empty table gives no rows.
    """
    address = F.col(f"`{url}`")
    taken = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "template", "score", "verdict")]
    named = pages.select(*[F.col(f"`{c}`") for c in taken], host_of(address).alias("host"), path_of(address).alias("path"))
    named = named.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("__form", forms(F.col("path")))
    folded = named.groupBy("host", F.col("__form").alias("form")).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("__rule.verdict") == "block", 1)).alias("blocked"),
        F.count(F.when(F.col("__rule.verdict") == "allow", 1)).alias("allowed"),
    )
    tree = templates(folded)
    pure = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).select(
        "host", "template",
        ((F.col("b") + PRIOR_BLOCKED) / (F.col("b") + F.col("a") + PRIOR_BLOCKED + PRIOR_ALLOWED)).alias("score"),
    )
    known = tree.join(pure, ["host", "template"]).select("host", F.col("form").alias("__form"), "template", "score")
    return named.join(known, ["host", "__form"]).select(
        *[F.col(f"`{c}`") for c in taken], "host", "path", F.col("__rule.rule").alias("rule"), "template", "score",
        F.coalesce("__rule.verdict", F.when(F.col("score") >= purity, "block").otherwise("allow")).alias("verdict"),
    )
