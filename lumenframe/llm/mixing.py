"""Mixing sources to target weights, native: hierarchical budgets over a domain-language-source tree.

A token budget goes down the tree. Among siblings it is shared by weight; a child that holds less
than its share is filled and what it can't take goes to its siblings, and only when a whole family
is full does the surplus reach the parent's siblings (a node's capacity is the sum over its
leaves). Each leaf then takes whole passes (epochs) over its documents and, of one more pass, the
longest prefix in that epoch's seeded order whose tokens fit.

The prefix of a leaf is found without sorting the leaf: tokens are summed per hash bucket of the
order key, a running sum over buckets finds the one where the budget ends, and only its rows are
ordered. A leaf with a third of all rows costs no task more than any other.

Defined cases: tokens are UTF-8 bytes / 4 rounded up, at least 1 (a null or empty text: 1), unless
a token column is given. Very long texts count whole. docs must have the columns lang and source (an
error otherwise); other columns, whatever their names, pass through. Null languages and sources form the leaf ''. Rows with equal ids share an
order key and are taken or left together. Null ids share one key. An empty table gives no rows.
Integer arithmetic only, so results don't depend on the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize


@dataclass(frozen=True)
class Targets:
    """Integer weights by name at each level; names that aren't listed weigh `other`."""

    domains: dict[str, int] = field(default_factory=lambda: {"group0": 4, "group1": 3, "group2": 2, "group3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1

    def unit(self) -> int:
        """The least common multiple of all weights."""
        return lcm(self.other, *self.domains.values(), *self.languages.values(), *self.sources.values())


def default_domain(source: Column) -> Column:
    """group0..group3 by the number a source's name ends with; 'other' without one."""
    digits = F.regexp_extract(source, "[0-9]{1,9}$", 0)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("group"), (F.nullif(digits, F.lit("")).cast("bigint") % 4).cast("string")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("bigint"))


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("bigint")


def share_among_siblings(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Adds alloc: `budget` (equal in a family) shared by `w`, no node above `cap`. Needs columns w, cap, budget and unit (a multiple of every w, so that cap / w compares as whole numbers)."""
    whole = Window.partitionBy(*family)
    order = whole.orderBy(F.expr("cast(cap as decimal(38, 0)) * (unit div w)"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ranked = nodes.select(
        "*",
        F.coalesce(F.sum("cap").over(before), zero).alias("cap_before"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero)).alias("w_from"),
    ).withColumn("full", F.col("cap") * F.col("w_from") + F.col("cap_before") * F.col("w") <= F.col("budget") * F.col("w"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(whole)
    w_left = F.sum(F.when(F.col("full"), zero).otherwise(F.col("w"))).over(whole)
    return (
        ranked.withColumn("left", left)
        .withColumn("w_left", w_left)
        .withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("left * w div nullif(w_left, 0)")))
        .drop("cap_before", "w_from", "full", "left", "w_left")
    )


def leaf_budgets(leaves: DataFrame, targets: Targets, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds budget, whole (epochs) and rest (tokens of the next epoch)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    num, den = share
    unit = F.lit(targets.unit()).cast("bigint").alias("unit")
    domains = (
        leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        .withColumn("root", F.lit(0))
        .withColumn("budget", F.expr(f"sum(tokens) over (partition by root) * {num} div {den}"))
        .withColumn("budget", F.expr("least(budget, sum(cap) over (partition by root))"))
        .withColumn("w", _weight(F.col("domain"), targets.domains, targets.other)).select("*", unit)
    )
    domains = share_among_siblings(domains, ["root"], "domain").select("domain", F.col("alloc").alias("budget"))
    langs = (
        leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
        .join(domains, "domain")
        .withColumn("w", _weight(F.col("lang"), targets.languages, targets.other)).select("*", unit)
    )
    langs = share_among_siblings(langs, ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    sources = leaves.join(langs, ["domain", "lang"]).withColumn("w", _weight(F.col("source"), targets.sources, targets.other)).select("*", unit)
    return share_among_siblings(sources, ["domain", "lang"], "source").select(
        "domain", "lang", "source", "tokens",
        F.col("alloc").alias("budget"),
        F.expr("alloc div tokens").alias("whole"),
        F.expr("alloc % tokens").alias("rest"),
    )


LEAF = ["domain", "lang", "source"]
BUCKET_DIGITS = 4


def mix(
    docs: DataFrame,
    targets: Targets = Targets(),
    share: tuple[int, int] = (3, 5),
    max_epochs: int = 4,
    seed: int = 17,
    domain=default_domain,
    tokens=None,
    id_col: str = "doc_id",
) -> DataFrame:
    """row (all columns of docs), domain, tokens, budget (of the leaf) and copies (how often the mix holds the row; rows with 0 are left out).

    share: the total budget as a fraction of all tokens. max_epochs: how often a document may be repeated.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.col(tokens) if tokens else token_estimate(F.col("text"))).cast("bigint").alias("n"),
    ).withColumn("domain", domain(F.col("source")))
    leaves = narrow.groupBy(*LEAF).agg(F.sum("n").alias("tokens"))
    # One row a leaf, as written tables: Spark knows their size, broadcasts them while that is small and else joins by sorting.
    budgets = materialize(leaf_budgets(leaves, targets, share, max_epochs), "leaf-budgets")

    def order_key(epoch: Column, ident: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"))

    keyed = narrow.join(budgets.where("rest > 0").select(*LEAF, "whole", "rest"), LEAF).select(
        *LEAF, "n", "rest", order_key(F.col("whole"), F.col("id")).alias("key")
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    up_to = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy(*LEAF, "bucket", "rest").agg(F.sum("n").alias("n"))
    ends = (
        sums.withColumn("upto", F.sum("n").over(up_to))
        .where("upto > rest")
        .groupBy(*LEAF)
        .agg(F.min("bucket").alias("cut_bucket"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("base"))
    )
    ends = materialize(ends, "leaf-ends")
    in_cut = keyed.join(ends, LEAF).where("bucket = cut_bucket")
    running = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = in_cut.withColumn("upto", F.col("base") + F.sum("n").over(running)).where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("cut_key"))
    plan = (
        budgets.join(ends.select(*LEAF, "cut_bucket"), LEAF, "left")
        .join(cuts, LEAF, "left")
        .select(*LEAF, "budget", "whole", "rest", F.coalesce("cut_key", "cut_bucket").alias("cut"))
    )
    plan = materialize(plan, "leaf-plan")
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        domain(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("domain"),
        (F.col(tokens) if tokens else token_estimate(F.col("text"))).cast("bigint").alias("n"),
    )
    taken = (F.col("rest") > 0) & (order_key(F.col("whole"), F.col(f"row.{id_col}")) <= F.col("cut"))
    return (
        marked.join(plan, LEAF)
        .withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0))
        .where("copies > 0")
        .select(F.col("row"), F.col("domain"), F.col("n").alias("tokens"), "budget", "copies")
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it was taken, columns as they were."""
    mixed = mix(docs, **how)
    if how.get("max_epochs", 4) > 1:
        mixed = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select("row.*")


def _case(column: str, weights: dict[str, int], other: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END" if weights else str(other)


def _shared(nodes: str, family: str, name: str, unit: int) -> str:
    return f"""
  SELECT *, CASE WHEN fits THEN cap ELSE (budget - sum(CASE WHEN fits THEN cap ELSE 0 END) OVER (PARTITION BY {family}))::BIGINT * w
      // nullif((sum(CASE WHEN fits THEN 0 ELSE w END) OVER (PARTITION BY {family}))::BIGINT, 0) END AS alloc
  FROM (
    SELECT *, cap * w_from + cap_before * w <= budget * w AS fits
    FROM (
      SELECT *, coalesce(sum(cap) OVER (PARTITION BY {family} ORDER BY cap::HUGEINT * ({unit} // w), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
        (sum(w) OVER (PARTITION BY {family}) - coalesce(sum(w) OVER (PARTITION BY {family} ORDER BY cap::HUGEINT * ({unit} // w), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS w_from
      FROM {nodes}))"""


def oracle_sql(targets: Targets = Targets(), share: tuple[int, int] = (3, 5), max_epochs: int = 4, seed: int = 17) -> str:
    num, den = share
    return f"""
WITH narrow AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    greatest(1, (strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS n, regexp_extract(coalesce(source, ''), '[0-9]{{1,9}}$') AS digits
  FROM documents),
d AS (SELECT *, CASE WHEN digits = '' THEN 'other' ELSE 'group' || (digits::BIGINT % 4)::VARCHAR END AS domain FROM narrow),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {max_epochs})::BIGINT AS cap FROM d GROUP BY ALL),
dom0 AS (SELECT domain, sum(cap)::BIGINT AS cap, sum(tokens)::BIGINT AS tokens, 0 AS root, {_case('domain', targets.domains, targets.other)}::BIGINT AS w FROM leaves GROUP BY domain),
dom1 AS (SELECT *, least((sum(tokens) OVER ())::BIGINT * {num} // {den}, (sum(cap) OVER ())::BIGINT) AS budget FROM dom0),
dom AS ({_shared('dom1', 'root', 'domain', targets.unit())}),
lang0 AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value(dom.alloc)::BIGINT AS budget, {_case('l.lang', targets.languages, targets.other)}::BIGINT AS w
  FROM leaves l JOIN dom USING (domain) GROUP BY l.domain, l.lang),
lng AS ({_shared('lang0', 'domain', 'lang', targets.unit())}),
src0 AS (SELECT l.*, lng.alloc AS budget, {_case('l.source', targets.sources, targets.other)}::BIGINT AS w FROM leaves l JOIN lng USING (domain, lang)),
src AS ({_shared('src0', 'domain, lang', 'source', targets.unit())}),
budgets AS (SELECT domain, lang, source, alloc AS budget, alloc // tokens AS whole, alloc % tokens AS rest FROM src),
keyed AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.n, b.budget, b.whole, b.rest,
    md5('{seed}:' || b.whole::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, 'null')) AS key
  FROM d JOIN budgets b USING (domain, lang, source)),
cum AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, n AS n_tokens, budget AS leaf_budget, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM cum WHERE whole > 0 OR upto <= rest
"""
