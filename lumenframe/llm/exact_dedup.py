"""Exact deduplication, native.

Rows are grouped by a 128-bit content hash (MD5) and, inside that, by the text itself, so the
grouping compares bytes and a hash collision can't merge two texts. The grouping combines on the
map side: a text that fills a third of the table reaches a reducer once per map task. What each
document is told (the row that stays, the group's size) travels back on the digests alone, so
texts are shuffled once.

Defined cases: a null text counts as empty. A null id never wins while its group has another id;
a group of null ids only keeps its null. Rows that repeat both id and text count as the same
document: each is reported, and deduplicate() keeps one of them. An empty table gives no rows.
Extra columns are untouched by deduplicate() and ignored by exact_groups(). Two different texts
with equal MD5 *and* equal SHA-256 stop the job instead of giving a wrong answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lumenframe.llm.common import text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits, as binary."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: which id stays, max or min."""
    chosen = {"max": F.max, "min": F.min}[keep]
    text = text_or_empty(text_col)
    digests = [content_hash(text).alias("h"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("s")]
    rows = docs.select(F.col(id_col).alias("doc_id"), *digests, text.alias("t"))
    classes = rows.groupBy("h", "s", "t").agg(chosen("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    told = (
        classes.groupBy("h", "s")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("k"))
        .withColumn("group_size", F.when(F.col("k") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256"))))
        .drop("k")
    )
    return rows.drop("t").join(told, ["h", "s"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )


def _orderable(kind) -> bool:
    if isinstance(kind, MapType):
        return False
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return kind.typeName() != "variant"


def deduplicate(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row that stays of each group of equal texts, all its columns as they were; one text shuffle."""
    pick = {"max": F.max_by, "min": F.min_by}[keep]
    text = text_or_empty(text_col)
    others = [c for c in docs.columns if c != text_col]
    stable = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text_col and _orderable(f.dataType)]
    missing = F.col(id_col).isNull()
    ahead = missing if keep == "min" else ~missing
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNull().alias("no_text"))
    best = docs.groupBy(content_hash(text).alias("__h"), text.alias("__t")).agg(
        pick(row, F.struct(ahead, F.col(id_col), F.xxhash64(*stable), F.col(text_col).isNotNull())).alias("__r")
    )
    place = {c: F.col(f"__r.c{i}") for i, c in enumerate(others)}
    place[text_col] = F.when(~F.col("__r.no_text"), F.col("__t"))
    return best.select(*[place[c].alias(c) for c in docs.columns])


ORACLE_SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (
  SELECT doc_id,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
         sha256(coalesce(text, '')) AS text_sha256
  FROM documents
)
"""
