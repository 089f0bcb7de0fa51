"""The mix of `documents` for a budget of three fifths of all tokens: one row per document taken."""

from pyspark.sql import functions as F

from lumenframe.llm import mixing
from lumenframe.llm.common import table

ORACLE_SQL = mixing.oracle_sql()


def query(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "row.doc_id",
        "domain",
        F.coalesce("row.lang", F.lit("")).alias("lang"),
        F.coalesce("row.source", F.lit("")).alias("source"),
        F.col("tokens").alias("n_tokens"),
        F.col("budget").alias("leaf_budget"),
        F.col("copies").cast("bigint").alias("copies"),
    )
