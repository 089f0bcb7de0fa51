"""Every document without the bytes of 100-byte strings that start earlier elsewhere."""

from pyspark.sql import functions as F

from lumenframe.llm import repeats
from lumenframe.llm.common import table

ORACLE_SQL = None


def query(spark, sf_dir):
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
