"""Every document's secrets: counts and digest of the base kinds, and all spans."""

from pyspark.sql import functions as F

from lumenframe.llm import secrets
from lumenframe.llm.common import table

ORACLE_SQL = None


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in secrets.BASE]))
    return found.select(
        "doc_id",
        *[count(r.name).alias(f"n_{r.name}") for r in secrets.BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
