"""Every document, with the row that stays of its group of equal texts (the largest doc_id)."""

from lumenframe.llm import exact_dedup
from lumenframe.llm.common import table

ORACLE_SQL = exact_dedup.ORACLE_SQL


def query(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")
