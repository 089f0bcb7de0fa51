"""Every document with its SimHash and the smallest doc_id reachable over links of at most 4 bits."""

from lumenframe.llm import simhash
from lumenframe.llm.common import table

ORACLE_SQL = None


def query(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
