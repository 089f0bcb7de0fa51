"""Every document's toxicity score and the class it gives."""

from lumenframe.llm import toxicity
from lumenframe.llm.common import table

ORACLE_SQL = None


def query(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
