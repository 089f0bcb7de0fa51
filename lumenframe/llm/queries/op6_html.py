"""Every page's main text and its length in code points."""

from pyspark.sql import functions as F

from lumenframe.llm import html_text
from lumenframe.llm.common import table

ORACLE_SQL = None


def query(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
