"""Every document's token ids packed into sequences of at most 1024: one row per piece."""

from pyspark.sql import functions as F

from lumenframe.llm import packing
from lumenframe.llm.common import table

ORACLE_SQL = None


def query(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
