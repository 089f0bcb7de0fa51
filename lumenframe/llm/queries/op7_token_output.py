"""Every document in packed id matrices: one row per matrix, its binaries as checksums."""

from pyspark.sql import functions as F

from lumenframe.llm import token_output
from lumenframe.llm.common import table

ORACLE_SQL = None


def query(spark, sf_dir):
    blocks = token_output.matrices(table(spark, sf_dir, "documents"))
    return blocks.select(
        "block_id", "n_rows", "width", "n_tokens", F.size("segment_docs").cast("bigint").alias("n_segments"), "segment_docs", "segment_starts",
        *[F.crc32(c).alias(f"{c}_crc32") for c in ("ids", "cu_seqlens", "row_segments", "positions")],
    )
