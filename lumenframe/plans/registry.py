"""Where queries and the SQL they are checked against are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None):
    def keep(f: Callable) -> Callable:
        FOUND[name] = (f, sql)
        return f

    return keep


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    whole = ("int", "smallint", "tinyint", "bigint")
    return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in whole else F.col(f"`{c}`") for c, t in df.dtypes])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
