"""Sinks: binary columns to files, and text dumps.

Files are written by the tasks that hold the rows, under a task-attempt name first and renamed
when whole, so that a retried task leaves no half-written file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import curves


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> None:
    """One file a row, under its relative name, in a folder that every executor shares (a mounted file system).

    Rows with null content are left out; names that lead out of the folder, and names given twice, are errors.
    """
    whole = rows.where(F.col(content).isNotNull())
    if not whole.groupBy(F.col(name).cast("string").alias("n")).count().where("count > 1").isEmpty():
        raise ValueError("several rows have one name")

    def put(part) -> None:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for row in part:
            target = os.path.normpath(os.path.join(folder, row[0]))
            if not target.startswith(os.path.normpath(folder) + os.sep):
                raise ValueError(f"{row[0]} leads out of the folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            made = f"{target}.{uuid.uuid4().hex}.part"
            with open(made, "wb") as f:
                f.write(row[1])
            os.replace(made, target)

    whole.select(F.col(name).cast("string"), content).foreachPartition(put)


def parameters_json(rows: DataFrame, columns: list[str], out: str = "json") -> DataFrame:
    """The named columns as one JSON text; nested structs, arrays and maps stay nested."""
    return rows.withColumn(out, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def curve_dump(spark: SparkSession) -> DataFrame:
    """value: `index: value` of the encoder's curve, four digits each, one row a table entry."""
    return curves.curve_table(spark, curves.log_encode, "e").orderBy("i").select(F.format_string("%04d: %04d", "i", "e").alias("value"))
