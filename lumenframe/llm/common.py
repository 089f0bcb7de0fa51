"""What the corpus operators share: tables, durable intermediate results, and shipping of this package."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lumenframe

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and driver and executors are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lumenframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenframe-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    made = spark.read.schema(schema).parquet(path)
    made._lumenframe_path = path
    return made


def discard(*made: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no plan needs any more."""
    for df in made:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lumenframe_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that functions pickled by name are found there."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenframe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(lumenframe.__file__)))
    made = tempfile.mkdtemp(prefix="lumenframe-")
    sc.addPyFile(shutil.make_archive(os.path.join(made, "lumenframe_pkg"), "zip", root, "lumenframe"))
    sc._lumenframe_shipped = True


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which Arrow gives back the memory that it keeps for more batches: a worker outlives its tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
