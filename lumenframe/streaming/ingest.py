"""Files as they arrive: the batch operators over a binaryFile stream, and running statistics of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.container import tags_of

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """New files of a folder, at most per_trigger in a micro-batch, so that content held at once is bounded."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)


def arriving_tags(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """Tag rows of containers as they arrive; stateless, so no watermark is needed."""
    return tags_of(arriving(spark, folder, glob, per_trigger))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and type; state older than the watermark goes, events later than that are left out."""
    return (
        events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.floor("value")).alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "events", "value")
    )
