"""Planes taller than the part that one task transforms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators import wavelet


def plane_rows(spark, planes):
    rows = [pd.DataFrame({"image_id": image, "channel": channel, "row": np.indices(x.shape)[0].ravel(), "col": np.indices(x.shape)[1].ravel(), "v": x.ravel()}) for (image, channel), x in planes.items()]
    return spark.createDataFrame(pd.concat(rows).astype("int32").sample(frac=1, random_state=1))


@pytest.mark.parametrize("height", [479, 500, 513, 530, 545, 1024, 1071])
def test_parts_give_the_bands_of_the_whole_plane(spark, height):
    rng = np.random.default_rng(height)
    planes = {(0, 0): rng.integers(0, 4096, (height, 24)), (0, 2): rng.integers(0, 4096, (height, 24)), (7, 0): rng.integers(0, 4096, (41, 27))}
    found = wavelet.pyramid(plane_rows(spark, planes)).toPandas()
    n = 0
    for (image, channel), plane in planes.items():
        for level in range(3):
            bands = arrays.forward_2d(plane, wavelet.PRESCALE[level])
            plane = bands[0]
            for b in range(0 if level == 2 else 1, 4):
                own = found[(found.image_id == image) & (found.channel == channel) & (found.level == level) & (found.band == b)].sort_values(["row", "col"])
                assert (own[["row", "col"]].to_numpy() == np.argwhere(np.ones(bands[b].shape))).all() and (own.v.to_numpy() == bands[b].ravel()).all()
                n += len(own)
    assert n == len(found)


@pytest.mark.parametrize("lost", [(3, 3), (511, 5), (700, 0), (1099, 23)])
def test_missing_samples_are_an_error(spark, lost):
    rows = plane_rows(spark, {(0, 0): np.zeros((1100, 24), int)})
    with pytest.raises(Exception, match="samples, not"):
        wavelet.pyramid(rows.where(~((F.col("row") == lost[0]) & (F.col("col") == lost[1])))).count()


@pytest.mark.parametrize("gap", [(0, 9), (480, 1023), (500, 520), (512, 1535)])
def test_missing_lines_are_an_error(spark, gap):
    rows = plane_rows(spark, {(0, 0): np.zeros((1600, 24), int)})
    with pytest.raises(Exception, match="samples, not"):
        wavelet.pyramid(rows.where(~F.col("row").between(*gap))).count()


def test_a_plane_is_dealt_to_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = wavelet.pyramid(plane_rows(spark, {(0, 0): np.zeros((4000, 24), int)}))
        assert done.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
