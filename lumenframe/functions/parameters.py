"""Defaults of an image's parameters and what follows from them; a maker and a model are the caller's to give."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parameter defaults, by group. Rationals are (numerator, denominator).
EXIF = {
    "exposure_time": (1, 60), "exposure_bias": (0, 1), "f_stop_number": (2800, 1000), "aperture": (int(log(2.8) / log(sqrt(2.0)) * 1000), 1000), "focal_length": (3, 1), "digital_zoom": (1, 1),
    "focal_length_in_35mm_film": 15, "iso_speed_rating": 232, "date_time_original": "2016-3-25 15:55:23", "date_time_digitized": "2016-3-25 15:55:23", "user_comment": "",
}
PROFILE = {
    "compute_color_matrix": True, "matrix_weighting": 1.0, "illuminant1": 3, "illuminant2": 23, "wb1": (1.3396, 1.0, 2.780029), "wb2": (1.9036, 1.0, 1.7483),
    "cam_to_srgb_1": (1.2963, -0.2025, -0.0939, -0.4789, 1.5728, -0.0939, -0.1007, -0.7605, 1.8612),
    "cam_to_srgb_2": (1.558, -0.3019, -0.2561, -0.3023, 1.6328, -0.3305, -0.0365, -0.5127, 1.5492),
}
TUNING = {
    "static_black_level": (0, 0, 0, 0), "dgain_saturation_level": (16383, 16383, 16383, 16383), "wb_gains": (6273 / 4096, 1.0, 8371 / 4096), "iso_value": 228, "shutter_time": 34952, "pixel_format": "rggb14",
}
CHANNELS = ("red", "green_even", "green_odd", "blue")
QUALITY = {False: "fs1", True: "medium"}  # by fast_encoding


def flat() -> list[tuple[str, str, int, str]]:
    """(group, name, index, value as text) of every default."""
    rows = []
    for group, values in (("exif", EXIF), ("profile", PROFILE), ("tuning", TUNING)):
        for name, value in values.items():
            for i, x in enumerate(value if isinstance(value, tuple) else (value,)):
                rows.append((group, name, i, f"{x:.6f}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x)))
    return rows


def defaults(spark) -> DataFrame:
    return spark.createDataFrame(flat(), "part string, name string, i int, value string")


def with_defaults(given: DataFrame) -> DataFrame:
    """given: (image_id, part, name, i, value). Every default of every image, overridden where given."""
    every = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(n).alias("name"), F.lit(i).alias("i"), F.lit(v).alias("value")) for p, n, i, v in flat()])
    whole = given.select("image_id").distinct().select("image_id", F.explode(every).alias("d")).select("image_id", "d.*")
    return whole.join(given.select("image_id", "part", "name", "i", F.col("value").alias("own")), ["image_id", "part", "name", "i"], "left").select("image_id", "part", "name", "i", F.coalesce("own", "value").alias("value"))


def saturation(channel: Column, levels: tuple[int, ...]) -> Column:
    """A channel's saturation level; null for no channel."""
    out = F.lit(None).cast("int")
    for name, level in zip(CHANNELS, levels, strict=True):
        out = F.when(channel == name, level).otherwise(out)
    return out


def camera_name(make: Column, model: Column) -> Column:
    return F.concat_ws(" ", make, model)


def black_levels(cell: Column, levels: list[Column]) -> Column:
    """levels: red, green of red rows, green of blue rows, blue. In the order of the 2x2 cell, which the mosaic decides."""
    r, gr, gb, b = levels
    return F.when(cell == "rggb", F.array(r, gr, gb, b)).when(cell == "gbrg", F.array(gb, b, r, gr))


def white_levels(levels: list[Column]) -> Column:
    """One level if all are equal, else all four."""
    same = (levels[0] == levels[1]) & (levels[0] == levels[2]) & (levels[0] == levels[3])
    return F.when(same, F.array(levels[0])).otherwise(F.array(*levels))


def rational(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
