"""Warps of images far taller than the radius of their coefficients."""

import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import render


def samples(spark, height, width, first=0):
    return spark.createDataFrame([(0, first + r, c, (r * 37 + c * 11) % 4096) for r in range(height) for c in range(width)], "image_id int, row int, col int, v int")


@pytest.mark.parametrize("row", [40_000, 3_000_000, 2_000_000_000])
def test_places_far_beyond_the_edges_take_the_nearest_corner(spark, row):
    source, target = samples(spark, 8, 5), samples(spark, 1, 5, row)
    places = render.warp_places(target, (250.0, 2.0), 256.0, [0.9375, 0.0625, -0.03125, 0.015625], (0.0078125, -0.00390625))
    found = {r["col"]: r["v"] for r in render.gather_bicubic(source, places, 8, 5).collect()}
    assert found == {0: 7 * 37, 1: 7 * 37, 2: 7 * 37, 3: 7 * 37 + 44, 4: 7 * 37 + 44}


def test_nearest_warp_leaves_out_places_beyond_any_row(spark):
    px = samples(spark, 8, 5).unionByName(samples(spark, 1, 5, 2_000_000))
    found = render.warp_nearest(px, (4.0, 2.0), 256.0, [1.0, 0.0625]).collect()
    assert {(r["row"], r["col"]): r["v"] for r in found} == {(r, c): (r * 37 + c * 11) % 4096 for r in range(8) for c in range(5)}


def test_places_that_share_samples_ask_for_them_once(spark):
    px = samples(spark, 400, 6)
    places = px.selectExpr("image_id", "row", "col", "cast(200 as bigint) sr", "cast(300 as bigint) sc")  # all from one place
    done = render.gather_bicubic(px, places, 400, 6)
    assert {r["v"] for r in done.collect()} == {done.head()["v"]} and done.count() == 2400
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan  # sixteen rows a place before
    asked = places.selectExpr("image_id", "0 tile_row", "0 tile_col", "1 r", "2 c").coalesce(1).mapInArrow(render._asked(400, 6), "image_id int, tile_row int, tile_col int, gr int, gc int, asked bigint")
    assert asked.count() == 16


def test_gather_across_tiles_with_repeated_and_missing_samples(spark):
    rng = np.random.default_rng(11)
    height, width = 300, 270
    rows = [(i, r, c, int(v)) for i in (0, 3) for (r, c), v in np.ndenumerate(rng.integers(0, 4096, (height, width))) if rng.random() > 0.02]
    rows += rows[::50]
    px = spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "row", "col", "v"]).astype("int32"))
    at = [(i, r, c, int(rng.integers(-900, (height + 6) * 128)), int(rng.integers(-900, (width + 6) * 128))) for i in (0, 3) for r in range(250, 262) for c in range(240, 270)]
    places = spark.createDataFrame(at + at[:5], "image_id int, row int, col int, sr bigint, sc bigint")
    found = {(r["image_id"], r["row"], r["col"]): r["v"] for r in render.gather_bicubic(px, places, height, width).collect()}
    held = {}
    for i, r, c, v in rows:
        held.setdefault((i, r, c), []).append(v)
    weights = render._tap_weights()
    expected = {}
    for i, r, c, sr, sc in at:
        s = w = 0
        for k in range(4):
            for j in range(4):
                near = held.get((i, min(height - 1, max(0, sr // 128 + k - 1)), min(width - 1, max(0, sc // 128 + j - 1))), [])
                weight = int(weights[sr % 128, k] * weights[sc % 128, j])
                s, w = s + weight * sum(near), w + weight * len(near)
        if w:
            expected[i, r, c] = min(4095, max(0, (2 * s + w) // (2 * w)))
    assert len(expected) > 700 and found == expected
