"""Sums of rectangles whose lines are far more than the rectangles."""

from lumenframe.operators import stage


def test_rectangle_lines_are_never_broadcast(spark):
    v = {(r, c): r * 8 + c for r in range(9) for c in range(8)}
    px = spark.createDataFrame([(0, r, c, x) for (r, c), x in v.items()], "image_id int, row int, col int, v int")
    rects = [(i, i % 7, i % 5, i % 7 + 4, i % 5 + 4) for i in range(40)]
    done = stage.rectangle_sums(px, spark.createDataFrame(rects, "rect_id int, t int, l int, b int, r int"), 8)
    found = {r["rect_id"]: (r["samples"], r["total"]) for r in done.collect()}
    inside = {i: [x for (r, c), x in v.items() if t <= r <= b and left <= c <= right] for i, t, left, b, right in rects}
    assert found == {i: (len(x), sum(x)) for i, x in inside.items()}
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
