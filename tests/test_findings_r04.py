"""Tests of the findings of round 4: what failed at size, in small."""

from pyspark.sql import functions as F


def test_nodes_of_subdivided_rings_are_worked_out_once(spark):
    from threadloom.operators import vector

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],), (None,)], "outer array<struct<x:double,y:double>>")
    # a ring that is itself an expression stands once in the plan, not once for each use
    marked = F.transform("outer", lambda v: F.struct((v["x"] * 12345.0).alias("x"), v["y"].alias("y")))
    made = df.select(vector.nodes_of(vector.subdivided_ring(marked)).alias("n"))
    assert made._jdf.queryExecution().analyzed().toString().count("12345.0") == 1
    whole, none = (r.n for r in df.select(vector.nodes_of(vector.subdivided_ring("outer")).alias("n")).collect())
    assert none is None
    assert [(p.x, p.y, p.smooth) for p in whole] == [(0, 0, False), (2, 0, True), (4, 0, False), (4, 1, True), (4, 2, False), (2, 2, True), (0, 2, False), (0, 1, True)]


def _boxes(n, same=False):
    import numpy as np

    at = lambda k: 0 if same else 1000 * k
    return [{"outer": np.array([0, 100, 100 + 100j, 100j]) + at(k), "holes": [], "color": (9, 9, 9), "fill_type": None, "angle_deg": None, "object_id": k} for k in range(n)]


def test_plans_over_the_limit_are_left_where_they_get_there(monkeypatch):
    from threadloom.kernels import fills
    from threadloom.plans import digitize as D

    made, rows = [], fills.rows
    monkeypatch.setattr(fills, "rows", lambda *a: made.append(1) or rows(*a))
    plan, steps = D.reduced(_boxes(30), limit=50)
    assert steps == ["spacing", "spacing", "drop5", "drop10", "length"] and [len(b["runs"]) for b in plan] == [30]
    # five plans that end with their first object, and a whole one
    assert len(made) == 35
    # one within the limit is whole
    full = D.count(D.digitize(_boxes(30)))
    assert D.count(D.reduced(_boxes(30), limit=full)[0]) == full


def test_objects_of_one_shape_are_filled_once(monkeypatch):
    from threadloom.kernels import fills
    from threadloom.plans import digitize as D

    made, rows = [], fills.rows
    monkeypatch.setattr(fills, "rows", lambda *a: made.append(1) or rows(*a))
    plan = D.digitize(_boxes(30, same=True))
    assert len(made) == 1 and [r["object_id"] for r in plan[0]["runs"]] == list(range(30))


def test_even_steps_are_moved_and_sorted_once(spark):
    from threadloom.operators import paths

    rows = [(1, 0, 0, 0), (1, 1, 100, 0), (1, 2, 100, 50), (2, 0, 7, 7), (3, 0, 5, 5), (3, 1, 5, 5)]
    points = spark.createDataFrame(rows, "p bigint, i bigint, x int, y int")
    run = paths.running(points, ["p"], 25, passes=2)
    assert [tuple(r)[1:] for r in run.where("p = 1").orderBy("seq").collect()] == [(s, *z) for s, z in enumerate([(0, 0), (25, 0), (50, 0), (75, 0), (100, 0), (100, 25), (100, 50), (100, 25), (100, 0), (75, 0), (50, 0), (25, 0), (0, 0)])]
    # paths without length have their one point
    assert sorted(tuple(r) for r in run.where("p > 1").collect()) == [(2, 0, 7, 7), (3, 0, 5, 5)]
    column = paths.satin(points, ["p"], 10.0, 25)
    assert [r.seq for r in column.orderBy("seq").collect()] == list(range(column.count())) and {r.p for r in column.collect()} == {1}
    for made, sorts in ((run, 1), (column, 2)):
        plan = made.select("*")._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == sorts, plan


def test_quick_ways_of_pictures_and_moves():
    import numpy as np

    from threadloom.kernels import codec, pictures

    a = np.random.default_rng(4).integers(0, 256, (6, 1200, 4)).astype(np.uint8)
    back = pictures.decode(pictures.encode_png(a))
    assert (back == a).all()
    half = pictures.shrunk(back)
    assert (half == np.floor(a.reshape(3, 2, 600, 2, 4).mean((1, 3)) + 0.5)).all()
    assert codec.split((0, 0), (121, -121)) == [(121, -121)] and codec.split((0, 0), (0.6, 0)) == [(1, 0)] and len(codec.split((0, 0), (122, 0))) == 2


def test_runs_are_rows_and_leave_in_frames(spark, monkeypatch):
    import pandas as pd

    from threadloom.plans import digitize as D
    from threadloom.plans import incremental

    plan = D.digitize(_boxes(5))
    monkeypatch.setattr(D, "FRAME_ROWS", 100)
    frames = list(D.run_frames(7, D.sewn(_boxes(5)), step="a"))
    assert len(frames) == 5 and sum(len(x) for f in frames for x in f["xs"]) == D.count(plan)
    monkeypatch.undo()
    ring = lambda k: [{"x": float(x + 1000 * k), "y": float(y)} for x, y in ((0, 0), (100, 0), (100, 100), (0, 100))]
    rows = spark.createDataFrame([(7, k, ring(k), [], 9, 9, 9) for k in range(5)], "design_id bigint, region_idx int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, r int, g int, b int")
    got = D.digitize_designs(rows).toPandas().sort_values(["block_idx", "run_idx", "seq"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, D.stitch_rows(7, plan).reset_index(drop=True), check_dtype=False)
    # what is kept is kept by runs as well
    first = incremental.regenerate(rows, D.digitize_runs(rows.limit(0)).selectExpr("*", "0L as hash"), D.Options(), D.digitize_runs)
    assert first.count() == 5 and "xs" in first.columns
