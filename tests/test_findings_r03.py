"""Tests of the findings of round 3: what failed at size, or differed from the SQL, in small."""

from pyspark.sql import functions as F

from threadloom import tables
from threadloom.operators import color, raster
from threadloom.plans import pictures as C
from threadloom.plans import queries as Q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")
    try:
        t = tables.stored(spark.range(2000))
        assert "BroadcastHashJoin" not in _plan(t.join(t.withColumnRenamed("id", "k"), F.col("id") == F.col("k")))
        few = tables.stored(spark.range(2))
        assert "BroadcastHashJoin" in _plan(few.join(spark.range(9).withColumnRenamed("id", "k"), F.col("id") == F.col("k")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_promoted_centers_are_rounded_once(spark):
    rows = [(1, 0, 0, 255, 0, 0, 0), (1, 1, 0, 255, 0, 0, 0), (1, 2, 0, 255, 0, 0, 0), (1, 3, 0, 254, 0, 0, 0), (1, 4, 1, 0, 0, 0, 0)]
    px = spark.createDataFrame([r[:6] for r in rows], "img int, x int, y int, r int, g int, b int")
    centers = spark.createDataFrame([(1, 0, 0, 0, 0)], "img int, place int, l long, a long, b long")
    lab = px.where("y = 0").withColumn("lab", color.X.rgb_to_lab("r", "g", "b")).select(*(F.sum(color.X.round_half_up(F.col(f"lab.{c}") * 1e6).cast("long")).alias(c) for c in "lab")).first()
    got = color.promoted(px, centers).select("img", "place", "l", "a", "b").collect()
    assert [tuple(r) for r in got] == [(1, 1, lab.l // 4, lab.a // 4, lab.b // 4)]


def test_white_background_joins_no_pixels(spark):
    square = lambda img, w, h, dark=(), clear=(): [(img, x, y, *(3 * [0 if (x, y) in dark else 255]), 0 if (x, y) in clear else 255) for x in range(w) for y in range(h)]
    rows = square(1, 3, 3, {(1, 1)}) + square(2, 3, 3, {(0, 0), (2, 2)}) + square(3, 3, 3, {(2, 0)}) + square(4, 3, 3, (), {(0, 2)}) + square(5, 1, 4) + square(6, 4, 1)
    w = raster.white_background(spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int, a int"))
    assert dict(map(tuple, w.collect())) == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert "Join" not in _plan(w)


def test_colors_of_pictures_go_by_their_pixels(spark):
    # equal areas (the red one first), whose smoothed outlines differ
    files = spark.createDataFrame([(k, bytearray(Q.pictures.encode_png(Q._painted(k)))) for k in (3510, 3654, 4006)], "design_id bigint, content binary")
    rows = C.pictures_to_plans(files).select("design_id", "block_idx", "r").distinct().collect()
    for k in (3510, 3654, 4006):
        assert [r.r for r in sorted((x for x in rows if x.design_id == k), key=lambda x: x.block_idx)] == [220, 30, 30]


def test_kernels_are_dealt_to_tasks(spark, tmp_path):
    from threadloom import catalog

    spark.range(400).selectExpr("id as c_custkey", "'AUTOMOBILE' as c_mktsegment", "concat('c', id) as c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("tatami_runs", "zigzag_line", "satin_runs", "hidden_paths", "qr_roundtrip", "embedded_documents"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 4, name


def test_nodes_and_moved_rings_are_worked_out_once(spark):
    from threadloom.operators import geometry, vector

    p = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    df = spark.range(1).select(F.lit(1).alias("design_id"), F.col("id").alias("poly"), F.array(p, p, p).alias("outer"), F.array(p, p, p).alias("hole"))
    # a path that is itself an expression stands once in the plan, not once for each use
    marked = F.transform("outer", lambda v: F.struct((v["x"] * 12345.0).alias("x"), v["y"].alias("y"), F.lit(True).alias("smooth")))
    text = df.select(vector.node_polyline(marked).alias("z"))._jdf.queryExecution().analyzed().toString()
    assert text.count("12345.0") == 1
    assert len(geometry.kaleidoscope(df)._jdf.queryExecution().analyzed().toString()) < 60_000


def test_a_plan_leaves_in_frames(monkeypatch):
    import numpy as np
    import pandas as pd

    from threadloom.plans import digitize as D

    run = lambda n, k: {"stitches": np.arange(n) + 1j * k, "connection": "jump", "object_id": k, "stitch_type": "tatami"}
    plan = [{"thread": (1, 2, 3), "runs": [run(6, 0), run(7, 1)]}, {"thread": (4, 5, 6), "runs": [run(30, 2)]}]
    whole = D.stitch_rows(9, plan)
    monkeypatch.setattr(D, "FRAME_ROWS", 10)
    frames = list(D.stitch_frames(9, plan, step=["a", "b"]))
    assert [len(f) for f in frames] == [6, 7, 30] and [f["step"].iloc[0] for f in frames] == ["a", "a", "b"]
    pd.testing.assert_frame_equal(pd.concat(frames).drop(columns="step").reset_index(drop=True), whole.reset_index(drop=True))


def test_tours_compare_places():
    import time

    import numpy as np

    from threadloom.kernels import order

    # 40,000 points in 200 places on a line; every place's points in their order
    z = (np.arange(40_000) * 37 % 200).astype(complex)
    t = time.perf_counter()
    got = order.tour(z, -1000 + 0j)
    assert time.perf_counter() - t < 10
    assert got == sorted(range(40_000), key=lambda k: (z[k].real, k))


def test_designs_are_dealt_to_tasks(spark):
    from threadloom.plans import digitize as D

    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (60, 0), (60, 60), (0, 60))]
    rows = spark.createDataFrame([(k, 0, ring, [], 9, 9, 9) for k in range(40)], "design_id bigint, region_idx int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, r int, g int, b int")
    made = D.digitize_designs(rows.coalesce(1))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert made.select("design_id").distinct().count() == 40


def test_searches_meet_each_place_and_shape_once(spark):
    from threadloom.operators import geometry, vector

    # ten outlines that lie on each other, and ten queries in one place
    ring = [(0, 0), (20, 0), (20, 20), (0, 20)]
    points = spark.createDataFrame([(1, p, 0, i, x, y) for p in range(10) for i, (x, y) in enumerate(ring)], "design_id long, poly long, ring int, i int, x long, y long")
    q = spark.createDataFrame([(1, k, 3, 1) for k in range(10)], "design_id long, q long, qx long, qy long")
    rings = spark.createDataFrame([(1, p, [{"x": float(x), "y": float(y)} for x, y in ring], [{"x": x / 2 + 5, "y": y / 2 + 5} for x, y in ring[:: -1 if p else 1]]) for p in range(10)], "design_id long, poly long, outer array<struct<x:double,y:double>>, hole array<struct<x:double,y:double>>")
    assert vector.near_edges(q, points, 2.0).count() == 1
    assert {tuple(r) for r in vector.nearest_segment(q, points, 2.0).select("poly", "i").collect()} == {(9, 0)} and vector.nearest_segment(q, points, 2.0).count() == 10
    assert {(r.poly, r.d2) for r in vector.nearest_node(q, points, 9).collect()} == {(9, 10)}
    assert {(r.poly, r.inside) for r in vector.hits(q, rings, points).collect()} == {(9, True)}
    assert {r.depth for r in geometry.depths(rings).collect()} == {9}
    assert {(r.outer_poly, r.holders) for r in geometry.holes_to_outers(rings).collect()} == {(0, 10)}


def test_pictures_are_dealt_before_they_are_spread(spark, tmp_path):
    from threadloom.sources import adapters as A

    spark.range(20).selectExpr("id as s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    px = A.pixels(spark, str(tmp_path))
    assert px.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    # what is grouped within a picture is not moved again
    assert _plan(raster.majority(px.select("img", "x", "y", "label"))).count("Exchange") == 1


def test_groups_of_one_shape_are_scanned_once(spark, monkeypatch):
    from threadloom.operators import scan

    square, inner = [(0.25, 0.25), (10.25, 0.25), (10.25, 8.25), (0.25, 8.25)], [(2.25, 2.25), (2.25, 6.25), (8.25, 6.25), (8.25, 2.25)]
    at = lambda ring, x, y: [(a + x, b + y) for a, b in ring]
    # forty pairs of rings in rows and columns; two that touch at a corner; one moved by less than a pixel; far ones
    rows = [(1, 0, at(r, 12 * (k % 8), 10 * (k // 8) - 30)) for k in range(40) for r in (square, inner)]
    rows += [(2, 0, square), (2, 0, at(square, 10, 8)), (2, 0, at(square, 40, 0.5)), (2, 1, at(square, -5000, 70_000)), (3, 0, at(square, 1e-20, 0)), (4, 0, square[:2])]
    o = spark.createDataFrame(rows, "img long, label long, ring array<struct<x:double,y:double>>")
    scanned, whole = [], scan.spans
    monkeypatch.setattr(scan, "spans", lambda x, rule="nonzero": scanned.append(x.count()) or whole(x, rule))
    plain = lambda df: sorted((r.img, r.label, r.ring, r.area, tuple((p.x, p.y) for p in r.outer), tuple(tuple((p.x, p.y) for p in h) for h in r.holes)) for r in df.collect())
    got = plain(scan.regions(o))
    assert len(got) == 45 and scanned[0] < 12
    # as where every group is scanned in its place
    monkeypatch.setattr(scan, "SHAPE_POINTS", 0)
    assert plain(scan.regions(o)) == got
