"""Operators over tables: small cases by hand, and every registered query against DuckDB on the smallest test data."""

import datetime
import decimal
import glob
import importlib.util
import os

import pytest
from pyspark.sql import functions as F

from threadloom import catalog
from threadloom.functions import exprs as X
from threadloom.operators import geometry, layout, library, machine, plan, raster, rules
from threadloom.streaming import simulate

DIR = "/root/testdata/sf0.001"


def stitches(spark, runs):
    """runs: (design, block, run, points)."""
    rows = [(d, f"t{b}", b, r, k, x, y) for d, b, r, points in runs for k, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "design_id bigint, thread string, block_idx bigint, run_idx bigint, seq bigint, x int, y int")


@pytest.fixture(scope="module")
def two(spark):
    """Lengths 150 and 200; the move between the red runs doesn't count."""
    return stitches(spark, [(1, 0, 0, [(0, 0), (100, 0)]), (1, 0, 1, [(400, 0), (450, 0)]), (1, 1, 0, [(0, 0), (0, 200)])])


def test_lengths_counts_bounds(two):
    assert {r.block_idx: r.length_milli for r in plan.thread_length(two).collect()} == {0: 150_000, 1: 200_000}
    assert plan.counts(two).first()[1:] == (6, 0, 1)
    assert plan.bounds(two).first().asDict() == {"design_id": 1, "min_x": 0, "max_x": 450, "min_y": 0, "max_y": 200, "width": 450, "height": 200}
    s = plan.stats(two).first()
    assert (s.jumps, s.trims, s.travels, s.travel_max, s.step_min, s.step_max) == (1, 0, 2, 450_000, 50_000, 200_000)


def test_sequence_and_moves(two):
    rows = plan.sequence(two).orderBy("order_no").collect()
    assert [(r.color_change, r.trim) for r in rows] == [(False, False), (False, False), (True, True)]
    assert [r.move for r in plan.flat_moves(two).orderBy("block_idx", "run_idx", "seq").collect()] == [2, 0, 1, 0, 3, 0]


@pytest.mark.parametrize(("points", "code"), [
    ([[(0, 0), (600, 0)]], "out-of-hoop"), ([[(0, 0), (130, 0)]], "long-stitch-in-run"), ([[(0, 0), (3, 0), (20, 0)]], "short-stitches"), ([[(-400, 0), (-390, 0)], [(-100, 0), (-90, 0)], [(200, 0), (210, 0)]], None),
])
def test_rules(spark, points, code):
    st = stitches(spark, [(1, 0, k, p) for k, p in enumerate(points)])
    found = {r.code for r in rules.issues(rules.counters(st)).collect()}
    assert found - {"long-stitch-in-run"} == ({code} if code not in (None, "long-stitch-in-run") else set()) and (code != "long-stitch-in-run" or code in found)


def test_rules_on_given_runs(spark, two):
    """An empty run hides the gap before it; a trim within an object is an error."""
    runs = spark.createDataFrame([(1, 0, 0, 2, 0, 0, 100, 0, "trim", 7), (1, 0, 1, 0, None, None, None, None, "trim", 7), (1, 0, 2, 2, 900, 0, 950, 0, "jump", 7), (1, 0, 3, 2, 0, 0, 9, 0, "trim", 7)], "design_id bigint, block_idx bigint, run_idx bigint, n bigint, x0 int, y0 int, x1 int, y1 int, connection string, object_id int")
    c = rules.counters(two, runs).first()
    assert (c.trims, c.long_jumps, c.object_trims) == (2, 0, 1)
    assert "trim-in-object" in {r.code for r in rules.issues(rules.counters(two, runs)).collect()}


def test_operations_equal_the_kernel(spark):
    from threadloom.kernels import codec

    points = [[(0, 0), (100, 0), (100, 0), (100, -100)], [(120, -100), (130, -110)], [(400, 0), (430, 10)], [(430, 10), (700, 10)]]
    st = stitches(spark, [(1, 0, 0, points[0]), (1, 0, 1, points[1]), (1, 0, 2, points[2]), (1, 1, 0, points[3]), (2, 0, 0, [(5, 5)])])
    for locks in (True, False):
        got = [(r.kind, r.x, r.y) for r in machine.operations(st, locks).where("design_id = 1").orderBy("op_seq").collect()]
        runs = [{"stitches": p, "connection": c} for p, c in zip(points, ("trim", "continuous", "jump", "trim"), strict=True)]
        assert got == codec.operations({"name": "", "blocks": [{"runs": runs[:3]}, {"runs": runs[3:]}]}, locks)
    assert [r.kind for r in machine.operations(st).where("design_id = 2").orderBy("op_seq").collect()] == ["jump", "stitch", "end"]


def test_frames(spark):
    ops = spark.createDataFrame([(1, k, kind, x, 0) for k, (kind, x) in enumerate([("jump", 5), ("stitch", 5), ("stitch", 9), ("colorChange", None), ("jump", 20), ("stitch", 20), ("trim", None), ("stitch", 30), ("end", None)])], "design_id bigint, op_seq bigint, kind string, x int, y int")
    rows = machine.frames(ops).orderBy("stitch_no").collect()
    assert [(r.x, r.color_index, r.from_jump, r.after_trim, r.color_changed) for r in rows] == [(5, 0, True, False, False), (9, 0, False, False, False), (20, 1, True, False, True), (30, 1, False, True, False)]


def test_stream_over_several_batches(spark, tmp_path):
    """State is carried from one file to the next."""
    events = [(k, 1 + k % 2, k) for k in range(400)]
    for part in range(4):
        spark.createDataFrame(events[part * 100 : part * 100 + 100], "event_id long, user_id long, x long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        batch = simulate.event_ops(spark.read.parquet(str(tmp_path / "in")))
        q = simulate.stream_frames(simulate.event_ops(spark.readStream.schema("event_id long, user_id long, x long").parquet(str(tmp_path / "in"))))
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("design_id", "stitch_no", "x", "y", "color_index", "from_jump", "after_trim", "color_changed").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(machine.frames(batch))


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(X.round_half_up(F.lit(v))) for v in (-2.5, 2.5, -0.5, 1.49)] == [-2, 3, 0, 1]
    assert [one(X.mm_to_units(F.lit(v))) for v in (0.35, 0.38, 0.40, 0.42, 0.45, 0.15, 0.25)] == [3, 4, 4, 4, 5, 1, 3]
    assert one(X.segment_distance(5, 5, 0, 0, 10, 0)) == 5 and one(X.segment_distance(-3, 4, 0, 0, 10, 0)) == 5
    assert one(X.turn_degrees(1, 0, 0, 1)) == pytest.approx(90) and one(X.stitch_angle(-1, 0)) == pytest.approx(0) and one(X.stitch_angle(1, -1)) == pytest.approx(135)
    assert one(X.label_text(F.lit("Tést"))) == "T_st" + " " * 12
    assert [tuple(p) for p in one(X.split_move(F.lit(0), F.lit(0), F.lit(250), F.lit(-10)))] == [(83, -3), (167, -7), (250, -10)]
    lab = one(X.rgb_to_lab(F.lit(255), F.lit(255), F.lit(255)))
    assert lab.l == pytest.approx(100, abs=0.01)


def test_rings(spark):
    box = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    r = spark.range(1).select(box.alias("b"))
    assert r.select(X.doubled_area("b")).first()[0] == 200
    assert r.select(X.point_in_ring(F.lit(5.0), F.lit(5.0), "b"), X.point_in_ring(F.lit(10.5), F.lit(5.0), "b")).first()[:] == (True, False)
    assert len(r.select(X.chaikin("b")).first()[0]) == 8
    turned = r.select(X.transform_ring("b", rotation=3.141592653589793 / 2)).first()[0]
    assert turned[1].y == pytest.approx(10) and r.select(X.doubled_area(X.outer_winding(F.reverse("b")))).first()[0] == 200


def test_raster_ties_and_closing(spark):
    px = spark.createDataFrame([(0, x, y, 0 if (x + y) % 2 else 1) for y in range(3) for x in range(3)], "img int, x int, y int, label int")
    got = {(r.x, r.y): r.smooth for r in raster.majority(px).collect()}
    assert got[1, 1] == 1 and len(got) == 9
    gap = spark.createDataFrame([(0, x, 0, 0 if x in (2, 3, 6, 7) else -1) for x in range(12)], "img int, x int, y int, label int")
    assert [r.closed for r in raster.closing(gap, 0, 2).orderBy("x").collect()] == [1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_library(spark):
    rows = [("a", "Rose", "red flower", ["plant"], False, "2024-01-02"), ("b", "Car", "fast", ["toy", "wheels"], True, "2024-01-03"), ("c", "Tulip", None, ["plant", "Spring"], True, "2024-01-01")]
    lib = spark.createDataFrame(rows, "id string, name string, note string, tags array<string>, favorite boolean, updated string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(library.search(lib)) == ["b", "a", "c"] and ids(library.search(lib, "FLOWER")) == ["a"] and ids(library.search(lib, "spring")) == ["c"]
    assert ids(library.search(lib, tags=["plant", "Spring"])) == ["c"] and ids(library.search(lib, favorites=True)) == ["b", "c"]
    assert sorted(r.tag for r in library.tags(lib).collect()) == ["Spring", "plant", "toy", "wheels"]
    uses = spark.createDataFrame([(1, f"x{k % 15}", k) for k in range(40)] + [(1, "a", 99)], "user_id int, id string, at int")
    recent = library.recent(uses).orderBy("place").collect()
    assert len(recent) == 12 and recent[0].id == "a" and recent[1].id == "x9"
    assert ids(library.upsert(lib.where("id <> 'b'"), lib.where("id = 'a'").withColumn("name", F.lit("R2"))).orderBy("id")) == ["a", "c"]
    assert {r.id: r.favorite for r in library.toggle_favorite(lib, lib.where("id = 'a'")).collect()} == {"a": True, "b": True, "c": True}


def test_layout(spark):
    g = spark.createDataFrame([(1, k, c, 10) for k, c in enumerate("ab\nc")], "text_id int, pos int, char string, advance long")
    rows = {r.char: (r.x4, r.y4) for r in layout.horizontal(g, 20).collect()}
    assert rows == {"a": (-20, -40), "b": (20, -40), "c": (-20, 40)}
    assert {r.char: r.rotation for r in layout.arc(g.where("char <> 'c'"), 100.0).collect()} == {"a": 50, "b": -50}


def test_geometry(spark):
    corner = [(0, 0, 0), (1, 100, 0), (2, 100, 100), (3, 0, 100)]
    pts = spark.createDataFrame([(1, p, "red", 0, i, x * s, y * s) for p, s in ((1, 1), (2, 2)) for i, x, y in corner], "design_id long, poly long, thread string, ring int, i int, x long, y long")
    assert {r.poly: r.area2 for r in geometry.areas(pts).collect()} == {1: 20_000, 2: 80_000}
    assert geometry.scan_rows(pts.where("poly = 1"), 20).count() == 5
    assert geometry.color_order(pts).first().net2 == 100_000


def _norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return repr(int(v)) if v == int(v) else repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_duckdb(spark, name):
    import duckdb

    df = catalog.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = con.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(tuple(_norm(r[k]) for k in order) for r in found.fetchall())
    assert sorted(tuple(_norm(v) for v in r) for r in df.collect()) == want


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DIR):
        assert entry.entry(spark).count() > 0
