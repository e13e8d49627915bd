"""Edits, overrides, table functions, files, and regeneration."""

import pytest
from pyspark.sql import functions as F

from threadloom.kernels import codec
from threadloom.operators import edits as E
from threadloom.plans import digitize, incremental, udtf
from threadloom.sources import files


@pytest.fixture(scope="module")
def path(spark):
    return spark.range(1).select(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (20, 5), (30, 0)))).alias("p"))


def _xy(df, column):
    return [tuple(v) for v in df.select(column.alias("v")).first().v]


def test_nodes(path):
    point = F.struct(F.lit(5.0).alias("x"), F.lit(1.0).alias("y"))
    assert _xy(path, E.insert_node("p", 1, point)) == [(0, 0), (5, 1), (10, 0), (20, 5), (30, 0)]
    assert _xy(path, E.delete_node("p", 2)) == [(0, 0), (10, 0), (30, 0)] and len(_xy(path, E.delete_node("p", 0, least=4))) == 4
    assert _xy(path, E.move_node("p", 3, 1, 2))[3] == (31, 2)
    assert _xy(path, E.soft_move("p", 0, 8, 0, 20))[:2] == [(8, 0), (10 + 8 * 0.75**2, 0)]
    a, b = path.select(E.split_path("p", 1).alias("v")).first().v
    assert (len(a), len(b)) == (2, 3)
    assert len(_xy(path, E.join_paths(F.slice("p", 1, 2), F.slice("p", 2, 3)))) == 4
    assert len(_xy(path, E.subdivided("p"))) == 7 and _xy(path, E.spaced_nodes("p", 15)) == [(0, 0), (20, 5)]


def _regions(spark, size=100.0):
    box = lambda s: [{"x": -s, "y": -s}, {"x": s, "y": -s}, {"x": s, "y": s}, {"x": -s, "y": s}]
    rows = [(d, k, box(size / (k + 1) if d == 1 else 40.0), [], 200, 10 * k, 0) for d in (1, 2) for k in range(2)]
    return spark.createDataFrame(rows, "design_id bigint, region_idx int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, r int, g int, b int")


def test_regeneration_equals_digitizing_anew(spark):
    options = digitize.Options()
    first = digitize.digitize_designs(_regions(spark), options).join(incremental.with_hash(_regions(spark), options), "design_id")
    changed = _regions(spark, 90.0)
    again = incremental.regenerate(changed, first, options)
    key = lambda df: sorted(map(tuple, df.drop("hash").collect()), key=repr)
    assert key(again.select(*first.columns)) == key(digitize.digitize_designs(changed, options).select(*[c for c in first.columns if c != "hash"]))
    assert key(first) != key(again.select(*first.columns))
    assert incremental.with_hash(changed, options).join(first.select("design_id", "hash").distinct(), ["design_id", "hash"]).count() == 1


def test_overrides(spark):
    gen = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "design_id long, object_id long, x int")
    over = spark.createDataFrame([(1, 2, 60)], "design_id long, object_id long, x int")
    assert sorted(map(tuple, E.baked(gen, over).collect())) == [(1, 1, 5), (1, 2, 60), (2, 1, 7)]
    r = spark.createDataFrame([(1, 0, "auto", 45.0), (1, 1, "satin", 0.0)], "design_id long, region_idx int, fill_type string, angle_deg double")
    c = spark.createDataFrame([(1, 1, None, 30.0)], "design_id long, region_idx int, fill_type string, angle_deg double")
    assert sorted(map(tuple, E.restyled(r, c).collect())) == [(1, 0, "auto", 45.0), (1, 1, "satin", 30.0)]
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "design_id long, region_idx int, key string")
    known = spark.createDataFrame([(1, "b", 4)], "design_id long, key string, object_id long")
    assert {x.key: x.object_id for x in E.reconciled(new, known).collect()} == {"a": 5, "b": 4, "c": 6}


def test_table_function(spark):
    udtf.register(spark)
    _regions(spark).createOrReplaceTempView("boxes")
    out = spark.sql("SELECT design_id, region_idx, max(run_idx) AS runs, count(*) AS n FROM boxes, LATERAL stitches_of('tatami', outer, holes, map('angle_deg', 0.0D)) GROUP BY ALL").collect()
    assert len(out) == 4 and all(r.runs == 0 and r.n > 50 for r in out)


def test_files(spark, tmp_path):
    st = digitize.digitize_designs(_regions(spark))
    made = files.file_contents(st).collect()
    assert len(made) == 2
    for r in made:
        (tmp_path / f"{r.design_id}.dst").write_bytes(r.dst)
        (tmp_path / f"{r.design_id}.pes").write_bytes(r.pes)
    dst = files.dst_records(files.binary_files(spark, f"{tmp_path}/*.dst"))
    pes = files.pes_records(files.binary_files(spark, f"{tmp_path}/*.pes"))
    want = codec.read_dst(made[0].dst)
    assert dst.where(f"file like '%/{made[0].design_id}.dst'").count() == want["stitches"]
    first = files.points(dst, True).where(f"file like '%/{made[0].design_id}.dst'").orderBy("rec").collect()
    assert [(r.x, r.y) for r in first] == codec.dst_points(want["records"])
    assert files.points(pes, False).count() > len(first) and pes.select(F.size("palette")).first()[0] == 2
    assert files.sketch_imports(files.binary_files(spark, f"{tmp_path}/*.pes")).where("document like '%layers%'").count() == 2


def test_documents(spark):
    texts = spark.createDataFrame([("a", '{"version":3,"name":"N","settings":{"angleDeg":10}}'), ("b", '{"version":9}'), ("c", "no json")], "file string, content string")
    p = {r.file: r for r in files.projects(texts).collect()}
    assert (p["a"].ok, p["a"].angleDeg, p["a"].trimMode, p["a"].underlay) == (True, 10.0, "auto", ["edge"]) and not p["b"].ok and not p["c"].ok
    back = files.projects(files.project_json(files.projects(texts.where("file = 'a'")))).first()
    assert back.name == "N" and back.angleDeg == 10.0
    doc = '{"layers":[{"elements":[{"kind":"stroke","points":[[0,0],[10,0]],"width":0.5,"color":[1,2,3]}]}]}'
    st = files.sketch_plans(spark.createDataFrame([("s", doc)], "file string, content string"))
    assert st.count() == 6 and {r.stitch_type for r in st.collect()} == {"running"}
    drawing = spark.createDataFrame([("d", '<svg xmlns="http://www.w3.org/2000/svg"><rect width="9" height="9"/></svg>')], "file string, content string")
    assert files.svg_regions(drawing).first().outer[0].x == -500
