"""Machine files as data sources, pictures of all kinds, edits with timers, polylines in rounds, strokes that go on, ordered pages."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.kernels import codec
from threadloom.kernels import shapes as S
from threadloom.operators import fits, library, raster, simplify
from threadloom.plans import queries as kernel_queries
from threadloom.sources import files, formats
from threadloom.streaming import recompile

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans(spark):
    formats.register(spark)
    return formats.clustered(kernel_queries.plan_rows(spark, SF).where("design_id < 8")).cache()


def written(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.startswith("design-"))


@pytest.mark.parametrize("kind", ["dst", "pes"])
def test_files_there_and_back(spark, plans, tmp_path, kind):
    at = str(tmp_path / "files")
    plans.write.format(kind).mode("append").save(at)
    designs = [r.design_id for r in plans.select("design_id").distinct().collect()]
    assert written(at) == sorted(f"design-{k}.{kind}" for k in designs)
    assert not [p for p in os.listdir(at) if p.startswith("_staging")] and os.path.exists(f"{at}/_SUCCESS")
    got = spark.read.format(kind).load(at)
    for k in designs:
        plan = files.plan_of(plans.where(f"design_id = {k}").toPandas(), f"DESIGN{k}")
        expected = [(kd, x, y) for x, y, kd in codec.read_dst(codec.write_dst(plan))["records"]] if kind == "dst" else [tuple(o) for o in codec.read_pes(codec.write_pes(plan))["ops"]]
        own = got.where(F.col("file").endswith(f"design-{k}.{kind}")).orderBy("rec").collect()
        assert [(r.kind, r.dx, r.dy) for r in own] == expected and all(r.error is None for r in own)
    # a broken file is a row; one file alone can be read; files are packed by size
    (tmp_path / "files" / f"broken.{kind}").write_bytes(b"no such thing")
    bad = spark.read.format(kind).load(at).where("error is not null").collect()
    assert len(bad) == 1 and bad[0].file.endswith(f"broken.{kind}") and bad[0].rec is None
    one = next(os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.startswith("design-"))
    assert spark.read.format(kind).load(one).select("file").distinct().count() == 1
    assert len(formats.Reader(at, f".{kind}", None, [], 1).partitions()) == len(designs) + 1
    assert len(formats.Reader(at, f".{kind}", None, [], 1 << 30).partitions()) == 1


def test_append_and_overwrite(spark, plans, tmp_path):
    at = str(tmp_path / "files")
    plans.where("design_id < 3").write.format("dst").mode("append").save(at)
    plans.where("design_id = 5").write.format("dst").mode("append").save(at)
    assert written(at) == ["design-0.dst", "design-1.dst", "design-2.dst", "design-5.dst"]
    plans.where("design_id = 1").write.format("dst").mode("overwrite").save(at)
    assert written(at) == ["design-1.dst"]


def test_a_failed_job_leaves_nothing(spark, plans, tmp_path):
    at = str(tmp_path / "files")
    plans.where("design_id = 1").write.format("dst").mode("append").save(at)
    mixed = plans.unionByName(plans).orderBy("seq").coalesce(1)
    with pytest.raises(Exception, match="comes twice"):
        mixed.write.format("dst").mode("append").save(at)
    assert written(at) == ["design-1.dst"] and not [p for p in os.listdir(at) if p.startswith("_staging")]


def test_pictures_that_the_jvm_reads(spark, tmp_path):
    j = spark._jvm
    image = j.java.awt.image.BufferedImage(1300, 20, 1)
    for x in range(1300):
        for y in range(20):
            image.setRGB(x, y, 0xC83214 if x < 650 else 0x1432C8)
    for kind in ("jpg", "png", "bmp", "gif"):
        assert j.javax.imageio.ImageIO.write(image, kind, j.java.io.File(str(tmp_path / f"a.{kind}")))
    (tmp_path / "broken.jpg").write_bytes(b"nonsense")
    got = formats.image_files(spark, str(tmp_path)).collect()
    assert sorted(os.path.basename(r.file) for r in got if r.error is None) == ["a.bmp", "a.gif", "a.jpg", "a.png"]
    assert [os.path.basename(r.file) for r in got if r.error is not None] == ["broken.jpg"]
    px = formats.pixel_rows(formats.image_files(spark, str(tmp_path))).groupBy("img").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("x") < 290, F.col("r"))).alias("r"), F.avg(F.when(F.col("x") > 310, F.col("b"))).alias("b"), F.min("a").alias("a")).collect()
    assert len(px) == 4
    for p in px:
        assert (p.x, p.y, p.n, p.a) == (599, 8, 600 * 9, 255) and abs(p.r - 200) < 6 and abs(p.b - 200) < 6


def edit_files(spark, tmp_path, parts):
    t0, at = dt.datetime(2024, 1, 1), tmp_path / "edits"
    at.mkdir()
    for k, part in enumerate(parts):
        df = spark.createDataFrame([(d, t0 + dt.timedelta(milliseconds=m)) for d, m in part], "design_id long, at timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (made,) = [f for f in os.listdir(tmp_path / f"part{k}") if f.endswith(".parquet")]
        os.rename(tmp_path / f"part{k}" / made, at / f"{k}.parquet")
        os.utime(at / f"{k}.parquet", (1000 + k, 1000 + k))
    return str(at), lambda r, t0=t0: (r.design_id, round((r.first_edit - t0).total_seconds() * 1000), round((r.last_edit - t0).total_seconds() * 1000), r.edits, round((r.due - t0).total_seconds() * 1000))


def test_edits_come_due_over_batches(spark, tmp_path):
    """The first design's edits are in two files and meet; its last one is still open at the end, and so is the third's."""
    parts = [[(1, 0), (1, 100), (2, 50)], [(1, 300), (2, 700), (3, 10_000)], [(3, 10_100), (1, 20_000)], [(3, 19_900), (4, 20_010)]]
    at, row = edit_files(spark, tmp_path, parts)
    got = sorted(map(row, recompile.run_stream(spark, at, lambda s: s, recompile.WAIT).collect()))
    assert got == [(1, 0, 300, 3, 550), (2, 50, 50, 1, 300), (2, 700, 700, 1, 950), (3, 10_000, 10_100, 2, 10_350)]


def polylines(closed=False):
    rng = np.random.default_rng(4)
    out = {0: [0j, 1 + 1j], 1: [5 + 5j] * 6, 2: [complex(k, 0) for k in range(50)], 3: [complex(k, (k % 7) ** 2) for k in range(80)], 4: [0j, 10 + 0j, 10 + 10j, 10j], 5: [0j]}
    for k in range(6, 20):
        out[k] = (np.cumsum(rng.integers(-9, 10, 60) + 1j * rng.integers(-9, 10, 60))).tolist()
    t = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    out[20] = (np.round(100 * np.cos(t)) + 1j * np.round(60 * np.sin(t))).tolist()
    return out


@pytest.mark.parametrize("closed", [False, True])
def test_polylines_with_fewer_points(spark, closed):
    paths = polylines()
    df = spark.createDataFrame([(k, i, p.real, p.imag) for k, z in paths.items() for i, p in enumerate(z)], "path int, i int, x double, y double").repartition(3)
    got = {}
    for r in simplify.simplified(df, ["path"], 4.0, closed).orderBy("path", "i").collect():
        got.setdefault(r.path, []).append(complex(r.x, r.y))
    for k, z in paths.items():
        z = np.array(z)
        expected = S.simplify_ring(z, 4.0) if closed else S.simplify(z, 4.0) if len(z) > 1 else z
        assert got[k] == expected.tolist(), k
    nodes = simplify.nodes(df.where("path = 4"), ["path"], 4.0, closed=closed).orderBy("i").collect()
    assert [(r.x, r.y, r.smooth) for r in nodes] == [(0, 0, False), (10, 0, False), (10, 10, False), (0, 10, False)]
    assert any(r.smooth for r in simplify.nodes(df.where("path = 20"), ["path"], 1.0, closed=closed).collect())
    assert simplify.simplified(df.where("false"), ["path"], 4.0, closed).count() == 0


FITS = "design_id long, pos long, kind string, closed boolean, width double, style string, points array<struct<x:double,y:double>>"


def test_strokes_that_go_on(spark):
    rng = random.Random(2)
    rows = []
    for design in range(30):
        x = 0.0
        for pos in range(rng.randint(1, 12)):
            kind, n = rng.choice(["stroke"] * 6 + ["fill"]), rng.randint(1, 4)
            points = [(x + k, 0.0) for k in range(n)]
            x = points[-1][0] + rng.choice([0.0, 0.0, 1.0, 1.6, 3.0])
            rows.append((design, pos, kind, rng.random() < 0.1, rng.choice([1.0, 1.4, 1.6, 1.9, 2.2, 5.0]), f"s{pos}", points))
    expected = []
    for design in range(30):
        out = []
        for r in (r for r in rows if r[0] == design):
            p = out[-1] if out else None
            able = lambda q: q["kind"] == "stroke" and not q["closed"] and q["width"] >= 1.4
            q = {"pos": r[1], "kind": r[2], "closed": r[3], "width": r[4], "style": r[5], "points": list(r[6]), "parts": 1}
            if p and able(p) and able(q) and abs(p["width"] - q["width"]) <= max(0.3, p["width"] * 0.2) and abs(p["points"][-1][0] - q["points"][0][0]) < max(p["width"], 1.5):
                p["points"] += q["points"][1:]
                p["parts"] += 1
            else:
                out.append(q)
        expected += [(design, *q.values()) for q in out]
    got = fits.merged(spark.createDataFrame(rows, FITS).repartition(4)).collect()
    assert sorted((r.design_id, r.pos, r.kind, r.closed, r.width, r.style, [tuple(p) for p in r.points], r.parts) for r in got) == sorted(expected)
    assert any(r.parts > 2 for r in got)


def test_pages_are_in_order(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 40), f"n{k}") for k in range(500)]
    got = library.pages(spark.createDataFrame(rows, "id long, updated long, name string").repartition(6), 30).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted((r["rank"], r.page, r.id) for r in got) == [(k, (k - 1) // 30 + 1, r[0]) for k, r in enumerate(order, 1)]


def test_top_colors(spark):
    rows = [(1, k % 20, k // 20, k % 13, 0, 0) for k in range(200)] + [(2, 0, 0, 9, 9, 9)]
    got = raster.dominant_colors(spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int")).orderBy("img", "rank").collect()
    assert [(r["rank"], r.r, r.n) for r in got if r.img == 1] == [(k, k - 1, 16 if k <= 5 else 15) for k in range(1, 9)]
    assert [(r["rank"], r.r) for r in got if r.img == 2] == [(1, 9)]


def test_projects_keep_their_first_date(spark):
    old = '{"version":2,"name":"a","createdAt":"2020-01-02T03:04:05.000Z"}'
    p = files.projects(spark.createDataFrame([("x", old), ("y", '{"version":3}')], "file string, content string"))
    now = F.expr("make_timestamp(2024, 5, 6, 7, 8, 9.5, 'UTC')")
    at = lambda path: F.get_json_object("content", path)
    got = {r.file: (r.c, r.u) for r in files.project_json(p, now).select("file", at("$.createdAt").alias("c"), at("$.updatedAt").alias("u")).collect()}
    assert got == {"x": ("2020-01-02T03:04:05.000Z", "2024-05-06T07:08:09.500Z"), "y": ("2024-05-06T07:08:09.500Z",) * 2}
