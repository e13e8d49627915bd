"""Picture files of all kinds that are read, files that can't be, and what regions bring along to digitising."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.kernels import fills, images, pictures, svg
from threadloom.plans import digitize, incremental
from threadloom.plans import pictures as plans
from threadloom.sources import files


def png(px: np.ndarray, color: int, filters, palette=None, clear=None) -> bytes:
    """A PNG file of rows filtered one by one, plainly."""
    h, w, n = px.shape
    rows = []
    for y in range(h):
        kind = filters[y % len(filters)]
        line = bytearray([kind])
        for x in range(w * n):
            v = int(px.reshape(h, -1)[y, x])
            a = int(px.reshape(h, -1)[y, x - n]) if x >= n else 0
            b = int(px.reshape(h, -1)[y - 1, x]) if y else 0
            c = int(px.reshape(h, -1)[y - 1, x - n]) if y and x >= n else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        rows.append(bytes(line))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = zlib.compress(b"".join(rows))
    extra = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"")
    return pictures.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + extra + chunk(b"IDAT", body[:40]) + chunk(b"IDAT", body[40:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("color, n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_of_all_filters(color, n):
    px = np.random.default_rng(color).integers(0, 256, (13, 9, n), dtype=np.uint8)
    got = pictures.decode(png(px, color, (0, 1, 2, 3, 4)))
    want = np.full((13, 9, 4), 255, np.uint8)
    want[..., :3] = px[..., :3] if n >= 3 else px[..., :1]
    if n in (2, 4):
        want[..., 3] = px[..., -1]
    assert np.array_equal(got, want)
    assert np.array_equal(pictures.decode(pictures.encode_png(want)), want)


def test_png_with_a_palette():
    px = np.arange(12, dtype=np.uint8).reshape(3, 4, 1) % 3
    got = pictures.decode(png(px, 3, (0,), bytes([255, 0, 0, 0, 255, 0, 0, 0, 255]), bytes([255, 0])))
    assert got[0, 0].tolist() == [255, 0, 0, 255] and got[0, 1].tolist() == [0, 255, 0, 0] and got[0, 2].tolist() == [0, 0, 255, 255]


def test_ppm_and_pgm():
    px = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert np.array_equal(pictures.decode(b"P6\n# made here\n4 2\n255\n" + px.tobytes())[..., :3], px)
    assert pictures.decode(b"P5 4 2 255\n" + bytes(range(8)))[1, 3].tolist() == [7, 7, 7, 255]


def test_shrinking_keeps_means():
    a = np.random.default_rng(2).integers(0, 256, (700, 1300, 4), dtype=np.uint8)
    b = pictures.shrunk(a)
    assert b.shape == (323, 600, 4) and abs(b.mean() - a.mean()) < 0.5
    assert pictures.shrunk(a[:50, :60]).shape == (50, 60, 4)


def test_broken_files_are_rows(spark):
    good = pictures.encode_png(np.full((20, 30, 4), (200, 30, 30, 255), np.uint8))
    df = spark.createDataFrame([(1, good), (2, b"no picture"), (3, good[:40]), (4, b"")], "design_id long, content binary")
    regions = plans.picture_regions(df).collect()
    assert {r.design_id for r in regions if r.error} == {2, 3, 4} and [r.kept for r in regions if not r.error] == [True]
    assert {r.design_id for r in plans.pictures_to_plans(df).collect()} == {1}
    assert {r.design_id: r.error is None for r in plans.picture_labels(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    texts = spark.createDataFrame([("a", b"<svg><rect width='9' height='5'/></svg>"), ("b", b"<svg><rect"), ("c", b'<!DOCTYPE svg [<!ENTITY x "y">]><svg/>'), ("d", b'<!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "x.dtd"><svg><rect width="9" height="5"/></svg>')], "file string, content binary")
    out = {r.file: r.error for r in files.svg_regions(texts).collect()}
    assert out["a"] is None and out["d"] is None and "ParseError" in out["b"] and "entities" in out["c"]
    assert all("ValueError" in r.error for r in files.pes_records(texts).collect())


def test_a_transparent_corner_is_no_white_background():
    a = np.full((9, 9, 4), 255, np.uint8)
    assert plans.white_corners(a)
    a[0, 8, 3] = 0
    assert not plans.white_corners(a)
    a[0, 8] = (9, 9, 9, 255)
    assert plans.white_corners(a) and images.background(a, True).sum() == 80


BOX = [{"x": 0.0, "y": 0.0}, {"x": 200.0, "y": 0.0}, {"x": 200.0, "y": 100.0}, {"x": 0.0, "y": 100.0}]
POINTS = "array<struct<x:double,y:double>>"


def regions(spark, **extra):
    kinds = {"angle_lines": f"array<{POINTS}>", "baked": f"array<{POINTS}>", "fill_type": "string", "object_id": "int"}
    names = "".join(f", {k} {kinds[k]}" for k in extra)
    return spark.createDataFrame([(1, 0, BOX, [], 200, 30, 30, *extra.values())], f"design_id long, region_idx int, outer {POINTS}, holes array<{POINTS}>, r int, g int, b int{names}")


def test_regions_bring_angle_lines_baked_runs_and_ids(spark):
    plain = digitize.digitize_designs(regions(spark)).collect()
    lines = [[BOX[0], BOX[1]], [BOX[0], BOX[3]]]
    turned = digitize.digitize_designs(regions(spark, angle_lines=lines)).collect()
    assert {(r.x, r.y) for r in turned} != {(r.x, r.y) for r in plain} and len(turned) > 100
    want = fills.finish(fills.turning(np.array([0, 200, 200 + 100j, 100j]), [], [(0, 200), (0, 100j)], 4, 30)[0])
    assert [(r.x, r.y) for r in sorted(turned, key=lambda r: r.seq)] == [(int(z.real), int(z.imag)) for z in want]
    run = [{"x": 5.0, "y": 5.0}, {"x": 50.0, "y": 5.0}]
    kept = digitize.digitize_designs(regions(spark, baked=[run], object_id=7)).collect()
    assert [(r.x, r.y, r.stitch_type, r.object_id) for r in kept] == [(5, 5, "manual", 7), (50, 5, "manual", 7)]
    hashes = {incremental.with_hash(regions(spark, **x), digitize.Options()).first()["hash"] for x in ({}, {"angle_lines": lines}, {"baked": [run]}, {"object_id": 7}, {"fill_type": "satin"})}
    assert len(hashes) == 5


def test_colours_agree_in_both_readers(spark):
    texts = ["#f80", "#0a141e", "rgb(1, 2 ,3)", " Red ", "none", "", "nonsense", "GREY", "transparent", "#12", "rgb(1,2)", "rgb(a,2,3)", "rgb 1 2 3", "rgb(7 8 9)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", X.css_color("t")).collect()
    for r in rows:
        assert (tuple(r.c) if r.c else None) == svg.color(r.t), r.t


def test_a_format_of_ones_own(spark):
    files.register_exporter("count", lambda plan: str(sum(len(r["stitches"]) for b in plan["blocks"] for r in b["runs"])).encode())
    st = digitize.digitize_designs(regions(spark))
    assert bytes(files.exported(st, "count").first().content) == str(st.count()).encode()
    assert {r.format for f in ("dst", "pes", "svg") for r in files.exported(st, f).collect()} == {"dst", "pes", "svg"}
    with pytest.raises(KeyError):
        files.exported(st, "unknown")


def test_holes_of_no_ring_go_to_the_nearest(spark):
    from threadloom.operators import geometry

    ring = lambda x, s: [{"x": x - s, "y": -s}, {"x": x + s, "y": -s}, {"x": x + s, "y": s}, {"x": x - s, "y": s}]
    rows = [(1, 0, ring(0, 20), None), (1, 1, ring(200, 20), ring(140, 3)), (1, 2, ring(100, 2), ring(3, 3)), (2, 3, ring(130, 20), None)]
    df = spark.createDataFrame(rows, "design_id long, poly long, outer array<struct<x:int,y:int>>, hole array<struct<x:int,y:int>>")
    assert {(r.hole_poly, r.outer_poly, r.holders) for r in geometry.holes_to_outers(df).collect()} == {(1, 1, 0), (2, 0, 1)}


def test_centres_in_blocks(spark, monkeypatch):
    from threadloom.operators import color

    df = spark.createDataFrame([(k, k % 3, [float(k % 3), 0.0]) for k in range(9)], "vec_id long, label long, embedding array<double>")
    assert {(r.vec_id, r.center) for r in color.nearest_center(df).collect()} == {(k, k % 3) for k in range(9)}
    monkeypatch.setattr(color, "CENTERS_AT_ONCE", 2)
    assert {(r.vec_id, r.center) for r in color.nearest_center(df).collect()} == {(k, k % 3) for k in range(9)}
