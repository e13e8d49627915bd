"""Parts, rings, specks, scan conversion and centres as tables, against the arrays' kernels and by hand; and the tables that they keep."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import tables
from threadloom.kernels import images as I
from threadloom.kernels import shapes as H
from threadloom.operators import color, scan, stretches

_ROW = 1 << 32


def pictures():
    rng = np.random.default_rng(1)
    maps = [np.zeros((5, 5), int), rng.integers(0, 3, (14, 17)), rng.integers(-1, 3, (9, 21))]
    # parts that touch at corners, and parts with and without labels
    maps += [(rng.random((14, 17)) < 0.6).astype(int), (rng.random((14, 17)) < 0.5).astype(int) - 1, np.arange(64).reshape(8, 8) // 8 % 2]
    return maps


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(img, x, y, int(v)) for img, m in enumerate(pictures()) for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "img int, x int, y int, label int").repartition(5)


@pytest.fixture(scope="module")
def labeled(pixels):
    return tables.stored(stretches.parted(tables.stored(stretches.of_pixels(pixels))))


def test_stretches_cover_each_pixel_once(pixels, labeled):
    for r in labeled.groupBy("img").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("n")).collect():
        assert r.n == pictures()[r.img].size
    assert labeled.where("x2 < x1").count() == 0


def test_parts(labeled):
    got = stretches.parts(labeled).collect()
    for img, m in enumerate(pictures()):
        ids, n = I.parts(m)
        expected = []
        for k in range(n):
            at = np.argwhere(ids == k)
            expected.append((int(m[tuple(at[0])]), len(at), int(at[0][0]) * _ROW + int(at[0][1]), int(at[:, 1].min()), int(at[:, 1].max()), int(at[:, 0].min()), int(at[:, 0].max())))
        assert sorted(expected) == sorted((r.label, r.area, r.part, r.min_x, r.max_x, r.min_y, r.max_y) for r in got if r.img == img)


def test_rings_follow_each_other(pixels):
    got = stretches.rings(stretches.of_pixels(pixels)).collect()
    for img, m in enumerate(pictures()):
        for label in np.unique(m):
            expected = sorted((H.area(z), sorted((int(p.real), int(p.imag)) for p in z)) for z in I.loops(m == label))
            own = {}
            for r in got:
                if (r.img, r.label) == (img, label):
                    own.setdefault(r.ring, []).append((r.i, r.x, r.y, r.ex, r.ey, r.n))
            found = []
            for ring, sides in own.items():
                sides.sort()
                assert [s[0] for s in sides] == list(range(sides[0][5]))
                assert all(sides[k][3:5] == sides[(k + 1) % len(sides)][1:3] for k in range(len(sides)))
                assert ring // 4 == min(y * _ROW + x for _, x, y, *_ in sides)
                found.append((H.area(np.array([complex(s[1], s[2]) for s in sides])), sorted((s[1], s[2]) for s in sides)))
            assert sorted(found) == expected


def test_one_long_ring_takes_few_rounds(spark, monkeypatch):
    """A spiral of one pixel's width: a ring of over 200 corners, ranked in as many rounds as its length has digits."""
    m = np.zeros((41, 41), int)
    x, y, dx, dy = 0, 20, 1, 0
    steps = [n for n in range(40, 0, -2) for _ in range(2)]
    y = x = 0
    m[0, 0] = 1
    for n in steps:
        for _ in range(n):
            x, y = x + dx, y + dy
            m[y, x] = 1
        dx, dy = -dy, dx
    px = spark.createDataFrame([(1, int(b), int(a), int(v)) for (a, b), v in np.ndenumerate(m)], "img int, x int, y int, label int").where("label = 1")
    written = []
    keep = stretches.stored
    monkeypatch.setattr(stretches, "stored", lambda df: written.append(1) or keep(df))
    sizes = stretches.ring_sizes(stretches.rings(stretches.of_pixels(px))).collect()
    z = I.loops(m == 1)
    assert sorted(r.corners for r in sizes) == sorted(len(r) for r in z)
    assert sorted(r.area2 for r in sizes) == sorted(round(2 * H.area(r)) for r in z)
    assert len(written) <= 3 + 1 + max(r.corners for r in sizes).bit_length()


def test_specks(spark, labeled):
    colors = [(-1, 50.0, 0.0, 0.0), (0, 50.0, 0.0, 0.0), (1, 50.0, 90.0, 0.0), (2, 55.0, 0.0, 0.0)]
    table = spark.createDataFrame(colors, "label long, l double, a double, b double").select("label", F.struct("l", "a", "b").alias("lab"))
    got = {(r.img, r.part): r for r in stretches.without_specks(labeled, table).collect()}
    c = np.array([x[1:] for x in colors[1:]])
    for img, m in enumerate(pictures()):
        out, (ids, n) = I.without_specks(m, c, 25.0, 16, 2), I.parts(m)
        for k in range(n):
            y, x = np.argwhere(ids == k)[0]
            r = got.pop((img, int(y) * _ROW + int(x)))
            assert r.label == out[y, x] and r.merged == (out[y, x] != m[y, x])
    assert not got


def test_components_of_a_star_a_chain_and_a_ring(spark):
    links = [(0, 5, k) for k in range(10, 200)] + [(1, k, k + 1) for k in range(300)] + [(2, k, (k + 1) % 50) for k in range(50)] + [(2, 7, 7), (2, 8, 7), (3, 1000, 999)]
    got = {(r.img, r.node): r.part for r in stretches.components(spark.createDataFrame(links, "img int, a long, b long")).collect()}
    assert got == {**{(0, k): 5 for k in (5, *range(10, 200))}, **{(1, k): 0 for k in range(301)}, **{(2, k): 0 for k in range(50)}, (3, 1000): 999, (3, 999): 999}


def ring(*points):
    return [(float(x), float(y)) for x, y in points]


OUTLINES = "img long, label long, ring array<struct<x:double,y:double>>"


def test_winding_rules(spark):
    square, inner = ring((0, 0), (10, 0), (10, 8), (0, 8)), ring((2, 2), (8, 2), (8, 6), (2, 6))
    rows = [(1, 0, square), (1, 0, inner[::-1]), (2, 0, square), (2, 0, inner), (3, 0, ring((0, 0), (6, 0), (6, 6), (0, 6))), (3, 0, ring((4, 4), (9, 4), (9, 9), (4, 9))), (4, 0, ring((0, 0), (10, 0.2), (10, 0.4), (0, 0.3)))]
    o = spark.createDataFrame(rows, OUTLINES)
    found = lambda rule: sorted((r.img, r.area, len(r.holes)) for r in scan.regions(o, rule=rule).collect())
    assert found("nonzero") == [(1, 56.0, 1), (2, 80.0, 0), (3, 57.0, 0)]
    assert found("evenodd") == [(1, 56.0, 1), (2, 56.0, 1), (3, 21.0, 0), (3, 32.0, 0)]
    assert [r.area for r in scan.regions(o, least=57.0).orderBy("area").collect()] == [57.0, 80.0]
    # units of four pixels: outlines keep their size
    fine = scan.regions(o.where("img = 1"), pixels=4.0).first()
    assert fine.area == 56.0 and {(p.x, p.y) for p in fine.outer} == set(square) and {(p.x, p.y) for p in fine.holes[0]} == set(inner)


def test_scan_against_points(spark):
    """A random many-sided ring that crosses itself: each pixel's middle by its winding number."""
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 40, (12, 2))
    o = spark.createDataFrame([(1, 0, [tuple(map(float, p)) for p in points])], OUTLINES)
    for rule in ("nonzero", "evenodd"):
        got = np.zeros((40, 40), bool)
        for r in scan.spans(o, rule).collect():
            got[r.y, r.x1 : r.x2 + 1] = True
        for y in range(40):
            for x in range(40):
                wound = 0
                for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, 0), strict=True):
                    if (ay <= y + 0.5) != (by <= y + 0.5) and ax + (y + 0.5 - ay) * (bx - ax) / (by - ay) <= x + 0.5:
                        wound += 1 if by > ay else -1
                assert got[y, x] == (wound != 0 if rule == "nonzero" else wound % 2 == 1)


def test_hole_that_touches_the_outside_at_a_corner(spark):
    m = ["11110", "11011", "10111", "11111"]
    rows = [(1, 0, y, x, x) for y, line in enumerate(m) for x, v in enumerate(line) if v == "1"]
    st = spark.createDataFrame(rows, "img long, label long, y long, x1 long, x2 long")
    st = stretches.of_pixels(st.select("img", "label", "y", F.col("x1").alias("x")))
    sizes = sorted(r.area2 for r in stretches.ring_sizes(stretches.rings(st)).collect())
    loops = I.loops(np.array([[v == "1" for v in line] for line in m]))
    assert sizes == sorted(round(2 * H.area(z)) for z in loops)


def test_curved_contours(spark):
    q = spark.createDataFrame([([(0, 0, True), (10, 0, False), (10, 10, True), (0, 10, False)],), ([(0, 0, False), (10, 0, False), (10, 10, False), (0, 10, False)],)], "p array<struct<x:int,y:int,on:boolean>>")
    one, two = (r.r for r in q.select(scan.flattened(F.col("p"), 2).alias("r")).collect())
    assert [(p.x, p.y) for p in one] == [(0, 0), (7.5, 2.5), (10, 10), (2.5, 7.5)]
    assert sorted((p.x, p.y) for p in two) == [(0, 5), (1.25, 1.25), (1.25, 8.75), (5, 0), (5, 10), (8.75, 1.25), (8.75, 8.75), (10, 5)]


def test_text_that_the_font_lacks(spark):
    font = spark.createDataFrame([("a", 10, [ring((0, -8), (6, -8), (6, 0), (0, 0))]), (" ", 5, [])], "char string, advance long, rings array<array<struct<x:double,y:double>>>")
    texts = spark.createDataFrame([(1, "a a"), (2, "a\na"), (3, ""), (4, None), (5, "?"), (6, "a?a")], "text_id long, text string")
    got = sorted((r.img, r.area) for r in scan.regions(scan.placed_outlines(texts, font, 20)).collect())
    assert got == [(1, 48.0), (1, 48.0), (2, 48.0), (2, 48.0), (6, 48.0), (6, 48.0)]


def test_centers_of_many_pictures(spark):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for img in range(100):
        rgb = rng.integers(0, 256, (60 if img else 1, 3))
        rows += [(img, *map(int, p), k) for k, p in enumerate(rgb)]
        seen, first = np.unique(rgb, axis=0, return_index=True)
        points = np.floor(I.lab(rgb[np.sort(first)]) * 1e6 + 0.5)
        weight = np.array([(rgb == rgb[f]).all(1).sum() for f in np.sort(first)])
        c = [points[0]]
        while len(c) < 4:
            d = np.min([((points - q) ** 2).sum(1) for q in c], 0)
            if d.max() <= 0:
                break
            c.append(points[d.argmax()])
        moves = []
        for _ in range(16):
            near = np.argmin([((points - q) ** 2).sum(1) for q in c], 0)
            new = [np.floor((2 * (points * weight[:, None])[near == j].sum(0) + weight[near == j].sum()) / (2 * weight[near == j].sum())) if (near == j).any() else c[j] for j in range(len(c))]
            moves.append(sum(((a - b) ** 2).sum() for a, b in zip(new, c, strict=True)))
            c = new
            if moves[-1] < 0.01e12:
                break
        expected[img] = c
        assert not img or moves[0] > 0 < moves[1]
    got = {}
    for r in color.kmeans_by_picture(spark.createDataFrame(rows, "img int, r int, g int, b int, pos int"), 4).collect():
        got.setdefault(r.img, {})[r.place] = (r.l, r.a, r.b)
    for img, c in expected.items():
        assert len(got[img]) == len(c)
        assert all(np.abs(np.array(got[img][k]) - q).max() <= 1 for k, q in enumerate(c))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "img int, x int, y int, label int")
    st = stretches.of_pixels(none)
    assert stretches.parted(st).count() == stretches.rings(st).count() == 0
    assert scan.regions(spark.createDataFrame([], OUTLINES)).count() == 0
    assert color.kmeans_by_picture(spark.createDataFrame([], "img int, r int, g int, b int, pos int"), 3).count() == 0


def test_scopes_delete_their_own(spark):
    outside = tables.stored(spark.range(5))
    with tables.scope(spark) as own:
        inside, kept = tables.stored(spark.range(6)), tables.stored(spark.range(7))
        with tables.scope(spark):
            deeper = tables.stored(spark.range(8))
        own.release(kept)
    there = [os.path.exists(t.stored_at.removeprefix("file:")) for t in (outside, inside, deeper, kept)]
    assert there == [True, False, False, True]
    assert outside.count() == 5 and kept.count() == 7
    tables.forget(outside, kept)
    assert not os.path.exists(kept.stored_at.removeprefix("file:"))


def test_nearest_centers_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 3)], int(k % 41)) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, color.nearest_center(df).collect()))
    monkeypatch.setattr(color, "CENTERS_AT_ONCE", 6)
    assert sorted(map(tuple, color.nearest_center(df).collect())) == whole and len(whole) == 400
