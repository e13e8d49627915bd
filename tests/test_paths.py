"""Paths, masks and blobs as tables against the arrays' kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.kernels import fills as G
from threadloom.kernels import images as I
from threadloom.kernels import shapes as S
from threadloom.operators import color, paths, stretches

KEYS = ["path"]


def arrays():
    rng = np.random.default_rng(6)
    out = {0: np.array([0, 100 + 0j]), 1: np.array([5 + 5j] * 4), 2: np.array([0, 50, 50 + 50j, 50j]), 3: np.array([3 + 4j]), 4: np.array([0, 0, 30, 30, 30 + 300j])}
    for k in range(5, 25):
        out[k] = np.cumsum(rng.integers(-40, 41, 14) + 1j * rng.integers(-40, 41, 14))
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(k, i, int(p.real), int(p.imag)) for k, z in arrays().items() for i, p in enumerate(z)], "path int, i int, x int, y int").repartition(3)


def got(df, order="i"):
    out = {}
    for r in df.orderBy("path", *([order] if isinstance(order, str) else order)).collect():
        out.setdefault(r.path, []).append(complex(r.x, r.y))
    return {k: np.array(z) for k, z in out.items()}


@pytest.mark.parametrize("closed", [False, True])
def test_even_steps(points, closed):
    made = got(paths.resampled(points, KEYS, 25.0, closed=closed), "k")
    for k, z in arrays().items():
        expected = S.resample(np.append(z, z[0]) if closed else z, 25.0)
        # lengths are whole thousandths
        assert len(made[k]) == len(expected) and np.abs(made[k] - expected).max() < 0.02, k
    twelve = got(paths.resampled(points, KEYS, count=12), "k")
    assert all(len(z) == (12 if np.abs(np.diff(arrays()[k])).sum() else 1) for k, z in twelve.items())


@pytest.mark.parametrize("passes", [1, 2, 3])
def test_running(points, passes):
    made = got(paths.running(points, KEYS, 25, passes=passes), "seq")
    for k, z in arrays().items():
        if len(z) > 1 and np.abs(np.diff(z)).sum():
            (expected,) = G.running(z, 25, passes=passes)
            assert len(made[k]) == len(expected) and np.abs(made[k] - expected).max() <= 1, k


def test_equal_parts(points):
    made = got(paths.stepped(points, KEYS, 7.0), ["i", "part"])
    for k, z in arrays().items():
        assert np.abs(made[k] - S.densify(z, 7.0)).max() < 1e-9, k


def test_sides(points):
    some = {k: z for k, z in arrays().items() if k == 2 or k > 4}
    made = got(paths.offset(points, KEYS, 8.0))
    for k, z in some.items():
        assert np.abs(made[k] - S.inset(z, 8.0)).max() < 1e-9, k
    ribbons = got(paths.ribbon(points, KEYS, 5.0))
    assert not {1, 3} & ribbons.keys()
    for k, z in arrays().items():
        expected = S.ribbon(z, 5.0)
        if expected is not None:
            outer = expected[0]
            assert len(ribbons[k]) == len(outer) and abs(abs(S.area(ribbons[k])) - abs(S.area(outer))) < 1e-6, k


def test_columns(points):
    made, even = got(paths.satin(points, KEYS, 30.0, 40), "seq"), got(paths.resampled(points, KEYS, 40.0), "k")
    for k, z in arrays().items():
        if len(z) > 1 and np.abs(np.diff(z)).sum():
            # from the same even steps, as a cut hangs on whether one side moves twice as far
            side = G._normals(even[k]) * 15.0
            expected = G.zigzag(even[k] + side, even[k] - side)
            assert len(made[k]) == len(expected) and np.abs(made[k] - expected).max() <= 1, k
        else:
            assert k not in made


def test_ready_for_a_machine(points):
    made = got(paths.finished(points.withColumns({"x": F.floor(F.col("x") / 8).cast("int") * 9, "y": F.col("y") * 2}), KEYS), "seq")
    for k, z in arrays().items():
        z = np.floor(z.real / 8) * 9 + 2j * z.imag
        if len(z) >= 2:
            assert made[k].tolist() == G.finish(z).tolist(), k
    assert 3 not in made


def test_crossings(points):
    made = {r.path for r in paths.crossings(points, KEYS).collect()}
    for k, z in arrays().items():
        assert (k in made) == (len(z) > 2 and S.crossing(z)), k
    # the size of cells changes nothing
    pairs = lambda cell: sorted((r.path, r.i, r.j) for r in paths.crossings(points, KEYS, cell=cell).collect())
    assert pairs(16) == pairs(64) == pairs(5000)


def test_corners_and_pull(points):
    made = got(paths.corners_cut(points, KEYS), ["i", "part"])
    for k, z in arrays().items():
        if len(z) >= 3:
            assert np.abs(made[k] - S.rounded_corners(z, 1)).max() < 1e-9, k
    made = got(paths.pulled(points, KEYS, 4.0, 3.0))
    for k, z in arrays().items():
        if len(z) >= 3:
            expected, _ = G.compensated(z, [], 4.0, 3.0, 0.0)
            assert np.abs(made[k] - expected).max() < 1e-6, k


def test_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(0, 9)), float(rng.integers(-50, 50)) + 0.5, float(a := int(rng.integers(-99, 99))), float(a + int(rng.integers(1, 200)))) for k in range(80)]
    df = spark.createDataFrame(rows, "path int, row int, y double, x1 double, x2 double")
    made = got(paths.row_points(df, 30.0).select("path", "k", "x", "y"), "k")
    for k, row, y, x1, x2 in rows:
        expected = G.row_stitches(x1, x2, y, row, 30.0)
        assert len(made[k]) == len(expected) and np.abs(made[k] - expected).max() < 1e-6, k


def test_empty_paths(spark, points):
    none = points.where("false")
    for df in (paths.resampled(none, KEYS, 5.0), paths.stepped(none, KEYS, 5.0), paths.ribbon(none, KEYS, 5.0), paths.satin(none, KEYS, 5.0), paths.finished(none, KEYS), paths.crossings(none, KEYS), paths.pulled(none, KEYS, 1.0, 1.0)):
        assert df.count() == 0


def masks():
    rng = np.random.default_rng(8)
    return [rng.random((17, 23)) < p for p in (0.02, 0.2, 0.9)] + [np.zeros((17, 23), bool), np.ones((17, 23), bool)]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_discs(spark, radius):
    rows = [(k, int(x), int(y), 0) for k, m in enumerate(masks()) for y, x in np.argwhere(m)]
    st = stretches.of_pixels(spark.createDataFrame(rows, "img int, x int, y int, label int"))
    sizes = spark.createDataFrame([(k, 0, 23, 17) for k in range(len(masks()))], "img int, label long, width int, height int")

    def painted(df):
        out = [np.zeros((17, 23), bool) for _ in masks()]
        for r in df.collect():
            assert not out[r.img][r.y, r.x1 : r.x2 + 1].any()
            out[r.img][r.y, r.x1 : r.x2 + 1] = True
        return out

    for a, m in zip(painted(stretches.grown(st, radius, sizes.drop("label"))), masks(), strict=True):
        assert (a == I.grown(m, radius)).all()
    for a, m in zip(painted(stretches.shrunk(st, radius, sizes)), masks(), strict=True):
        assert (a == ~I.grown(~m, radius)).all()
    for a, m in zip(painted(stretches.outside(st, sizes)), masks(), strict=True):
        assert (a == ~m).all()


def test_backgrounds(spark):
    rng = np.random.default_rng(11)
    pictures = []
    for p in (0.4, 0.6, 0.75):
        a = np.full((15, 19, 4), 255, np.uint8)
        a[rng.random((15, 19)) < p, :3] = 90
        a[rng.random((15, 19)) < 0.05, 3] = 0
        pictures.append(a)
    rows = [(k, x, y, *map(int, a[y, x])) for k, a in enumerate(pictures) for y in range(15) for x in range(19)]
    out = [np.zeros((15, 19), bool) for _ in pictures]
    for r in stretches.background(spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int, a int")).collect():
        out[r.img][r.y, r.x1 : r.x2 + 1] = True
    for a, hidden in zip(pictures, out, strict=True):
        assert (hidden == I.background(a, True)).all()


def test_blobs_become_centers(spark):
    rgb = np.full((20, 30, 3), 200)
    for n, (y, x, h, w) in enumerate([(1, 1, 2, 2), (1, 8, 1, 3), (5, 2, 3, 4), (5, 12, 2, 5), (12, 2, 4, 4), (12, 15, 3, 3)]):
        rgb[y : y + h, x : x + w] = (20 + 40 * n, 10, 10)
    rows = [(1, x, y, *map(int, rgb[y, x])) for y in range(20) for x in range(30)] + [(2, x, 0, 9, 9, 9) for x in range(5)]
    px = spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int")
    base = color.kmeans_by_picture(px.where("x = 0 and y = 0").withColumn("pos", F.lit(0)), 1, 1)
    made = sorted((r.img, r.place, r.l, r.a, r.b) for r in color.promoted(px, base).collect())
    at = np.argwhere(np.ones((20, 30), bool))
    points = I.lab(rgb.reshape(-1, 3))
    expected = I.promoted(points, at, (20, 30), points[:1], 25.0)[1:]
    assert len(expected) == 4 and [m[:2] for m in made] == [(1, k) for k in range(1, 5)]
    assert np.abs(np.array([m[2:] for m in made]) / 1e6 - expected).max() < 1e-5


def test_small_parts_of_far_colors_stay(spark):
    parts = spark.createDataFrame([(1, 0, 0, 400), (1, 0, 1, 20), (1, 1, 2, 20), (1, 1, 3, 9), (1, 2, 4, 299)], "img int, label long, part long, area long")
    near = spark.createDataFrame([(0, 50.0, 0.0, 0.0), (1, 50.0, 90.0, 0.0), (2, 55.0, 0.0, 0.0)], "label long, l double, a double, b double").select("label", F.struct("l", "a", "b").alias("lab"))
    kept = lambda c: [r.kept for r in stretches.area_filter(parts, c).orderBy("part").collect()]
    assert kept(near) == [True, True, True, False, True]
    assert kept(near.where("label <> 1")) == [True, False, False, False, False]
