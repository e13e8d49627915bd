"""Registered queries of single kernels: paths, rings, curves, stitches, masks, files and edits, on figures of which SQL states the results."""

from __future__ import annotations

from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from threadloom.functions import dims
from threadloom.functions import exprs as X
from threadloom.kernels import codec, svg
from threadloom.kernels import fills as G
from threadloom.kernels import images as I
from threadloom.kernels import shapes as S
from threadloom.operators import color, edits, report
from threadloom.plans import digitize as D
from threadloom.plans import incremental, sketch, udtf
from threadloom.sources import adapters as A
from threadloom.tables import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def _each(spark, d, schema: str, one, table: str = "customer", key: str = "c_custkey"):
    """A row of values for each row of a table, from its key; several where `one` gives a list of tuples."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["k"].tolist():
                made = one(k)
                out += [(k, *r) for r in made] if isinstance(made, list) else [(k, *made)]
            yield pd.DataFrame(out, columns=names)

    return A.dealt(A.table(spark, d, table).select(F.col(key).alias("k")), "k").mapInPandas(run, schema)


def _milli(v) -> int:
    return int(np.floor(float(v) * 1000 + 0.5))


_M = lambda e: f"cast(floor(({e}) * 1000.0::DOUBLE + 0.5) AS BIGINT)"
_K = "WITH c AS (SELECT c_custkey AS k FROM customer)"


@query("point_functions", _K + f""", p AS (SELECT k, k % 97 - 40 AS px, k % 89 - 30 AS py, 60 + k % 50 AS bx, k % 31 AS by_ FROM c),
q AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * bx + py * by_) / (bx * bx + by_ * by_)::DOUBLE)) AS t FROM p)
SELECT k, {_M('sqrt((px - t * bx) * (px - t * bx) + (py - t * by_) * (py - t * by_))')} AS gap, {_M('degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (bx * px + by_ * py) / (sqrt((bx * bx + by_ * by_)::DOUBLE) * sqrt((px * px + py * py)::DOUBLE))))))')} AS turn,
{_M('sin(k * 127.1::DOUBLE + 311.7::DOUBLE) * 43758.5453::DOUBLE - floor(sin(k * 127.1::DOUBLE + 311.7::DOUBLE) * 43758.5453::DOUBLE)')} AS noise, {_M('-2.0::DOUBLE * px * cos(0.5::DOUBLE) - 2.0::DOUBLE * py * sin(0.5::DOUBLE) + 7')} AS mx, {_M('-2.0::DOUBLE * px * sin(0.5::DOUBLE) + 2.0::DOUBLE * py * cos(0.5::DOUBLE) - 3')} AS my FROM q WHERE px <> 0 OR py <> 0""")
def _(spark, d):
    """Distance to a segment, turn between two directions, noise, and a point that is scaled, flipped, turned and moved."""
    k = F.col("k")
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", (k % 97 - 40).alias("px"), (k % 89 - 30).alias("py"), (60 + k % 50).alias("bx"), (k % 31).alias("by")).where("px <> 0 or py <> 0")
    moved = X.transform_ring(F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))), 7.0, -3.0, 0.5, 2.0, flip_x=True)
    return c.select("k", X.milli(X.segment_distance("px", "py", F.lit(0), F.lit(0), "bx", "by")).alias("gap"), X.milli(X.turn_degrees("bx", "by", "px", "py")).alias("turn"), X.milli(X.noise("k")).alias("noise"), X.milli(moved[0]["x"]).alias("mx"), X.milli(moved[0]["y"]).alias("my"))


@query("chaikin_ring", f"WITH {A.OUTLINES_SQL}, e AS (SELECT a.poly, a.i, a.x, a.y, b.x AS nx, b.y AS ny FROM poly a JOIN poly b ON a.poly = b.poly AND b.ring = 0 AND b.i = (a.i + 1) % 4 WHERE a.ring = 0) SELECT poly, cast(2 * i + q AS INT) AS i, x * 4 + (nx - x) * (1 + 2 * q) AS x4, y * 4 + (ny - y) * (1 + 2 * q) AS y4 FROM e, range(0, 2) t(q)")
def _(spark, d):
    r = A.rings(spark, d).select("poly", F.posexplode(X.chaikin("outer")).alias("i", "p"))
    return r.select("poly", "i", (F.col("p.x") * 4).cast("long").alias("x4"), (F.col("p.y") * 4).cast("long").alias("y4"))


@query("corner_keeping", _K + " SELECT k, 4::BIGINT AS box_points, true AS box_same, 2 * (12 + k % 20) AS round_points, 0::BIGINT AS sharp_left FROM c")
def _(spark, d):
    """Corner cutting leaves a box as it is, and doubles the points of a polygon that turns gently."""

    def one(k):
        box = S.ring([(0, 0), (50 + k % 40, 0), (50 + k % 40, 30), (0, 30)])
        n = 12 + k % 20
        gentle = 100 * np.exp(2j * np.pi * np.arange(n) / n)
        kept, cut = S.rounded_corners(box, 2), S.rounded_corners(gentle, 1)
        return len(kept), bool(np.array_equal(kept, box)), len(cut), int((S.turns(cut) >= 60).sum())

    return _each(spark, d, "k bigint, box_points bigint, box_same boolean, round_points bigint, sharp_left bigint", one)


@query("simplified_paths", _K + " SELECT k, CASE WHEN k % 5 <= 2 THEN 2 ELSE 3 + k % 7 END AS open_points, CASE WHEN k % 5 <= 2 THEN 4 ELSE 8 END::BIGINT AS ring_points FROM c")
def _(spark, d):
    """Paths that swing out by k % 5 to both sides, at a tolerance of 2.5 (one side's swing is all that shows against the chord), and boxes
    with such swings in the middle of their sides."""

    def one(k):
        a, n = k % 5, 3 + k % 7
        z = np.arange(n) * 50 + 1j * a * np.where(np.arange(n) % 2, 1, -1) * np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), 0, 1)
        ring = S.ring([(0, 0), (50, -a), (100, 0), (100 + a, 40), (100, 80), (50, 80 + a), (0, 80), (-a, 40)])
        return len(S.simplify(z, 2.5)), len(S.simplify_ring(ring, 2.5))

    return _each(spark, d, "k bigint, open_points bigint, ring_points bigint", one)


@query("resampled_paths", _K + f""", p AS (SELECT k, 60 + k % 40 AS w, 30 + k % 25 AS h FROM c), n AS (SELECT *, floor((w + h) / 7.0::DOUBLE + 0.5)::BIGINT AS n FROM p)
SELECT k, n + 1 AS points, {_M('CASE WHEN (w + h)::DOUBLE * (n // 2) / n <= w THEN (w + h)::DOUBLE * (n // 2) / n ELSE w END')} AS mid_x, {_M('greatest(0, (w + h)::DOUBLE * (n // 2) / n - w)')} AS mid_y, 12::BIGINT AS counted, 1 + ceil(w / 7.0::DOUBLE)::BIGINT + ceil(h / 7.0::DOUBLE)::BIGINT AS dense FROM n""")
def _(spark, d):
    """Angles of two legs at even steps of 7, at twelve points, and with no step over 7."""

    def one(k):
        w, h = 60 + k % 40, 30 + k % 25
        z = np.array([0, w, w + 1j * h])
        even = S.resample(z, 7.0)
        mid = even[(len(even) - 1) // 2]
        return len(even), _milli(mid.real), _milli(mid.imag), len(S.resample(z, count=12)), len(S.densify(z, 7.0))

    return _each(spark, d, "k bigint, points bigint, mid_x bigint, mid_y bigint, counted bigint, dense bigint", one)


@query("ring_walks", _K + """, p AS (SELECT k, 60 + k % 40 AS w, 30 + k % 25 AS h, k % 60 AS s FROM c)
SELECT k, s AS px, 0::BIGINT AS py, least((w + h) - s + k % 20, 2 * (w + h) - ((w + h) - s + k % 20)) AS way, 5::BIGINT AS gap, s AS place FROM p""")
def _(spark, d):
    """A point along a ring, the shorter way from it to one on the opposite side, and the ring's point nearest to one beside it."""

    def one(k):
        w, h, s = 60 + k % 40, 30 + k % 25, k % 60
        t = S.Track(S.ring([(0, 0), (w, 0), (w, h), (0, h)]))
        p = t.point(s)
        way = np.abs(np.diff(t.walk(s, w + h + k % 20))).sum()
        place, gap = t.nearest(p - 5j)
        return round(p.real), round(p.imag), round(way), round(gap), round(place)

    return _each(spark, d, "k bigint, px bigint, py bigint, way bigint, gap bigint, place bigint", one)


@query("crossings", _K + " SELECT k, k % 2 = 1 AS crosses FROM c")
def _(spark, d):
    """Rings of which every other one is a bow tie."""
    return _each(spark, d, "k bigint, crosses boolean", lambda k: (S.crossing(S.ring([(0, 0), (50 + k % 9, 0), (50 + k % 9, 30), (0, 30)] if k % 2 == 0 else [(0, 0), (50 + k % 9, 30), (50 + k % 9, 0), (0, 30)])),))


@query("ribbons", _K + " SELECT k, (40 + k % 60) * 2 * (3 + k % 5) AS area, 0::BIGINT AS holes, 1::BIGINT AS ring_holes FROM c")
def _(spark, d):
    """Straight strokes as areas, and closed ones as areas with a hole."""

    def one(k):
        r = 3 + k % 5
        outer, holes = S.ribbon(np.array([0, 40 + k % 60], complex), r)
        _, inner = S.ribbon(S.ring([(0, 0), (50, 0), (50, 60), (0, 60)]), r, closed=True)
        return round(abs(S.area(outer))), len(holes), len(inner)

    return _each(spark, d, "k bigint, area bigint, holes bigint, ring_holes bigint", one)


@query("inset_and_pull", _K + f""", p AS (SELECT k, 60 + k % 40 AS w, 30 + k % 25 AS h, 1 + k % 4 AS pull, 1 + k % 3 AS push FROM c)
SELECT k, {_M('w - 2 * 8 * sqrt(0.5::DOUBLE)')} AS inset_w, w - 2 * push AS fill_w, h + 2 * pull AS fill_h, CASE WHEN w >= h THEN w ELSE w + 2 * pull END AS column_w, CASE WHEN w >= h THEN h + 2 * pull ELSE h END AS column_h FROM p""")
def _(spark, d):
    """Boxes moved in along their corners, widened across level rows and shortened along them, and widened as columns."""

    def one(k):
        w, h, pull, push = 60 + k % 40, 30 + k % 25, 1 + k % 4, 1 + k % 3
        box = S.ring([(0, 0), (w, 0), (w, h), (0, h)])
        side = lambda z: (round(np.ptp(z.real)), round(np.ptp(z.imag)))
        return (_milli(np.ptp(S.inset(box, 8).real)), *side(G.compensated(box, [], pull, push, 0.0)[0]), *side(G.compensated_column(box, [], pull)[0]))

    return _each(spark, d, "k bigint, inset_w bigint, fill_w bigint, fill_h bigint, column_w bigint, column_h bigint", one)


_N = lambda e: f"cast(floor(({e}) * 1000.0::DOUBLE + 0.500001::DOUBLE) AS BIGINT)"
_SVG_CURVES = _K + f""", g AS (SELECT k, 10 + k % 30 AS a, 20 + k % 17 AS b FROM c), t AS (SELECT *, range AS i, range / 24.0::DOUBLE AS t FROM g, range(1, 25))
SELECT k, 'Q' AS kind, i, {_N('2 * (1 - t) * t * a + t * t * 60')} AS x, {_N('2 * (1 - t) * t * b')} AS y FROM t UNION ALL SELECT k, 'C', i, {_N('3 * (1 - t) * t * t * a + t * t * t * 60')}, {_N('3 * (1 - t) * (1 - t) * t * b + 3 * (1 - t) * t * t * b')} FROM t
UNION ALL SELECT k, 'A', i, {_N('a - a * cos(pi() * t)')}, {_N('-a * sin(pi() * t)')} FROM t"""


@query("flattened_curves", _SVG_CURVES)
def _(spark, d):
    """A quadratic and a cubic curve and half a circle, at 24 parameters."""

    def drawn(k):
        a, b = 10 + k % 30, 20 + k % 17
        return [svg.path(text)[0][0][1:] for text in (f"M0 0 Q{a} {b} 60 0", f"M0,0 C0,{b} {a} {b} 60 0", f"M0 0 a{a} {a} 0 0 1 {2 * a} 0")]

    def run(batches):
        # a little over a half, as some values lie on one
        near = lambda v: np.floor(v * 1000 + 0.500001).astype(np.int64)
        for pdf in batches:
            # a row for each point: a frame is made of columns, for some hundred figures at a time
            for start in range(0, len(pdf), 500):
                keys = pdf["k"].to_numpy()[start : start + 500]
                curves = [z for k in keys.tolist() for z in drawn(k)]
                n = np.array([len(z) for z in curves])
                z = np.concatenate(curves)
                yield pd.DataFrame({"k": np.repeat(np.repeat(keys, 3), n), "kind": np.repeat(np.tile(np.array(["Q", "C", "A"], object), len(keys)), n), "i": np.concatenate([np.arange(1, m + 1) for m in n.tolist()]), "x": near(z.real), "y": near(z.imag)})

    return A.dealt(A.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k").mapInPandas(run, "k bigint, kind string, i bigint, x bigint, y bigint")


@query("transform_lists", _K + f""", v AS (SELECT k, k % 7 AS tx, k % 5 + 1 AS s, radians(k % 90)::DOUBLE AS r FROM c)
SELECT k, {_M('tx + (10.0::DOUBLE * s * cos(r) - 4.0::DOUBLE * s * sin(r))')} AS x, {_M('3 + (10.0::DOUBLE * s * sin(r) + 4.0::DOUBLE * s * cos(r))')} AS y FROM v""")
def _(spark, d):
    """translate, rotate and scale, the last one first."""
    return _each(spark, d, "k bigint, x bigint, y bigint", lambda k: (lambda p: (_milli(round(p.real, 9)), _milli(round(p.imag, 9))))(svg.moved(np.array([10 + 4j]), svg.matrix(f"translate({k % 7}, 3) rotate({k % 90}) scale({k % 5 + 1})"))[0]))


@query("svg_shapes", _K + """ SELECT k, ['rect', 'circle', 'ellipse', 'polygon', 'polyline', 'path'][k % 6 + 1] AS tag, [4, 48, 48, 3, 3, 4][k % 6 + 1]::BIGINT AS points, k % 6 <> 4 AS closed, CASE WHEN k % 2 = 0 THEN 10 ELSE 200 END::BIGINT AS red FROM c""")
def _(spark, d):
    """Basic shapes, with colours from a style, from an attribute, or from the group around them."""

    def one(k):
        w = 20 + k % 30
        tag, attributes = (("rect", f'x="1" y="2" width="{w}" height="10"'), ("circle", f'cx="0" cy="0" r="{w}"'), ("ellipse", f'cx="0" cy="0" rx="{w}" ry="9"'), ("polygon", f'points="0,0 {w},0 0,9"'), ("polyline", f'points="0 0 {w} 0 0 9"'), ("path", f'd="M0 0H{w}V9H0Z"'))[k % 6]
        own = 'style="fill: rgb(10, 20, 30)"' if k % 2 == 0 else ""
        fills, _ = svg.shapes(f'<svg><g fill="#c81e1e"><{tag} {attributes} {own}/></g></svg>')
        outline = svg.outlines(tag, ElementTree.fromstring(f"<{tag} {attributes}/>").attrib)[0]
        return tag, len(fills[0][1][0]), outline[1], fills[0][0][0]

    return _each(spark, d, "k bigint, tag string, points bigint, closed boolean, red bigint", one)


@query("running_lines", _K + """, p AS (SELECT k, 200 + k % 90 AS l, floor((200 + k % 90) / 25.0::DOUBLE + 0.5)::BIGINT AS n, floor(4 * (100 + k % 30) / 25.0::DOUBLE + 0.5)::BIGINT AS m FROM c)
SELECT k, n + 1 AS once, 2 * n + 1 AS twice, 3 * n + 1 AS thrice, m + 1 AS closed, 3 * floor(4 * (100 + k % 30) / 30.0::DOUBLE + 0.5)::BIGINT + 1 AS outline, CASE WHEN 0.3 + k % 20 / 10.0 < 0.8 THEN 'running' WHEN 0.3 + k % 20 / 10.0 < 1.4 THEN 'triple' ELSE 'satin' END AS style FROM p""")
def _(spark, d):
    """Stitches of lines sewn once, there and back, three times, of closed ones, of outlines, and how a width is sewn."""

    def one(k):
        line, side = np.array([0, 200 + k % 90], complex), 100 + k % 30
        box = S.ring([(0, 0), (side, 0), (side, side), (0, side)])
        return (*(len(G.running(line, passes=p)[0]) for p in (1, 2, 3)), len(G.running(box, closed=True)[0]), len(G.outline(box, [], 30)[0]), sketch.stroke_style(round(0.3 + k % 20 / 10, 1)))

    return _each(spark, d, "k bigint, once bigint, twice bigint, thrice bigint, closed bigint, outline bigint, style string", one)


@query("finished_runs", _K + """, p AS (SELECT k, 3 + k % 8 AS n, 2 + k % 9 AS gap, 130 + k % 400 AS long FROM c)
SELECT k, 1 + ceil(long / 121.0::DOUBLE)::BIGINT AS long_stitches, CASE WHEN gap >= 5 THEN n ELSE 1 + ceil((n - 1) / ceil(5.0::DOUBLE / gap))::BIGINT END AS merged, gap * (n - 1) AS reach FROM p""")
def _(spark, d):
    """Runs with steps too long, and with steps too short: what is nearer than 0.5 mm to the last one kept goes, but not the end."""

    def one(k):
        n, gap, far = 3 + k % 8, 2 + k % 9, 130 + k % 400
        short = G.finish(np.arange(n) * gap + 0j)
        return len(G.finish(np.array([0, far], complex))), len(short), round(short.real.max())

    return _each(spark, d, "k bigint, long_stitches bigint, merged bigint, reach bigint", one)


@query("satin_lines", _K + """, p AS (SELECT k, 90 + k % 70 AS l, floor((90 + k % 70) / 3.0::DOUBLE + 0.5)::BIGINT AS n, 30 + 2 * (k % 20) AS w FROM c)
SELECT k, 2 * (n + 1) AS stitches, cast(floor(w / 2.0::DOUBLE + 0.5) AS BIGINT) AS hi, cast(floor(-w / 2.0::DOUBLE + 0.5) AS BIGINT) AS lo, 4::BIGINT AS split, floor(l / 25.0::DOUBLE + 0.5)::BIGINT + 1 AS center, CASE WHEN w >= 25 THEN 2 * (floor(l / 15.0::DOUBLE + 0.5)::BIGINT + 1) END AS zigzag FROM p""")
def _(spark, d):
    """Columns along straight paths, rails that are cut where one side moves twice as far, and the two kinds of underlay."""

    def one(k):
        l, w = 90 + k % 70, 30 + 2 * (k % 20)
        run = G.satin_line(np.array([0, l], complex), w)[0]
        rails = G.zigzag(np.array([0, 10j]), np.array([50, 50 + 20j]))
        under = G.satin_underlay(run, ("center", "zigzag"))
        return len(run), round(run.imag.max()), round(run.imag.min()), len(rails) - 2, len(under[0]), len(under[1])

    return _each(spark, d, "k bigint, stitches bigint, hi bigint, lo bigint, split bigint, center bigint, zigzag bigint", one)


@query("fill_underlays", _K + """, p AS (SELECT k, 120 + k % 60 AS w, 90 + k % 50 AS h FROM c)
SELECT k, 2::BIGINT AS runs, cast(floor((2 * (w + h) - 8 * 8 * sqrt(0.5::DOUBLE)) / 25 + 0.5) AS BIGINT) + 1 AS edge, cast(floor(2.0::DOUBLE * (w + h) / 30 + 0.5) AS BIGINT) + 1 AS micro, greatest(1, h // 30) AS rows FROM p""")
def _(spark, d):
    """A line inside the edge, wide level rows (their turns are counted), and the walk around a region too small for rows."""

    def one(k):
        w, h = 120 + k % 60, 90 + k % 50
        box = S.ring([(0, 0), (w, 0), (w, h), (0, h)])
        under = G.fill_underlay(box, [], ("edge", "tatami"), 90.0)
        edge, rows = under
        return len(under), len(edge), len(G.micro(box)[0]), len(np.unique(np.round(rows.imag)))

    return _each(spark, d, "k bigint, runs bigint, edge bigint, micro bigint, rows bigint", one)


@query("row_penetrations", _K + """, p AS (SELECT k, 70 + k % 90 AS w, k % 8 AS row FROM c), q AS (SELECT *, CASE WHEN row % 2 = 1 THEN 15 ELSE 30 END AS start FROM p)
SELECT k, 2 + greatest(0, ceil((w - 7.5::DOUBLE - start) / 30))::BIGINT AS stitches, CASE WHEN w - 7.5 > start THEN start ELSE w END AS second FROM q""")
def _(spark, d):
    """A row's penetrations without jitter: odd rows begin half a stitch earlier."""
    return _each(spark, d, "k bigint, stitches bigint, second bigint", lambda k: (lambda z: (len(z), round(z[1].real)))(G.row_stitches(0.0, 70.0 + k % 90, 0.0, k % 8, 30.0, 0.0)))


@query("grown_masks", _K + """, r AS (SELECT k, 1 + k % 6 AS r FROM c)
SELECT k, (SELECT count(*) FROM range(-6, 7) a(x), range(-6, 7) b(y) WHERE x * x + y * y <= r * r) AS disc, 2 * r * r + 2 * r + 1 AS steps, 2 * (11 - r) + 1 AS eroded FROM r""")
def _(spark, d):
    """A pixel grown by a disc, by steps through an open field, and a square shrunk: its half side is 11."""

    def one(k):
        r = 1 + k % 6
        m = np.zeros((41, 41), bool)
        m[20, 20] = True
        square = np.zeros((41, 41), bool)
        square[9:32, 9:32] = True
        return int(I.grown(m, r).sum()), int(I.grown(m, r, np.ones_like(m)).sum()), int((~I.grown(~square, r)).any(0).sum())

    return _each(spark, d, "k bigint, disc bigint, steps bigint, eroded bigint", one)


@query("background_masks", _K + """, p AS (SELECT k, 8 + k % 9 AS w, 6 + k % 5 AS h, k % 3 AS m FROM c)
SELECT k, CASE m WHEN 0 THEN 30 * 24 - w * h WHEN 1 THEN 4 ELSE 30 * 24 - w * h + 4 END::BIGINT AS hidden FROM p""")
def _(spark, d):
    """White around a box, with white (or, in two of three, transparent) pixels in it that the border does not reach."""

    def one(k):
        w, h, m = 8 + k % 9, 6 + k % 5, k % 3
        a = np.full((24, 30, 4), 255, np.uint8)
        a[3 : 3 + h, 3 : 3 + w, :3] = (200, 30, 30)
        a[5:7, 5:7] = (255, 255, 255, 0 if m else 255)
        return (int(I.background(a, m != 1).sum()),)

    return _each(spark, d, "k bigint, hidden bigint", one)


@query("label_parts", _K + " SELECT k, 2 + k % 4 AS parts, CASE WHEN k % 4 >= 1 THEN 6 ELSE 0 END::BIGINT AS bridged FROM c")
def _(spark, d):
    """Connected parts of a map with some separate boxes, and the gap between two of them that closing fills."""

    def one(k):
        m = np.full((12, 60), -1)
        for j in range(1 + k % 4):
            m[3:6, 2 + 12 * j : 8 + 12 * j] = 0
        if k % 4 >= 1:
            m[3:6, 10:14] = 0
        return I.parts(m)[1], int(((I.closed_gaps(m, 1, 1) == 0) & (m == -1)).sum())

    return _each(spark, d, "k bigint, parts bigint, bridged bigint", one)


@query("bucket_fills", "SELECT s_suppkey AS k, ['ok', 'ok', 'open', 'on-line'][s_suppkey % 4 + 1] AS status, CASE WHEN s_suppkey % 4 < 2 THEN 1 ELSE 0 END::BIGINT AS rings FROM supplier")
def _(spark, d):
    """Boxes of strokes: closed, with a gap of half a millimetre, with a wide one, and asked on the line itself."""

    def one(k):
        gap = (0, 0.5, 8, 0)[k % 4]
        box = np.array([0, 20, 20 + 20j, 20j, 1j * gap]) - 10 - 10j
        status, rings = I.bucket([(box, 1.0)], -9.9 - 0j if k % 4 == 3 else 0j, cells=200)
        return status, len(rings)

    return _each(spark, d, "k bigint, status string, rings bigint", one, "supplier", "s_suppkey")


@query("lab_centers", f"""WITH {A.COLORS_SQL}, three(r, g, b) AS (VALUES (220, 30, 30), (30, 60, 200), (255, 255, 255)), u AS (SELECT r, g, b, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM three),
l AS (SELECT r, CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END AS x, CASE WHEN y <= 0.04045 THEN y / 12.92 ELSE pow((y + 0.055) / 1.055, 2.4) END AS y, CASE WHEN z <= 0.04045 THEN z / 12.92 ELSE pow((z + 0.055) / 1.055, 2.4) END AS z FROM u),
m AS (SELECT r, (x * 0.4124 + y * 0.3576 + z * 0.1805) / 0.95047 AS x, x * 0.2126 + y * 0.7152 + z * 0.0722 AS y, (x * 0.0193 + y * 0.1192 + z * 0.9505) / 1.08883 AS z FROM l), n AS (SELECT r, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16.0::DOUBLE / 116 END AS x, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16.0::DOUBLE / 116 END AS y, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16.0::DOUBLE / 116 END AS z FROM m)
SELECT cast(floor((116 * y - 16) * 10 + 1e-9) AS BIGINT) AS l, cast(floor(500 * (x - y) * 10 + 1e-9) AS BIGINT) AS a, cast(floor(200 * (y - z) * 10 + 1e-9) AS BIGINT) AS b FROM n""")
def _(spark, d):
    """Means of three colours' pixels: the first colour, the farthest from it, and the farthest from both."""
    k = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % 3 + 1).cast("int"))
    px = A.table(spark, d, "part").select(pick(220, 30, 255).alias("r"), pick(30, 60, 255).alias("g"), pick(30, 200, 255).alias("b"), k.alias("pos"))
    c = color.kmeans_by_picture(px.withColumn("img", F.lit(0)), 3)
    return c.select(*(F.floor(F.col(m) / 100_000.0 + 1e-9).cast("long").alias(m) for m in "lab"))


@query("dst_headers", _K + """ SELECT k, 'LA:Job ' || rpad((k % 1000)::VARCHAR, 12, ' ') || chr(13) || 'ST:' || lpad((3 + k % 20 + 1 + 2 * 2)::VARCHAR, 7, ' ') || chr(13) || 'CO:  0' || chr(13) || '+X:' || lpad((10 * (2 + k % 20))::VARCHAR, 5, ' ') || chr(13) AS head, 512 + 3 * (3 + k % 20 + 1 + 2 * 2) + 3 AS bytes FROM c""")
def _(spark, d):
    """The first fields of a header, padded with spaces, and a file's size: the stitches of a line, the jump to it, and two stitches of a lock at
    each end."""

    def one(k):
        plan = {"name": f"Job {k % 1000}", "blocks": [{"thread": {"r": 0, "g": 0, "b": 0}, "runs": [{"stitches": [(10 * j, 0) for j in range(3 + k % 20)], "connection": "jump"}]}]}
        made = codec.write_dst(plan)
        return made[:47].decode(), len(made)

    return _each(spark, d, "k bigint, head string, bytes bigint", one)


@query("thumbnails", _K + """, p AS (SELECT k, 20 + k % 60 AS w, 15 + k % 40 AS h FROM c), s AS (SELECT *, least(44.0::DOUBLE / w, 34.0::DOUBLE / h) AS f FROM p),
o AS (SELECT k, floor(x * f + (48 - w * f) / 2 + 0.5)::BIGINT AS px, floor(y * f + (38 - h * f) / 2 + 0.5)::BIGINT AS py FROM s, (SELECT range AS a FROM range(0, 6)), (SELECT range AS b FROM range(0, 6)), LATERAL (SELECT a * w // 5 AS x, b * h // 5 AS y))
SELECT k, count(DISTINCT px * 100 + py) AS pixels, cast(sum(DISTINCT px * 100 + py) AS BIGINT) AS places FROM o GROUP BY k""")
def _(spark, d):
    """Pixels of a plan's picture of 48 by 38, read back from its bits."""

    def one(k):
        w, h = 20 + k % 60, 15 + k % 40
        plan = {"blocks": [{"runs": [{"stitches": [(a * w // 5, b * h // 5) for a in range(6) for b in range(6)]}]}]}
        bits = np.unpackbits(np.frombuffer(codec.thumbnail(plan), np.uint8).reshape(38, 6), axis=1, bitorder="little")
        y, x = np.nonzero(bits)
        return len(x), int((x * 100 + y).sum())

    return _each(spark, d, "k bigint, pixels bigint, places bigint", one)


@query("embedded_documents", """SELECT c_custkey AS k, c_name AS name, length(c_name) + 12 AS extra, 1::BIGINT AS elements, c_custkey % 7 + 0.125::DOUBLE AS x FROM customer""")
def _(spark, d):
    """Sketch documents in PES files, found again by their mark; decimals are kept to a thousandth."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, name in zip(pdf["k"].tolist(), pdf["name"], strict=True):
                doc = sketch.load(sketch.save({"name": name, "layers": [{"elements": [{"kind": "stroke", "points": [[k % 7 + 0.1250004, 0.0], [9.0, 0.0]], "width": 0.5, "color": [0, 0, 0]}]}]}))
                plan = {"name": name, "blocks": [{"thread": {"r": 0, "g": 0, "b": 0}, "runs": [{"stitches": [(0, 0), (50, 0)], "connection": "jump"}]}]}
                text = sketch.save(doc)
                made = codec.write_pes(plan, codec.with_document(text))
                back = sketch.load(codec.embedded_document(made))
                out.append((k, back["name"], len(made) - len(codec.write_pes(plan)) - len(text) + len(name), len(back["layers"][0]["elements"]), back["layers"][0]["elements"][0]["points"][0][0]))
            yield pd.DataFrame(out, columns=["k", "name", "extra", "elements", "x"])

    return A.dealt(A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k").mapInPandas(run, "k bigint, name string, extra bigint, elements bigint, x double")


@query("reopened_stitches", _K + " SELECT k, ['stroke', 'stroke', 'fill'][k % 3 + 1] AS kind, ['auto', 'satin', NULL][k % 3 + 1] AS style, CASE k % 3 WHEN 0 THEN 0.5 WHEN 1 THEN (20 + 2 * (k % 8)) / 10.0 END::DOUBLE AS width, CASE k % 3 WHEN 2 THEN 0.0 END::DOUBLE AS angle FROM c")
def _(spark, d):
    """Runs read back as what they were sewn for: lines, columns of their width, fills with their row angle."""

    def one(k):
        if k % 3 == 0:
            z = np.arange(12) * 2.0 + 1j * (k % 5)
        elif k % 3 == 1:
            w = (20 + 2 * (k % 8)) / 10
            z = np.array([(j // 2) * 0.4 + (1j * w if j % 2 else 0) for j in range(60)])
        else:
            z = np.concatenate([np.arange(0, 21, 3.0)[:: 1 if r % 2 == 0 else -1] + 0.4j * r for r in range(30)])
        e = sketch.reconstruct(z, (10, 20, 30))[0]
        return e["kind"], e.get("style"), round(e["width"], 1) if "width" in e else None, e.get("angle")

    return _each(spark, d, "k bigint, kind string, style string, width double, angle double", one)


@query("incremental_designs", "SELECT c_custkey % 50 AS design_id, c_custkey % 50 % 3 <> 0 AS kept FROM customer GROUP BY ALL")
def _(spark, d):
    """Designs of which every third one gets another row angle: the others' stitches are taken from the run before, where all had a mark."""
    r, g, b = report.thread_color("thread")
    base = A.rings(spark, d).select("design_id", F.col("poly").cast("int").alias("region_idx"), "outer", F.array().cast("array<array<struct<x:bigint,y:bigint>>>").alias("holes"), r.alias("r"), g.alias("g"), b.alias("b"), F.lit(30.0).alias("angle_deg"))
    first = stored(incremental.regenerate(base, D.digitize_runs(base.limit(0)).withColumn("hash", F.lit(0).cast("long")), D.Options(), D.digitize_runs))
    marked = first.withColumn("stitch_type", F.lit("kept"))
    changed = base.withColumn("angle_deg", F.when(F.col("design_id") % 3 == 0, 60.0).otherwise(30.0))
    out = incremental.regenerate(changed, marked.select(*first.columns), D.Options(), D.digitize_runs)
    return out.groupBy("design_id").agg(F.bool_and(F.col("stitch_type") == "kept").alias("kept"))


@query("generators_in_sql", _K + ", p AS (SELECT k, 20 + k % 60 AS w, 20 + (k * 7) % 60 AS h FROM c) SELECT k AS poly, floor(4 * (w + h) / 25.0::DOUBLE + 0.5)::BIGINT + 1 AS stitches FROM p")
def _(spark, d):
    """A registered generator as a table function of SQL: lines around outlines."""
    udtf.register(spark)
    A.dealt(A.rings(spark, d).select("poly", F.transform("outer", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("outer")), "poly").createOrReplaceTempView("rings_of_outlines")
    return spark.sql("SELECT poly, count(*) AS stitches FROM rings_of_outlines, LATERAL stitches_of('running', outer, null, null) GROUP BY poly")


@query("path_edits", _K + """ SELECT k, '0,1,9,2,3' AS inserted, '0,2,3' AS deleted, '0,1|1,2,3' AS split, '0,1,2,3,4,5' AS joined, '0,0.5,1,1.5,2,2.5,3' AS divided, k % 10 + 1 AS moved, CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 2 END AS spaced FROM c""")
def _(spark, d):
    """Nodes inserted, deleted, moved, paths split and joined, divided, and thinned out to a gap."""
    at = lambda *xs: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in xs))
    text = lambda p: F.array_join(F.transform(p, lambda v: F.regexp_replace(v["x"].cast("string"), r"\.0$", "")), ",")
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumns({"p": at(0, 1, 2, 3), "q": at(3, 4, 5)})
    split = edits.split_path("p", 1)
    gap = lambda n: F.size(edits.spaced_nodes("p", n))
    k = F.col("k") % 3
    return c.select(
        "k", text(edits.insert_node("p", 2, F.struct(F.lit(9.0).alias("x"), F.lit(0.0).alias("y")))).alias("inserted"), text(edits.delete_node("p", 1)).alias("deleted"), F.concat(text(split[0]), F.lit("|"), text(split[1])).alias("split"), text(edits.join_paths("p", "q")).alias("joined"),
        text(edits.subdivided("p")).alias("divided"), (edits.move_node("p", 1, 0.0, 0.0)[1]["x"] + F.col("k") % 10).cast("long").alias("moved"), F.when(k == 0, gap(1.0)).when(k == 1, gap(1.5)).otherwise(gap(2.0)).alias("spaced"),
    )


@query("object_overrides", _K + """, o AS (SELECT k % 50 AS design_id, k AS object_id FROM c)
SELECT design_id, object_id, CASE WHEN object_id % 4 = 0 THEN 'manual' ELSE 'tatami' END AS stitch_type, CASE WHEN object_id % 6 = 0 THEN 'satin' ELSE 'auto' END AS fill_type, CASE WHEN object_id % 10 = 0 THEN 90.0 ELSE 45.0 END::DOUBLE AS angle_deg,
CASE WHEN object_id % 7 <> 0 THEN object_id * 3 ELSE 3 * max(object_id) FILTER (object_id % 7 <> 0) OVER (PARTITION BY design_id) + row_number() OVER (PARTITION BY design_id, object_id % 7 = 0 ORDER BY object_id) END AS new_id FROM o""")
def _(spark, d):
    """Baked stitches instead of generated ones, changed fills and angles, and ids kept where the content is known."""
    o = A.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("design_id"), F.col("c_custkey").alias("object_id"))
    baked = edits.baked(o.withColumn("stitch_type", F.lit("tatami")), o.where("object_id % 4 = 0").withColumn("stitch_type", F.lit("manual")))
    r = o.select("design_id", F.col("object_id").alias("region_idx"), F.lit("auto").alias("fill_type"), F.lit(45.0).alias("angle_deg"))
    i = F.col("region_idx")
    changes = r.where("region_idx % 6 = 0 or region_idx % 10 = 0").select("design_id", "region_idx", F.when(i % 6 == 0, "satin").alias("fill_type"), F.when(i % 10 == 0, 90.0).alias("angle_deg"))
    styled = edits.restyled(r, changes)
    known = o.where("object_id % 7 <> 0").select("design_id", F.col("object_id").alias("key"), (F.col("object_id") * 3).alias("object_id"))
    named = edits.reconciled(o.select("design_id", F.col("object_id").alias("region_idx"), F.col("object_id").alias("key")), known).select("design_id", "region_idx", F.col("object_id").alias("new_id"))
    return baked.join(styled.withColumnRenamed("region_idx", "object_id"), ["design_id", "object_id"]).join(named.withColumnRenamed("region_idx", "object_id"), ["design_id", "object_id"]).select("design_id", "object_id", "stitch_type", "fill_type", "angle_deg", "new_id")


@query("manual_orders", """SELECT s_suppkey AS k, 'green,red,blue' AS colors, '2,0,1' AS objects, 3::BIGINT AS blocks, CASE WHEN s_suppkey % 2 = 0 THEN 'outline' ELSE 'tatami' END AS how FROM supplier""")
def _(spark, d):
    """Colours and objects in a given order; a small object stays because its colour stands out; fill types by region."""
    red, blue, green = (220, 30, 30), (30, 60, 200), (30, 150, 70)
    names = {red: "red", blue: "blue", green: "green"}

    def one(k):
        box = lambda x, s, c, n: {"outer": S.ring([(x, 0), (x + s, 0), (x + s, s), (x, s)]), "holes": [], "color": c, "object_id": n, "fill_type": "outline" if k % 2 == 0 else "tatami"}
        regions = [box(0, 60, red, 0), box(100, 60, red, 1), box(200, 60, red, 2), box(0, 90, blue, 3), box(300, 20, green, 4)]
        plan = D.digitize(regions, D.Options(color_order=(green, red, blue), object_order=(4, 2, 0, 1, 3), min_extent=30.0))
        seen = list(dict.fromkeys(r["object_id"] for b in plan if b["thread"] == red for r in b["runs"]))
        return ",".join(names[b["thread"]] for b in plan), ",".join(map(str, seen)), len(plan), "outline" if plan[1]["runs"][0]["stitch_type"] == "running" else "tatami"

    return _each(spark, d, "k bigint, colors string, objects string, blocks bigint, how string", one, "supplier", "s_suppkey")


@query("fabric_options", f"WITH {dims.FABRIC_SQL} SELECT id, cast(floor(row_mm::DOUBLE / 0.1::DOUBLE + 0.5) AS BIGINT) AS row_spacing, cast(floor(satin_mm::DOUBLE / 0.1::DOUBLE + 0.5) AS BIGINT) AS satin_spacing, cast(floor(length_mm::DOUBLE / 0.1::DOUBLE + 0.5) AS BIGINT) AS stitch_length, cast(floor(pull_mm::DOUBLE / 0.1::DOUBLE + 0.5) AS BIGINT) AS pull, cast(floor(trim_mm::DOUBLE / 0.1::DOUBLE + 0.5) AS BIGINT) AS trim_distance FROM fabric")
def _(spark, d):
    """Digitising options of each fabric."""

    def run(batches):
        for pdf in batches:
            made = [(f, D.of_fabric(f)) for f in pdf["id"]]
            yield pd.DataFrame([(f, *(int(getattr(o, k)) for k in ("row_spacing", "satin_spacing", "stitch_length", "pull", "trim_distance"))) for f, o in made], columns=["id", "row_spacing", "satin_spacing", "stitch_length", "pull", "trim_distance"])

    return dims.fabrics(spark).select("id").mapInPandas(run, "id string, row_spacing bigint, satin_spacing bigint, stitch_length bigint, pull bigint, trim_distance bigint")


@query("svg_previews", _K + """ SELECT k, (k % 3 + 1)::BIGINT AS lines, (k % 3)::BIGINT AS dashes, '#0a1e' || lpad(printf('%x', k % 200), 2, '0') AS color, k % 50 * 10 + 40 AS width FROM c""")
def _(spark, d):
    """Previews: a line for each run in its colour, a dashed one for each move, and a frame with a margin."""
    import re

    def one(k):
        runs = [{"stitches": [(0, 100 * j), (k % 50 * 10, 100 * j)], "connection": "jump"} for j in range(k % 3 + 1)]
        text = codec.svg_preview({"blocks": [{"thread": {"r": 10, "g": 30, "b": k % 200}, "runs": runs}]})
        box = re.search(r'viewBox="([^"]*)"', text)[1].split()
        return text.count("<polyline"), text.count("stroke-dasharray"), re.search(r'stroke="(#[0-9a-f]{6})" stroke-width="3"', text)[1], int(box[2])

    return _each(spark, d, "k bigint, lines bigint, dashes bigint, color string, width bigint", one)


@query("medial_rails", _K + f""", p AS (SELECT k, 100 + k % 60 AS w, 20 + k % 30 AS h FROM c), n AS (SELECT *, floor((w + 2 * h) / 3.0::DOUBLE + 0.5)::BIGINT AS n FROM p),
q AS (SELECT *, unnest(range(0, n)) AS j FROM n), s AS (SELECT *, j * (w + 2 * h) / (n - 1)::DOUBLE AS along FROM q),
t AS (SELECT *, CASE WHEN along <= h THEN 0 WHEN along <= h + w THEN along - h ELSE w END AS x, CASE WHEN along <= h THEN along WHEN along <= h + w THEN h ELSE w + 2 * h - along END AS y FROM s),
u AS (SELECT k, n, w, x - lag(x) OVER v AS dx, y - lag(y) OVER v AS dy FROM t WINDOW v AS (PARTITION BY k ORDER BY j))
SELECT k, n AS points, {_M('any_value(w)')} AS lower, {_M('round(sum(sqrt(dx * dx + dy * dy)), 6)')} AS upper FROM u GROUP BY k, n""")
def _(spark, d):
    """The two halves of boxes between their ends: as many points on each, and the way along them, which cuts the corners of the box."""

    def one(k):
        w, h = 100 + k % 60, 20 + k % 30
        one_, two = G.medial_rails(S.ring([(0, 0), (w, 0), (w, h), (0, h)]))
        way = lambda z: _milli(round(float(np.abs(np.diff(z)).sum()), 6))
        return len(one_), way(one_), way(two)

    return _each(spark, d, "k bigint, points bigint, lower bigint, upper bigint", one)


@query("level_lines", _K + " SELECT k, 2 + k % 5 AS lines, 21::BIGINT AS points, 0::BIGINT AS off FROM c")
def _(spark, d):
    """Lines of a slanting plane on a grid of 21 by 21: one for each level, through every column, each on its level."""

    def one(k):
        n = 2 + k % 5
        y, x = np.mgrid[0:21, 0:21]
        value = y + 0.01 * x
        made = G.levels(value, [3.3 + 2.5 * j for j in range(n)], np.ones((20, 20), bool))
        off = sum(int((np.abs(z.imag + 0.01 * z.real - (3.3 + 2.5 * j)) > 1e-9).sum()) for j, zs in enumerate(made) for z in zs)
        return sum(map(len, made)), len(made[0][0]), off

    return _each(spark, d, "k bigint, lines bigint, points bigint, off bigint", one)


@query("turning_fills", _K + """, p AS (SELECT k, 60 + k % 60 AS w, 44 + 8 * (k % 6) AS h FROM c)
SELECT k, 1::BIGINT AS runs, 2 * (h // 8) + 1 AS rows, 0::BIGINT AS outside FROM p""")
def _(spark, d):
    """Two level direction lines make level rows: how many there are, none outside the box."""

    def one(k):
        w, h = 60 + k % 60, 44 + 8 * (k % 6)
        box = S.ring([(0, 0), (w, 0), (w, h), (0, h)])
        runs = G.turning(box, [], [(0, w), (1j * h, w + 1j * h)])
        z = runs[0]
        out = (z.real < -4) | (z.real > w + 4) | (z.imag < -4) | (z.imag > h + 4)
        return len(runs), len(np.unique(z.imag)), int(out.sum())

    return _each(spark, d, "k bigint, runs bigint, rows bigint, outside bigint", one)


@query("pen_drawings", _K + """ SELECT k, CASE WHEN k % 4 = 0 THEN 'nothing' WHEN k % 2 = 0 THEN 'region' ELSE 'line' END AS made, CASE WHEN k % 4 = 2 THEN 2 * (30 + k % 20) * 40 END::BIGINT AS area2, CASE WHEN k % 2 = 1 THEN floor((100 + k % 50) / 25.0::DOUBLE + 0.5)::BIGINT + 1 END AS stitches FROM c""")
def _(spark, d):
    """Finished drawings: too few points, an area wound as it must be, a line that is sewn as it is."""
    from threadloom.plans.edits import pen_finished

    def one(k):
        if k % 4 == 0:
            points, fill = [(0, 0), (5, 5)], True
        elif k % 2 == 0:
            points, fill = [(0, 0), (0, 40), (30 + k % 20, 40), (30 + k % 20, 0)], True
        else:
            points, fill = [(0, 0), (100 + k % 50, 0)], False
        r = pen_finished(points, fill)
        if r is None:
            return "nothing", None, None
        return ("line", None, len(r["baked"][0])) if "baked" in r else ("region", round(2 * S.area(r["outer"])), None)

    made = _each(spark, d, "k bigint, made string, area2 double, stitches double", one)
    return made.select("k", "made", F.when(~F.isnan("area2"), F.col("area2")).cast("long").alias("area2"), F.when(~F.isnan("stitches"), F.col("stitches")).cast("long").alias("stitches"))


@query("sketch_orders", _K + """ SELECT k, CASE WHEN k % 3 = 0 THEN 's0,f1,s2,f3' WHEN k % 3 = 1 THEN 'f1,f3,s2,s0' ELSE 'f1,s0' END AS units FROM c""")
def _(spark, d):
    """Elements of a layer in the order of drawing where it says so, else fills before strokes, a colour at a time and the nearest next;
    hidden layers go."""

    def one(k):
        stroke = lambda n, x, c: {"kind": "stroke", "name": f"s{n}", "points": [[x, 0], [x + 5, 0]], "width": 0.5, "color": c}
        fill = lambda n, x, c: {"kind": "fill", "name": f"f{n}", "outer": [[x, 0], [x + 5, 0], [x + 5, 5], [x, 5]], "holes": [], "color": c}
        layers = [{"elements": [stroke(0, 0, [1, 1, 1]), fill(1, 10, [2, 2, 2])]}, {"elements": [stroke(2, 20, [1, 1, 1]), fill(3, 30, [2, 2, 2])], "hidden": k % 3 == 2}]
        if k % 3 == 1:
            layers = [{"elements": layers[0]["elements"] + layers[1]["elements"]}]
        if k % 3 == 0:
            layers = [x | {"order": "manual"} for x in layers]
        return (",".join(e["name"] for e in sketch.sewing_order({"layers": layers})),)

    return _each(spark, d, "k bigint, units string", one)


@query("hidden_paths", _K + """ SELECT k, 11::BIGINT AS points, k % 10 AS under_fill, 6::BIGINT AS under_stroke, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS left_over, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS runs FROM c""")
def _(spark, d):
    """Points of a line under a later fill and under a wide stroke; thin lines that go as most of them is hidden; a move that is sewn since
    all of it will be covered (one run then leads on from the other without a cut)."""

    def one(k):
        p = np.arange(11) + 0.5 + 0j
        fill = {"kind": "fill", "outer": [(0, -5), (k % 10, -5), (k % 10, 5), (0, 5)], "color": [0, 0, 0]}
        stroke = {"kind": "stroke", "points": [(0, 3), (5.6, 3)], "width": 6.2, "color": [0, 0, 0]}
        thin = {"kind": "stroke", "points": [(x, 0) for x in range(10)], "width": 0.5, "style": "auto", "color": [0, 0, 0]}
        cover = {"kind": "fill", "outer": [(-1, -5), (9.5 if k % 3 == 0 else 4, -5), (9.5 if k % 3 == 0 else 4, 5), (-1, 5)], "color": [1, 1, 1]}
        dots = [{"kind": "stroke", "points": [(x, 0), (x + 4, 0)], "width": 0.5, "color": [9, 9, 9], "layer": 0} for x in (0, 30)]
        top = [{"kind": "fill", "outer": [(-5, -5), (40, -5), (40, 5), (-5, 5)], "holes": [], "color": [7, 7, 7], "angle": 0}] if k % 2 == 0 else []
        doc = sketch.load(sketch.save({"layers": [{"elements": dots}, {"elements": top}]}))
        first = sketch.compile_document(doc)[0]["runs"]
        cut = 1 + sum(r["connection"] != "continuous" for r in first[1:])
        # the line under the stroke's edge at 0.1 below it
        under = int(sketch.covers(stroke, p).sum())
        return len(p), int(sketch.covers(fill, p).sum()), under, len(sketch.without_hidden([thin, cover])), cut

    return _each(spark, d, "k bigint, points bigint, under_fill bigint, under_stroke bigint, left_over bigint, runs bigint", one)


@query("ray_hits", _K + " SELECT k, 10 + k % 30 AS ahead, 10 + k % 30 AS behind FROM c")
def _(spark, d):
    """First hits of a box on both sides of points on its middle line."""

    def one(k):
        h = 10 + k % 30
        left, right = G._chords(S.ring([(0, -h), (100, -h), (100, h), (0, h)]), np.array([50 + 0j]), np.array([1j]), 200.0)
        return round(left[0].imag), round(-right[0].imag)

    return _each(spark, d, "k bigint, ahead bigint, behind bigint", one)


@query("pec_colors", f"WITH {dims.PALETTE_SQL} SELECT pec_index, pr AS r, pg AS g, pb AS b FROM palette UNION ALL SELECT 99, pr, pg, pb FROM palette WHERE pec_index = 20")
def _(spark, d):
    """Threads of PES files by their numbers, black for one that isn't known: a file for each, read back."""

    def run(batches):
        for pdf in batches:
            out = []
            for n in pdf["n"].tolist():
                plan = {"name": "x", "blocks": [{"thread": {"r": 0, "g": 0, "b": 0}, "runs": [{"stitches": [(0, 0), (50, 0), (100, 0)], "connection": "jump"}]}]}
                made = bytearray(codec.write_pes(plan))
                made[22 + 49] = n
                e = sketch.import_pes(bytes(made))["layers"][0]["elements"][0]
                out.append((n, *e["color"]))
            yield pd.DataFrame(out, columns=["pec_index", "r", "g", "b"])

    numbers = [(p[0],) for p in dims.PALETTE] + [(99,)]
    return spark.createDataFrame(numbers, "n int").mapInPandas(run, "pec_index int, r int, g int, b int")


@query("baked_edits", _K + """ SELECT k, 5::BIGINT AS kept, 6::BIGINT AS inserted, 4::BIGINT AS deleted, k % 7 * 10 + 1 AS moved_x, 2::BIGINT AS least FROM c""")
def _(spark, d):
    """An object's stitches kept, and one of them moved, put in and taken out, while two are left."""
    from threadloom.plans import edits as E

    def one(k):
        plan = [{"runs": [{"object_id": n, "stitches": np.arange(5) * 10 + 1j * n} for n in range(3)]}]
        baked = E.bake(plan, k % 3)
        moved = E.edited(baked, 0, 2, k % 7 * 10 + 0.6 + 5j)
        return len(baked[0]), len(E.edited(baked, 0, 1, 3 + 3j, insert=True)[0]), len(E.edited(baked, 0, 1)[0]), int(moved[0][2].real), len(E.edited([baked[0][:2]], 0, 0)[0])

    return _each(spark, d, "k bigint, kept bigint, inserted bigint, deleted bigint, moved_x bigint, least bigint", one)


@query("near_white_outlines", _K + " SELECT k, CASE WHEN k % 256 > 235 THEN 0 ELSE 1 END::BIGINT AS runs FROM c")
def _(spark, d):
    """Outlines in grey: near-white ones are not sewn."""

    def one(k):
        g = k % 256
        return (len(D.object_runs({"outer": S.ring([(0, 0), (60, 0), (60, 60), (0, 60)]), "holes": [], "color": (g, g, g), "fill_type": "outline"}, D.Options())),)

    return _each(spark, d, "k bigint, runs bigint", one)


@query("merged_centers", _K + """ SELECT k, 2 + k % 3 AS capped, 3::BIGINT AS near, 2::BIGINT AS blended, CASE WHEN k % 5 >= 4 THEN 2 ELSE 1 END::BIGINT AS promoted FROM c""")
def _(spark, d):
    """Colour centres: at most as many as asked for, those nearer than 6 made one, a small one between two large ones gone, and a far blob of
    four pixels or more that becomes one."""

    def one(k):
        far = np.array([[10.0, 0, 0], [40, 50, 0], [70, -60, 20], [90, 0, -70], [55, 10, 90]])
        points = np.repeat(far, 40, 0)
        close = np.array([[10.0, 0, 0], [12, 2, 0], [70, -60, 20], [90, 0, -70]])
        between = np.array([[0.0, 0, 0], [50, 0, 0], [100, 0, 0]])
        sizes = np.repeat(between, [100, 5, 100], 0)
        n = k % 5
        at = np.stack(np.mgrid[0:10, 0:10], -1).reshape(-1, 2)
        image = np.zeros((100, 3))
        image[: n] = (90, 80, 0)
        return len(I.merged(points, far, 2 + k % 3)), len(I.merged(np.repeat(close, 40, 0), close, 6)), len(I.merged(sizes, between, 6)), len(I.promoted(image, at, (10, 10), np.zeros((1, 3)), 25.0))

    return _each(spark, d, "k bigint, capped bigint, near bigint, blended bigint, promoted bigint", one)


@query("merged_specks", _K + """ SELECT k, CASE WHEN (1 + k % 5) * (1 + k % 5) < 16 THEN 0 ELSE (1 + k % 5) * (1 + k % 5) END AS like_specks, CASE WHEN (1 + k % 5) * (1 + k % 5) <= 2 THEN 0 ELSE (1 + k % 5) * (1 + k % 5) END AS far_specks FROM c""")
def _(spark, d):
    """Square specks in a field: those of a like colour go under 16 pixels, those of a far colour under 3."""

    def one(k):
        n = 1 + k % 5
        labels = np.zeros((20, 20), int)
        labels[5 : 5 + n, 5 : 5 + n] = 1
        like, far = np.array([[50.0, 0, 0], [55, 0, 0]]), np.array([[50.0, 0, 0], [50, 90, 0]])
        return int((I.without_specks(labels, like, 25.0) == 1).sum()), int((I.without_specks(labels, far, 25.0) == 1).sum())

    return _each(spark, d, "k bigint, like_specks bigint, far_specks bigint", one)


@query("designs_for_target", """WITH p AS (SELECT s_suppkey AS design_id, 200 + s_suppkey % 60 AS w, 100 + s_suppkey % 40 AS h, 100 + s_suppkey % 3 * 70 AS target FROM supplier), f AS (SELECT *, unnest(range(0, 21)) AS step FROM p),
n AS (SELECT *, greatest(1, floor((h::DOUBLE - h::DOUBLE % (4.0::DOUBLE * factor)) / (4 * factor) + 0.5))::BIGINT AS n FROM (SELECT *, round(1 + step * 0.05::DOUBLE, 2) AS factor FROM f)),
y AS (SELECT design_id, step, count(*) FILTER (floor((r + 0.5::DOUBLE) * 4 * factor + 0.5 + 1e-9) - floor((r - 0.5::DOUBLE) * 4 * factor + 0.5 + 1e-9) < 5) AS near FROM (SELECT *, unnest(range(1, n + 1)) AS r FROM n) WHERE r < n GROUP BY ALL),
-- a step to the next row that is under half a millimetre is left out
c AS (SELECT n.*, cast((n + 1) // 2 * (2 + greatest(0, ceil((w - 37.5::DOUBLE) / 30))) + n // 2 * (2 + greatest(0, ceil((w - 22.5::DOUBLE) / 30))) - coalesce(near, 0) AS BIGINT) AS stitches FROM n LEFT JOIN y USING (design_id, step)),
k AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY stitches > target AND step < 20, step) AS k FROM c)
SELECT design_id, target::BIGINT AS target, stitches, cast(round(factor * 100) AS BIGINT) AS factor FROM k WHERE k = 1""")
def _(spark, d):
    """Boxes of many sizes, and three targets: how many stitches a plan has, and by how much (in hundredths) its rows had to be spread for that,
    twice at most."""
    from threadloom.plans import digitize, pictures

    k = F.col("design_id")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h, zero = k % 60 + 200, k % 40 + 100, F.lit(0)
    r = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("design_id"))
    r = r.select("design_id", F.lit(0).alias("region_idx"), F.array(p(zero, zero), p(w, zero), p(w, h), p(zero, h)).alias("outer"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"), *(F.lit(0).alias(c) for c in "rgb"))
    made = None
    for target, part in ((100 + 70 * j, r.where(k % 3 == j)) for j in range(3)):
        one = pictures.designs_for_target(part, target, digitize.Options(angle_deg=0.0)).groupBy("design_id", "factor").agg(F.count(F.lit(1)).alias("stitches")).withColumn("target", F.lit(target).cast("long"))
        made = one if made is None else made.unionByName(one)
    return made.select("design_id", "target", "stitches", F.round(F.col("factor") * 100).cast("long").alias("factor"))
