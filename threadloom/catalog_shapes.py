"""Registered queries of node paths, elements, hits, strokes, appliqué and samples, with SQL that computes the same values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.kernels import fills as G
from threadloom.kernels import shapes as S
from threadloom.kernels import strokes
from threadloom.operators import report, vector
from threadloom.plans import applique, samples
from threadloom.sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


_POLY = f"WITH {A.OUTLINES_SQL}"
_M = lambda e: f"cast(floor(({e}) * 1000.0::DOUBLE + 0.5) AS BIGINT)"


def _curve(c: str) -> str:
    p0, p1, p2, p3 = (f"{v}{c}" for v in "pabn")
    return f"(2.0::DOUBLE * {p1} + ({p2} - {p0}) * t + (2.0::DOUBLE * {p0} - 5.0::DOUBLE * {p1} + 4.0::DOUBLE * {p2} - {p3}) * t * t + (3.0::DOUBLE * {p1} - {p0} - 3.0::DOUBLE * {p2} + {p3}) * t * t * t) * 0.5::DOUBLE"


@query("node_polyline", _POLY + f""", nd AS (SELECT poly, i, x, y, (poly + i) % 3 <> 0 AS smooth FROM poly WHERE ring = 0),
sg AS (SELECT a.poly, a.i AS s, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, CASE WHEN a.smooth THEN p.x ELSE a.x END AS px, CASE WHEN a.smooth THEN p.y ELSE a.y END AS py, CASE WHEN b.smooth THEN n.x ELSE b.x END AS nx, CASE WHEN b.smooth THEN n.y ELSE b.y END AS ny, a.smooth OR b.smooth AS curved
  FROM nd a JOIN nd b ON a.poly = b.poly AND b.i = (a.i + 1) % 4 JOIN nd n ON a.poly = n.poly AND n.i = (a.i + 2) % 4 JOIN nd p ON a.poly = p.poly AND p.i = (a.i + 3) % 4),
pt AS (SELECT poly, -1 AS s, 0 AS j, x::DOUBLE AS x, y::DOUBLE AS y FROM nd WHERE i = 0 UNION ALL SELECT poly, s, 1, bx, by_ FROM sg WHERE NOT curved
  UNION ALL SELECT poly, s, j, {_curve('x')}, {_curve('y').replace('by', 'by_')} FROM (SELECT *, range AS j, range / 8.0::DOUBLE AS t FROM sg, range(1, 9) WHERE curved))
SELECT poly, cast(row_number() OVER (PARTITION BY poly ORDER BY s, j) - 1 AS INT) AS i, {_M('x')} AS x, {_M('y')} AS y FROM pt""")
def _(spark, d):
    """Outlines of which two corners in three are smooth."""
    nodes = F.transform("outer", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), ((F.col("poly") + i) % 3 != 0).alias("smooth")))
    r = A.rings(spark, d).select("poly", F.posexplode(vector.node_polyline(nodes)).alias("i", "p"))
    return r.select("poly", "i", X.milli("p.x").alias("x"), X.milli("p.y").alias("y"))


@query("path_nodes", _POLY + """, nx AS (SELECT a.poly, a.i, a.x, a.y, b.x AS bx, b.y AS by_ FROM poly a JOIN poly b ON a.poly = b.poly AND b.ring = 0 AND b.i = (a.i + 1) % 4 WHERE a.ring = 0)
SELECT poly, 2 * i AS i, x * 10::BIGINT AS x10, y * 10::BIGINT AS y10, false AS smooth, 2 * i = 2 AS changed FROM nx UNION ALL SELECT poly, 2 * i + 1, (x + bx) * 5, (y + by_) * 5, true, true FROM nx""")
def _(spark, d):
    """Outlines with a node more on every side: those are smooth, the others corners; the third one is then made smooth."""
    nodes = vector.nodes_of(vector.subdivided_ring("outer"))
    r = A.dealt(A.rings(spark, d).select("poly", "outer"), "poly").select("poly", nodes.alias("n")).select("poly", F.posexplode(F.arrays_zip("n", vector.node_types("n", True, 2).alias("c"))).alias("i", "p"))
    return r.select("poly", "i", (F.col("p.n.x") * 10).cast("long").alias("x10"), (F.col("p.n.y") * 10).cast("long").alias("y10"), F.col("p.n.smooth").alias("smooth"), F.col("p.c.smooth").alias("changed"))


@query("edit_shape_roundtrip", _POLY + """, ar AS (SELECT poly, max(ring) AS holes, 2 * (max(x) FILTER (ring = 0) - min(x) FILTER (ring = 0)) * (max(y) FILTER (ring = 0) - min(y) FILTER (ring = 0)) AS area2 FROM poly GROUP BY poly)
SELECT poly, 4::INT AS nodes, 5::INT AS points, area2::BIGINT AS outer2, CASE WHEN holes = 1 THEN -200 END::BIGINT AS hole2 FROM ar""")
def _(spark, d):
    """Regions to node shapes and back: the ring ends where it began, outlines and holes keep their winding."""
    r = A.rings(spark, d).select("poly", vector.nodes_of("outer").alias("o"), vector.nodes_of("hole").alias("h"))
    back, hole = vector.shape_ring(vector.node_types("o", False)), vector.shape_ring(vector.node_types("h", False), outer=False)
    return r.select("poly", F.size("o").alias("nodes"), F.size(back).alias("points"), X.doubled_area(back).cast("long").alias("outer2"), X.doubled_area(hole).cast("long").alias("hole2"))


_RAILS = """, bb AS (SELECT poly, (max(x) - min(x)) // 2 AS w, (max(y) - min(y)) // 2 AS h, (max(x) + min(x)) // 2 AS cx, (max(y) + min(y)) // 2 AS cy FROM poly WHERE ring = 0 GROUP BY poly),
rk AS (SELECT *, range AS k, CASE WHEN w >= h THEN 2.0::DOUBLE * w ELSE 2.0::DOUBLE * (w + h) END * range / 15 AS dl, CASE WHEN w >= h THEN 4.0::DOUBLE * h + 2 * w ELSE 2.0::DOUBLE * (w + h) END * range / 15 AS dr FROM bb, range(0, 16)),
rl AS (SELECT *, CASE WHEN w >= h OR dl <= 2 * w THEN -w + dl ELSE w END AS lx, CASE WHEN w >= h OR dl <= 2 * w THEN -h ELSE -h + (dl - 2 * w) END::DOUBLE AS ly,
  CASE WHEN dr <= 2 * h THEN -w WHEN dr <= 2 * h + 2 * w THEN -w + (dr - 2 * h) ELSE w END AS rx, CASE WHEN dr <= 2 * h THEN -h + dr WHEN dr <= 2 * h + 2 * w THEN h ELSE h - (dr - 2 * h - 2 * w) END AS ry FROM rk),
rm AS (SELECT *, sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)) AS width, (lx + rx) / 2 AS mx, (ly + ry) / 2 AS my FROM rl),
rn AS (SELECT *, mx - lag(mx) OVER v AS ex, my - lag(my) OVER v AS ey FROM rm WINDOW v AS (PARTITION BY poly ORDER BY k)),
rs AS (SELECT poly, (list_sort(list(width)))[9] AS width, max(width) AS widest, sum(sqrt(ex * ex + ey * ey)) AS length FROM rn GROUP BY poly)"""


@query("stroke_analysis", _POLY + _RAILS + f"SELECT poly, {_M('width')} // 10 AS width, {_M('widest')} // 10 AS widest, {_M('length')} // 10 AS length, width <= 70 AND length / width >= 3 AS is_stroke FROM rs")
def _(spark, d):
    """Rails of outlines: widths and lengths in hundredths."""

    def run(batches):
        for pdf in batches:
            out = []
            for poly, outer in zip(pdf["poly"], pdf["outer"], strict=True):
                s = strokes.analyze(S.ring(outer))
                cut = lambda v: int(np.floor(v * 1000 + 0.5)) // 10
                out.append((poly, cut(s.width), cut(s.widths.max()), cut(s.length), strokes.looks_like_stroke(s)))
            yield pd.DataFrame(out, columns=["poly", "width", "widest", "length", "is_stroke"])

    return A.dealt(A.rings(spark, d).select("poly", "outer"), "poly").mapInPandas(run, "poly bigint, width bigint, widest bigint, length bigint, is_stroke boolean")


def _queries(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select((k % 50).alias("design_id"), k.alias("q"), ((k * 61) % 801 - 400).alias("qx"), ((k * 29) % 801 - 400).alias("qy"))


_HITS = _POLY + """, qs AS (SELECT c_custkey % 50 AS design_id, c_custkey AS q, (c_custkey * 61) % 801 - 400 AS qx, (c_custkey * 29) % 801 - 400 AS qy FROM customer),
eg AS (SELECT a.design_id, a.poly, a.ring, a.i, a.x, a.y, b.x AS nx, b.y AS ny FROM poly a JOIN poly b ON a.poly = b.poly AND a.ring = b.ring AND b.i = (a.i + 1) % 4),
et AS (SELECT q.design_id, q, qx, qy, poly, ring, i, x, y, (nx - x)::DOUBLE AS dx, (ny - y)::DOUBLE AS dy, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((qx - x) * (nx - x)::DOUBLE + (qy - y) * (ny - y)::DOUBLE) / ((nx - x)::DOUBLE * (nx - x) + (ny - y)::DOUBLE * (ny - y)))) AS t FROM qs q JOIN eg USING (design_id)),
ed AS (SELECT *, x + dx * t AS hx, y + dy * t AS hy, sqrt((x + dx * t - qx) * (x + dx * t - qx) + (y + dy * t - qy) * (y + dy * t - qy)) AS far FROM et)"""


@query("snap_to_artwork", _HITS + f""", fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY far, poly, ring, i) AS k FROM ed WHERE far < 40) WHERE k = 1)
SELECT qs.design_id, qs.q, {_M('coalesce(hx, qs.qx)')} AS x, {_M('coalesce(hy, qs.qy)')} AS y FROM qs LEFT JOIN fs USING (q)""")
def _(spark, d):
    return vector.snapped(_queries(spark, d), A.outlines(spark, d), 40.0)


@query("nearest_segment", _HITS + f"""SELECT design_id, q, poly, ring, i, {_M('hx')} AS x, {_M('hy')} AS y FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY far, poly DESC, ring DESC, i DESC) AS k FROM ed WHERE far <= 30) WHERE k = 1""")
def _(spark, d):
    return vector.nearest_segment(_queries(spark, d), A.outlines(spark, d), 30.0)


@query("nearest_node", _HITS + """, nn AS (SELECT q.design_id, q, poly, ring, i, cast(x - qx AS BIGINT) * (x - qx) + cast(y - qy AS BIGINT) * (y - qy) AS d2 FROM qs q JOIN poly USING (design_id))
SELECT design_id, q, poly, ring, i, d2 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, poly DESC, ring DESC, i DESC) AS k FROM nn WHERE d2 <= 2500) WHERE k = 1""")
def _(spark, d):
    return vector.nearest_node(_queries(spark, d), A.outlines(spark, d), 50)


_BOX = """, bx AS (SELECT design_id, poly, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM poly WHERE ring = 0 GROUP BY ALL)"""


@query("hit_test", _HITS + _BOX + """, top AS (SELECT q, max(poly) AS inside FROM qs JOIN bx USING (design_id) WHERE qx >= bx0 AND qx < bx1 AND qy >= by0 AND qy < by1
  AND NOT (poly % 3 = 0 AND qx >= (bx0 + bx1) / 2 - 5 AND qx < (bx0 + bx1) / 2 + 5 AND qy >= (by0 + by1) / 2 - 5 AND qy < (by0 + by1) / 2 + 5) GROUP BY q),
near AS (SELECT q, poly AS near FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY far, poly) AS k FROM ed WHERE far < 20) WHERE k = 1)
SELECT design_id, qs.q, coalesce(inside, near) AS poly, inside IS NOT NULL AS inside FROM qs LEFT JOIN top USING (q) LEFT JOIN near USING (q)""")
def _(spark, d):
    return vector.hits(_queries(spark, d), A.rings(spark, d), A.outlines(spark, d))


@query("meeting_boxes", _POLY + _BOX + "SELECT a.design_id, a.poly, count(b.poly) AS meets FROM bx a LEFT JOIN bx b ON a.design_id = b.design_id AND a.poly <> b.poly AND a.bx0 <= b.bx1 AND a.bx1 >= b.bx0 AND a.by0 <= b.by1 AND a.by1 >= b.by0 GROUP BY ALL")
def _(spark, d):
    return vector.meeting_boxes(A.rings(spark, d))


_R = "0.5::DOUBLE"


@query("element_edits", _POLY + f"""SELECT poly, i, {_M(f'10.0::DOUBLE + (x - 10) * cos({_R}) - (y - 5) * sin({_R})')} AS rx, {_M(f'5.0::DOUBLE + (x - 10) * sin({_R}) + (y - 5) * cos({_R})')} AS ry, (20 - x)::BIGINT AS fx, y::BIGINT AS fy, (10 + (x - 10) * 3)::BIGINT AS sx, (5 + (y - 5) * 2)::BIGINT AS sy,
cast(floor((poly % 180 + degrees({_R})) % 180 + 0.5) AS BIGINT) AS rotated_angle, (180 - poly % 180) % 180 AS flipped_angle FROM poly WHERE ring = 0""")
def _(spark, d):
    """Elements turned by half a radian, flipped and scaled about (10, 5), with their row angles."""
    made = F.arrays_zip(vector.rotated("outer", 10, 5, 0.5).alias("r"), vector.flipped("outer", 10, 5).alias("f"), vector.scaled("outer", 10, 5, 3, 2).alias("s"))
    angle = F.col("poly") % 180
    r = A.rings(spark, d).select("poly", angle.alias("a"), F.posexplode(made).alias("i", "p"))
    whole = lambda c: F.col(c).cast("long")
    return r.select("poly", "i", X.milli("p.r.x").alias("rx"), X.milli("p.r.y").alias("ry"), whole("p.f.x").alias("fx"), whole("p.f.y").alias("fy"), whole("p.s.x").alias("sx"), whole("p.s.y").alias("sy"), vector.rotated_angle("a", 0.5).alias("rotated_angle"), vector.flipped_angle("a").alias("flipped_angle"))


@query("duplicate_elements", _POLY + """, f AS (SELECT design_id, poly, x, y FROM poly WHERE ring = 0 AND i = 0) SELECT design_id, poly, x::BIGINT AS x, y::BIGINT AS y FROM f
UNION ALL SELECT design_id, max(poly) OVER (PARTITION BY design_id) + row_number() OVER (PARTITION BY design_id ORDER BY poly), x + 20, y - 10 FROM f""")
def _(spark, d):
    r = vector.duplicated(A.rings(spark, d).select("design_id", "poly", "outer"), 20.0, -10.0)
    return r.select("design_id", "poly", F.col("outer")[0]["x"].cast("long").alias("x"), F.col("outer")[0]["y"].cast("long").alias("y"))


@query("delete_nodes", "SELECT c_custkey AS poly, CASE c_custkey % 4 WHEN 0 THEN '0,3,7' WHEN 1 THEN '0,2,4,5,6,7' WHEN 2 THEN '0,1,2,3,4,5,6' ELSE '2,5,6' END AS left_over FROM customer")
def _(spark, d):
    """Nodes taken from paths of eight, three at least: where six are to go, the first one listed stays."""
    gone = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in ([0, 1, 2, 4, 5, 6], [1, 3], [7], [2, 0, 1, 3, 4, 7]))), (F.col("poly") % 4 + 1).cast("int"))
    path = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("x"), F.col("poly").alias("y")))
    kept = vector.without_nodes(path, gone, 3)
    return A.rings(spark, d).select("poly", F.array_join(F.transform(kept, lambda p: p["x"].cast("string")), ",").alias("left_over"))


@query("soft_move", _POLY + """, st AS (SELECT *, coalesce(lead(x) OVER v, first_value(x) OVER v) AS nx, coalesce(lead(y) OVER v, first_value(y) OVER v) AS ny FROM poly WHERE ring = 0 WINDOW v AS (PARTITION BY poly ORDER BY i)),
sl AS (SELECT *, sqrt((nx - x)::DOUBLE * (nx - x) + (ny - y)::DOUBLE * (ny - y)) AS step FROM st),
ss AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY poly ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(step) OVER (PARTITION BY poly) AS total FROM sl),
sg AS (SELECT a.*, least(abs(a.s - b.s), a.total - abs(a.s - b.s)) AS far FROM ss a JOIN ss b ON a.poly = b.poly AND b.i = 1),
sh AS (SELECT *, CASE WHEN i = 1 THEN 1.0 WHEN far < 120 THEN (1.0::DOUBLE - (far / 120) * (far / 120)) * (1.0::DOUBLE - (far / 120) * (far / 120)) ELSE 0.0 END AS share FROM sg)
""" + f"SELECT design_id, poly, ring, i, {_M('x + share * 10.0::DOUBLE')} AS x, {_M('y + share * -5.0::DOUBLE')} AS y FROM sh")
def _(spark, d):
    p = A.outlines(spark, d).where("ring = 0").drop("thread")
    return vector.soft_moved(p, p.where("i = 1"), 10.0, -5.0, 120.0)


@query("run_shapes", """SELECT c_custkey AS k, (4 + c_custkey % 5 + 2 * (c_custkey % 3))::INT AS n, (4 + c_custkey % 5)::INT AS without_locks, c_custkey % 4 <> 0 AS is_line FROM customer""")
def _(spark, d):
    """Runs with none to two lock pairs at their start, straight ones and ones that go back and forth."""
    k = F.col("c_custkey")
    at = lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    locks = F.flatten(F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, (k % 3).cast("int")), lambda _: F.array(at(F.lit(0)), at(F.lit(8)))))
    line = F.transform(F.sequence(F.lit(0).cast("long"), 3 + k % 5), lambda i: at(F.when(k % 4 == 0, (i % 2) * 100).otherwise(i * 100)))
    c = A.table(spark, d, "customer").select(k.alias("k"), F.concat(locks, line).alias("p"))
    return c.select("k", F.size("p").alias("n"), F.size(vector.strip_locks("p")).alias("without_locks"), vector.looks_like_line("p").alias("is_line"))


@query("line_order", "SELECT c_custkey % 50 AS design_id, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey) - 1 AS place, c_custkey AS poly, c_custkey % 2 = 1 AS turned FROM customer")
def _(spark, d):
    """Lines along an axis, every other one drawn backwards: the next one is the nearest, from whichever end."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["poly"].to_numpy()
        lines = [np.array([100 * k + 40, 100 * k] if k % 2 else [100 * k, 100 * k + 40], complex) for k in keys]
        order = strokes.line_order(lines, 0j)
        return pd.DataFrame({"design_id": pdf["design_id"].iloc[0], "place": np.arange(len(order)), "poly": [keys[k] for k, _ in order], "turned": [t for _, t in order]})

    return A.rings(spark, d).select("design_id", "poly").groupBy("design_id").applyInPandas(one, "design_id bigint, place bigint, poly bigint, turned boolean")


@query("zigzag_line", """WITH z AS (SELECT c_custkey AS poly, 100 + c_custkey % 60 AS len, floor((100 + c_custkey % 60) / 3.0::DOUBLE + 0.5)::BIGINT AS n FROM customer)
SELECT poly, seq, cast(floor(len::DOUBLE * (seq // 2) / n + 0.5) AS BIGINT) AS x, CASE seq % 2 WHEN 0 THEN 10 ELSE -10 END::BIGINT AS y FROM z, LATERAL (SELECT unnest(generate_series(0, 2 * n + 1)) AS seq)""")
def _(spark, d):
    def run(batches):
        for pdf in batches:
            # a frame for some hundred lines, which is what takes long
            for at in range(0, len(pdf), 500):
                polys = pdf["poly"].to_numpy()[at : at + 500]
                made = [strokes.zigzag_line(np.array([0, 100 + poly % 60], complex), 20.0)[0] for poly in polys.tolist()]
                n, z = [len(m) for m in made], np.concatenate(made)
                yield pd.DataFrame({"poly": np.repeat(polys, n), "seq": np.concatenate([np.arange(k) for k in n]), "x": z.real.astype(int), "y": z.imag.astype(int)})

    return A.dealt(A.rings(spark, d).select("poly"), "poly").mapInPandas(run, "poly bigint, seq bigint, x bigint, y bigint")


def _regions(spark, d):
    r, g, b = report.thread_color("thread")
    holes = F.when(F.col("hole").isNotNull(), F.array("hole")).otherwise(F.array())
    return A.rings(spark, d).select("design_id", F.col("poly").cast("int").alias("region_idx"), "outer", holes.alias("holes"), r.alias("r"), g.alias("g"), b.alias("b"))


@query("applique_steps", _POLY + """, bb AS (SELECT design_id, poly, (max(x) - min(x)) // 2 AS w, (max(y) - min(y)) // 2 AS h, (max(x) + min(x)) // 2 AS cx FROM poly WHERE ring = 0 GROUP BY ALL),
ob AS (SELECT *, 3 * (row_number() OVER (PARTITION BY design_id ORDER BY poly) - 1) AS first_block FROM bb)
SELECT design_id, first_block + s AS block_idx, poly AS object_id, ['placement', 'tackdown', 'satin'][s + 1] AS step, s < 2 AS guided,
CASE s WHEN 0 THEN floor(4 * (w + h) / 25.0::DOUBLE + 0.5) + 1 WHEN 1 THEN floor((4 * (w + h) - 8 * 15 * sqrt(0.5)) / 25 + 0.5) + 1 END::BIGINT AS stitches, CASE s WHEN 0 THEN cx - w WHEN 2 THEN cx - w - 12 END::BIGINT AS min_x, CASE s WHEN 0 THEN cx + w WHEN 2 THEN cx + w + 13 END::BIGINT AS max_x FROM ob, range(0, 3) t(s)""")
def _(spark, d):
    """Each outline's three steps: stitches of the two lines, the extent of the placement and of the satin edge."""
    st = applique.applique_designs(_regions(spark, d).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "design_id"))
    n, only = F.count(F.lit(1)), lambda v, *steps: F.when(F.col("step").isin(*steps), v)
    g = st.groupBy("design_id", "block_idx", "object_id", "step").agg(n.alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max((F.col("r") == 120) & (F.col("g") == 120) & (F.col("b") == 120)).alias("guided"))
    return g.select("design_id", "block_idx", "object_id", "step", "guided", only(F.col("n"), "placement", "tackdown").alias("stitches"), only(F.col("lo").cast("long"), "placement", "satin").alias("min_x"), only(F.col("hi").cast("long"), "placement", "satin").alias("max_x"))


@query("applique_warnings", "SELECT p_partkey, p_size / 5.0::DOUBLE > 6 AS wide FROM part")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", applique.width_warning(F.col("p_size") / 5.0).isNotNull().alias("wide"))


@query("sample_designs", "SELECT * FROM (VALUES ('a-solid-circle', 'CIRCLE', 2505::BIGINT, 0::BIGINT, 60::BIGINT, 60::BIGINT), ('b-donut', 'DONUT', 2575, 1, 64, 64), ('c-scatter', 'FLOWER', 1732, 2, 71, 80)) t(id, name, stitches, color_changes, width_mm, height_mm)")
def _(spark, d):
    """Stitches, colour changes and sizes of the samples, which are published."""
    mm = lambda c: F.floor((F.max(c) - F.min(c)) / 10 + 0.5)
    return samples.stitches(spark).groupBy("id", "name").agg(F.count(F.lit(1)).alias("stitches"), (F.count_distinct("block_idx") - 1).alias("color_changes"), mm("x").alias("width_mm"), mm("y").alias("height_mm"))


@query("centerlines", _POLY + """, bb AS (SELECT poly, (max(x) - min(x)) // 2 AS w, (max(y) - min(y)) // 2 AS h, (max(x) + min(x)) // 2 AS cx, (max(y) + min(y)) // 2 AS cy FROM poly WHERE ring = 0 GROUP BY poly)
SELECT poly, greatest(1, floor(2 * greatest(w, h) / 5.003::DOUBLE))::BIGINT AS points, CASE WHEN w >= h THEN cy ELSE cx END AS axis FROM bb""")
def _(spark, d):
    """Middles of slices of outlines: how many, and the line that they lie on."""

    def run(batches):
        for pdf in batches:
            out = []
            for poly, outer in zip(pdf["poly"], pdf["outer"], strict=True):
                o = S.ring(outer)
                z = strokes.centerline(o, spacing=5.003)
                level = np.ptp(o.real) >= np.ptp(o.imag)
                out.append((poly, len(z), round(float(z.imag[0] if level else z.real[0]))))
            yield pd.DataFrame(out, columns=["poly", "points", "axis"])

    return A.dealt(A.rings(spark, d).select("poly", "outer"), "poly").mapInPandas(run, "poly bigint, points bigint, axis bigint")


@query("line_underlays", """WITH l AS (SELECT c_custkey AS poly, 100 + c_custkey % 60 AS len FROM customer), n AS (SELECT *, floor(len / 25.0::DOUBLE + 0.5)::BIGINT AS n FROM l)
SELECT poly, n + 1 AS center, 2 * (floor(len / 15.0::DOUBLE + 0.5)::BIGINT + 1) AS zigzag, 2 * n + 1 AS edge FROM n""")
def _(spark, d):
    def run(batches):
        for pdf in batches:
            made = [(k, strokes.line_underlay(np.array([0, 100 + k % 60], complex), 40.0, ("center", "zigzag", "edge", "tatami"))) for k in pdf["poly"]]
            yield pd.DataFrame([(k, *map(len, runs)) for k, runs in made], columns=["poly", "center", "zigzag", "edge"])

    return A.dealt(A.rings(spark, d).select("poly"), "poly").mapInPandas(run, "poly bigint, center bigint, zigzag bigint, edge bigint")


@query("transformed_regions", _POLY + f""", t AS (SELECT poly, ring, i, -2.0::DOUBLE * x AS x, 2.0::DOUBLE * y AS y FROM poly)
SELECT poly, ring, i, {_M('x * cos(0.3::DOUBLE) - y * sin(0.3::DOUBLE) + 5')} AS x, {_M('x * sin(0.3::DOUBLE) + y * cos(0.3::DOUBLE) - 6')} AS y, 'outer,holes' AS kept FROM t""")
def _(spark, d):
    """Regions flipped, doubled, turned and moved; their fill and angle are gone."""
    holes = F.when(F.col("hole").isNotNull(), F.array("hole")).otherwise(F.array())
    r = vector.transformed(A.rings(spark, d).select("poly", "outer", holes.alias("holes"), F.lit("satin").alias("fill_type"), F.lit(30.0).alias("angle_deg")), 5.0, -6.0, 0.3, 2.0, flip_x=True)
    kept = ",".join(c for c in r.columns if c != "poly")
    rings = r.select("poly", F.posexplode(F.concat(F.array("outer"), "holes")).alias("ring", "r")).select("poly", "ring", F.posexplode("r").alias("i", "p"))
    return rings.select("poly", "ring", "i", X.milli("p.x").alias("x"), X.milli("p.y").alias("y"), F.lit(kept).alias("kept"))


@query("sketch_images", "SELECT s_suppkey, 2::BIGINT AS images, 8 + s_suppkey % 9 AS width, 5 + s_suppkey % 7 AS height, s_suppkey % 256 AS red, 1::BIGINT AS layers FROM supplier")
def _(spark, d):
    """Sketch documents with pictures as data URLs."""
    import base64
    import json

    from threadloom.kernels import pictures
    from threadloom.plans import sketch

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["s_suppkey"].tolist():
                a = np.full((5 + k % 7, 8 + k % 9, 4), 255, np.uint8)
                a[2, 3, 0] = k % 256
                url = "data:image/png;base64," + base64.b64encode(pictures.encode_png(a)).decode()
                doc, images = sketch.load_with_images(json.dumps({"doc": {"layers": [{"elements": []}]}, "images": {"one": url, "two": url}}))
                one = images["one"]
                out.append((k, len(images), one.shape[1], one.shape[0], int(one[2, 3, 0]), len(doc["layers"])))
            yield pd.DataFrame(out, columns=["s_suppkey", "images", "width", "height", "red", "layers"])

    return A.dealt(A.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").mapInPandas(run, "s_suppkey bigint, images bigint, width bigint, height bigint, red bigint, layers bigint")


@query("shrunk_pictures", "SELECT s_suppkey, 600::BIGINT AS width, cast(floor((300 + s_suppkey % 200) / 2.0::DOUBLE + 0.5) AS BIGINT) AS height, 40 + s_suppkey % 100 AS mean FROM supplier")
def _(spark, d):
    """Pictures of 1,200 columns, by turns dark and light, at half their size."""
    from threadloom.kernels import pictures

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["s_suppkey"].tolist():
                a = np.full((300 + k % 200, 1200, 4), 255, np.uint8)
                a[:, ::2, :3], a[:, 1::2, :3] = 20 + k % 100, 60 + k % 100
                b = pictures.shrunk(pictures.decode(pictures.encode_png(a)))
                out.append((k, b.shape[1], b.shape[0], int(b[0, :, 0].mean())))
            yield pd.DataFrame(out, columns=["s_suppkey", "width", "height", "mean"])

    return A.dealt(A.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").mapInPandas(run, "s_suppkey bigint, width bigint, height bigint, mean bigint")


@query("nearest_stitch", f"WITH {A.STITCHES_SQL}" + """, qs AS (SELECT c_custkey % 15 AS design_id, c_custkey AS q, (c_custkey * 61) % 801 - 400 AS qx, (c_custkey * 29) % 801 - 400 AS qy FROM customer),
sd AS (SELECT design_id, q, block_idx, run_idx, seq, cast(x - qx AS BIGINT) * (x - qx) + cast(y - qy AS BIGINT) * (y - qy) AS d2 FROM qs JOIN st USING (design_id))
SELECT design_id, q, block_idx, run_idx, seq, d2 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, block_idx, run_idx, seq) AS k FROM sd WHERE d2 < 3600) WHERE k = 1""")
def _(spark, d):
    k = F.col("q")
    return vector.nearest_stitch(_queries(spark, d).withColumn("design_id", k % 15), A.stitches(spark, d))


@query("stroke_stitches", """WITH p AS (SELECT c_custkey AS poly, 120 + c_custkey % 60 AS w, [10, 30, 90][c_custkey % 3 + 1] AS h FROM customer)
SELECT poly, ['running', 'satin', 'none'][poly % 3 + 1] AS how, CASE WHEN poly % 3 = 2 THEN 0 ELSE 1 END::BIGINT AS runs, CASE WHEN poly % 3 < 2 THEN 0 END::BIGINT AS outside FROM p""")
def _(spark, d):
    """Boxes as strokes: thin ones along their middle, wider ones as a column, very wide ones not at all."""

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["poly"].tolist():
                w, h = 120 + k % 60, (10, 30, 90)[k % 3]
                runs = strokes.stroke_stitch(S.ring([(0, 0), (w, 0), (w, h), (0, h)]))
                z = np.concatenate(runs) if runs else np.zeros(0, complex)
                off = int(((z.real < 0) | (z.real > w) | (z.imag < 0) | (z.imag > h)).sum()) if runs else None
                out.append((k, "none" if not runs else "running" if len(z) < w / 10 else "satin", len(runs), off))
            yield pd.DataFrame(out, columns=["poly", "how", "runs", "outside"]).astype({"outside": "Int64"})

    return A.dealt(A.rings(spark, d).select("poly"), "poly").mapInPandas(run, "poly bigint, how string, runs bigint, outside bigint")


@query("stitches_to_strokes", "SELECT c_custkey AS poly, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 2 END::BIGINT AS points, c_custkey % 2 = 0 AS closed FROM customer")
def _(spark, d):
    """Hand-set stitches with locks at both ends: rounds that end where they began, and lines."""

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["poly"].tolist():
                side = 10 + k % 20
                path = [(0, 0), (side, 0), (side, side), (0, side), (0, 0)] if k % 2 == 0 else [(0, 0), (side / 2, 0), (side, 0)]
                lock = [(0, 0), (0.8, 0)]
                e = strokes.as_stroke(lock * (k % 3) + path, (1, 2, 3))
                out.append((k, len(e["points"]), e["closed"]))
            yield pd.DataFrame(out, columns=["poly", "points", "closed"])

    return A.dealt(A.rings(spark, d).select("poly"), "poly").mapInPandas(run, "poly bigint, points bigint, closed boolean")
