"""Outlines: areas, containment, scan rows, copies.  Rings are rows of points (ring, i, x, y) or arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X

from .vector import holders, let, places

RING = ["design_id", "poly", "ring"]


def edges(points: DataFrame) -> DataFrame:
    """Each point with the next of its ring, the last with the first."""
    w = Window.partitionBy("design_id", "poly", "ring").orderBy("i")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return points.withColumns({"nx": nxt("x"), "ny": nxt("y")})


def areas(points: DataFrame) -> DataFrame:
    """Twice the signed area of each ring."""
    return edges(points).groupBy(*RING).agg(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("area2"))


def net_areas(points: DataFrame) -> DataFrame:
    """Twice the area without holes, and the shorter side of the outer ring's box."""
    a = areas(points).groupBy("design_id", "poly").agg(F.sum(F.when(F.col("ring") == 0, F.abs("area2")).otherwise(-F.abs("area2"))).alias("net2"))
    b = points.where("ring = 0").groupBy("design_id", "poly").agg(F.least(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("min_extent"))
    return a.join(b, ["design_id", "poly"])


def drop_small(points: DataFrame, min_net2: int) -> DataFrame:
    return net_areas(points).where(F.col("net2") >= min_net2)


def centroids(points: DataFrame) -> DataFrame:
    """Area centroids in thousandths; a ring without area has its first point."""
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    g = edges(points).groupBy(*RING).agg(F.sum(cross).alias("a"), F.sum((F.col("x") + F.col("nx")) * cross).alias("sx"), F.sum((F.col("y") + F.col("ny")) * cross).alias("sy"), F.min_by(F.struct("x", "y"), "i").alias("p"))
    at = lambda s, c: F.when(F.col("a") == 0, F.col(f"p.{c}") * 1000).otherwise(X.milli(F.col(s) / (F.lit(3.0) * F.col("a"))))
    return g.select(*RING, at("sx", "x").cast("long").alias("cx"), at("sy", "y").cast("long").alias("cy"))


def color_order(points: DataFrame, first: list[str] | None = None) -> DataFrame:
    """Colours of each design in sewing order: listed ones first, others by area, larger first, then by first appearance."""
    n = net_areas(points).join(points.select("design_id", "poly", "thread").distinct(), ["design_id", "poly"])
    g = n.groupBy("design_id", "thread").agg(F.sum("net2").alias("net2"), F.min("poly").alias("first_poly"), F.count(F.lit(1)).alias("polys"))
    rank = F.nullif(F.array_position(F.array(*(F.lit(x) for x in first)), F.col("thread")), F.lit(0)) if first else F.lit(None).cast("long")
    w = Window.partitionBy("design_id").orderBy(rank.asc_nulls_last(), F.desc("net2"), "first_poly")
    return g.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def holes_to_outers(rings: DataFrame) -> DataFrame:
    """Each hole with the smallest outer ring of its design that is larger and holds its centre; a hole that lies in none with the one,
    of those larger than it, of which the centre is nearest.  Holes meet the rings of their own cells of a grid only; those that no
    ring holds, and they alone, are compared with all of their design.  rings: design_id, poly, outer, hole."""
    mean = lambda c: F.aggregate(F.transform("hole", lambda p: p[c].cast("double")), F.lit(0.0), lambda a, v: a + v) / F.size("hole")
    h = rings.where("hole is not null").select("design_id", F.col("poly").alias("q"), mean("x").alias("qx"), mean("y").alias("qy"), F.abs(X.doubled_area("hole")).cast("long").alias("hole2"))
    # holes of one size and middle find the same ring, and rings that lie on each other are one, with the first of their keys and their number
    keys = ["design_id", "qx", "qy", "hole2"]
    at = h.select(*keys).distinct()
    o = rings.groupBy("design_id", "outer").agg(F.min("poly").alias("poly"), F.count(F.lit(1)).alias("n")).withColumn("outer2", X.doubled_area("outer").cast("long"))
    j = holders(at, o).where("outer2 > hole2")
    found = j.groupBy(*keys).agg(F.min_by("poly", F.struct("outer2", "poly")).alias("outer_poly"), F.sum("n").alias("holders"))
    b = X.ring_bounds("outer")
    o = o.select("design_id", F.col("poly").alias("outer_poly"), "outer2", ((b["min_x"] + b["max_x"]) / 2).alias("ox"), ((b["min_y"] + b["max_y"]) / 2).alias("oy"))
    lost = at.join(found, keys, "left_anti").join(o, "design_id").where("outer2 > hole2")
    far = X.distance(F.col("ox") - F.col("qx"), F.col("oy") - F.col("qy"))
    lost = lost.groupBy(*keys).agg(F.min_by("outer_poly", F.struct(far, "outer_poly")).alias("outer_poly"), F.lit(0).cast("long").alias("holders"))
    return h.join(found.unionByName(lost), keys).select("design_id", F.col("q").alias("hole_poly"), "outer_poly", "holders")


def depths(rings: DataFrame) -> DataFrame:
    """How many other outer rings of the design hold a ring's first point: even ones are outlines, odd ones holes.  Points in one place are looked
    up once, and rings that lie on each other are one with their number; a ring that holds its own first point doesn't count itself."""
    p = rings.select("design_id", F.col("poly").alias("q"), F.col("outer")[0]["x"].alias("qx"), F.col("outer")[0]["y"].alias("qy"), "outer")
    alike = rings.groupBy("design_id", "outer").agg(F.count(F.lit(1)).alias("n"))
    n = holders(places(p), alike).groupBy("design_id", "qx", "qy").agg(F.sum("n").alias("n"))
    own = F.when(X.point_in_ring("qx", "qy", "outer"), 1).otherwise(0)
    return p.join(n, ["design_id", "qx", "qy"], "left").select("design_id", F.col("q").alias("poly"), F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col("n") - own).alias("depth"))


def grid_hits(rings: DataFrame, step: int = 50) -> DataFrame:
    """Points of a grid over the hoop that lie in each outline, outside its hole: only the grid points in its box are made."""
    b = X.ring_bounds("outer")
    line = lambda lo, hi: F.sequence(F.ceil(lo / step).cast("long"), F.floor(hi / step).cast("long"))
    r = rings.withColumn("b", b).where(F.expr(f"ceil(b.min_x / {step}) <= floor(b.max_x / {step}) and ceil(b.min_y / {step}) <= floor(b.max_y / {step})"))
    r = r.withColumn("gx", F.explode(line(F.col("b.min_x"), F.col("b.max_x")))).withColumn("gy", F.explode(line(F.col("b.min_y"), F.col("b.max_y"))))
    r = r.withColumns({"gx": F.col("gx") * step, "gy": F.col("gy") * step})
    inside = X.point_in_ring("gx", "gy", "outer") & ~F.coalesce(X.point_in_ring("gx", "gy", "hole"), F.lit(False))
    return r.where(inside).select("design_id", "poly", "gx", "gy")


def scan_rows(points: DataFrame, spacing: int = 10) -> DataFrame:
    """Horizontal rows through each outline, at half spacings from its top: crossings sorted by x, paired into segments.
    Coordinates in thousandths."""
    box = points.where("ring = 0").groupBy("design_id", "poly").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    e = edges(points).join(box, ["design_id", "poly"])
    n = F.greatest(F.lit(1), F.floor((F.col("y1") - F.col("y0")) / spacing))
    lo, hi = F.least("y", "ny"), F.greatest("y", "ny")
    # an edge meets the rows with lo <= row y < hi, so only those are made
    first = F.greatest(F.lit(0), F.ceil((lo - F.col("y0")) / spacing - 0.5)).cast("long")
    last = F.least(n - 1, F.ceil((hi - F.col("y0")) / spacing - 0.5) - 1).cast("long")
    e = e.withColumns({"_a": first, "_b": last}).where("_a <= _b and y <> ny").withColumn("row", F.explode(F.sequence("_a", "_b")))
    y = F.col("y0") + (F.col("row") + 0.5) * spacing
    e = e.withColumn("cross", F.col("x") + (F.col("nx") - F.col("x")) * (y - F.col("y")) / (F.col("ny") - F.col("y")))
    e = e.select("design_id", "poly", "row", X.milli(y).alias("row_y"), X.milli("cross").alias("cross"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("design_id", "poly", "row").orderBy("cross")) - 1)
    return e.groupBy("design_id", "poly", "row", "row_y", F.floor(F.col("k") / 2).alias("seg")).agg(F.min("cross").alias("x1"), F.max("cross").alias("x2"), F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")


def _copies(rings: DataFrame, keys: list[str], point) -> DataFrame:
    """Outlines and holes with their points moved, wound as they must be: (design_id, poly, keys, ring, i, x, y), in thousandths."""

    def moved(ring, outer: bool):
        r = F.transform(F.col(ring), lambda p: point(p["x"].cast("double"), p["y"].cast("double")))
        # a ring is moved once, and not again for each of the points that its area asks for
        wound = lambda r: F.when(X.doubled_area(r) < 0 if outer else X.doubled_area(r) > 0, F.reverse(r)).otherwise(r)
        return let(r, wound)

    r = rings.select("design_id", "poly", *keys, F.posexplode(F.array(moved("outer", True), F.when(F.col("hole").isNotNull(), moved("hole", False)))).alias("ring", "_r")).where("_r is not null")
    r = r.select("design_id", "poly", *keys, "ring", F.posexplode("_r").alias("i", "p"))
    return r.select("design_id", "poly", *keys, "ring", "i", X.milli("p.x").alias("x"), X.milli("p.y").alias("y"))


def _turned(x, y, angle, cx: float, cy: float):
    c, s = F.cos(angle), F.sin(angle)
    return F.struct((F.lit(cx) + (x - cx) * c - (y - cy) * s).alias("x"), (F.lit(cy) + (x - cx) * s + (y - cy) * c).alias("y"))


def radial(rings: DataFrame, count: int = 6, cx: float = 0.0, cy: float = 0.0, turn_each: bool = True) -> DataFrame:
    """`count` copies around a centre, the first in place: turned with their way around it, or moved along it as they are."""
    a = F.col("copy") * F.lit(2.0) * F.lit(math.pi) / count
    r = rings.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1)))).withColumn("_a", a)
    if turn_each:
        return _copies(r, ["copy"], lambda x, y: _turned(x, y, F.col("_a"), cx, cy))
    mean = lambda c: F.aggregate(F.transform("outer", lambda p: p[c].cast("double")), F.lit(0.0), lambda a, v: a + v) / F.size("outer")
    r = r.withColumns({"_mx": mean("x"), "_my": mean("y")}).withColumn("_to", _turned(F.col("_mx"), F.col("_my"), F.col("_a"), cx, cy))
    return _copies(r, ["copy"], lambda x, y: F.struct((x + (F.col("_to.x") - F.col("_mx"))).alias("x"), (y + (F.col("_to.y") - F.col("_my"))).alias("y")))


def mirror(rings: DataFrame, axis: str = "x", at: float = 0.0, keep: bool = True) -> DataFrame:
    """Copies mirrored at a line, and the originals as copy 0."""
    made = rings.withColumn("copy", F.explode(F.array(*(F.lit(k) for k in ((0, 1) if keep else (1,))))))
    flip = lambda x, y: F.struct((2.0 * at - x if axis == "x" else x).alias("x"), (2.0 * at - y if axis == "y" else y).alias("y"))
    own = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return _copies(made, ["copy"], lambda x, y: F.when(F.col("copy") == 1, flip(x, y)).otherwise(own(x, y)))


def kaleidoscope(rings: DataFrame, segments: int = 6, cx: float = 0.0, cy: float = 0.0) -> DataFrame:
    """Turned copies and mirror images around a centre, two for each segment; the images are flipped at the segment's own axis: back by its
    angle, over, and forth again."""
    r = rings.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(max(1, segments) - 1)))).withColumn("flip", F.explode(F.array(F.lit(0), F.lit(1))))
    r = r.withColumn("_a", F.col("segment") * F.lit(2.0) * F.lit(math.pi) / segments)

    def point(x, y):
        back = _turned(x, y, -F.col("_a"), cx, cy)
        return F.when(F.col("flip") == 0, _turned(x, y, F.col("_a"), cx, cy)).otherwise(_turned(F.lit(2.0 * cx) - back["x"], back["y"], F.col("_a"), cx, cy))

    return _copies(r, ["segment", "flip"], point)


def recommend(points: DataFrame, white=None, stats: DataFrame | None = None) -> DataFrame:
    """Settings suggested by the shares of thin and wide area of a design.  white: a condition on points of regions in near-white, of which
    one over a quarter of all area is a background; stats: plan statistics (design_id, stitches, density per square centimetre in
    thousandths), by which dense plans are thinned out."""
    marked = points.withColumn("_white", F.lit(False) if white is None else white)
    n = net_areas(points).join(marked.where("ring = 0").groupBy("design_id", "poly", "thread", "_white").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")), ["design_id", "poly"])
    # areas are doubled and in hundredths of square millimetres
    thin = (F.least("w", "h") < 30) | (F.col("net2") * 10 < F.col("w") * F.col("h") * 6)
    g = n.groupBy("design_id").agg(
        F.count(F.lit(1)).alias("regions"), F.count_distinct("thread").alias("colors"), F.sum("net2").alias("total2"), F.coalesce(F.sum(F.when(thin, F.col("net2"))), F.lit(0)).alias("thin2"), F.max("net2").alias("max2"),
        F.coalesce(F.max(F.when(F.col("_white"), F.col("net2"))), F.lit(0)).alias("white2"),
    )
    dense = F.lit(False)
    if stats is not None:
        g = g.join(stats.select("design_id", F.col("stitches").alias("_stitches"), F.col("density").alias("_density")), "design_id", "left")
        dense = F.coalesce((F.col("_stitches") > 10_000) | (F.col("_density") > 700_000), F.lit(False))
    fill = F.when(F.col("thin2") * 10 > F.col("total2") * 6, "satin").when(((F.col("total2") - F.col("thin2")) * 10 > F.col("total2") * 7) & (F.col("max2") > 20_000), "tatami").otherwise("auto")
    under = F.when(F.col("max2") > 60_000, "edge,tatami").when((F.col("total2") > F.col("thin2")) & (F.col("max2") > 16_000), "edge").otherwise("")
    return g.select(
        "design_id", "regions", F.greatest(F.lit(2), F.least(F.lit(12), "colors")).cast("long").alias("color_count"), fill.alias("fill_type"), under.alias("underlay"), F.when(fill == "satin", "center").otherwise("auto").alias("satin_underlay"),
        F.when(dense, 1.25).otherwise(1.0).alias("density_scale"), (F.col("white2") * 4 > F.col("total2")).alias("remove_white"),
    )
