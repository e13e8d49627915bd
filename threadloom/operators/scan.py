"""Outlines to label maps, and text to regions by way of its glyphs' outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.tables import stored

from . import layout, stretches


def flattened(points: Column, pieces: int = 4) -> Column:
    """A contour of points (x, y, on) as a ring: a point that is not on the contour bends it, as the control of a quadratic curve between its
    neighbours, or halfway to those that are not on it either; each curve is cut into `pieces` equal steps of its parameter."""
    n = F.size(points)
    at = lambda i: F.element_at(points, F.pmod(i, n) + 1)
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    half = lambda a, b: p((a["x"] + b["x"]) / 2.0, (a["y"] + b["y"]) / 2.0)
    toward = lambda c, b: F.when(b["on"], p(b["x"], b["y"])).otherwise(half(c, b))

    def bend(i: Column) -> Column:
        c, a, b = at(i), toward(at(i), at(i - 1)), toward(at(i), at(i + 1))
        t = [k / pieces for k in range(1, pieces)]
        curve = [p(*((1 - u) ** 2 * a[k] + 2 * u * (1 - u) * c[k] + u * u * b[k] for k in "xy")) for u in t]
        # its beginning is a point of its own only halfway between two controls
        return F.when(at(i - 1)["on"], F.array(*curve)).otherwise(F.array(a, *curve))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(at(i)["on"], F.array(p(at(i)["x"], at(i)["y"]))).otherwise(bend(i))))


def spans(outlines: DataFrame, rule: str = "nonzero") -> DataFrame:
    """Stretches (img, label, y, x1, x2) of the pixels whose middles lie inside rings (img, label, ring: array of x, y).  nonzero: where the rings
    wind around a point, so overlapping ones are one and a ring the other way round is a hole; evenodd: where an odd number of them holds it.

    Every edge is cut by the middles of the rows that it crosses; the crossings of a row are gone through from left to right."""
    n = F.size("ring")
    edges = F.transform("ring", lambda p, i: F.struct(p["x"].cast("double").alias("x0"), p["y"].cast("double").alias("y0"), F.element_at("ring", (i + 1) % n + 1)["x"].cast("double").alias("x1"), F.element_at("ring", (i + 1) % n + 1)["y"].cast("double").alias("y1")))
    e = outlines.select("img", "label", F.explode(edges).alias("e")).select("img", "label", "e.*").where("y0 <> y1")
    low, high = F.ceil(F.least("y0", "y1") - 0.5), F.ceil(F.greatest("y0", "y1") - 0.5) - 1
    e = e.select("*", low.alias("low"), high.alias("high")).where("low <= high").select("*", F.explode(F.sequence("low", "high")).alias("y"))
    x = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    c = e.select("img", "label", "y", x.alias("x"), F.when(F.col("y1") > F.col("y0"), 1).otherwise(-1).alias("turn"))
    w = Window.partitionBy("img", "label", "y").orderBy("x", "turn")
    wound = F.sum("turn" if rule == "nonzero" else F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = wound != 0 if rule == "nonzero" else wound % 2 == 1
    c = c.select("*", inside.alias("inside"), F.lead("x").over(w).alias("until")).where("inside and until is not null")
    c = c.select("img", "label", "y", F.ceil(F.col("x") - 0.5).cast("long").alias("x1"), (F.ceil(F.col("until") - 0.5) - 1).cast("long").alias("x2")).where("x1 <= x2")
    # neighbours without a pixel between them are one
    v = Window.partitionBy("img", "label", "y").orderBy("x1")
    apart = F.when(F.col("x1") > F.lag("x2").over(v) + 1, 1).otherwise(0)
    c = c.select("*", apart.alias("apart")).withColumn("island", F.sum("apart").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("img", "label", "y", "island").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).select("img", "label", F.col("y").cast("long").alias("y"), "x1", "x2")


def placed_outlines(texts: DataFrame, glyphs: DataFrame, line_height: int, spacing: int = 0, most_glyphs: int = 100_000) -> DataFrame:
    """Rings (img, label, pos, ring) of texts (text_id, text) set along lines around their middle, in units: glyphs (char, advance, rings: array of
    arrays of points from the glyph's left edge and base line).  A font is broadcast if it has up to `most_glyphs`; characters that
    it lacks take no room."""
    chars = texts.select("text_id", F.posexplode(F.split("text", "")).alias("pos", "char")).where("char <> ''")
    font = glyphs.select("char", "advance", "rings")
    font = F.broadcast(font) if glyphs.limit(most_glyphs + 1).count() <= most_glyphs else font
    set_ = chars.join(font, "char", "left").where((F.col("char") == "\n") | F.col("advance").isNotNull()).withColumn("advance", F.coalesce("advance", F.lit(0)).cast("long"))
    at = layout.horizontal(set_.select("text_id", "pos", "char", "advance"), line_height, spacing).select("text_id", "pos", "x4", "y4")
    # both sides are by text, so the font's outlines join where the letters are
    s = set_.where(F.col("rings").isNotNull()).join(at, ["text_id", "pos"])
    left, base = F.col("x4") / 4.0 - F.col("advance") / 2.0, F.col("y4") / 4.0
    ring = F.transform("r", lambda p: F.struct((p["x"] + left).alias("x"), (p["y"] + base).alias("y")))
    return s.select("text_id", "pos", "x4", "y4", "advance", F.explode("rings").alias("r")).select(F.col("text_id").alias("img"), F.lit(0).cast("long").alias("label"), "pos", ring.alias("ring"))


#: Rings of more points together are scanned where they lie.
SHAPE_POINTS = 10_000


def _groups(outlines: DataFrame) -> DataFrame:
    """Rings (img, label, ring) with the group (band, island) that they belong to, and its points: groups are a row or a column of pixels apart at
    least, so what is inside, and which pixels hang together, can be told of each alone."""
    least = lambda c: F.ceil(F.array_min(F.transform("ring", lambda p: p[c].cast("double"))) - 0.5)
    most = lambda c: F.ceil(F.array_max(F.transform("ring", lambda p: p[c].cast("double"))) - 0.5) - 1
    r = outlines.where(F.size("ring") > 2).select("img", "label", "ring", least("x").alias("x1"), most("x").alias("x2"), least("y").alias("y1"), most("y").alias("y2"))

    for name, by, lo, hi in (("band", ["img", "label"], "y1", "y2"), ("island", ["img", "label", "band"], "x1", "x2")):
        w = Window.partitionBy(*by).orderBy(lo, hi)
        new = F.when(F.col(lo) > F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 1).otherwise(0)
        r = r.withColumn("new", new).withColumn(name, F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    return r.withColumn("points", F.sum(F.size("ring")).over(Window.partitionBy("img", "label", "band", "island")))


def _shapes(groups: DataFrame) -> DataFrame:
    """A row for each group: img, label, shape (its rings, moved by whole pixels to the origin where that loses no digit), by which it was moved (sx,
    sy), and a hash of the shape."""
    g = groups.groupBy("img", "label", "band", "island").agg(F.min("x1").alias("sx"), F.min("y1").alias("sy"), F.array_sort(F.collect_list("ring")).alias("rings"))
    s = lambda c: F.col(f"s{c}").cast("double")
    exact = F.forall("rings", lambda r: F.forall(r, lambda p: ((p["x"] - s("x")) + s("x") == p["x"]) & ((p["y"] - s("y")) + s("y") == p["y"])))
    g = g.withColumn("exact", exact).withColumns({c: F.when(F.col("exact"), F.col(c)).otherwise(0).cast("long") for c in ("sx", "sy")})
    shape = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] - s("x")).alias("x"), (p["y"] - s("y")).alias("y"))))
    return g.select("img", "label", "sx", "sy", shape.alias("shape")).withColumn("hash", F.xxhash64("shape"))


def regions(outlines: DataFrame, pixels: float = 1.0, least: float = 0.0, rule: str = "nonzero") -> DataFrame:
    """From outlines in units, with `pixels` to a unit: a row for each region of at least `least` square units: img, label, ring (which names it),
    outer, holes (arrays of corners, in units), area (without the holes).  Rings are of one part each, and a hole belongs to the outer ring of
    its part, so no hole is compared with any ring.

    Groups of rings that lie apart are scanned each alone, and those of one shape, like a letter wherever it stands, once."""
    real = lambda p: F.struct((p["x"].cast("double") * pixels).alias("x"), (p["y"].cast("double") * pixels).alias("y"))
    groups = stored(_groups(outlines.select("img", "label", F.transform("ring", real).alias("ring"))))
    met = stored(_shapes(groups.where(F.col("points") <= SHAPE_POINTS)))
    shapes = stored(met.select("hash", "shape").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = _scanned(shapes.select(F.col("id").alias("img"), F.lit(0).cast("long").alias("label"), F.explode("shape").alias("ring")), rule).drop("label")
    found = stored(shapes.join(found.withColumnRenamed("img", "id"), "id").drop("id"))
    g = met.join(found, ["hash", "shape"]).drop("hash", "shape")
    large = groups.where(F.col("points") > SHAPE_POINTS)
    if not large.isEmpty():
        zero = F.lit(0).cast("long")
        g = g.unionByName(_scanned(large.select("img", "label", "ring"), rule).withColumns({"sx": zero, "sy": zero}))
    path = lambda p: F.transform(p, lambda c: F.struct(((c["x"] + F.col("sx")) / pixels).alias("x"), ((c["y"] + F.col("sy")) / pixels).alias("y")))
    area = F.col("area") / (2.0 * pixels * pixels)
    ring = F.col("ring") + (F.col("sy") * F.lit(stretches._ROW) + F.col("sx")) * 4
    return g.where(area >= least).select("img", "label", ring.alias("ring"), path("outer").alias("outer"), F.transform("holes", path).alias("holes"), area.alias("area"))


def _scanned(outlines: DataFrame, rule: str) -> DataFrame:
    """Regions of outlines in pixels: img, label, ring, outer, holes, and twice the area, all in whole pixels."""
    st = stored(spans(outlines, rule))
    r = stretches.rings(st)
    size = F.sum(F.col("x") * F.col("ey") - F.col("ex") * F.col("y"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    # a ring's first corner touches a pixel of its part: an outer ring's the one to its lower right, a hole's the one above that
    first = F.min(F.when(F.col("i") == 0, F.struct("x", "y")))
    each = r.groupBy("img", "label", "ring").agg(size.alias("area"), path.alias("path"), first.alias("first"))
    touch = F.when(F.col("area") > 0, F.col("first")).otherwise(F.struct(F.col("first.x").alias("x"), (F.col("first.y") - 1).alias("y")))
    each = each.withColumn("touch", touch).select("*", F.col("touch.x").alias("px"), F.col("touch.y").alias("py"))
    of = _part_of(each, stretches.parted(st))
    outer = F.max(F.when(F.col("area") > 0, F.struct("ring", "path")))
    g = of.groupBy("img", "label", "part").agg(outer.alias("o"), F.transform(F.array_sort(F.collect_list(F.when(F.col("area") < 0, F.struct("ring", "path")))), lambda h: h["path"]).alias("holes"), F.sum("area").alias("area"))
    return g.select("img", "label", "o.ring", F.col("o.path").alias("outer"), "holes", "area")


def _part_of(points: DataFrame, labeled: DataFrame) -> DataFrame:
    """The part of each point's pixel (px, py): the last stretch of its row and label that begins up to there."""
    a = points.select("img", "label", F.col("py").alias("y"), F.col("px").alias("x"), F.lit(1).alias("side"), F.struct(*(F.col(c) for c in points.columns if c not in ("img", "label"))).alias("p"), F.lit(None).cast("long").alias("part"))
    b = labeled.select("img", "label", "y", F.col("x1").alias("x"), F.lit(0).alias("side"), F.lit(None).cast(a.schema["p"].dataType).alias("p"), "part")
    w = Window.partitionBy("img", "label", "y").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("part", F.last("part", ignorenulls=True).over(w)).where("side = 1").select("img", "label", "part", "p.*")
