"""Label maps as rows (img, x, y, label): smoothing, closing, boundaries, luminance bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X


def majority(labels: DataFrame) -> DataFrame:
    """The most frequent label in the 3 by 3 around a pixel, itself counting twice; on ties the one met first, row by row. Each
    pixel votes for its nine neighbours, so a shuffle by pixel is all it takes."""
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    # a voter at (x + dx, y + dy) is seen from the pixel at the opposite offset
    v = labels.withColumn("o", F.explode(around)).select("img", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "label", (-F.col("o.dy") * 3 - F.col("o.dx")).alias("turn"), F.when((F.col("o.dx") == 0) & (F.col("o.dy") == 0), 2).otherwise(1).alias("votes"))
    v = v.groupBy("img", "x", "y", "label").agg(F.sum("votes").alias("votes"), F.min("turn").alias("turn"), F.max(F.col("votes") == 2).alias("own"))
    g = v.groupBy("img", "x", "y").agg(F.max_by("label", F.struct("votes", -F.col("turn"))).alias("smooth"), F.max("own").alias("there"))
    return g.where("there").drop("there")


def closing(labels: DataFrame, color: int, radius: int = 3) -> DataFrame:
    """Dilation, then erosion, of one label's mask by a square: along rows and along columns, as running extremes. Outside the image
    nothing is set and nothing must be."""
    mask = labels.select("img", "x", "y", "label", (F.col("label") == color).cast("int").alias("m"))
    row, column = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-radius, radius), Window.partitionBy("img", "x").orderBy("y").rowsBetween(-radius, radius)
    for extreme, w in ((F.max, row), (F.max, column), (F.min, row), (F.min, column)):
        mask = mask.withColumn("m", extreme("m").over(w))
    return mask.select("img", "x", "y", "label", F.col("m").alias("closed"))


def boundary_edges(labels: DataFrame) -> DataFrame:
    """Unit edges around each label's pixels, clockwise: (img, label, sx, sy, ex, ey)."""
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    near = {"up": F.lag("label").over(column), "down": F.lead("label").over(column), "left": F.lag("label").over(row), "right": F.lead("label").over(row)}
    l = labels.withColumns(near)
    x, y = F.col("x"), F.col("y")
    edge = {"up": (x, y, x + 1, y), "right": (x + 1, y, x + 1, y + 1), "down": (x + 1, y + 1, x, y + 1), "left": (x, y + 1, x, y)}
    each = F.array(*(F.when(F.coalesce(F.col(k) != F.col("label"), F.lit(True)), F.struct(*(c.alias(n) for c, n in zip(v, ("sx", "sy", "ex", "ey"), strict=True)))) for k, v in edge.items()))
    return l.select("img", "label", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("img", "label", "e.*")


def luminance_bands(pixels: DataFrame, bands: int = 3, white: float = 0.92) -> DataFrame:
    """Band of each pixel by its luminance, null from `white` on; 4 bands at most."""
    n = max(1, min(4, bands))
    v = X.luminance("r", "g", "b")
    return pixels.select("img", "x", "y", X.milli(v).alias("lum_milli"), F.when(v < white, F.least(F.lit(n - 1), F.floor(v * n / white))).cast("long").alias("band"))


def band_segments(banded: DataFrame) -> DataFrame:
    """Maximal stretches of a row within one band."""
    w = Window.partitionBy("img", "y", "band").orderBy("x")
    s = banded.where("band is not null").withColumn("island", F.col("x") - F.row_number().over(w))
    return s.groupBy("img", "y", "band", "island").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("island")


def palette_of(pixels: DataFrame) -> DataFrame:
    """Mean colour of each label, rounded, and its place by first pixel."""
    mean = lambda c: X.round_half_up(F.sum(c) / F.count(F.lit(1))).cast("long").alias(c)
    g = pixels.groupBy("img", "label").agg(mean("r"), mean("g"), mean("b"), F.min(F.col("y") * 65536 + F.col("x")).alias("first"))
    return g.withColumn("place", (F.row_number().over(Window.partitionBy("img").orderBy("first")) - 1).cast("long")).drop("first")


def dominant_colors(pixels: DataFrame, k: int = 8) -> DataFrame:
    """The k colours that most pixels of a picture have, the one met first on ties: (img, rank, r, g, b, n).  Counts are summed before they are moved,
    and no task hands on more than k of a picture."""
    g = pixels.groupBy("img", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("y").cast("long") * 65536 + F.col("x")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("n"), "first"))
    return g.withColumn("rank", rank).where(F.col("rank") <= k).select("img", "rank", "r", "g", "b", "n")


def white_background(pixels: DataFrame, threshold: int = 240) -> DataFrame:
    """Whether three of an image's four corners are near white, and none of them transparent (a: null where there is no such channel).

    One aggregate of whole numbers, summed up before anything moves: of the first row, the first column and the whole picture the last
    pixel, each as its place with two bits for what it is.  So pixels are joined with nothing, and no side can be taken for small."""
    alpha = F.coalesce(F.col("a"), F.lit(255)) if "a" in pixels.columns else F.lit(255)
    near = F.coalesce((F.col("r") >= threshold) & (F.col("g") >= threshold) & (F.col("b") >= threshold), F.lit(False))
    x, y, bits = F.col("x").cast("long"), F.col("y").cast("long"), F.when(near, 2).otherwise(0) + F.when(alpha >= 128, 1).otherwise(0)
    last = lambda at, where=None: F.max(at * 4 + bits if where is None else F.when(where, at * 4 + bits))
    g = pixels.groupBy("img").agg(F.max(x).alias("mx"), F.max(y).alias("my"), last(F.lit(0), (x == 0) & (y == 0)).alias("p0"), last(x, y == 0).alias("p1"), last(y, x == 0).alias("p2"), last(x * F.lit(1 << 30) + y).alias("p3"))
    mx, my = F.col("mx"), F.col("my")
    place = lambda p: F.shiftright(p, 2)
    # a picture of one row or column has the same pixel at two corners, and one that lacks pixels may have none there
    is_corner = (F.col("p0").isNotNull(), (mx > 0) & (place("p1") == mx), (my > 0) & (place("p2") == my), (mx > 0) & (my > 0) & (place("p3") == mx * F.lit(1 << 30) + my))
    there = F.filter(F.array(*(F.when(ok, F.col(f"p{k}").bitwiseAND(3)) for k, ok in enumerate(is_corner))), lambda c: c.isNotNull())
    found = g.select("img", there.alias("c")).where(F.size("c") > 0)
    return found.select("img", ((F.size(F.filter("c", lambda c: c >= 2)) >= 3) & F.forall("c", lambda c: c % 2 == 1)).alias("white"))
