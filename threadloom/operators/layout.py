"""Text layout: glyphs (text_id, pos, char, advance) placed along lines, columns or an arc, in whole units times 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X


def _centered(df: DataFrame, x: str, y: str, out=("x2", "y2")) -> DataFrame:
    """Moved so that the middle of the placed points' box is the origin; doubled, so that halves stay whole."""
    w = Window.partitionBy("text_id")
    mid = lambda c: F.min(c).over(w) + F.max(c).over(w)
    return df.withColumns({"_mx": mid(x), "_my": mid(y)}).withColumns({out[0]: F.col(x) * 2 - F.col("_mx"), out[1]: F.col(y) * 2 - F.col("_my")}).drop("_mx", "_my")


def horizontal(glyphs: DataFrame, line_height: int, spacing: int = 0) -> DataFrame:
    """Pen positions add up along a line; a line feed starts the next. (text_id, pos, char, x4, y4: quarters from the centre.)"""
    w = Window.partitionBy("text_id").orderBy("pos")
    g = glyphs.withColumn("line", F.sum(F.when(F.col("char") == "\n", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.where("char <> '\n'")
    pen = F.coalesce(F.sum(F.col("advance") + spacing).over(Window.partitionBy("text_id", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumns({"_x": pen * 2 + F.col("advance"), "_y": F.col("line") * line_height * 2})
    return _centered(g, "_x", "_y", ("x4", "y4")).select("text_id", "pos", "char", F.col("x4").cast("long").alias("x4"), F.col("y4").cast("long").alias("y4"))


def vertical(glyphs: DataFrame, font_size: int, line_width: int, spacing: int = 0) -> DataFrame:
    """Down each column, columns from right to left."""
    w = Window.partitionBy("text_id").orderBy("pos")
    g = glyphs.withColumn("line", F.sum(F.when(F.col("char") == "\n", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("char <> '\n'")
    k = F.row_number().over(Window.partitionBy("text_id", "line").orderBy("pos")) - 1
    g = g.withColumns({"_x": -F.col("line") * line_width * 2, "_y": k * (font_size + spacing) * 2 + font_size})
    return _centered(g, "_x", "_y", ("x4", "y4")).select("text_id", "pos", "char", F.col("x4").cast("long").alias("x4"), F.col("y4").cast("long").alias("y4"))


def arc(glyphs: DataFrame, radius: float, center: float = 0.0, spacing: int = 0, inward: bool = False) -> DataFrame:
    """Along a circle; line feeds are left out. (text_id, pos, char, x, y, rotation in thousandths.)"""
    g = glyphs.where("char <> '\n'")
    every = Window.partitionBy("text_id")
    total = F.sum(F.col("advance") + spacing).over(every) - spacing
    done = F.coalesce(F.sum(F.col("advance") + spacing).over(every.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    angle = center + (-1 if inward else 1) * (done + F.col("advance") / 2.0 - total / 2.0) / radius
    g = g.withColumn("angle", angle).withColumns({"_x": F.sin("angle") * radius, "_y": F.cos("angle") * (radius if inward else -radius)})
    turn = F.lit(3.141592653589793) - F.col("angle") if inward else -F.col("angle")
    return _centered(g, "_x", "_y").select("text_id", "pos", "char", X.milli(F.col("x2") / 2).alias("x"), X.milli(F.col("y2") / 2).alias("y"), X.milli(turn).alias("rotation"))


def quality(sizes: DataFrame) -> DataFrame:
    """Warnings for letter heights (font_size, puffy): too small, stems too thin, close to too small for raised letters."""
    h = F.col("font_size") * 0.1
    least = F.when(F.col("puffy"), 8.0).otherwise(5.0)
    codes = F.array(F.when(h < least, "critical:height"), F.when(h * 0.12 < 1.0, "notice:stem"), F.when(F.col("puffy") & (h < 10.0), "notice:puffy"))
    return sizes.withColumn("warnings", F.array_compact(codes))
