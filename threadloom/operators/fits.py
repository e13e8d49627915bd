"""Strokes that were read from stitches: neighbours that go on in one another become one.

Rows (design_id, pos, kind, closed, width, points: array of x, y) in the order in which they are sewn, in millimetres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least width of a column of satin, how far widths may be apart, and how far ends.
COLUMN = 1.4
WIDTH_SLACK, WIDTH_SHARE = 0.3, 0.2
LEAST_REACH = 1.5


def _goes_on(head: Column, end: Column, s: Column) -> Column:
    """Whether a stroke goes on from one of the width `head` that ends at `end`."""
    far2 = (s["a"]["x"] - end["x"]) * (s["a"]["x"] - end["x"]) + (s["a"]["y"] - end["y"]) * (s["a"]["y"] - end["y"])
    reach = F.greatest(head, F.lit(LEAST_REACH))
    return (F.abs(head - s["width"]) <= F.greatest(F.lit(WIDTH_SLACK), head * WIDTH_SHARE)) & (far2 < reach * reach)


def grouped(fits: DataFrame) -> DataFrame:
    """The rows with `head`: the pos of the stroke that each is a part of.  Whether one goes on is a matter of the first one's width, so rows are
    gone through in order; but only columns next to each other have to be, as anything else ends a stroke, and of them only widths and
    ends are collected."""
    able = F.coalesce((F.col("kind") == "stroke") & ~F.col("closed") & (F.col("width") >= COLUMN) & (F.size("points") > 0), F.lit(False))
    w = Window.partitionBy("design_id").orderBy("pos")
    f = fits.withColumn("_able", able)
    # every other row is an island of its own
    turn = F.when(F.col("_able") & F.coalesce(F.lag("_able").over(w), F.lit(False)), 0).otherwise(1)
    f = f.withColumn("_turn", turn).withColumn("_island", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    double = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    thin = F.struct("pos", F.col("width").cast("double").alias("width"), double(F.try_element_at("points", F.lit(1))).alias("a"), double(F.try_element_at("points", F.lit(-1))).alias("z"))
    chains = f.where("_able").groupBy("design_id", "_island").agg(F.array_sort(F.collect_list(thin)).alias("s"))
    zero = F.struct(F.lit(None).cast("double").alias("width"), F.lit(None).cast("struct<x:double,y:double>").alias("end"), F.col("s")[0]["pos"].alias("head"), F.array().cast(f"array<struct<pos:{fits.schema['pos'].dataType.simpleString()},head:{fits.schema['pos'].dataType.simpleString()}>>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        on = F.coalesce(_goes_on(acc["width"], acc["end"], s), F.lit(False))
        head = F.when(on, acc["head"]).otherwise(s["pos"])
        return F.struct(F.when(on, acc["width"]).otherwise(s["width"]).alias("width"), s["z"].alias("end"), head.alias("head"), F.array_append(acc["done"], F.struct(s["pos"].alias("pos"), head.alias("head"))).alias("done"))

    heads = chains.select("design_id", F.explode(F.aggregate("s", zero, step, lambda acc: acc["done"])).alias("d")).select("design_id", "d.pos", "d.head")
    return f.drop("_able", "_turn", "_island").join(heads, ["design_id", "pos"], "left").withColumn("head", F.coalesce("head", "pos"))


def merged(fits: DataFrame) -> DataFrame:
    """A row for each stroke: those that go on in one another as one, with the first one's properties, and without the points where they meet."""
    rest = [c for c in fits.columns if c not in ("design_id", "pos", "points")]
    g = grouped(fits)
    first = F.min_by(F.struct(*rest), "pos").alias("own")
    part = F.struct("pos", F.when(F.col("pos") == F.col("head"), F.col("points")).otherwise(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0)))).alias("points"))
    out = g.groupBy("design_id", F.col("head").alias("pos")).agg(first, F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["points"])).alias("points"), F.count(F.lit(1)).alias("parts"))
    return out.select("design_id", "pos", *(F.col(f"own.{c}") for c in rest), "points", "parts")
