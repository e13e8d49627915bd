"""What runs of stitches look like: columns of satin, lines, fills; from turns and lengths, by windows within a run and one aggregate.

Rows as in operators.plan (design_id, block_idx, run_idx, seq, x, y), in units; limits are in millimetres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X

from .plan import RUN

# Turns of a column in a row, and how far they are apart at least; returns within this are to the same point.
TURNS, GAP_MM, SAME_MM = 5, 0.6, 0.25


def turns(st: DataFrame, unit_mm: float = 0.1) -> DataFrame:
    """Stitches with turn: R where the ones next to a point lie within a quarter millimetre of each other, Z where the way turns back by more than 120
    degrees, S elsewhere; and wide: both steps are GAP_MM or more."""
    w = Window.partitionBy(*RUN).orderBy("seq")
    s = st.select(*RUN, "seq", "x", "y", *(f(c).over(w).alias(n + c) for c in "xy" for f, n in ((F.lag, "p"), (F.lead, "n"))))
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    a2, b2, dot = X.squared(ax, ay), X.squared(bx, by), (ax * bx + ay * by).cast("long")
    near = X.squared(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) < (SAME_MM / unit_mm) ** 2
    # dot / (|a| |b|) < -1/2 in whole numbers
    back = (dot < 0) & (a2 > 0) & (b2 > 0) & (4 * dot * dot > a2 * b2)
    turn = F.when(F.col("px").isNull() | F.col("nx").isNull(), "S").when(near, "R").when(back, "Z").otherwise("S")
    least = (GAP_MM / unit_mm) ** 2
    return s.select(*RUN, "seq", "x", "y", turn.alias("turn"), F.coalesce((a2 >= least) & (b2 >= least), F.lit(False)).alias("wide"), F.coalesce(back, F.lit(False)).alias("back"), F.coalesce((a2 > 0) & (b2 > 0), F.lit(False)).alias("bends"))


def columns(st: DataFrame) -> DataFrame:
    """Stretches of runs that are columns of satin: TURNS or more wide turns in a row; (run, first, last), with the stitches that they begin and end at,
    which the stretches beside share.  Gaps and islands: of turns in a row, the number and the place among turns differ by the same."""
    w = Window.partitionBy(*RUN).orderBy("seq")
    z = turns(st).where(F.col("turn").isin("Z", "R") & F.col("wide"))
    z = z.withColumn("_island", F.col("seq") - F.row_number().over(w))
    g = z.groupBy(*RUN, "_island").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count(F.lit(1)).alias("turns")).where(F.col("turns") >= TURNS)
    return g.select(*RUN, (F.col("a") - 1).alias("first"), (F.col("b") + 1).alias("last"), "turns")


def looks(st: DataFrame, unit_mm: float = 0.1) -> DataFrame:
    """Of each run: points, reversals, its length and its box's diagonal (thousandths of units), and whether it looks like a line (few turns back and not over
    eight times as long as its box) or a fill (six points or more, three turns back or more from one long step to the next, and over three times as long)."""
    t = turns(st, unit_mm)
    w = Window.partitionBy(*RUN).orderBy("seq")
    t = t.withColumn("d", F.struct((F.col("x") - F.lag("x").over(w)).alias("x"), (F.col("y") - F.lag("y").over(w)).alias("y")))
    # a fill's rows turn back over short steps between them, which don't count
    far = F.coalesce(X.squared("d.x", "d.y") >= (GAP_MM / unit_mm) ** 2, F.lit(False))
    p = F.last(F.when(far, F.col("d")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.select("*", far.alias("far"), p.alias("p"))
    dot = (F.col("d.x") * F.col("p.x") + F.col("d.y") * F.col("p.y")).cast("long")
    row = F.coalesce(F.col("far") & (dot < 0) & (4 * dot * dot > X.squared("d.x", "d.y") * X.squared("p.x", "p.y")), F.lit(False))
    step = X.milli(X.distance("d.x", "d.y"))
    g = t.withColumns({"step": step, "row": row}).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("points"), F.count_if("back").alias("reversals"), F.count_if("bends").alias("bends"), F.count_if("row").alias("rows_back"), F.coalesce(F.sum("step"), F.lit(0)).alias("length"),
        X.milli(X.distance(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).alias("diagonal"),
    )
    # the box counts as a millimetre at least
    box = F.greatest(F.col("diagonal"), F.lit(int(1000 / unit_mm)))
    line: Column = (F.col("points") >= 2) & ((F.col("bends") == 0) | (F.col("reversals") * 100 < F.col("bends") * 15)) & (F.col("length") < 8 * box)
    fill: Column = (F.col("points") >= 6) & (F.col("rows_back") >= 3) & (F.col("diagonal") > 0) & (F.col("length") > 3 * F.col("diagonal"))
    return g.select(*RUN, "points", "reversals", "length", "diagonal", line.alias("is_line"), fill.alias("is_fill"))
