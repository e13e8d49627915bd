"""Polylines with fewer points, set at a time: rows (keys, i, x, y), of which those stay that lie farther than a tolerance from the chord that would
replace them, the farthest of each stretch first.

A round finds the farthest point of every stretch of every path at once and splits the stretches there; paths that are done drop out, so a
round works on what is still open, and there are as many as the deepest path has splits (about the logarithm of its length, unless it
is made against that)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.tables import forget, scope, stored


def _gap2(p: str, a: str, b: str) -> Column:
    """Squared distance of a point from a segment."""
    c = lambda n, k: F.col(f"{n}.{k}").cast("double")
    dx, dy, wx, wy = c(b, "x") - c(a, "x"), c(b, "y") - c(a, "y"), c(p, "x") - c(a, "x"), c(p, "y") - c(a, "y")
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wx * dx + wy * dy) / n))).otherwise(F.lit(0.0))
    return (wx - t * dx) * (wx - t * dx) + (wy - t * dy) * (wy - t * dy)


def simplified(points: DataFrame, keys: list[str], tolerance: float, closed: bool = False) -> DataFrame:
    """The points that stay, as they were.  An open path keeps its ends.  A closed one is cut at its first point and the one farthest from that, and
    stays as it is with up to four points."""
    point = F.struct("i", "x", "y")
    p = points.select(*keys, "i", "x", "y")
    ends = p.groupBy(*keys).agg(F.min(point).alias("first"), F.max(point).alias("last"), F.count(F.lit(1)).alias("n"))
    with scope(points.sparkSession) as own:
        if closed:
            away = lambda c: (F.col(c) - F.col(f"first.{c}")).cast("double")
            far = p.join(ends, keys).groupBy(*keys).agg(F.max_by(point, F.struct(away("x") * away("x") + away("y") * away("y"), -F.col("i"))).alias("far"))
            ends = stored(ends.join(far, keys))
            # the first point again, after the last
            again = F.struct((F.col("last.i") + 1).alias("i"), F.col("first.x").alias("x"), F.col("first.y").alias("y"))
            small, before = F.col("n") <= 4, F.col("i") < F.col("far.i")
            rows = p.join(ends, keys).select(*keys, point.alias("p"), F.when(before, F.col("first")).otherwise(F.col("far")).alias("a"), F.when(before, F.col("far")).otherwise(again).alias("b"), small.alias("small"), ((F.col("i") == F.col("first.i")) | (F.col("i") == F.col("far.i"))).alias("end"))
            rows = stored(rows)
            kept = rows.where(F.col("small") | F.col("end"))
            # a ring that is all one point is that point
            open_ = rows.where(~F.col("small") & ~F.col("end") & (F.col("a.i") != F.col("b.i")))
            open_ = open_.join(ends.where("far.i = first.i").select(*keys), keys, "left_anti")
        else:
            rows = stored(p.join(ends, keys).select(*keys, point.alias("p"), F.col("first").alias("a"), F.col("last").alias("b"), F.col("i").isin(F.col("first.i"), F.col("last.i")).alias("end")))
            kept, open_ = rows.where("end"), rows.where("not end")
        found = [stored(kept.select(*keys, "p.*"))]
        state = stored(open_.select(*keys, "p", "a", "b"))
        forget(rows)
        while not state.isEmpty():
            s = state.withColumn("gap2", _gap2("p", "a", "b"))
            far = stored(s.groupBy(*keys, F.col("a.i").alias("at")).agg(F.max_by("p", F.struct("gap2", -F.col("p.i"))).alias("far"), F.max("gap2").alias("gap2")).where(F.col("gap2") > tolerance * tolerance).drop("gap2"))
            found.append(stored(far.select(*keys, "far.*")))
            j = state.withColumn("at", F.col("a.i")).join(far, [*keys, "at"]).where(F.col("p.i") != F.col("far.i"))
            before = F.col("p.i") < F.col("far.i")
            new = stored(j.select(*keys, "p", F.when(before, F.col("a")).otherwise(F.col("far")).alias("a"), F.when(before, F.col("far")).otherwise(F.col("b")).alias("b")))
            forget(state, far)
            state = new
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        out = own.release(stored(out))
    return out


def nodes(points: DataFrame, keys: list[str], tolerance: float = 4.0, corner: float = 50.0, closed: bool = False) -> DataFrame:
    """Node paths of dense points: simplified, and corners where what is left turns by `corner` degrees or more, and at the ends of open paths:
    (keys, i, x, y, smooth)."""
    w, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = lambda c: (F.coalesce(F.lag(c).over(w), F.last(c).over(whole)), F.coalesce(F.lead(c).over(w), F.first(c).over(whole)))
    (px, nx), (py, ny) = around("x"), around("y")
    s = simplified(points, keys, tolerance, closed).withColumns({"_px": px, "_py": py, "_nx": nx, "_ny": ny, "_end": F.lag("i").over(w).isNull() | F.lead("i").over(w).isNull()})
    sharp = X.turn_degrees(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"), F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y")) >= corner
    return s.select(*keys, "i", "x", "y", (~(sharp if closed else sharp | F.col("_end"))).alias("smooth"))
