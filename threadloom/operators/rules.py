"""Validation and diagnosis of stitch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.model import COLOR_WARN_COUNT, HOOP_HALF, MAX_STITCH, MAX_STITCHES, MIN_STITCH, TRIM_ABOVE, TRIM_WARN_FACTOR

from .plan import RUN, bounds, runs, stats, steps

#: code -> severity, in the order of the rules.
SEVERITY = {
    "empty-plan": "error", "out-of-hoop": "error", "stitch-count-exceeded": "error", "long-stitch-in-run": "warning", "continuous-too-far": "warning", "short-stitches": "warning",
    "trim-in-object": "error", "long-jump": "warning", "too-many-colors": "warning", "too-many-trims": "warning",
}


def counters(st: DataFrame, run_table: DataFrame | None = None) -> DataFrame:
    """What the rules look at, a row for each design. run_table: runs with connection and, where known, object_id; all runs of a
    block, empty ones too (n = 0), since a gap counts only from the run right before."""
    d2 = X.squared("dx", "dy")
    s = steps(st).groupBy("design_id").agg(
        F.count(F.lit(1)).alias("stitches"), F.count_if(d2 > MAX_STITCH * MAX_STITCH).alias("long_steps"), F.count_if((d2 > 0) & (d2 < MIN_STITCH * MIN_STITCH)).alias("short_steps"), F.count_distinct("block_idx").alias("colors"),
    )
    r = runs(st).withColumn("object_id", F.lit(None).cast("int")) if run_table is None else run_table
    w = Window.partitionBy("design_id", "block_idx").orderBy("run_idx")
    r = r.withColumns({"_n": F.lag("n").over(w), "_x": F.lag("x1").over(w), "_y": F.lag("y1").over(w), "_object": F.lag("object_id").over(w), "_any": F.lag(F.lit(1)).over(w)})
    gap = X.squared(F.col("x0") - F.col("_x"), F.col("y0") - F.col("_y"))
    here = (F.col("n") > 0) & F.col("_any").isNotNull()
    both = here & (F.col("_n") > 0)
    c = F.col("connection")
    g = r.groupBy("design_id").agg(
        F.count_if((F.col("run_idx") > 0) & (c == "trim")).alias("trims"), F.count_if(both & (c == "continuous") & (gap > MAX_STITCH * MAX_STITCH)).alias("far_continuous"),
        F.count_if(both & (c == "jump") & (gap > TRIM_ABOVE * TRIM_ABOVE)).alias("long_jumps"), F.count_if(here & (c == "trim") & (F.col("object_id") == F.col("_object"))).alias("object_trims"),
    )
    b = bounds(st)
    return g.join(s, "design_id", "left").join(b, "design_id", "left").na.fill(0, ["stitches", "long_steps", "short_steps", "colors"])


def issues(c: DataFrame) -> DataFrame:
    """(design_id, severity, code, n) of the rules that a design breaks; an empty plan breaks that one only."""
    outside = (F.col("min_x") < -HOOP_HALF) | (F.col("max_x") > HOOP_HALF) | (F.col("min_y") < -HOOP_HALF) | (F.col("max_y") > HOOP_HALF)
    some = F.col("stitches") > 0
    over = lambda name, limit: F.when(some & (F.col(name) > limit), F.col(name)).otherwise(0)
    rules = {
        "empty-plan": F.when(~some, 1).otherwise(0), "out-of-hoop": F.when(some & outside, 1).otherwise(0), "stitch-count-exceeded": over("stitches", MAX_STITCHES), "long-stitch-in-run": over("long_steps", 0),
        "continuous-too-far": over("far_continuous", 0), "short-stitches": over("short_steps", 0), "trim-in-object": over("object_trims", 0), "long-jump": over("long_jumps", 0),
        "too-many-colors": over("colors", COLOR_WARN_COUNT), "too-many-trims": F.when(some & (F.col("trims") > F.greatest(F.lit(1), F.col("colors")) * TRIM_WARN_FACTOR), F.col("trims")).otherwise(0),
    }
    each = F.array(*(F.struct(F.lit(SEVERITY[k]).alias("severity"), F.lit(k).alias("code"), v.cast("long").alias("n")) for k, v in rules.items()))
    return c.select("design_id", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("i")).select("design_id", "i.*")


def diagnoses(st: DataFrame) -> DataFrame:
    """(design_id, level, code, n): issues as critical or notice, two notices more, or ok; with the design's overall level."""
    found = issues(counters(st)).select("design_id", F.when(F.col("severity") == "error", "critical").otherwise("notice").alias("level"), "code", "n")
    s = stats(st).select("design_id", "stitches", "travel_max")
    near = s.where((F.col("stitches") <= MAX_STITCHES) & (F.col("stitches") > MAX_STITCHES * 0.9)).select("design_id", F.lit("notice").alias("level"), F.lit("near-stitch-limit").alias("code"), F.col("stitches").alias("n"))
    far = s.where(F.col("travel_max") > TRIM_ABOVE * 1000).select("design_id", F.lit("notice").alias("level"), F.lit("long-travel").alias("code"), F.col("travel_max").alias("n"))
    every = found.unionByName(near).unionByName(far)
    fine = s.join(every.select("design_id").distinct(), "design_id", "left_anti").select("design_id", F.lit("ok").alias("level"), F.lit("ok").alias("code"), F.col("stitches").alias("n"))
    rank = F.when(F.col("level") == "critical", 0).when(F.col("level") == "notice", 1).otherwise(2)
    out = every.unionByName(fine).withColumn("rank", rank)
    return out.withColumn("overall_rank", F.min("rank").over(Window.partitionBy("design_id")))


__all__ = ["RUN", "SEVERITY", "counters", "diagnoses", "issues"]
