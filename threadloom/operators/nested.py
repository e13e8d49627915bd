"""Plans as documents: (design_id, blocks: array of (thread, runs: array of (connection, stitches: array of (x, y)))).

A row of stitches cannot say that a run, or a block, is empty; a document can, and the counts differ in what they make of it: trims that are
marked, trims that are sewn, and trims of the sewing order are three figures, and colour changes are two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.model import MAX_STITCH, TRIM_ABOVE

from .plan import RUN


def of_rows(st: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents of stitches, and of runs (with their connection), of which some may have no stitches."""
    point = F.struct("x", "y")
    s = st.groupBy(*RUN).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda e: e["p"]).alias("stitches"))
    none = F.array().cast("array<struct<x:int,y:int>>")
    r = runs.select(*RUN, "thread", "connection").join(s, RUN, "left").withColumn("stitches", F.coalesce("stitches", none))
    run = F.struct("run_idx", F.struct("connection", "stitches").alias("run"))
    b = r.groupBy("design_id", "block_idx", "thread").agg(F.transform(F.array_sort(F.collect_list(run)), lambda e: e["run"]).alias("runs"))
    block = F.struct("block_idx", F.struct("thread", "runs").alias("block"))
    return b.groupBy("design_id").agg(F.transform(F.array_sort(F.collect_list(block)), lambda e: e["block"]).alias("blocks"))


def rows(plans: DataFrame) -> DataFrame:
    """A row for each stitch, with run_idx and connection but no seq for an empty run, and neither for an empty block."""
    b = plans.select("design_id", F.posexplode("blocks").alias("block_idx", "b")).select("design_id", "block_idx", "b.thread", F.posexplode_outer("b.runs").alias("run_idx", "r"))
    r = b.select("design_id", "block_idx", "thread", "run_idx", "r.connection", F.posexplode_outer("r.stitches").alias("seq", "p"))
    return r.select("design_id", *(F.col(c).cast("long").alias(c) for c in ("block_idx", "run_idx", "seq")), "thread", "connection", "p.x", "p.y")


def _sewn(blocks: Column) -> Column:
    """Runs with stitches, in order: block, run (their own numbers), connection, first and last stitch, and how many there are."""
    run = lambda r, b, i: F.struct(b.alias("block"), i.alias("run"), r["connection"].alias("connection"), F.size(r["stitches"]).alias("n"), F.try_element_at(r["stitches"], F.lit(1)).alias("a"), F.try_element_at(r["stitches"], F.lit(-1)).alias("z"))
    every = F.flatten(F.transform(blocks, lambda b, k: F.transform(b["runs"], lambda r, i: run(r, k, i))))
    return F.filter(every, lambda r: r["n"] > 0)


def _after(sewn: Column) -> Column:
    """Pairs of a run and the one sewn before it."""
    n = F.size(sewn)
    return F.zip_with(F.slice(sewn, 2, F.greatest(n - 1, F.lit(0))), F.slice(sewn, 1, F.greatest(n - 1, F.lit(0))), lambda r, p: F.struct(r.alias("r"), p.alias("p"), X.squared(r["a"]["x"] - p["z"]["x"], r["a"]["y"] - p["z"]["y"]).alias("d2")))


def _number(array: Column) -> Column:
    return F.size(array).cast("long")


def counts(plans: DataFrame) -> DataFrame:
    """Of each plan: stitches; trims_marked (of runs after a block's first one, empty ones too), trims_sewn (of runs with stitches after the first
    of the plan, none that is a block's number 0), trims_in_order (a block's first sewn run counts unless the block is number 0); jumps;
    travels and travel_total (thousandths); color_changes (blocks less one) and colors_sewn_changes (blocks with stitches less one); palette
    (blocks, empty ones too: what a file's list of colours has)."""
    p = plans.select("design_id", "blocks", _sewn(F.col("blocks")).alias("sewn")).withColumn("steps", _after(F.col("sewn")))
    marked = F.aggregate("blocks", F.lit(0), lambda s, b: s + F.size(F.filter(b["runs"], lambda r, i: (i > 0) & (r["connection"] == "trim"))))
    trims = lambda kind: F.filter("steps", lambda s: (s["r"]["run"] > 0) & (s["r"]["connection"] == kind))
    travels = F.filter("steps", lambda s: F.when(s["r"]["run"] == 0, s["d2"] > 0).otherwise(s["r"]["connection"].isin("trim", "jump")))
    begins = lambda s: (s["r"]["run"] == 0) | (s["r"]["block"] != s["p"]["block"])
    # the first entry of a plan begins its block
    first = F.when((F.size("sewn") > 0) & (F.try_element_at("sewn", F.lit(1))["block"] > 0), 1).otherwise(0)
    in_order = _number(F.filter("steps", lambda s: F.when(begins(s), s["r"]["block"] > 0).otherwise(s["r"]["connection"] == "trim"))) + first
    less_one = lambda n: F.greatest(n - 1, F.lit(0)).cast("long")
    return p.select(
        "design_id", F.aggregate("sewn", F.lit(0).cast("long"), lambda s, r: s + r["n"]).alias("stitches"), marked.cast("long").alias("trims_marked"), _number(trims("trim")).alias("trims_sewn"), in_order.cast("long").alias("trims_in_order"),
        _number(trims("jump")).alias("jumps"), _number(travels).alias("travels"), F.aggregate(travels, F.lit(0).cast("long"), lambda t, s: t + X.milli(F.sqrt(s["d2"].cast("double")))).alias("travel_total"),
        less_one(F.size("blocks")).alias("color_changes"), less_one(F.size(F.array_distinct(F.transform("sewn", lambda r: r["block"])))).alias("colors_sewn_changes"), _number(F.col("blocks")).alias("palette"),
    )


def gaps(plans: DataFrame) -> DataFrame:
    """Of each plan, gaps that are too long for how a run is joined: only to the run next before it in the block, so none where that one is empty."""
    run = lambda r: F.struct(r["connection"].alias("connection"), F.try_element_at(r["stitches"], F.lit(1)).alias("a"), F.try_element_at(r["stitches"], F.lit(-1)).alias("z"))
    ends = F.transform("blocks", lambda b: F.transform(b["runs"], run))
    pairs = F.flatten(F.transform(ends, lambda rs: F.zip_with(F.slice(rs, 2, F.greatest(F.size(rs) - 1, F.lit(0))), F.slice(rs, 1, F.greatest(F.size(rs) - 1, F.lit(0))), lambda r, p: F.struct(r["connection"].alias("connection"), X.squared(r["a"]["x"] - p["z"]["x"], r["a"]["y"] - p["z"]["y"]).alias("d2")))))
    p = plans.select("design_id", F.filter(pairs, lambda g: g["d2"].isNotNull()).alias("gaps"))
    over = lambda kind, most: _number(F.filter("gaps", lambda g: (g["connection"] == kind) & (g["d2"] > most * most)))
    return p.select("design_id", over("continuous", MAX_STITCH).alias("continuous_too_far"), over("jump", TRIM_ABOVE).alias("long_jumps"))
