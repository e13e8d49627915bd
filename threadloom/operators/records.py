"""Records around a plan: counts of elements and layers, compile statistics, restored and moved objects, undo logs, names and ids, settings
with defaults, and recommendations read from a model's answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.model import STITCHES_PER_MINUTE

from .plan import RUN, runs

# Elements of a compiled plan: stitches with a column that names the element


def element_ranges(st: DataFrame, key: str = "object_id") -> DataFrame:
    """Of each element: how many stitches, and from which flat position to before which one it is sewn."""
    r = st.groupBy(*RUN, key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("design_id").orderBy("block_idx", "run_idx").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_to", F.sum("n").over(w)).withColumn("_from", F.col("_to") - F.col("n"))
    return r.groupBy("design_id", key).agg(F.sum("n").alias("n"), F.min("_from").alias("from_pos"), F.max("_to").alias("to_pos"))


def layer_counts(st: DataFrame, layer: str = "layer") -> DataFrame:
    return st.groupBy("design_id", layer).agg(F.count(F.lit(1)).alias("stitches"))


def compile_stats(st: DataFrame) -> DataFrame:
    """Distinct threads, colour changes, trims, jumps, size, minutes and the longest jump, in tenths of a minute and of a millimetre."""
    r = runs(st)
    inner = F.col("run_idx") > 0
    g = r.groupBy("design_id").agg(
        F.sum("n").alias("stitches"), F.count_distinct("thread").alias("colors"), F.greatest(F.lit(0), F.count_distinct("block_idx") - 1).cast("long").alias("color_changes"),
        F.count_if(inner & (F.col("connection") == "trim")).alias("trims"), F.count_if(inner & (F.col("connection") == "jump")).alias("jumps"),
        F.coalesce(F.max(F.when(inner & (F.col("connection") != "continuous"), F.col("d2"))), F.lit(0)).alias("_d2"),
    )
    b = st.groupBy("design_id").agg((F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))
    tenths = X.round_half_up(F.col("stitches") / float(STITCHES_PER_MINUTE) * 10).alias("minutes_tenths")
    return g.join(b, "design_id").select("design_id", "stitches", "colors", "color_changes", "trims", "jumps", "width", "height", tenths, X.round_half_up(F.sqrt(F.col("_d2").cast("double"))).alias("longest_jump"))


# Objects: (design_id, object_id, ...), regions (design_id, region_idx, ...)


def restored(regions: DataFrame, saved: DataFrame) -> DataFrame:
    """Object ids for reopened regions: the saved ones by position where a design has as many of them as regions (numbers after the largest
    where a saved id is missing), else numbers from 0.  saved: design_id, pos, object_id."""
    n = lambda df, name: df.groupBy("design_id").agg(F.count(F.lit(1)).alias(name))
    top = saved.groupBy("design_id").agg(F.max("object_id").alias("_top"))
    sizes = n(regions, "_r").join(n(saved, "_s"), "design_id", "left").join(top, "design_id", "left").select("design_id", F.coalesce(F.col("_r") == F.col("_s"), F.lit(False)).alias("_same"), F.coalesce("_top", F.lit(-1)).alias("_top"))
    j = regions.join(sizes, "design_id").join(saved.withColumnRenamed("pos", "region_idx"), ["design_id", "region_idx"], "left")
    known = F.when(F.col("_same"), F.col("object_id"))
    j = j.withColumn("_known", known)
    new = F.row_number().over(Window.partitionBy("design_id", F.col("_known").isNull()).orderBy("region_idx"))
    return j.withColumn("object_id", F.coalesce("_known", F.when(F.col("_same"), F.col("_top") + new).otherwise(new - 1))).drop("_known", "_same", "_top")


def appended(*parts: DataFrame) -> DataFrame:
    """Regions of several tables one after the other, numbered anew within their designs: fills before strokes, originals before copies,
    restored ones last."""
    every = reduce(DataFrame.unionByName, (p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)))
    w = Window.partitionBy("design_id").orderBy("_part", "region_idx")
    return every.withColumn("region_idx", (F.row_number().over(w) - 1).cast("int")).drop("_part")


def moved_in_color(order: DataFrame, moves: DataFrame) -> DataFrame:
    """Objects in sewing order (design_id, block_idx, place, object_id), one of a design moved up or down by one in its colour (moves:
    design_id, object_id, way): it changes places with its neighbour, unless it is the colour's first or last."""
    w = Window.partitionBy("design_id", "block_idx")
    o = order.join(moves.select("design_id", "object_id", "way"), ["design_id", "object_id"], "left")
    o = o.withColumns({"_at": F.max(F.when(F.col("way").isNotNull(), F.col("place"))).over(w), "_way": F.max("way").over(w), "_last": F.max("place").over(w)})
    to = F.col("_at") + F.col("_way")
    ok = F.col("_at").isNotNull() & to.between(F.lit(0), F.col("_last"))
    place = F.when(ok & (F.col("place") == F.col("_at")), to).when(ok & (F.col("place") == to), F.col("_at")).otherwise(F.col("place"))
    return o.select("design_id", "block_idx", place.alias("place"), "object_id")


HISTORY = 30


def undo_states(log: DataFrame, most: int = HISTORY) -> DataFrame:
    """What each design shows after its log (design_id, seq, action: record, undo or redo, state): a record ends what could be redone, a
    state equal to the one shown is no record, and `most` states can be gone back to.  A log is one user's, and folded in order."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        past, future, now = [], [], None
        for action, state in pdf.sort_values("seq")[["action", "state"]].itertuples(index=False):
            if action == "record":
                if state == now:
                    continue
                past = [*past, now][-most:] if now is not None else past
                future, now = [], state
            elif action == "undo" and past:
                future.append(now)
                now = past.pop()
            elif action == "redo" and future:
                past.append(now)
                now = future.pop()
        return pd.DataFrame({"design_id": [pdf["design_id"].iloc[0]], "state": [now], "can_undo": [len(past)], "can_redo": [len(future)]})

    return log.groupBy("design_id").applyInPandas(one, "design_id bigint, state string, can_undo bigint, can_redo bigint")


# Names, ids, settings


def design_name(text) -> Column:
    """Letters, digits, _ and - of a name, eight at most; SKETCH where none is left."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(X.col(text), "[^A-Za-z0-9_-]", ""), 1, 8), F.lit("")), F.lit("SKETCH"))


def base_name(file_name, name=None) -> Column:
    """The first eight signs of a file's name without its ending, else of the name, else of `design`, in capitals."""
    base = F.nullif(F.regexp_replace(X.col(file_name), r"\.[^.]+$", ""), F.lit(""))
    return F.upper(F.substring(F.coalesce(base, F.nullif(X.col(name), F.lit("")) if name is not None else F.lit(None), F.lit("design")), 1, 8))


def short_id(millis, salt, prefix: str = "TL") -> Column:
    """An id from a time (milliseconds, given, so that a query stays the same) and a number below 65536, both to base 36."""
    return F.upper(F.concat_ws("-", F.lit(prefix), F.conv(X.col(millis).cast("string"), 10, 36), F.conv(X.col(salt).cast("string"), 10, 36)))


def one_of(value, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(X.col(value).isin(*allowed), X.col(value)).otherwise(F.lit(default))


def whole_within(value, low: int, high: int, default: int) -> Column:
    """A number rounded, halves up, and kept within bounds; the default where there is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), X.round_half_up(F.coalesce(X.col(value).cast("double"), F.lit(float(default)))))).cast("int")


KINDS = ("photo", "illustration", "anime", "logo", "line_art")
ANSWER = (
    "struct<image_type:string,color_reduction_plan:struct<target_color_count:double>,vectorization_plan:struct<smoothing_level:string,keep_holes:boolean>,"
    "stitch_plan:array<struct<region_name:string,stitch_type:string,density:string,direction:string>>,thread_trim_plan:struct<minimize_trims:boolean,max_jump_before_trim_mm:double>,"
    "transparent_or_empty_regions:array<struct<reason:string>>>"
)
#: Row spacing for densities, and the ones to choose from. Fixed values.
SCALE, SCALES = {"low": 1.5, "medium": 1.0, "high": 0.9}, (1.0, 0.9, 1.25, 1.5)


def analysis(text) -> Column:
    """A model's answer, from JSON, with every field of a kind and within bounds; null where it is no answer of a known image type."""
    a = F.from_json(X.col(text), ANSWER)
    within = lambda v, lo, hi, d: F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(v, F.lit(d))))
    plan = F.transform(F.coalesce(a["stitch_plan"], F.array().cast("array<struct<region_name:string,stitch_type:string,density:string,direction:string>>")), lambda s: F.struct(
        F.coalesce(s["region_name"], F.lit("")).alias("region_name"), one_of(s["stitch_type"], ("satin", "tatami", "running"), "tatami").alias("stitch_type"), one_of(s["density"], ("low", "medium", "high"), "medium").alias("density"), F.coalesce(s["direction"], F.lit("along_path")).alias("direction")))
    out = F.struct(
        a["image_type"].alias("image_type"), whole_within(a["color_reduction_plan"]["target_color_count"], 2, 12, 6).alias("colors"),
        one_of(a["vectorization_plan"]["smoothing_level"], ("low", "medium", "high"), "medium").alias("smoothing"), F.coalesce(a["vectorization_plan"]["keep_holes"], F.lit(True)).alias("keep_holes"),
        F.coalesce(a["thread_trim_plan"]["minimize_trims"], F.lit(True)).alias("minimize_trims"), within(a["thread_trim_plan"]["max_jump_before_trim_mm"], 1.0, 30.0, 8.0).alias("max_jump_mm"),
        plan.alias("stitch_plan"), (F.size(F.coalesce(a["transparent_or_empty_regions"], F.array().cast("array<struct<reason:string>>"))) > 0).alias("remove_white"),
    )
    return F.when(a["image_type"].isin(*KINDS), out)


def recommended(a) -> Column:
    """Settings from an analysis: the density nearest to the mean of its parts, the fill that more than twice as many parts have."""
    plan = X.col(a)["stitch_plan"]
    scale = F.create_map(*(F.lit(x) for pair in SCALE.items() for x in pair))
    mean = F.when(F.size(plan) > 0, F.aggregate(plan, F.lit(0.0), lambda t, s: t + F.element_at(scale, s["density"])) / F.size(plan)).otherwise(F.lit(1.0))
    best = reduce(lambda b, v: F.when(F.abs(F.lit(v) - mean) < F.abs(b - mean), F.lit(v)).otherwise(b), SCALES[1:], F.lit(SCALES[0]))
    many = lambda kind: F.size(F.filter(plan, lambda s: s["stitch_type"] == kind))
    fill = F.when(many("satin") > many("tatami") * 2, "satin").when(many("tatami") > many("satin") * 2, "tatami").otherwise("auto")
    return F.struct(X.col(a)["colors"].alias("color_count"), fill.alias("fill_type"), best.alias("density"), F.when(fill == "satin", "").otherwise("edge").alias("underlay"), X.col(a)["remove_white"].alias("remove_white"))


def with_fallback(answers: DataFrame, local: DataFrame) -> DataFrame:
    """Recommendations of a model's answers (design_id, answer, JSON or null where there was none), and the local ones (columns color_count,
    fill_type, underlay, density_scale, remove_white) for designs without a valid answer.  The call itself is not made here."""
    a = local.join(answers.select("design_id", analysis("answer").alias("_a")), "design_id", "left").withColumn("_r", recommended("_a"))
    there = F.col("_a").isNotNull()
    pick = lambda name, own: F.when(there, F.col(f"_r.{name}")).otherwise(F.col(own)).alias(own)
    return a.select("design_id", there.alias("answered"), pick("color_count", "color_count"), pick("fill_type", "fill_type"), pick("underlay", "underlay"), pick("density", "density_scale"), pick("remove_white", "remove_white"))


def merged_settings(given, defaults: dict[str, str]) -> Column:
    """A map of settings, those given (a map, or null) before the defaults, and given ones that have no default kept."""
    base = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    return F.map_zip_with(base, F.coalesce(X.col(given), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, a, b: F.coalesce(b, a))
