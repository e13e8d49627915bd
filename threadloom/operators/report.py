"""Work orders: threads used, in PEC colours, with the fabric's recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import dims
from threadloom.functions import exprs as X

from .color import nearest_thread
from .plan import bounds, counts, thread_length


def fabric_or_standard(df: DataFrame, key: str) -> DataFrame:
    """The recipe of a key, the standard one where there is none; twelve rows, so a broadcast."""
    recipes = dims.fabrics(df.sparkSession)
    std = next(f for f in dims.FABRICS if f[0] == "standard")
    j = df.join(F.broadcast(recipes), df[key] == recipes["id"], "left")
    return j.withColumns({"fabric": F.coalesce("id", F.lit(std[0])), "row_u": F.coalesce(X.mm_to_units("row_spacing_mm"), X.mm_to_units(F.lit(std[1]))), "needle": F.coalesce("needle", F.lit(std[11]))})


def thread_color(thread) -> tuple:
    """A colour for a thread's name, for tables that have names only."""
    h = F.crc32(X.col(thread))
    return tuple(F.shiftright(h, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in (2, 1, 0))


def usage(st: DataFrame) -> DataFrame:
    """Of each block in order: PEC colour, stitches, length in thousandths."""
    n = st.groupBy("design_id", "block_idx", "thread").agg(F.count(F.lit(1)).alias("stitches"))
    t = n.join(thread_length(st), ["design_id", "block_idx", "thread"])
    r, g, b = thread_color("thread")
    t = t.withColumns({"r": r, "g": g, "b": b})
    return t.withColumn("t", nearest_thread(t)).select("design_id", (F.col("block_idx") + 1).alias("sew_order"), "thread", "t.pec_index", "t.name", "stitches", "length_milli")


def work_order(st: DataFrame) -> DataFrame:
    """One row for each design: totals, size, and notes on limits."""
    from threadloom.model import MAX_STITCHES

    c, b = counts(st), bounds(st)
    length = thread_length(st).groupBy("design_id").agg(F.sum("length_milli").alias("thread_milli"), F.count(F.lit(1)).alias("colors"))
    j = c.join(b, "design_id").join(length, "design_id")
    notes = F.concat_ws(";", F.when(F.col("stitches") > MAX_STITCHES, "too many stitches"), F.when((F.col("width") > 1000) | (F.col("height") > 1000), "over the hoop"))
    return j.select("design_id", "stitches", "colors", "color_changes", "trims", "width", "height", X.milli(F.col("stitches") / 400.0).alias("minutes"), "thread_milli", notes.alias("notes"))
