"""Counts, lengths, travel and order of stitch plans.

Input: stitches (design_id, thread, block_idx, run_idx, seq, x, y), in the order of (block_idx, run_idx, seq); every window
lies within one design, so a plan is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.model import STITCHES_PER_MINUTE

RUN = ["design_id", "block_idx", "run_idx"]


def steps(st: DataFrame) -> DataFrame:
    """Each stitch with the one before it in its run: dx, dy (null at the start)."""
    w = Window.partitionBy(*RUN).orderBy("seq")
    return st.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)})


def thread_length(st: DataFrame) -> DataFrame:
    """Thousandths of units of stitched length of each block; moves between runs don't count, blocks without a step have 0."""
    length = X.milli(X.distance("dx", "dy"))
    return steps(st).groupBy("design_id", "block_idx", "thread").agg(F.coalesce(F.sum(length), F.lit(0)).alias("length_milli"))


def runs(st: DataFrame, mode: str = "auto") -> DataFrame:
    """A row for each run that has stitches: n, ends, the squared gap from the run before, its connection."""
    first, last = F.struct("x", "y"), F.struct("x", "y")
    r = st.groupBy(*RUN, "thread").agg(F.count(F.lit(1)).alias("n"), F.min_by(first, "seq").alias("a"), F.max_by(last, "seq").alias("z"))
    r = r.select(*RUN, "thread", "n", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("z.x").alias("x1"), F.col("z.y").alias("y1"))
    w = Window.partitionBy("design_id").orderBy("block_idx", "run_idx")
    r = r.withColumns({"px": F.lag("x1").over(w), "py": F.lag("y1").over(w), "pblock": F.lag("block_idx").over(w), "order_no": (F.row_number().over(w) - 1).cast("long")})
    r = r.withColumn("d2", X.squared(F.col("x0") - F.col("px"), F.col("y0") - F.col("py")))
    return r.withColumn("connection", X.connection("d2", F.col("px").isNull(), mode=mode))


def counts(st: DataFrame) -> DataFrame:
    """Stitches; trims (runs after a block's first that are joined by one); colour changes (blocks less one)."""
    r = runs(st)
    return r.groupBy("design_id").agg(
        F.sum("n").alias("stitches"), F.count_if((F.col("run_idx") > 0) & (F.col("connection") == "trim")).alias("trims"),
        F.greatest(F.lit(0), F.count_distinct("block_idx") - 1).cast("long").alias("color_changes"),
    )


def bounds(st: DataFrame) -> DataFrame:
    b = st.groupBy("design_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return b.withColumns({"width": F.col("max_x") - F.col("min_x"), "height": F.col("max_y") - F.col("min_y")})


def _travels(r: DataFrame) -> DataFrame:
    """Marks runs that a travel leads to: a block's first if it lies elsewhere, others if they are trimmed or jumped to."""
    after = F.col("px").isNotNull()
    first = F.col("run_idx") == 0
    return r.withColumns({
        "is_trim": after & ~first & (F.col("connection") == "trim"), "is_jump": after & ~first & (F.col("connection") == "jump"),
        "is_travel": after & F.when(first, F.col("d2") > 0).otherwise(F.col("connection") != "continuous"), "travel": X.milli(F.sqrt(F.col("d2").cast("double"))),
    })


def per_color(st: DataFrame) -> DataFrame:
    r = _travels(runs(st)).groupBy("design_id", "block_idx", "thread").agg(F.sum("n").alias("stitches"), F.count_if("is_trim").alias("trims"), F.count(F.lit(1)).alias("runs"))
    return r.join(thread_length(st), ["design_id", "block_idx", "thread"])


def stats(st: DataFrame) -> DataFrame:
    """One row for each design; lengths in thousandths of units, fractions in thousandths."""
    r = _travels(runs(st)).groupBy("design_id").agg(
        F.sum("n").alias("stitches"), F.count_distinct("block_idx").alias("colors"), F.count_if("is_trim").alias("trims"), F.count_if("is_jump").alias("jumps"), F.count_if("is_travel").alias("travels"),
        F.coalesce(F.sum(F.when(F.col("is_travel"), F.col("travel"))), F.lit(0)).alias("travel_total"), F.coalesce(F.max(F.when(F.col("is_travel"), F.col("travel"))), F.lit(0)).alias("travel_max"),
    )
    length = X.milli(X.distance("dx", "dy"))
    s = steps(st).groupBy("design_id").agg(
        F.coalesce(F.sum(length), F.lit(0)).alias("length_total"), F.coalesce(F.min(length), F.lit(0)).alias("step_min"), F.coalesce(F.max(length), F.lit(0)).alias("step_max"), F.count("dx").alias("step_count"),
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"),
    )
    j = r.join(s, "design_id").withColumns({"width": F.col("_x1") - F.col("_x0"), "height": F.col("_y1") - F.col("_y0")})
    box = F.col("width").cast("double") * F.col("height")
    ratio = lambda a, b: F.when(F.col(b) > 0, X.round_half_up(F.col(a).cast("double") / F.col(b)).cast("long")).otherwise(F.lit(0))
    return j.select(
        "design_id", "stitches", "colors", F.greatest(F.lit(0), F.col("colors") - 1).cast("long").alias("color_changes"), "trims", "jumps", "travels", "travel_total", "travel_max", ratio("travel_total", "travels").alias("travel_avg"),
        X.milli(F.col("stitches") / F.lit(float(STITCHES_PER_MINUTE))).alias("minutes"), "width", "height", "length_total", "step_min", "step_max", ratio("length_total", "step_count").alias("step_avg"),
        F.when(box > 0, X.milli(F.col("stitches") * 10000.0 / box)).otherwise(F.lit(0)).alias("density"),
    )


def sequence(st: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row for each run in sewing order; known: runs, if there are any already."""
    r = runs(st) if known is None else known
    start = F.col("pblock").isNull() | (F.col("pblock") != F.col("block_idx")) | (F.col("run_idx") == 0)
    r = r.withColumn("_start", start)
    return r.select(
        "design_id", "order_no", "block_idx", "run_idx", "thread", "n", "connection", F.coalesce("d2", F.lit(0)).alias("travel2"), "x0", "y0", "x1", "y1",
        (F.col("_start") & (F.col("block_idx") > 0)).alias("color_change"), F.when(F.col("_start"), F.col("block_idx") > 0).otherwise(F.col("connection") == "trim").alias("trim"),
    )


def sequence_trims(st: DataFrame) -> DataFrame:
    """Entries with a trim, and whether each begins a block among those shown."""
    s = sequence(st).where("trim")
    w = Window.partitionBy("design_id").orderBy("order_no")
    return s.select("design_id", "order_no", "block_idx", "run_idx", F.coalesce(F.lag("block_idx").over(w) != F.col("block_idx"), F.lit(True)).alias("heads_block"))


def object_positions(seq: DataFrame) -> DataFrame:
    """Of each object in its block: first and last entry, number of entries, and its place by first appearance."""
    o = seq.groupBy("design_id", "block_idx", "object_id").agg(F.min("order_no").alias("first_no"), F.max("order_no").alias("last_no"), F.count(F.lit(1)).alias("entries"))
    w = Window.partitionBy("design_id", "block_idx")
    return o.withColumns({"place": (F.row_number().over(w.orderBy("first_no")) - 1).cast("long"), "objects": F.count(F.lit(1)).over(w)})


def flat_moves(st: DataFrame) -> DataFrame:
    """Stitches in order with how each is reached: 0 sewn, 1 after a jump, 2 after a trim or at the start, 3 after a colour change."""
    r = runs(st).select(*RUN, "connection")
    s = st.join(r, RUN)
    first = F.col("seq") == 0
    move = F.when(first & (F.col("run_idx") == 0), F.when(F.col("block_idx") == 0, 2).otherwise(3)).when(first & (F.col("connection") == "trim"), 2).when(first & (F.col("connection") == "jump"), 1).otherwise(0)
    return s.select(*RUN, "seq", "x", "y", move.alias("move"))


def long_splits(st: DataFrame) -> DataFrame:
    """Steps within runs over the longest stitch, as the points that they are split at."""
    w = Window.partitionBy(*RUN).orderBy("seq")
    s = st.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where(F.greatest(F.abs(F.col("x") - F.col("px")), F.abs(F.col("y") - F.col("py"))) > 121)
    return s.select(*RUN, "seq", F.posexplode(X.split_move("px", "py", "x", "y")).alias("part", "p")).select(*RUN, "seq", F.col("part").cast("long").alias("part"), "p.x", "p.y")


def reorder_blocks(st: DataFrame, source: int, target: int) -> DataFrame:
    """Moves one block of each design to another place."""
    b = F.col("block_idx")
    if source < target:
        new = F.when(b == source, target).when((b > source) & (b <= target), b - 1)
    else:
        new = F.when(b == source, target).when((b >= target) & (b < source), b + 1)
    return st.withColumn("block_idx", new.otherwise(b).cast("long"))


def dedup_points(st: DataFrame) -> DataFrame:
    """Without points that repeat the one before them in their run."""
    w = Window.partitionBy(*RUN).orderBy("seq")
    return st.withColumns({"_px": F.lag("x").over(w), "_py": F.lag("y").over(w)}).where("_px is null or _px <> x or _py <> y").drop("_px", "_py")


def turn_labels(st: DataFrame, unit_mm: float = 0.1) -> DataFrame:
    """R where the stitches next to a point lie within 0.25 mm of each other, Z where the direction turns back, S elsewhere."""
    w = Window.partitionBy(*RUN).orderBy("seq")
    s = st.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    near = X.squared(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) < (0.25 / unit_mm) ** 2
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    dot, n = (ax * bx + ay * by).cast("long"), X.squared(ax, ay) * X.squared(bx, by)
    # dot / (|a| |b|) < -1/2, in whole numbers
    back = (n > 0) & (dot < 0) & (4 * dot * dot > n)
    return s.select(*RUN, "seq", F.when(F.col("px").isNull() | F.col("nx").isNull(), "S").when(near, "R").when(back, "Z").otherwise("S").alias("label"))


def moving_average(st: DataFrame, k: int = 2) -> DataFrame:
    """Points averaged over k neighbours on both sides, fewer at the ends; in thousandths."""
    w = Window.partitionBy(*RUN).orderBy("seq").rowsBetween(-k, k)
    mean = lambda c: X.milli(F.sum(c).over(w).cast("double") / F.count(F.lit(1)).over(w))
    return st.select(*RUN, "seq", mean("x").alias("mx"), mean("y").alias("my"))


def principal_angles(st: DataFrame) -> DataFrame:
    """Direction of largest variance of each design's points, in thousandths of a radian; sums stay whole until the last step."""
    n, sx, sy, sxx, syy, sxy = (F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    s = st.groupBy("design_id").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    a = n * sxy - sx * sy
    b = (n * sxx - sx * sx) - (n * syy - sy * sy)
    return s.select("design_id", X.milli(F.lit(0.5) * F.atan2(F.lit(2.0) * a, b)).alias("angle_milli"))
