"""Windows over an order that no one task holds: a design of any length is cut into stretches, each of which is gone through by itself, and
what a stretch has to know of those before it (sums, the last row, the last value that is not null) comes from a table of the stretches.

Rows are dealt by range of key and order, so a stretch is a bounded share of the table whatever the keys are like, and a key goes on from one to
the next.  At most one key goes over each cut, so what is carried is a row or two for each stretch, which bounds the broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.tables import stored

from . import machine
from .plan import RUN

ORDER = ["block_idx", "run_idx", "seq"]


def dealt(df: DataFrame, keys: list[str], order: list[str], stretches: int | None = None) -> DataFrame:
    """The rows with _part, the number of their stretch, written in order."""
    n = stretches or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys, *order).select("*", F.spark_partition_id().alias("_part")))


def scanned(df: DataFrame, keys: list[str], order: list[str], sums: dict | None = None, before: dict | None = None, after: dict | None = None, latest: dict | None = None) -> DataFrame:
    """A dealt table with more columns, by key and order: sums, of a column over all rows up to this one; before and after, its value in
    the row before and the row after; latest, its last value that is not null in the rows before."""
    sums, before, after, latest = ({k: X.col(c) for k, c in (given or {}).items()} for given in (sums, before, after, latest))
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    place, upto, earlier = F.struct(*order), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    row = lambda cs: F.struct(*(c.alias(k) for k, c in cs.items()), F.lit(0).alias("_"))
    ends = df.groupBy(*keys, "_part").agg(
        F.max_by(row(before), place).alias("_last"), F.min_by(row(after), place).alias("_first"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{k}") for k, c in sums.items()),
        *(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_latest_{k}") for k, c in latest.items()),
    )
    v = Window.partitionBy(*keys).orderBy("_part")
    past = v.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), F.lag("_last").over(v).alias("_last"), F.lead("_first").over(v).alias("_next"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
        *(F.sum(f"_sum_{k}").over(past).alias(f"_sum_{k}") for k in sums), *(F.last(f"_latest_{k}", ignorenulls=True).over(past).alias(f"_latest_{k}") for k in latest),
    ).where("_n > 1")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = df.select(
        "*", F.row_number().over(w).alias("_i"), F.lead(F.lit(1)).over(w).isNull().alias("_end"), *(F.lag(c).over(w).alias(f"_before_{k}") for k, c in before.items()), *(F.lead(c).over(w).alias(f"_after_{k}") for k, c in after.items()),
        *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_in_{k}") for k, c in sums.items()), *(F.last(c, ignorenulls=True).over(earlier).alias(f"_by_{k}") for k, c in latest.items()),
    )
    # no more rows than stretches, and as many again
    j = inside.join(F.broadcast(carried), same, "left")
    return j.select(
        *df.columns, *((F.col(f"_in_{k}") + F.coalesce(f"_sum_{k}", F.lit(0))).alias(k) for k in sums), *(F.when(F.col("_i") == 1, F.col(f"_last.{k}")).otherwise(F.col(f"_before_{k}")).alias(k) for k in before),
        *(F.when(F.col("_end"), F.col(f"_next.{k}")).otherwise(F.col(f"_after_{k}")).alias(k) for k in after), *(F.coalesce(f"_by_{k}", f"_latest_{k}").alias(k) for k in latest),
    )


def dst_points(moves: DataFrame) -> DataFrame:
    """Where the stitches of a move stream land (machine.dst_points), however long a stream is."""
    p = scanned(dealt(moves, ["design_id"], ["rec"]), ["design_id"], ["rec"], sums={"x": "dx", "down": "dy"})
    return p.where("kind = 'stitch'").select("design_id", "rec", "x", (-F.col("down")).alias("y"))


def runs(st: DataFrame, mode: str = "auto") -> DataFrame:
    """plan.runs: ends of runs come from partial aggregates, and each run knows the one before it."""
    point = F.struct("x", "y")
    r = st.groupBy(*RUN, "thread").agg(F.count(F.lit(1)).alias("n"), F.min_by(point, "seq").alias("a"), F.max_by(point, "seq").alias("z"))
    r = r.select(*RUN, "thread", "n", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("z.x").alias("x1"), F.col("z.y").alias("y1"))
    by = ["block_idx", "run_idx"]
    r = scanned(dealt(r, ["design_id"], by), ["design_id"], by, sums={"_no": F.lit(1)}, before={"px": "x1", "py": "y1", "pblock": "block_idx"}).drop("_part")
    r = r.withColumn("order_no", (F.col("_no") - 1).cast("long")).drop("_no").withColumn("d2", X.squared(F.col("x0") - F.col("px"), F.col("y0") - F.col("py")))
    return r.withColumn("connection", X.connection("d2", F.col("px").isNull(), mode=mode))


def flat_moves(st: DataFrame) -> DataFrame:
    """plan.flat_moves: only the first stitches of runs meet their run."""
    r = runs(st).select(*RUN, "connection")
    heads, rest = st.where("seq = 0").join(r, RUN), st.where("seq <> 0")
    move = F.when(F.col("run_idx") == 0, F.when(F.col("block_idx") == 0, 2).otherwise(3)).when(F.col("connection") == "trim", 2).when(F.col("connection") == "jump", 1).otherwise(0)
    return heads.select(*RUN, "seq", "x", "y", move.alias("move")).unionByName(rest.select(*RUN, "seq", "x", "y", F.lit(0).alias("move")))


def _known(st: DataFrame) -> DataFrame:
    """What machine.operations has to know of each stitch: of its run and of the run before only where a run begins or the design ends."""
    key = ["design_id"]
    s = dealt(st.select("design_id", *ORDER, "x", "y"), key, ORDER)
    s = scanned(s, key, ORDER, before={"qx": "x", "qy": "y", "qblock": "block_idx", "qrun": "run_idx"}, after={"following": "seq"})
    same = (F.col("qblock") == F.col("block_idx")) & (F.col("qrun") == F.col("run_idx"))
    s = s.withColumns({"px": F.when(same, F.col("qx")), "py": F.when(same, F.col("qy")), "is_last": F.col("following").isNull()})
    s = stored(s.drop("qrun", "following"))
    moved = F.col("px").isNotNull() & ((F.col("px") != F.col("x")) | (F.col("py") != F.col("y")))
    # a run's first point off its start is the first that moves
    r = s.groupBy(*RUN).agg(
        F.min(F.when(moved, F.struct("seq", "x", "y"))).alias("towards"), F.max(F.when(moved, F.struct("seq", F.col("px").alias("x"), F.col("py").alias("y")))).alias("back"), F.min_by(F.struct("qx", "qy"), "seq").alias("e")
    )
    r = r.select(*RUN, "towards", F.coalesce("back.x", "e.qx").alias("bx"), F.coalesce("back.y", "e.qy").alias("by"))
    by = ["block_idx", "run_idx"]
    r = scanned(dealt(r, key, by), key, by, before={"pbx": "bx", "pby": "by"}).drop("_part")
    edge = F.col("px").isNull() | F.col("is_last")
    own = r.schema
    plain = s.where(~edge).select("*", *(F.lit(None).cast(own[c].dataType).alias(c) for c in ("towards", "bx", "by", "pbx", "pby")))
    return s.where(edge).join(r, RUN).select(*plain.columns).unionByName(plain)


def operations(st: DataFrame, locks: bool = True) -> DataFrame:
    """machine.operations, for designs of any length: (design_id, op_seq, kind, x, y)."""
    each = stored(machine.with_operations(_known(st), locks).select("design_id", *ORDER, "_part", "ops"))
    each = scanned(each, ["design_id"], ORDER, sums={"upto": F.size("ops")})
    each = each.select("design_id", (F.col("upto") - F.size("ops")).alias("base"), F.posexplode("ops").alias("k", "op"))
    return each.select("design_id", (F.col("base") + F.col("k")).cast("long").alias("op_seq"), "op.*")
