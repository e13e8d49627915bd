"""Machine operations of stitch plans: jumps, trims, colour changes, splits and lock stitches; and what a player shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.model import LOCK_LENGTH, MIN_STITCH

from .plan import RUN

_OP = "struct<kind:string,x:int,y:int>"


def _op(kind: str, x=None, y=None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if x is None else X.col(x)).cast("int").alias("x"), (F.lit(None) if y is None else X.col(y)).cast("int").alias("y"))


def _none() -> Column:
    return F.array().cast(f"array<{_OP}>")


def _moves(kind: str, x0, y0, x1, y1) -> Column:
    return F.transform(X.split_move(x0, y0, x1, y1), lambda p: _op(kind, p["x"], p["y"]))


def _lock(x, y, tx, ty) -> Column:
    """Out towards a point by at most LOCK_LENGTH and back; nothing where that is under MIN_STITCH, or without a point."""
    x, y, tx, ty = (X.col(v) for v in (x, y, tx, ty))
    d = X.distance(tx - x, ty - y)
    n = F.least(F.lit(float(LOCK_LENGTH)), d)
    bx, by = F.floor(x + (tx - x) / F.nullif(d, F.lit(0.0)) * n + 0.5), F.floor(y + (ty - y) / F.nullif(d, F.lit(0.0)) * n + 0.5)
    return F.when(tx.isNotNull() & (n >= MIN_STITCH), F.array(_op("stitch", bx, by), _op("stitch", x, y))).otherwise(_none())


def operations(st: DataFrame, locks: bool = True) -> DataFrame:
    """(design_id, op_seq, kind, x, y). A run's first stitch brings the ops that lead to it, and a design's last one the end.  All that a
    stitch needs to know of its run and of the one before comes from windows within the design, so a plan is read and shuffled once."""
    run, whole = Window.partitionBy(*RUN).orderBy("seq"), Window.partitionBy(*RUN)
    d = Window.partitionBy("design_id").orderBy("block_idx", "run_idx", "seq")
    s = st.select("design_id", "block_idx", "run_idx", "seq", "x", "y").withColumns({
        "px": F.lag("x").over(run), "py": F.lag("y").over(run), "sx": F.first("x").over(run), "sy": F.first("y").over(run),
        # of the stitch before, whatever run it is in
        "qx": F.lag("x").over(d), "qy": F.lag("y").over(d), "qblock": F.lag("block_idx").over(d), "is_last": F.lead("seq").over(d).isNull(),
    })
    moved = F.col("px").isNotNull() & ((F.col("px") != F.col("x")) | (F.col("py") != F.col("y")))
    off_start = (F.col("x") != F.col("sx")) | (F.col("y") != F.col("sy"))
    s = s.withColumns({
        "towards": F.min(F.when(off_start, F.struct("seq", "x", "y"))).over(whole), "back": F.max(F.when(moved, F.struct("seq", F.col("px").alias("x"), F.col("py").alias("y")))).over(whole),
        "ex": F.first("qx").over(run), "ey": F.first("qy").over(run),
    })
    # where the thread came from before a run's end: the last move in it, else the end of the run before
    s = s.withColumns({"bx": F.coalesce("back.x", "ex"), "by": F.coalesce("back.y", "ey")})
    s = s.withColumns({"pbx": F.lag("bx").over(d), "pby": F.lag("by").over(d)})
    each = with_operations(s, locks).select("design_id", "block_idx", "run_idx", "seq", F.posexplode("ops").alias("k", "op"))
    number = F.row_number().over(Window.partitionBy("design_id").orderBy("block_idx", "run_idx", "seq", "k")) - 1
    return each.select("design_id", number.cast("long").alias("op_seq"), "op.*")


def with_operations(s: DataFrame, locks: bool = True) -> DataFrame:
    """Stitches that know what `operations` has to know of them, with ops, the array of theirs."""
    moved = F.col("px").isNotNull() & ((F.col("px") != F.col("x")) | (F.col("py") != F.col("y")))
    first, start, apart = F.col("px").isNull(), F.col("qx").isNull(), (F.col("x") != F.col("qx")) | (F.col("y") != F.col("qy"))
    how = X.connection(X.squared(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")), start)
    new_block = F.col("qblock").isNull() | (F.col("qblock") != F.col("block_idx"))
    cut = ~new_block & (how == "trim")
    lock = _lock if locks else (lambda *a: _none())
    off, jump = lock("qx", "qy", "pbx", "pby"), _moves("jump", "qx", "qy", "x", "y")
    lead = F.when(start, _moves("jump", F.lit(0), F.lit(0), "x", "y"))
    lead = lead.when(new_block, F.concat(off, F.array(_op("colorChange")), F.when(apart, jump).otherwise(_none())))
    lead = lead.when(~apart, _none()).when(how == "continuous", _moves("stitch", "qx", "qy", "x", "y")).when(cut, F.concat(off, F.array(_op("trim")), jump)).otherwise(jump)
    tie_in = F.when(start | new_block | cut, lock("x", "y", F.col("towards.x"), F.col("towards.y"))).otherwise(_none())
    own = F.when(first, F.concat(lead, F.array(_op("stitch", "x", "y")), tie_in)).when(moved, _moves("stitch", "px", "py", "x", "y")).otherwise(_none())
    tail = F.when(F.col("is_last"), F.concat(lock("x", "y", "bx", "by"), F.array(_op("end")))).otherwise(_none())
    return s.withColumn("ops", F.concat(own, tail))


def frames(ops: DataFrame) -> DataFrame:
    """A row for each stitch of an op stream: colour so far, number, and what came since the stitch before."""
    w = Window.partitionBy("design_id").orderBy("op_seq")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    is_stitch = F.col("kind") == "stitch"
    o = ops.withColumn("island", F.coalesce(F.count_if(is_stitch).over(upto), F.lit(0)))
    g = o.groupBy("design_id", "island").agg(
        F.max(F.when(is_stitch, F.col("op_seq"))).alias("op_seq"), F.max(F.when(is_stitch, F.col("x"))).alias("x"), F.max(F.when(is_stitch, F.col("y"))).alias("y"),
        F.count_if(F.col("kind") == "colorChange").alias("changes"), (F.count_if(F.col("kind") == "jump") > 0).alias("from_jump"), (F.count_if(F.col("kind") == "trim") > 0).alias("after_trim"),
    )
    v = Window.partitionBy("design_id").orderBy("island").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("color_index", F.sum("changes").over(v))
    return g.where("op_seq is not null").select("design_id", (F.col("island") + 1).alias("stitch_no"), "x", "y", "color_index", "from_jump", "after_trim", (F.col("changes") > 0).alias("color_changed"))


def dst_moves(ops: DataFrame) -> DataFrame:
    """Op streams as moves of at most 121 with y up: a trim is three small jumps that lead back, the end has none."""
    w = Window.partitionBy("design_id").orderBy("op_seq")
    placed = F.col("kind").isin("stitch", "jump")
    at = lambda c: F.coalesce(F.last(F.when(placed, F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    o = ops.withColumns({"px": at("x"), "py": at("y")})
    move = lambda dx, dy, kind: F.struct(F.lit(dx).cast("int").alias("dx") if isinstance(dx, int) else dx.alias("dx"), F.lit(dy).cast("int").alias("dy") if isinstance(dy, int) else dy.alias("dy"), X.col(kind).alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"))
    each = F.when(placed, F.array(move(F.col("x") - F.col("px"), F.col("py") - F.col("y"), F.col("kind"))))
    each = each.when(F.col("kind") == "trim", F.array(move(2, 2, "jump"), move(-4, -4, "jump"), move(2, 2, "jump"))).when(F.col("kind") == "colorChange", F.array(move(0, 0, "colorChange")))
    o = o.select("design_id", "op_seq", F.posexplode(each).alias("k", "m"))
    number = F.row_number().over(Window.partitionBy("design_id").orderBy("op_seq", "k")) - 1
    return o.select("design_id", number.cast("long").alias("rec"), "m.dx", "m.dy", "m.kind")


# Fixed values of the DST format: of each balanced ternary digit, the byte and the bits for +1 and -1.
DST_X = ((0, 0x01, 0x02), (1, 0x01, 0x02), (0, 0x04, 0x08), (1, 0x04, 0x08), (2, 0x04, 0x08))
DST_Y = ((0, 0x80, 0x40), (1, 0x80, 0x40), (0, 0x20, 0x10), (1, 0x20, 0x10), (2, 0x20, 0x10))
DST_KIND = {"stitch": 0x03, "jump": 0x83, "colorChange": 0xC3}


def dst_bytes(dx="dx", dy="dy", kind="kind") -> list[Column]:
    """The three bytes of a move: digit k of a value v is the balanced remainder of (v + 121) by powers of three."""
    out = [F.lit(0), F.lit(0), F.when(X.col(kind) == "jump", DST_KIND["jump"]).when(X.col(kind) == "colorChange", DST_KIND["colorChange"]).otherwise(DST_KIND["stitch"])]
    for value, bits in ((dx, DST_X), (dy, DST_Y)):
        for k, (byte, plus, minus) in enumerate(bits):
            digit = F.floor((X.col(value) + 121) / 3**k) % 3 - 1
            out[byte] = out[byte] + F.when(digit == 1, plus).when(digit == -1, minus).otherwise(0)
    return out


def dst_values(b0="b0", b1="b1", b2="b2") -> list[Column]:
    """dx, dy, kind of three bytes."""
    bytes_ = [X.col(b).cast("int") for b in (b0, b1, b2)]
    out = []
    for bits in (DST_X, DST_Y):
        total = F.lit(0)
        for k, (byte, plus, minus) in enumerate(bits):
            on = lambda m, byte=byte: F.when(bytes_[byte].bitwiseAND(F.lit(m)) != 0, 1).otherwise(0)
            total = total + (on(plus) - on(minus)) * 3**k
        out.append(total)
    top = bytes_[2].bitwiseAND(F.lit(0xC0))
    return [*out, F.when(top == 0xC0, "colorChange").when(top >= 0x80, "jump").otherwise("stitch")]


def dst_points(moves: DataFrame) -> DataFrame:
    """Where the stitches of a move stream land; jumps move but don't show."""
    w = Window.partitionBy("design_id").orderBy("rec").rowsBetween(Window.unboundedPreceding, 0)
    p = moves.withColumns({"x": F.sum("dx").over(w), "y": -F.sum("dy").over(w)})
    return p.where("kind = 'stitch'").select("design_id", "rec", "x", "y")
