"""Paths as tables: rows (keys, i, x, y) of points in order; even steps, equal parts, sides, columns of satin, and runs that a machine can sew.

Lengths are whole thousandths, so they add up to the same whatever the order of sums, and where a step falls is decided in whole numbers.  All
windows lie within a path, so a table is moved once by its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.model import MAX_STITCH, MIN_STITCH, RUNNING_LENGTH, SATIN_SPACING


def edges(points: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """Each point but a path's last one with the next: (keys, i, x, y, nx, ny, len), and of a closed one the last with the first."""
    w = Window.partitionBy(*keys).orderBy("i")
    around = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))) if closed else F.lead(c).over(w)
    e = points.select(*keys, "i", "x", "y", around("x").alias("nx"), around("y").alias("ny"))
    return e.withColumn("len", X.milli(X.distance(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))))


def _even(points: DataFrame, keys: list[str], spacing: float | None, count: int | None, closed: bool) -> DataFrame:
    """(keys, k, x, y, n): `resampled`, with a path's last k.  Every edge makes its own points, the last one the path's end too, so the rows are
    read, moved and sorted once."""
    w, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys)
    e = edges(points, keys, closed)
    e = e.select("*", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"), F.coalesce(F.sum("len").over(whole), F.lit(0)).alias("total"), F.row_number().over(w).alias("_first"), F.lead("i").over(w).isNull().alias("_last"))
    n = F.lit(count - 1) if count else F.greatest(F.lit(1), F.floor(F.col("total") / F.lit(1000.0 * spacing) + 0.5))
    e = e.withColumn("n", F.when(F.col("total") > 0, n).otherwise(0).cast("long"))
    # the whole numbers k with s0 * n <= k * total < (s0 + len) * n, without n; a path without length has none
    e = e.withColumns({"low": F.expr("(s0 * n + total - 1) div greatest(total, 1)"), "high": F.expr("least(n - 1, ((s0 + len) * n + total - 1) div greatest(total, 1) - 1)")})
    none = F.array().cast("array<bigint>")
    inner = F.when(F.expr("total > 0 and len > 0 and low <= high"), F.sequence("low", "high")).otherwise(none)
    end = F.when(F.expr("_last and total > 0"), F.array("n")).when(F.expr("_first = 1 and total = 0"), F.array(F.lit(0).cast("long"))).otherwise(none)
    t = (F.col("k") * F.col("total") - F.col("s0") * F.col("n")).cast("double") / F.greatest(F.col("n") * F.col("len"), F.lit(1)).cast("double")
    on = e.select(*keys, "x", "y", "nx", "ny", "s0", "len", "total", "n", F.explode(F.concat(inner, end)).alias("k"))
    last = ("nx", "ny") if closed else ("x", "y")
    at = lambda c, o: F.when(F.col("total") == 0, F.col(c).cast("double")).when(F.col("k") == F.col("n"), F.col(o).cast("double")).otherwise(F.col(c) + (F.col(f"n{c}") - F.col(c)) * t)
    return on.select(*keys, "k", at("x", last[0]).alias("x"), at("y", last[1]).alias("y"), "n")


def resampled(points: DataFrame, keys: list[str], spacing: float | None = None, count: int | None = None, closed: bool = False) -> DataFrame:
    """(keys, k, x, y): points at even lengths along each path, both ends included, about `spacing` apart or `count` of them; of a path without
    length its first point.  A step belongs to the edge that it falls on, so every edge makes its own points and nothing is searched for."""
    return _even(points, keys, spacing, count, closed).drop("n")


def running(points: DataFrame, keys: list[str], length: float = RUNNING_LENGTH, closed: bool = False, passes: int = 1) -> DataFrame:
    """(keys, seq, x, y): even stitches along each path, forth, and back for each pass more, in whole units."""
    z = _even(points, keys, length, None, closed)
    z = z.select(*keys, "k", "n", X.round_half_up("x").cast("int").alias("x"), X.round_half_up("y").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    place = F.col("pass") * F.col("n") + F.when(F.col("pass") % 2 == 0, F.col("k")).otherwise(F.col("n") - F.col("k"))
    # a pass begins where the one before it ended, and that point is there already
    return z.withColumn("seq", place).where((F.col("pass") == 0) | (F.col("seq") > F.col("pass") * F.col("n"))).select(*keys, "seq", "x", "y")


def stepped(points: DataFrame, keys: list[str], most: float, closed: bool = False) -> DataFrame:
    """(keys, i, part, x, y): each edge in equal parts of at most `most`; part 0 is a path's own first point."""
    e = edges(points, keys, closed).where("nx is not null")
    n = F.greatest(F.lit(1), F.ceil(X.distance(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")) / most)).cast("long")
    e = e.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("part"))
    t = F.col("part").cast("double") / F.col("n")
    first = points.join(points.groupBy(*keys).agg(F.min("i").alias("i")), [*keys, "i"], "left_semi").select(*keys, "i", F.lit(0).cast("long").alias("part"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return first.unionByName(e.select(*keys, "i", "part", (F.col("x") + (F.col("nx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * t).alias("y")))


def _unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    d = X.distance(dx, dy)
    return F.when(d > 0, dx / d).otherwise(F.lit(0.0)), F.when(d > 0, dy / d).otherwise(F.lit(0.0))


def offset(points: DataFrame, keys: list[str], by: float, closed: bool = True) -> DataFrame:
    """Points moved along the mean of their two edges' normals, to the left of a positive ring's direction; at the end of an open path along the one
    edge's.  (keys, i, x, y)"""
    w, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda c: (F.coalesce(F.lag(c).over(w), F.last(c).over(whole)), F.coalesce(F.lead(c).over(w), F.first(c).over(whole))) if closed else (F.lag(c).over(w), F.lead(c).over(w))
    (px, nx), (py, ny) = near("x"), near("y")
    p = points.select(*keys, "i", "x", "y", px.alias("px"), py.alias("py"), nx.alias("nx"), ny.alias("ny"))
    ax, ay = _unit(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    bx, by_ = _unit(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    zero = F.lit(0.0)
    mx, my = _unit(F.coalesce(ax, zero) + F.coalesce(bx, zero), F.coalesce(ay, zero) + F.coalesce(by_, zero))
    return p.select(*keys, "i", (F.col("x") - my * by).alias("x"), (F.col("y") + mx * by).alias("y"))


def ribbon(points: DataFrame, keys: list[str], half: float) -> DataFrame:
    """The ring around open strokes: (keys, i, x, y), along one side and back along the other.  Points that repeat the one before go first."""
    w = Window.partitionBy(*keys).orderBy("i")
    p = points.withColumns({"_px": F.lag("x").over(w), "_py": F.lag("y").over(w)}).where("_px is null or _px <> x or _py <> y").select(*keys, "i", "x", "y")
    n = F.max("i").over(Window.partitionBy(*keys))
    left, right = offset(p, keys, half, closed=False), offset(p, keys, -half, closed=False)
    # one point alone has no sides
    both = left.unionByName(right.withColumn("i", 2 * n + 1 - F.col("i")))
    many = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return both.join(many, keys, "left_semi")


def satin(points: DataFrame, keys: list[str], width: float, spacing: float = SATIN_SPACING) -> DataFrame:
    """(keys, seq, x, y): a column of even width along each path, its two sides by turns; where one side moves at least twice as far as the other,
    both are cut in up to four.  Paths without length have none."""
    w = Window.partitionBy(*keys).orderBy("k")
    # a path without length has one point, k and n of which are 0
    c = _even(points, keys, spacing, None, False).where("n > 0")
    near = lambda c, f: F.coalesce(f(c).over(w), F.col(c))
    mx, my = _unit(near("x", F.lead) - near("x", F.lag), near("y", F.lead) - near("y", F.lag))
    c = c.select(*keys, "k", F.struct((F.col("x") - my * width / 2).alias("x"), (F.col("y") + mx * width / 2).alias("y")).alias("a"), F.struct((F.col("x") + my * width / 2).alias("x"), (F.col("y") - mx * width / 2).alias("y")).alias("b"))
    c = c.withColumns({"pa": F.lag("a").over(w), "pb": F.lag("b").over(w)})
    far = lambda p, q: X.distance(F.col(f"{q}.x") - F.col(f"{p}.x"), F.col(f"{q}.y") - F.col(f"{p}.y"))
    lo, hi = F.least(far("pa", "a"), far("pb", "b")), F.greatest(far("pa", "a"), far("pb", "b"))
    cut = F.when((lo > 1) & (hi / lo >= 2), F.least(X.round_half_up(hi / lo), F.lit(4))).otherwise(F.lit(1)).cast("int")
    # a step's stitches follow those of the steps before it, so the rows that it is cut into aren't sorted again
    c = c.withColumn("cut", F.when(F.col("pa").isNull(), 1).otherwise(cut))
    before = F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("before", before).select("*", F.explode(F.sequence(F.lit(1), "cut")).alias("part"))
    t = F.col("part").cast("double") / F.col("cut")
    at = lambda p, q, m: F.when(F.col(p).isNull(), F.col(f"{q}.{m}")).otherwise(F.col(f"{p}.{m}") + (F.col(f"{q}.{m}") - F.col(f"{p}.{m}")) * t)
    side = lambda s, p, q: F.struct(F.lit(s).alias("side"), *(X.round_half_up(at(p, q, m)).cast("int").alias(m) for m in "xy"))
    c = c.select(*keys, "before", "part", F.explode(F.array(side(0, "pa", "a"), side(1, "pb", "b"))).alias("s"))
    seq = ((F.col("before") + F.col("part") - 1) * 2 + F.col("s.side")).cast("long")
    return c.select(*keys, seq.alias("seq"), "s.x", "s.y")


def finished(points: DataFrame, keys: list[str], least: float = MIN_STITCH, most: float = MAX_STITCH) -> DataFrame:
    """(keys, seq, x, y): runs without stitches nearer than `least` to the last one kept (the end stays unless it is that very point), longer ones than
    `most` in equal parts; runs of fewer than two points go.  What is kept hangs on what was kept before, so a run is folded in its order."""
    z = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y"))).alias("z")).where(F.size("z") >= 2)
    d2 = lambda p, q: X.squared(p["x"] - q["x"], p["y"] - q["y"])

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(d2(last, p) >= least * least, F.array_append(acc, p)).otherwise(acc)

    kept = F.aggregate(F.slice("z", 2, F.size("z")), F.slice("z", 1, 1), step)
    end = F.element_at("z", -1)
    z = z.withColumn("kept", kept).withColumn("kept", F.when(d2(F.element_at("kept", -1), end) > 0, F.array_append("kept", end)).otherwise(F.col("kept")))
    p = z.select(*keys, F.posexplode("kept").alias("i", "p"), F.col("kept")[0].alias("first")).select(*keys, "i", "p.x", "p.y")
    w = Window.partitionBy(*keys).orderBy("i")
    p = p.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    far = X.distance(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    p = p.withColumn("n", F.when(far > most, F.ceil(far / most)).otherwise(1).cast("int")).select("*", F.explode(F.sequence(F.lit(1), "n")).alias("part"))
    t = F.col("part").cast("double") / F.col("n")
    at = lambda c, q: F.when(F.col(q).isNull(), F.col(c)).otherwise(X.round_half_up(F.col(q) + (F.col(c) - F.col(q)) * t)).cast("int").alias(c)
    seq = (F.row_number().over(Window.partitionBy(*keys).orderBy("i", "part")) - 1).cast("long")
    return p.select(*keys, seq.alias("seq"), at("x", "px"), at("y", "py"))


#: Side of a cell of the grid in which edges look for each other, in units.
CELL = 64


def crossings(points: DataFrame, keys: list[str], closed: bool = True, cell: float = CELL) -> DataFrame:
    """Pairs of a path's edges that cross, but not where they touch or follow each other: (keys, i, j).  Edges are put into the cells that their boxes
    cover, and meet only there; a pair that meets in several cells is looked at in the first one that both cover."""
    w = Window.partitionBy(*keys)
    e = edges(points, keys, closed).where("nx is not null").withColumns({"n": F.count(F.lit(1)).over(w), "at": (F.row_number().over(w.orderBy("i")) - 1).cast("long")})
    low = lambda a, b: F.floor(F.least(a, b) / cell).cast("long")
    high = lambda a, b: F.floor(F.greatest(a, b) / cell).cast("long")
    e = e.select(*keys, "i", "n", "at", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "nx", "ny")), low("x", "nx").alias("cx"), low("y", "ny").alias("cy"), high("x", "nx").alias("dx"), high("y", "ny").alias("dy"))
    c = e.withColumn("gx", F.explode(F.sequence("cx", "dx"))).withColumn("gy", F.explode(F.sequence("cy", "dy")))
    a, b = c.alias("a"), c.alias("b")
    same = F.col("a.gx").eqNullSafe(F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    apart = (F.col("b.at") - F.col("a.at") >= 2) & ~((F.col("a.at") == 0) & (F.col("b.at") == F.col("a.n") - 1) & F.lit(closed))
    here = (F.col("a.gx") == F.greatest("a.cx", "b.cx")) & (F.col("a.gy") == F.greatest("a.cy", "b.cy"))
    p = lambda s, q: (F.col(f"{s}.{q}x"), F.col(f"{s}.{q}y"))
    side = lambda o, q, r: F.signum((q[0] - o[0]) * (r[1] - o[1]) - (q[1] - o[1]) * (r[0] - o[0]))
    cross = (side(p("a", ""), p("a", "n"), p("b", "")) * side(p("a", ""), p("a", "n"), p("b", "n")) < 0) & (side(p("b", ""), p("b", "n"), p("a", "")) * side(p("b", ""), p("b", "n"), p("a", "n")) < 0)
    return a.join(b, same & apart & here & cross).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.i").alias("i"), F.col("b.i").alias("j"))


def corners_cut(points: DataFrame, keys: list[str], corner: float = 60.0) -> DataFrame:
    """(keys, i, part, x, y): one round of corner cutting of rings, but for vertices that turn by `corner` degrees or more: the others become two points, a
    quarter of the way to each neighbour."""
    w, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda c: (F.coalesce(F.lag(c).over(w), F.last(c).over(whole)), F.coalesce(F.lead(c).over(w), F.first(c).over(whole)))
    (px, nx), (py, ny) = near("x"), near("y")
    p = points.select(*keys, "i", "x", "y", px.alias("px"), py.alias("py"), nx.alias("nx"), ny.alias("ny"))
    sharp = X.turn_degrees(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")) >= corner
    at = lambda part, q: F.struct(F.lit(part).alias("part"), *((F.col(c) + (F.col(q + c) - F.col(c)) * 0.25 if q else F.col(c).cast("double")).alias(c) for c in "xy"))
    return p.select(*keys, "i", F.explode(F.when(sharp, F.array(at(0, ""))).otherwise(F.array(at(0, "p"), at(1, "n")))).alias("p")).select(*keys, "i", "p.part", "p.x", "p.y")


def pulled(points: DataFrame, keys: list[str], pull: float, push: float) -> DataFrame:
    """Rings as level rows have to be given: longer by `pull` across the rows on both sides, shorter by `push` along them, about the centroid; those under 20
    units in either direction stay.  (keys, i, x, y)"""
    w = Window.partitionBy(*keys)
    e = edges(points, keys, closed=True).withColumn("c", (F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).cast("double"))
    area = F.sum("c").over(w)
    middle = lambda a, b: F.sum((F.col(a) + F.col(b)) * F.col("c")).over(w) / (3.0 * area)
    first = lambda c: F.first(c).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")
    flat = F.abs(area) < 1e-9
    e = e.withColumns({"cx": F.when(flat, first("x")).otherwise(middle("x", "nx")), "cy": F.when(flat, first("y")).otherwise(middle("y", "ny"))})
    e = e.withColumns({"hx": F.max(F.abs(F.col("x") - F.col("cx"))).over(w), "hy": F.max(F.abs(F.col("y") - F.col("cy"))).over(w), "extent": F.least(F.max("x").over(w) - F.min("x").over(w), F.max("y").over(w) - F.min("y").over(w))})
    stays = (F.col("extent") < 20) | (F.col("hx") < 1e-6) | (F.col("hy") < 1e-6) | F.lit(pull <= 0 and push <= 0)
    fx, fy = F.greatest(F.lit(0.3), (F.col("hx") - push) / F.col("hx")), (F.col("hy") + pull) / F.col("hy")
    to = lambda c, f: F.when(stays, F.col(c).cast("double")).otherwise(F.col(f"c{c}") + (F.col(c) - F.col(f"c{c}")) * f).alias(c)
    return e.select(*keys, "i", to("x", fx), to("y", fy))


def row_points(rows: DataFrame, length: float = 30.0, jitter: float = 0.2) -> DataFrame:
    """Penetrations of rows (any columns, with row, y, x1, x2): odd rows are shifted by half a stitch, inner points moved a little so that they don't
    line up, ends stay.  Adds k and x."""
    r = rows.withColumn("_start", F.col("x1") + F.when(F.col("row") % 2 == 1, length / 2).otherwise(length))
    n = F.greatest(F.lit(0), F.ceil((F.col("x2") - length * 0.25 - F.col("_start")) / length)).cast("int")
    r = r.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") + 1)).alias("k"))
    base = F.floor(F.col("y") + 0.5) * 0.137 + (F.col("row") % 2) * 7
    moved = F.col("_start") + (F.col("k") - 1) * length + (X.noise(base + (F.col("k") - 1)) * 2 - 1) * length * jitter
    inner = F.greatest(F.col("x1") + length * 0.25, F.least(F.col("x2") - length * 0.25, moved))
    return r.withColumn("x", F.when(F.col("k") == 0, F.col("x1").cast("double")).when(F.col("k") > F.col("_n"), F.col("x2").cast("double")).otherwise(inner)).drop("_start", "_n")
