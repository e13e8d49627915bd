"""Node paths, elements and hits: edits of single paths as expressions over arrays, searches as joins over a grid.

A node path is an array of struct(x, y, smooth); a path an array of struct(x, y). Where points look for near edges or boxes, both sides
are put into the cells of a grid first, so only neighbours meet and no design is multiplied with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X

#: Side of a cell of the grid, in units.
CELL = 64


def _point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _at(nodes: Column, i: Column, closed: bool) -> Column:
    n = F.size(nodes)
    place = F.pmod(i, n) if closed else F.greatest(F.lit(0), F.least(n - 1, i))
    return F.element_at(nodes, (place + 1).cast("int"))


def node_polyline(nodes, closed: bool = True, samples: int = 8) -> Column:
    """The path through nodes: straight between corners, else a Catmull-Rom curve that a smooth end lets run on to the node beyond."""
    return let(X.col(nodes), lambda p: _through(p, closed, samples))


def _through(p: Column, closed: bool, samples: int) -> Column:
    # the four nodes of a segment are looked up once, not for every point on it
    def segment(s):
        a, b = _at(p, s, closed), _at(p, s + 1, closed)
        pick = lambda smooth, far, own: F.when(smooth, _point(far["x"], far["y"])).otherwise(_point(own["x"], own["y"]))
        ends = F.struct(pick(a["smooth"], _at(p, s - 1, closed), a).alias("p0"), _point(a["x"], a["y"]).alias("p1"), _point(b["x"], b["y"]).alias("p2"), pick(b["smooth"], _at(p, s + 2, closed), b).alias("p3"), (a["smooth"] | b["smooth"]).alias("bends"))
        return let(ends, between)

    def between(e):
        def on(t, c):
            p0, p1, p2, p3 = (e[f"p{k}"][c] for k in range(4))
            return (p1 * 2.0 + (p2 - p0) * t + (p0 * 2.0 - p1 * 5.0 + p2 * 4.0 - p3) * t * t + (p1 * 3.0 - p0 - p2 * 3.0 + p3) * t * t * t) * 0.5

        curve = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: _point(on(i / float(samples), "x"), on(i / float(samples), "y")))
        return F.when(~e["bends"], F.array(e["p2"])).otherwise(curve)

    last = F.size(p) - (0 if closed else 1)
    first = F.array(_point(p[0]["x"], p[0]["y"]))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), segment))
    return F.when(F.size(p) == 0, F.slice(F.transform(p, lambda v: _point(v["x"], v["y"])), 1, 0)).when(F.size(p) == 1, first).otherwise(F.concat(first, rest))


def nodes_of(path, closed: bool = True, corner: float = 50.0) -> Column:
    """Nodes for the points of a path: corners where it turns by `corner` degrees or more, and at the ends of an open one."""
    def nodes(p):
        def node(v, i):
            a, b = _at(p, i - 1, True), _at(p, i + 1, True)
            # the neighbours are looked up once, not for every use of a difference
            turn = let(F.struct((v["x"] - a["x"]).alias("ax"), (v["y"] - a["y"]).alias("ay"), (b["x"] - v["x"]).alias("bx"), (b["y"] - v["y"]).alias("by")), lambda d: X.turn_degrees(d["ax"], d["ay"], d["bx"], d["by"]))
            sharp = turn >= corner
            sharp = sharp if closed else sharp | (i == 0) | (i == F.size(p) - 1)
            return F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"), (~sharp).alias("smooth"))

        return F.transform(p, node)

    return let(X.col(path), nodes)


def node_types(nodes, smooth: bool, at: int | None = None) -> Column:
    """The nodes, one of them or all made smooth or corners."""
    return F.transform(X.col(nodes), lambda v, i: F.struct(v["x"].alias("x"), v["y"].alias("y"), (F.lit(smooth) if at is None else F.when(i == at, F.lit(smooth)).otherwise(v["smooth"])).alias("smooth")))


def shape_ring(nodes, outer: bool = True, samples: int = 8) -> Column:
    """The ring of closed nodes, with the winding of an outline or a hole."""
    wound = lambda ring: F.when(X.doubled_area(ring) < 0 if outer else X.doubled_area(ring) > 0, F.reverse(ring)).otherwise(ring)
    return let(X.col(nodes), lambda p: let(node_polyline(p, True, samples), wound))


def boxes_intersect(a, b) -> Column:
    """Whether two boxes (min_x, max_x, min_y, max_y) touch."""
    a, b = X.col(a), X.col(b)
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


# Elements


def rotated(path, cx: float, cy: float, radians: float) -> Column:
    c, s = F.cos(F.lit(radians)), F.sin(F.lit(radians))
    return F.transform(X.col(path), lambda v: _point(F.lit(cx) + (v["x"] - cx) * c - (v["y"] - cy) * s, F.lit(cy) + (v["x"] - cx) * s + (v["y"] - cy) * c))


def scaled(path, ax: float, ay: float, sx: float, sy: float) -> Column:
    return F.transform(X.col(path), lambda v: _point(F.lit(ax) + (v["x"] - ax) * sx, F.lit(ay) + (v["y"] - ay) * sy))


def translated(path, dx: float, dy: float) -> Column:
    return F.transform(X.col(path), lambda v: _point(v["x"] + dx, v["y"] + dy))


def half_turn(degrees) -> Column:
    """A row angle as a whole number of degrees in [0, 180]."""
    return X.round_half_up(F.pmod(F.pmod(X.col(degrees), F.lit(180.0)) + 180.0, F.lit(180.0))).cast("long")


def rotated_angle(angle, radians: float) -> Column:
    return half_turn(X.col(angle) + F.degrees(F.lit(radians)))


def flipped_angle(angle) -> Column:
    return half_turn(F.lit(180.0) - X.col(angle))


def flipped(path, cx: float, cy: float, horizontal: bool = True) -> Column:
    return scaled(path, cx, cy, -1.0 if horizontal else 1.0, 1.0 if horizontal else -1.0)


#: What a region may be told about its stitches, which does not outlive a move of the region.
STITCHING = ("fill_type", "angle_deg", "angle_lines", "baked")


def transformed(regions: DataFrame, tx: float = 0.0, ty: float = 0.0, rotation: float = 0.0, scale: float = 1.0, flip_x: bool = False, flip_y: bool = False) -> DataFrame:
    """Regions (outer, holes, ...) scaled and flipped, turned, and moved; what they were told about their stitches is dropped."""
    move = lambda r: X.transform_ring(r, tx, ty, rotation, scale, flip_x, flip_y)
    return regions.drop(*STITCHING).withColumns({"outer": move(F.col("outer")), "holes": F.transform("holes", move)})


def duplicated(elements: DataFrame, dx: float, dy: float, path: str = "outer", key: str = "poly") -> DataFrame:
    """The elements and moved copies of them, with keys after the largest of their design."""
    top = elements.groupBy("design_id").agg(F.max(key).alias("_top"))
    new = elements.join(top, "design_id").withColumn(key, F.col("_top") + F.row_number().over(Window.partitionBy("design_id").orderBy(key))).withColumn(path, translated(path, dx, dy)).drop("_top")
    return elements.withColumn(path, translated(path, 0.0, 0.0)).unionByName(new)


def without_nodes(path, gone, least: int) -> Column:
    """Without the nodes at positions `gone`; where fewer than `least` would be left, the first of those listed stay."""
    p, g = X.col(path), X.col(gone)
    short = F.greatest(F.lit(0), F.lit(least) - (F.size(p) - F.size(g)))
    really = F.slice(g, short + 1, F.greatest(F.size(g) - short, F.lit(0)))
    return F.filter(p, lambda v, i: ~F.array_contains(really, i))


def strip_locks(path, unit_mm: float = 0.1, pairs: int = 3) -> Column:
    """Without lock stitches at both ends: pairs that go out by 1.2 mm at most and come back to within 0.15 mm."""

    def cut(p):
        gap = lambda i, j: X.distance(F.element_at(p, i + 1)["x"] - F.element_at(p, j + 1)["x"], F.element_at(p, i + 1)["y"] - F.element_at(p, j + 1)["y"]) * unit_mm
        state = lambda a, b, going: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), going.alias("going"))

        def step(way):
            def go(s, _):
                i = s["a"] if way > 0 else s["b"]
                locked = F.when(s["going"] & (s["b"] - s["a"] >= 3), (gap(i, i + 2 * way) < 0.15) & (gap(i, i + way) <= 1.2)).otherwise(F.lit(False))
                move = F.when(locked, 2).otherwise(0)
                return state(s["a"] + move, s["b"], locked) if way > 0 else state(s["a"], s["b"] - move, locked)

            return go

        rounds = F.sequence(F.lit(1), F.lit(pairs))
        front = F.aggregate(rounds, state(F.lit(0), F.size(p) - 1, F.lit(True)), step(1))
        both = let(front, lambda s: F.aggregate(rounds, state(s["a"], s["b"], F.lit(True)), step(-1)))
        return let(both, lambda s: F.slice(p, s["a"] + 1, F.greatest(s["b"] - s["a"] + 1, F.lit(0))))

    return let(X.col(path), cut)


def looks_like_line(path, unit_mm: float = 0.1) -> Column:
    """Whether stitches were sewn as a line: few turns back (under 0.15 of all), and not over eight times as long as their box."""

    def verdict(p):
        near = lambda i, c: (F.element_at(p, i + 1)[c] - F.element_at(p, i)[c]) * unit_mm
        steps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(near(i, "x").alias("x"), near(i, "y").alias("y"), X.distance(near(i, "x"), near(i, "y")).alias("l")))
        box = X.ring_bounds(p)
        diagonal = F.greatest(F.lit(1.0), X.distance((box["max_x"] - box["min_x"]) * unit_mm, (box["max_y"] - box["min_y"]) * unit_mm))

        def judged(s):
            n = F.size(s) - 1
            cos = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when((a["l"] >= 1e-6) & (b["l"] >= 1e-6), (a["x"] * b["x"] + a["y"] * b["y"]) / (a["l"] * b["l"])))
            turns = let(F.filter(cos, lambda c: c.isNotNull()), lambda c: (F.size(c) == 0) | (F.size(F.filter(c, lambda v: v < -0.5)) / F.size(c) < 0.15))
            return turns & (F.aggregate(s, F.lit(0.0), lambda t, d: t + d["l"]) / diagonal < 8)

        return F.when(F.size(p) < 2, F.lit(False)).otherwise(let(steps, judged))

    return let(strip_locks(path, unit_mm), verdict)


# Rows of points: (design_id, poly, ring, i, x, y)


def soft_moved(points: DataFrame, selected: DataFrame, dx: float, dy: float, radius: float) -> DataFrame:
    """Selected nodes (design_id, poly, ring, i) of closed rings move by dx, dy, their neighbours by (1 - (d / radius)^2)^2 of that, d
    being the way along the ring to the nearest selected one."""
    keys = ["design_id", "poly", "ring"]
    w = Window.partitionBy(*keys).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = X.distance(F.coalesce(F.lead("x").over(w), F.first("x").over(whole)) - F.col("x"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)) - F.col("y"))
    p = points.withColumn("_step", step).withColumn("_s", F.coalesce(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    p = p.withColumn("_total", F.sum("_step").over(Window.partitionBy(*keys)))
    marked = p.join(selected.select(*keys, "i", F.lit(True).alias("_chosen")), [*keys, "i"], "left")
    # the places of a ring's selected nodes, a list that a ring's own length bounds
    marked = marked.withColumn("_places", F.collect_list(F.when(F.col("_chosen"), F.col("_s"))).over(Window.partitionBy(*keys)))
    gaps = F.transform("_places", lambda q: F.least(F.abs(F.col("_s") - q), F.col("_total") - F.abs(F.col("_s") - q)))
    d = F.array_min(gaps)
    t = F.lit(1.0) - (d / radius) * (d / radius)
    share = F.when(F.col("_chosen"), 1.0).when(d < radius, t * t).otherwise(0.0)
    return marked.select(*keys, "i", X.milli(F.col("x") + share * dx).alias("x"), X.milli(F.col("y") + share * dy).alias("y"))


def subdivided_ring(ring) -> Column:
    """A node more in the middle of every edge, the closing one too."""
    between = lambda v, b: F.array(_point(v["x"], v["y"]), _point((v["x"] + b["x"]) / 2, (v["y"] + b["y"]) / 2))
    return let(X.col(ring), lambda r: F.flatten(F.transform(r, lambda v, i: let(_at(r, i + 1, True), lambda b: between(v, b)))))


def _cells(lo, hi, cell: int) -> Column:
    return F.sequence(F.floor(X.col(lo) / cell).cast("long"), F.floor(X.col(hi) / cell).cast("long"))


def _edges(points: DataFrame, keep: list[str]) -> DataFrame:
    w = Window.partitionBy("design_id", "poly", "ring").orderBy("i")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(first)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(first))}).select(*keep, "ring", "i", "x", "y", "nx", "ny")


def places(queries: DataFrame) -> DataFrame:
    """The places (design_id, qx, qy) of queries, once each: what is near a place is near all queries there."""
    return queries.select("design_id", "qx", "qy").distinct()


def _in_cells(at: DataFrame, cell: int) -> DataFrame:
    return at.withColumns({"_gx": F.floor(F.col("qx") / cell).cast("long"), "_gy": F.floor(F.col("qy") / cell).cast("long")})


def _spread(rows: DataFrame, box: dict, cell: int) -> DataFrame:
    for name, (lo, hi) in box.items():
        rows = rows.withColumn(name, F.explode(_cells(lo, hi, cell)))
    return rows


def near_edges(queries: DataFrame, points: DataFrame, reach: float, last: bool = False, cell: int = CELL) -> DataFrame:
    """Pairs of places (design_id, qx, qy) and edges of rings at most `reach` apart: poly, ring, i, d, and the nearest point of the
    edge. An edge lies in all cells that its box, widened by `reach`, covers, and a place in one.  Of edges of a design that lie on each other
    the first is taken (the last one with `last`), as none of the others can be preferred to it."""
    e, own = _edges(points, ["design_id", "poly"]), F.struct("poly", "ring", "i")
    e = e.groupBy("design_id", "x", "y", "nx", "ny").agg((F.max(own) if last else F.min(own)).alias("_own"))
    box = {"_gx": (F.least("x", "nx") - reach, F.greatest("x", "nx") + reach), "_gy": (F.least("y", "ny") - reach, F.greatest("y", "ny") + reach)}
    at = places(queries)
    j = _in_cells(at, cell).join(_spread(e, box, cell), ["design_id", "_gx", "_gy"])
    dx, dy = (F.col("nx") - F.col("x")).cast("double"), (F.col("ny") - F.col("y")).cast("double")
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("qx") - F.col("x")) * dx + (F.col("qy") - F.col("y")) * dy) / n))).otherwise(F.lit(0.0))
    j = j.withColumns({"hx": F.col("x") + dx * t, "hy": F.col("y") + dy * t})
    j = j.withColumn("d", X.distance(F.col("hx") - F.col("qx"), F.col("hy") - F.col("qy")))
    return j.where(F.col("d") <= reach).select("design_id", "qx", "qy", "_own.*", "d", "hx", "hy")


_PLACE = ["design_id", "qx", "qy"]


def snapped(queries: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Each query moved to the nearest point of an edge nearer than the threshold, the first of equally near ones; else where it is."""
    best = near_edges(queries, points, threshold).where(F.col("d") < threshold).groupBy(*_PLACE).agg(F.min_by(F.struct("hx", "hy"), F.struct("d", "poly", "ring", "i")).alias("h"))
    return queries.join(best, _PLACE, "left").select("design_id", "q", X.milli(F.coalesce("h.hx", F.col("qx").cast("double"))).alias("x"), X.milli(F.coalesce("h.hy", F.col("qy").cast("double"))).alias("y"))


def nearest_segment(queries: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """The nearest edge within the tolerance, the last of equally near ones."""
    order = F.struct(-F.col("d"), F.col("poly"), F.col("ring"), F.col("i"))
    g = near_edges(queries, points, tolerance, last=True).groupBy(*_PLACE).agg(F.max_by(F.struct("poly", "ring", "i", "hx", "hy"), order).alias("s"))
    return queries.join(g, _PLACE).select("design_id", "q", "s.poly", "s.ring", "s.i", X.milli("s.hx").alias("x"), X.milli("s.hy").alias("y"))


def nearest_node(queries: DataFrame, points: DataFrame, tolerance: float, cell: int = CELL) -> DataFrame:
    """The nearest node within the tolerance, the last of equally near ones; of nodes in one place the last is taken at once."""
    r = float(tolerance)
    p = points.groupBy("design_id", "x", "y").agg(F.max(F.struct("poly", "ring", "i")).alias("_own"))
    p = _spread(p, {"_gx": (F.col("x") - r, F.col("x") + r), "_gy": (F.col("y") - r, F.col("y") + r)}, cell)
    j = _in_cells(places(queries), cell).join(p, ["design_id", "_gx", "_gy"]).withColumn("d2", X.squared(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))).where(F.col("d2") <= tolerance * tolerance)
    g = j.groupBy(*_PLACE).agg(F.max(F.struct((-F.col("d2")).alias("near"), "_own.poly", "_own.ring", "_own.i")).alias("s"))
    return queries.join(g, _PLACE).select("design_id", "q", "s.poly", "s.ring", "s.i", (-F.col("s.near")).alias("d2"))


def holders(queries: DataFrame, rings: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of queries (design_id, qx, qy, ...) and the outer rings that hold them: a ring lies in the cells of its box, a query in
    one, so a design's points and rings meet only where they are.  rings: design_id, outer, and whatever else they have."""
    b = X.ring_bounds("outer")
    r = _spread(rings.withColumn("b", b), {"_gx": ("b.min_x", "b.max_x"), "_gy": ("b.min_y", "b.max_y")}, cell)
    j = _in_cells(queries, cell).join(r, ["design_id", "_gx", "_gy"]).where("qx between b.min_x and b.max_x and qy between b.min_y and b.max_y")
    return j.where(X.point_in_ring("qx", "qy", "outer")).drop("_gx", "_gy", "b")


def hits(queries: DataFrame, rings: DataFrame, points: DataFrame, reach: float = 20.0) -> DataFrame:
    """What lies under each query: the topmost region (the one sewn last) that holds it, holes excepted; else the one with the nearest
    edge under `reach`, the first of equally near ones; null if there is none.  Of regions that lie on each other the topmost is taken at once."""
    alike = rings.groupBy("design_id", "outer", "hole").agg(F.max("poly").alias("poly"))
    top = holders(places(queries), alike).where(~F.coalesce(X.point_in_ring("qx", "qy", "hole"), F.lit(False))).groupBy(*_PLACE).agg(F.max("poly").alias("_inside"))
    edge = near_edges(queries, points, reach).where(F.col("d") < reach).groupBy(*_PLACE).agg(F.min_by("poly", F.struct("d", "poly")).alias("_near"))
    return queries.join(top, _PLACE, "left").join(edge, _PLACE, "left").select("design_id", "q", F.coalesce("_inside", "_near").alias("poly"), F.col("_inside").isNotNull().alias("inside"))


def nearest_stitch(queries: DataFrame, st: DataFrame, reach: int = 60, cell: int = CELL) -> DataFrame:
    """The stitch of its design nearest to each query and nearer than `reach`, the first of equally near ones in sewing order."""
    p = st.select("design_id", "block_idx", "run_idx", "seq", "x", "y").withColumn("_gx", F.explode(_cells(F.col("x") - reach, F.col("x") + reach, cell))).withColumn("_gy", F.explode(_cells(F.col("y") - reach, F.col("y") + reach, cell)))
    q = queries.withColumns({"_gx": F.floor(F.col("qx") / cell).cast("long"), "_gy": F.floor(F.col("qy") / cell).cast("long")})
    j = q.join(p, ["design_id", "_gx", "_gy"]).withColumn("d2", X.squared(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))).where(F.col("d2") < reach * reach)
    place = F.struct("block_idx", "run_idx", "seq")
    return j.groupBy("design_id", "q").agg(F.min_by(place, F.struct(F.col("d2"), place)).alias("s"), F.min("d2").alias("d2")).select("design_id", "q", "s.*", "d2")


def meeting_boxes(rings: DataFrame, cell: int = CELL) -> DataFrame:
    """How many other outlines of its design each outline's box touches: boxes meet in the cells that they cover, and a pair counts in the
    first cell that both cover."""
    b = rings.select("design_id", "poly", X.ring_bounds("outer").alias("b"))
    cells = b.withColumn("_gx", F.explode(_cells("b.min_x", "b.max_x", cell))).withColumn("_gy", F.explode(_cells("b.min_y", "b.max_y", cell)))
    other = cells.select("design_id", "_gx", "_gy", F.col("poly").alias("_o"), F.col("b").alias("_b"))
    at = lambda a, c: F.floor(F.greatest(F.col(f"b.{a}"), F.col(f"_b.{a}")) / cell) == F.col(c)
    pairs = cells.join(other, ["design_id", "_gx", "_gy"]).where((F.col("poly") != F.col("_o")) & boxes_intersect("b", "_b") & at("min_x", "_gx") & at("min_y", "_gy"))
    n = pairs.groupBy("design_id", "poly").agg(F.count(F.lit(1)).alias("meets"))
    return b.select("design_id", "poly").join(n, ["design_id", "poly"], "left").select("design_id", "poly", F.coalesce("meets", F.lit(0)).alias("meets"))
