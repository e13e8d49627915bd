"""Label maps as stretches: a row (img, label, y, x1, x2) for each maximal run of one label in a row of pixels.

Connected parts, the boundaries of parts as rings of corners, and the merging of specks, set at a time: a picture may be many tasks, and all
pictures of a table take their rounds together.  Work is in proportion to stretches, corners and contacts, not to pixels; what is joined is a row of
stretches with the next, by windows, so no row is multiplied with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.tables import forget, scope, stored

_ROW = 1 << 32


def of_pixels(labels: DataFrame) -> DataFrame:
    """From (img, x, y, label): one shuffle, by row."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("img", "y", "label").orderBy("x"))
    s = labels.select("img", "y", "label", "x", island.alias("island"))
    return s.groupBy("img", "y", "label", "island").agg(F.min("x").cast("long").alias("x1"), F.max("x").cast("long").alias("x2")).select("img", F.col("label").cast("long").alias("label"), F.col("y").cast("long").alias("y"), "x1", "x2")


def first_pixel(y="y", x="x1") -> Column:
    """A pixel's number in raster order; of a part, that of its first one names it."""
    return X.col(y) * F.lit(_ROW) + X.col(x)


def overlaps(st: DataFrame, alike: bool = True) -> DataFrame:
    """Pairs of stretches in neighbouring rows that share a column: (img, y (of the upper one), upper, lower: (label, x1, x2), from, to).
    alike: only those of one label, which meet label by label.  Stretches of a row are apart, so the one that begins last before another
    one's begin is the only one that can reach over it."""
    sides = F.array(F.struct(F.col("y").alias("gap"), F.lit(0).alias("side")), F.struct((F.col("y") - 1).alias("gap"), F.lit(1).alias("side")))
    e = st.select("img", "label", "x1", "x2", F.explode(sides).alias("s")).select("img", "label", "x1", "x2", "s.*")
    w = Window.partitionBy("img", *(["label"] if alike else []), "gap").orderBy("x1", "side").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("label", "x1", "x2")
    last = lambda side: F.last(F.when(F.col("side") == side, own), ignorenulls=True).over(w)
    e = e.select("*", own.alias("own"), last(0).alias("above"), last(1).alias("below"))
    e = e.withColumn("other", F.when(F.col("side") == 1, F.col("above")).otherwise(F.col("below"))).where(F.col("other.x2") >= F.col("x1"))
    upper, lower = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
    return e.select("img", F.col("gap").alias("y"), upper.alias("upper"), lower.alias("lower"), F.col("x1").alias("from"), F.least("x2", "other.x2").alias("to"))


def components(links: DataFrame, key: str = "img") -> DataFrame:
    """(key, node, part): the least node that each node of some link can reach.  Rounds of large and small stars: each node's
    neighbours are tied to the least of them, until nothing changes; some log n rounds, in each of which rows are at most the links.  A star's
    centre has one row after partial aggregation, and its leaves are a join that may be split."""
    with scope(links.sparkSession) as own:
        e = stored(links.select(key, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
        state = lambda t: tuple(t.agg(F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({key}, u, v))")).first())
        before = state(e)
        while True:
            both = e.unionByName(e.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy(key, "u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
            large = both.join(least, [key, "u"]).where("v > u").select(key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy(key, "u").agg(F.min("v").alias("m"))
            pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            small = large.join(least, [key, "u"]).select(key, F.explode(pairs).alias("p")).select(key, "p.u", "p.v").where("u <> v").distinct()
            new = stored(small)
            forget(e)
            e, after = new, state(new)
            if after == before:
                break
            before = after
        own.release(e)
    leaves = e.select(key, F.col("u").alias("node"), F.col("v").alias("part"))
    return leaves.unionByName(e.select(key, F.col("v").alias("node"), F.col("v").alias("part")).distinct())


def parted(st: DataFrame) -> DataFrame:
    """Stretches with their part: those of one label that hang together by their edges."""
    o = overlaps(st)
    links = o.select("img", first_pixel("y", "upper.x1").alias("a"), first_pixel(F.col("y") + 1, "lower.x1").alias("b"))
    s = st.withColumn("node", first_pixel())
    return s.join(components(links), ["img", "node"], "left").withColumn("part", F.coalesce("part", "node")).drop("node")


def parts(labeled: DataFrame) -> DataFrame:
    """A row for each part: area and box."""
    size = F.sum(F.col("x2") - F.col("x1") + 1).alias("area")
    return labeled.groupBy("img", "label", "part").agg(size, F.min("x1").alias("min_x"), F.max("x2").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def contacts(labeled: DataFrame) -> DataFrame:
    """(img, part, other, n, first): edges of pixels between two parts, and where part meets the other first, as (y, x, side): left, right, above, below."""
    s = labeled
    w = Window.partitionBy("img", "y").orderBy("x1")
    beside = s.select("img", "y", "part", "x1", F.lag("part").over(w).alias("before"), F.lag("x2").over(w).alias("end")).where("end = x1 - 1")
    at = lambda y, x, side: F.struct(y.alias("y"), x.alias("x"), F.lit(side).alias("side"))
    one = lambda part, other, n, first: F.struct(part.alias("part"), other.alias("other"), n.alias("n"), first.alias("first"))
    row, one_edge = F.col("y"), F.lit(1).cast("long")
    level = beside.select("img", F.explode(F.array(one(F.col("part"), F.col("before"), one_edge, at(row, F.col("x1"), 0)), one(F.col("before"), F.col("part"), one_edge, at(row, F.col("end"), 1)))).alias("c"))
    # windows pass the part on in the place of the label
    o = overlaps(s.select("img", F.col("part").alias("label"), "y", "x1", "x2"), alike=False).where("upper.label <> lower.label")
    n, a, b = F.col("to") - F.col("from") + 1, F.col("upper.label"), F.col("lower.label")
    upright = o.select("img", F.explode(F.array(one(a, b, n, at(row, F.col("from"), 3)), one(b, a, n, at(row + 1, F.col("from"), 2)))).alias("c"))
    return level.unionByName(upright).select("img", "c.*").groupBy("img", "part", "other").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def without_specks(labeled: DataFrame, colors: DataFrame, contrast: float = 25.0, least: int = 16, noise: int = 2) -> DataFrame:
    """(img, part, label, area, merged): parts under `least` pixels take the label that touches them most, one after the other in raster order
    (of equal ones, the label met first); over `noise` pixels only if the colours (label, lab) are within `contrast`.  Parts without a
    label (-1) stay.  A small part waits for the small ones before it that it touches and for no others, so a round settles all whose
    turn it is, in all pictures; there are as many rounds as the longest row of small parts that wait for each other has members."""
    size = parts(labeled).select("img", "part", "label", "area")
    touching = contacts(labeled)
    with scope(labeled.sparkSession) as own:
        small = (F.col("area") < least) & (F.col("label") >= 0)
        state = stored(size.select("img", "part", F.col("label").alias("was"), "label", "area", small.alias("open")))
        open_ = state.where("open").select("img", "part", F.col("was").alias("own"), F.col("area").alias("size"))
        touch = stored(touching.join(open_, ["img", "part"]))
        far = colors.select(F.col("label").alias("c1"), F.col("lab").alias("lab1")).crossJoin(F.broadcast(colors.select(F.col("label").alias("c2"), F.col("lab").alias("lab2"))))
        # a palette has some ten colours
        far = far.select("c1", "c2", (X.delta_e2(F.col("lab1"), F.col("lab2")) > contrast**2).alias("far"))
        while True:
            waiting = state.where("open").select("img", "part")
            other = state.select("img", F.col("part").alias("other"), F.col("label").alias("beside"), F.col("open").alias("undone"))
            now = touch.join(waiting, ["img", "part"], "left_semi").join(other, ["img", "other"])
            votes = now.groupBy("img", "part", "own", "size", "beside").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.bool_or(F.col("undone") & (F.col("other") < F.col("part"))).alias("waits"))
            most = F.max_by("beside", F.when(F.col("beside") != F.col("own"), F.struct("n", (-F.col("first.y")).alias("y"), (-F.col("first.x")).alias("x"), (-F.col("first.side")).alias("side"))))
            turn = votes.groupBy("img", "part", "own", "size").agg(most.alias("best"), F.count_if(F.col("beside") != F.col("own")).alias("others"), F.bool_or("waits").alias("waits")).where("not waits")
            turn = turn.join(F.broadcast(far), (F.col("own") == F.col("c1")) & (F.col("best") == F.col("c2")), "left")
            stays = (F.col("others") == 0) | ((F.col("best") >= 0) & (F.col("size") > noise) & F.coalesce("far", F.lit(False)))
            turn = turn.select("img", "part", F.when(~stays, F.col("best")).alias("new"), F.lit(True).alias("settled"))
            lone = waiting.join(touch, ["img", "part"], "left_anti").select("img", "part", F.lit(None).cast("long").alias("new"), F.lit(True).alias("settled"))
            new = stored(state.join(turn.unionByName(lone), ["img", "part"], "left").select("img", "part", "was", F.coalesce("new", "label").alias("label"), "area", (F.col("open") & F.col("settled").isNull()).alias("open")))
            forget(state)
            state = new
            if state.where("open").isEmpty():
                break
        own.release(state)
    return state.select("img", "part", "label", "area", (F.col("label") != F.col("was")).alias("merged"))


# Directions of boundaries, clockwise; a label lies to the right.
EAST, SOUTH, WEST, NORTH = range(4)


def sides(st: DataFrame) -> DataFrame:
    """Boundaries of labels between corners: (img, label, x, y, way, ex, ey, next_way), clockwise around the label, so outer ones have
    positive areas and holes negative ones.  Where two parts of a label touch at a corner, a boundary turns right and keeps to its own.

    The horizontal sides are what the stretches next above and below leave uncovered, and their ends are the corners; along a column
    beginnings and ends of vertical sides take turns."""
    o = overlaps(st)
    above = o.select("img", "lower.label", (F.col("y") + 1).alias("y"), F.col("lower.x1").alias("x1"), F.col("lower.x2").alias("x2"), F.lit(EAST).alias("way"), "from", "to")
    below = o.select("img", "upper.label", "y", F.col("upper.x1").alias("x1"), F.col("upper.x2").alias("x2"), F.lit(WEST).alias("way"), "from", "to")
    # after the last cover there may be a side up to the stretch's end
    last = st.select("img", "label", "y", "x1", "x2", F.explode(F.array(F.lit(EAST), F.lit(WEST))).alias("way"), (F.col("x2") + 1).alias("from"), (F.col("x2") + 1).alias("to"))
    covers = above.unionByName(below).unionByName(last)
    w = Window.partitionBy("img", "label", "y", "x1", "way").orderBy("from")
    free = covers.select("img", "label", "y", "way", "x1", "x2", F.coalesce(F.lag("to").over(w) + 1, F.col("x1")).alias("a"), F.col("from").alias("b")).where("a < b")
    line = F.when(F.col("way") == EAST, F.col("y")).otherwise(F.col("y") + 1)
    east = F.col("way") == EAST
    corner_a, corner_b = F.col("a") == F.col("x1"), F.col("b") == F.col("x2") + 1
    level = free.select(
        "img", "label", "way", line.alias("y"), F.when(east, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(east, F.col("b")).otherwise(F.col("a")).alias("ex"),
        # heading east it ends at a corner to the south, or at a step up; heading west the other way round
        F.when(east, F.when(corner_b, SOUTH).otherwise(NORTH)).otherwise(F.when(corner_a, NORTH).otherwise(SOUTH)).alias("next_way"),
        F.when(east, F.when(corner_a, NORTH).otherwise(SOUTH)).otherwise(F.when(corner_b, SOUTH).otherwise(NORTH)).alias("last_way"),
    )
    # an upright side begins where a level one ends, and ends where the next begins
    begins = level.select("img", "label", F.col("ex").alias("x"), "y", F.col("next_way").alias("way"), F.lit(1).alias("event"), F.lit(None).cast("int").alias("then"))
    ends = level.select("img", "label", "x", "y", F.col("last_way").alias("way"), F.lit(0).alias("event"), F.col("way").alias("then"))
    v = Window.partitionBy("img", "label", "x", "way").orderBy(F.when(F.col("way") == SOUTH, F.col("y")).otherwise(-F.col("y")), "event")
    upright = begins.unionByName(ends).select("*", F.lead("y").over(v).alias("ey"), F.lead("then").over(v).alias("next_way")).where("event = 1")
    return level.select("img", "label", "x", "y", "way", "ex", F.col("y").alias("ey"), "next_way").unionByName(upright.select("img", "label", "x", "y", "way", F.col("x").alias("ex"), "ey", "next_way"))


def rings(st: DataFrame) -> DataFrame:
    """Each side of `sides` with its ring (the place of the ring's first corner in raster order), n (its sides), and i, its own number from there.

    List ranking by doubling: a side knows the least corner among the next 2^k of its ring, and how far it is; a round joins it with what the side
    2^k further on knows.  After as many rounds as the longest ring's length has binary digits nothing changes any more."""
    here = lambda x, y, way: (F.col(y) * F.lit(_ROW) + F.col(x)) * 4 + F.col(way)
    with scope(st.sparkSession) as own:
        s = stored(sides(st).select("*", here("x", "y", "way").alias("id"), here("ex", "ey", "next_way").alias("next")))
        reach, known = 1, stored(s.select("img", "label", "id", F.col("next").alias("to"), F.col("id").alias("head"), F.lit(0).cast("long").alias("off")))
        while True:
            far = known.select("img", "label", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("head").alias("head2"), (F.col("off") + reach).alias("off2"))
            j = known.join(far, ["img", "label", "to"])
            closer = F.col("head2") < F.col("head")
            new = stored(j.select("img", "label", "id", F.col("to2").alias("to"), F.least("head", "head2").alias("head"), F.when(closer, F.col("off2")).otherwise(F.col("off")).alias("off"), closer.alias("moved")))
            done = new.where("moved").isEmpty()
            forget(known)
            known, reach = new.drop("moved"), reach * 2
            known.stored_at = new.stored_at
            if done:
                break
        lengths = known.groupBy("img", "label", "head").agg(F.count(F.lit(1)).alias("n"))
        out = s.join(known.drop("to"), ["img", "label", "id"]).join(lengths, ["img", "label", "head"])
        out = stored(out.select("img", "label", F.col("head").alias("ring"), ((F.col("n") - F.col("off")) % F.col("n")).alias("i"), "n", "x", "y", "ex", "ey"))
        own.release(out)
    return out


def ring_sizes(r: DataFrame) -> DataFrame:
    """Of each ring: corners, length and twice its signed area; outer rings are positive."""
    twice = F.sum(F.col("x") * F.col("ey") - F.col("ex") * F.col("y"))
    return r.groupBy("img", "label", "ring").agg(F.count(F.lit(1)).alias("corners"), F.sum(F.abs(F.col("ex") - F.col("x")) + F.abs(F.col("ey") - F.col("y"))).alias("length"), twice.alias("area2"))


def joined(st: DataFrame) -> DataFrame:
    """Stretches that may lie over each other, or side by side, as one each."""
    w = Window.partitionBy("img", "label", "y").orderBy("x1", "x2")
    apart = F.when(F.col("x1") > F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 1).otherwise(0)
    s = st.select("img", "label", "y", "x1", "x2", apart.alias("apart")).withColumn("island", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("img", "label", "y", "island").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("island")


def grown(st: DataFrame, radius: float, sizes: DataFrame) -> DataFrame:
    """Masks grown by a disc, within pictures of sizes (img, width, height): a stretch grows into one for each row of the disc."""
    r = int(radius)
    rows = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(int((radius * radius - dy * dy) ** 0.5)).alias("half")) for dy in range(-r, r + 1)))
    g = st.select("img", "label", "y", "x1", "x2", F.explode(rows).alias("d")).join(sizes, "img")
    g = g.select("img", "label", (F.col("y") + F.col("d.dy")).alias("y"), F.greatest(F.col("x1") - F.col("d.half"), F.lit(0)).alias("x1"), F.least(F.col("x2") + F.col("d.half"), F.col("width") - 1).alias("x2"), "height")
    return joined(g.where("y >= 0 and y < height"))


def outside(st: DataFrame, sizes: DataFrame) -> DataFrame:
    """What masks leave of their pictures; sizes: (img, label, width, height), a row for each mask, empty ones too."""
    rows = sizes.select("img", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("y"), F.col("width").cast("long").alias("x1"), F.col("width").cast("long").alias("x2"))
    w = Window.partitionBy("img", "label", "y").orderBy("x1")
    gaps = st.select("img", "label", "y", "x1", "x2").unionByName(rows).select("img", "label", "y", F.coalesce(F.lag("x2").over(w) + 1, F.lit(0)).cast("long").alias("a"), (F.col("x1") - 1).alias("b"))
    return gaps.where("a <= b").select("img", "label", "y", F.col("a").alias("x1"), F.col("b").alias("x2"))


def shrunk(st: DataFrame, radius: float, sizes: DataFrame) -> DataFrame:
    """Masks shrunk by a disc: what is left by the grown outside.  Beyond a picture's border nothing grows in."""
    return outside(grown(outside(st, sizes), radius, sizes.select("img", "width", "height").distinct()), sizes)


def background(pixels: DataFrame, white: int = 240) -> DataFrame:
    """Stretches (img, label 0) of the background of pictures (img, x, y, r, g, b, a): transparent pixels, and near-white ones that are connected with the
    border through others like them."""
    clear = F.col("a") < 128
    p = pixels.select("img", "x", "y", clear.alias("clear"), (clear | (F.least("r", "g", "b") >= white)).alias("open"))
    size = p.groupBy("img").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    mask = lambda c: of_pixels(p.where(c).select("img", "x", "y", F.lit(0).alias("label")))
    labeled = stored(parted(stored(mask("open"))))
    at_border = parts(labeled).join(size, "img").where("min_x = 0 or min_y = 0 or max_x = mx or max_y = my").select("img", "part")
    return joined(labeled.join(at_border, ["img", "part"], "left_semi").select("img", "label", "y", "x1", "x2").unionByName(mask("clear").select("img", "label", "y", "x1", "x2")))


def area_filter(found: DataFrame, colors: DataFrame, least: float = 300.0, contrast: float = 25.0) -> DataFrame:
    """Parts (img, label, part, area) with `kept`: those of `least` or more, and smaller ones down to a thirtieth of that (4 at least) if their colour (label,
    lab) stands far from another one; the others are what is left out."""
    a, b = colors.select("label", "lab"), colors.select(F.col("label").alias("other"), F.col("lab").alias("lab2"))
    far = a.crossJoin(F.broadcast(b)).where((F.col("label") != F.col("other")) & (X.delta_e2(F.col("lab"), F.col("lab2")) > contrast**2)).select("label").distinct().withColumn("stands_out", F.lit(True))
    rescued = F.coalesce("stands_out", F.lit(False)) & (F.col("area") >= max(4, int(least / 30 + 0.5)))
    # a palette has some ten colours
    return found.join(F.broadcast(far), "label", "left").withColumn("kept", (F.col("area") >= least) | rescued).drop("stands_out")
