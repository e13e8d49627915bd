"""Registered queries of label maps, pictures and text as whole tables: parts, rings, specks, centres, regions of text; with SQL for the same values."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators import color, paths, scan, stretches
from threadloom.sources import adapters as A
from threadloom.tables import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


_ROW = 1 << 32
_STRETCHES = f"""WITH RECURSIVE {A.PIXELS_SQL}, s0 AS (SELECT img, label, x, y, x - row_number() OVER (PARTITION BY img, y, label ORDER BY x) AS island FROM px),
ss AS (SELECT img, label::BIGINT AS label, y::BIGINT AS y, min(x)::BIGINT AS x1, max(x)::BIGINT AS x2, y::BIGINT * {_ROW} + min(x) AS node FROM s0 GROUP BY img, label, y, island),
lk AS (SELECT a.img, a.node AS u, b.node AS v FROM ss a JOIN ss b ON a.img = b.img AND a.label = b.label AND b.y = a.y + 1 AND a.x1 <= b.x2 AND b.x1 <= a.x2),
nb AS (SELECT img, u, v FROM lk UNION ALL SELECT img, v, u FROM lk),
-- from each stretch without a smaller neighbour to all larger ones that it can reach
re(img, seed, node) AS (
  SELECT img, node, node FROM ss WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.img = ss.img AND nb.u = ss.node AND nb.v < ss.node)
  UNION SELECT r.img, r.seed, n.v FROM re r JOIN nb n ON n.img = r.img AND n.u = r.node WHERE n.v > r.seed
), pp AS (SELECT img, node, min(seed) AS part FROM re GROUP BY img, node),
lb AS (SELECT ss.*, part FROM ss JOIN pp USING (img, node))"""


@query("picture_parts", _STRETCHES + " SELECT img, label, part, sum(x2 - x1 + 1)::BIGINT AS area, min(x1) AS min_x, max(x2) AS max_x, min(y) AS min_y, max(y) AS max_y FROM lb GROUP BY img, label, part")
def _(spark, d):
    return stretches.parts(stretches.parted(stored(stretches.of_pixels(A.pixels(spark, d)))))


@query("picture_rings", f"""WITH RECURSIVE {A.PIXELS_SQL}, s(way, dx, dy, sx, sy, ex, ey) AS (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)),
near AS (SELECT *, [lag(label) OVER c, lead(label) OVER r, lead(label) OVER c, lag(label) OVER r] AS beside FROM px WINDOW c AS (PARTITION BY img, x ORDER BY y), r AS (PARTITION BY img, y ORDER BY x)),
e0 AS (SELECT img, label::BIGINT AS label, way, (x + sx)::BIGINT AS x, (y + sy)::BIGINT AS y, (x + ex)::BIGINT AS ex, (y + ey)::BIGINT AS ey FROM near, s WHERE beside[way + 1] IS DISTINCT FROM label),
ed AS (SELECT *, (y * {_ROW} + x) * 4 + way AS id, count(*) OVER (PARTITION BY img, label, x, y) AS n FROM e0),
-- the next side: where there are two, the one to the right
nx AS (SELECT e.*, f.id AS next, f.way AS next_way FROM ed e JOIN ed f ON f.img = e.img AND f.label = e.label AND f.x = e.ex AND f.y = e.ey AND (f.n = 1 OR f.way = (e.way + 1) % 4)),
heads AS (SELECT f.* FROM nx e JOIN nx f ON f.img = e.img AND f.label = e.label AND f.id = e.next WHERE (e.way, f.way) IN ((3, 0), (2, 1))),
walk AS (
  SELECT img, label, id AS ring, next, (way <> next_way)::BIGINT AS corners, 1::BIGINT AS length, x * ey - ex * y AS area2 FROM heads WHERE next >= id
  UNION ALL
  SELECT w.img, w.label, w.ring, e.next, w.corners + (e.way <> e.next_way)::BIGINT, w.length + 1, w.area2 + e.x * e.ey - e.ex * e.y
  FROM walk w JOIN nx e ON e.img = w.img AND e.label = w.label AND e.id = w.next WHERE w.next > w.ring AND e.next >= w.ring
)
SELECT img, label, ring, corners, length, area2::BIGINT AS area2 FROM walk WHERE next = ring""")
def _(spark, d):
    """Corners, length and area of each boundary of each label."""
    return stretches.ring_sizes(stretches.rings(stored(stretches.of_pixels(A.pixels(spark, d)))))


#: Colours of the three labels: the second one stands far from the others.
_COLORS = ((0, 50.0, 0.0, 0.0), (1, 50.0, 90.0, 0.0), (2, 55.0, 0.0, 0.0))


@query("speckless_pictures", _STRETCHES + f""", ar AS (SELECT img, label, part, sum(x2 - x1 + 1)::BIGINT AS area FROM lb GROUP BY img, label, part),
pl AS (SELECT p.img, p.x, p.y, l.label, l.part FROM px p JOIN lb l ON l.img = p.img AND l.y = p.y AND p.x BETWEEN l.x1 AND l.x2),
ct AS (SELECT p.img, p.part, q.label AS beside, count(*) AS n, min((p.y * {_ROW} + p.x) * 4 + k) AS first FROM pl p, (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)) s(k, dx, dy), pl q
       WHERE q.img = p.img AND q.x = p.x + dx AND q.y = p.y + dy AND q.label <> p.label GROUP BY p.img, p.part, q.label),
-- no two small parts of these pictures touch each other, so none has to wait
bs AS (SELECT img, part, beside FROM (SELECT *, row_number() OVER (PARTITION BY img, part ORDER BY n DESC, first) AS k FROM ct) WHERE k = 1),
nw AS (SELECT a.*, CASE WHEN area < 16 AND beside IS NOT NULL AND NOT (area > 2 AND (label = 1 OR beside = 1)) THEN beside ELSE label END AS new FROM ar a LEFT JOIN bs USING (img, part))
SELECT img, part, new AS label, area, new <> label AS merged FROM nw""")
def _(spark, d):
    labeled = stored(stretches.parted(stored(stretches.of_pixels(A.pixels(spark, d)))))
    colors = spark.createDataFrame(_COLORS, "label long, l double, a double, b double").select("label", F.struct("l", "a", "b").alias("lab"))
    return stretches.without_specks(labeled, colors)


def _lab_sql(source: str) -> str:
    """l, a, b in millionths from r, g, b."""
    line = ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS l{c}" for c in "rgb")
    mixed = "(lr * 0.4124::DOUBLE + lg * 0.3576::DOUBLE + lb * 0.1805::DOUBLE) / 0.95047::DOUBLE AS x, lr * 0.2126::DOUBLE + lg * 0.7152::DOUBLE + lb * 0.0722::DOUBLE AS y, (lr * 0.0193::DOUBLE + lg * 0.1192::DOUBLE + lb * 0.9505::DOUBLE) / 1.08883::DOUBLE AS z"
    f = ", ".join(f"CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787::DOUBLE * {c} + 16.0::DOUBLE / 116.0::DOUBLE END AS f{c}" for c in "xyz")
    micro = lambda e, n: f"floor(({e}) * 1000000.0::DOUBLE + 0.5)::BIGINT AS {n}"
    return f"SELECT *, {micro('fy * 116.0::DOUBLE - 16.0::DOUBLE', 'l')}, {micro('(fx - fy) * 500.0::DOUBLE', 'a')}, {micro('(fy - fz) * 200.0::DOUBLE', 'b2')} FROM (SELECT *, {f} FROM (SELECT *, {mixed} FROM (SELECT *, {line} FROM {source})))"


def _centers_sql(k: int, rounds: int) -> str:
    d2 = "(p.l - c.l) * (p.l - c.l) + (p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b)"
    out = [f"WITH {A.PIXELS_SQL}, pd AS (SELECT img, r, g, b, count(*) AS n, min(y * 65536 + x) AS pos FROM px GROUP BY img, r, g, b)", f"pt AS (SELECT img, pos, n, l, a, b2 AS b FROM ({_lab_sql('pd')}))"]
    out.append("c0 AS (SELECT img, 0 AS place, arg_min(l, pos) AS l, arg_min(a, pos) AS a, arg_min(b, pos) AS b FROM pt GROUP BY img)")
    for j in range(1, k):
        out.append(f"f{j} AS (SELECT p.img, p.pos, p.l, p.a, p.b, min({d2}) AS d FROM pt p JOIN c{j - 1} c USING (img) GROUP BY ALL)")
        out.append(f"c{j} AS (SELECT * FROM c{j - 1} UNION ALL SELECT img, {j}, l, a, b FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY d DESC, pos) AS rk FROM f{j}) WHERE rk = 1 AND d > 0)")
    out.append(f"m0 AS (SELECT *, false AS done FROM c{k - 1})")
    for r in range(1, rounds + 1):
        out.append(f"a{r} AS (SELECT img, pos, n, l, a, b, place FROM (SELECT p.*, c.place, row_number() OVER (PARTITION BY p.img, p.pos ORDER BY {d2}, c.place) AS rk FROM pt p JOIN m{r - 1} c USING (img)) WHERE rk = 1)")
        mean = lambda c: f"((2 * sum({c} * n) + sum(n))::HUGEINT // (2 * sum(n)) - CASE WHEN (2 * sum({c} * n) + sum(n))::HUGEINT % (2 * sum(n)) < 0 THEN 1 ELSE 0 END)::BIGINT AS {c}"
        out.append(f"n{r} AS (SELECT img, place, {mean('l')}, {mean('a')}, {mean('b')} FROM a{r} GROUP BY img, place)")
        out.append(f"j{r} AS (SELECT m.img, m.place, m.l AS ol, m.a AS oa, m.b AS ob, m.done, coalesce(n.l, m.l) AS nl, coalesce(n.a, m.a) AS na, coalesce(n.b, m.b) AS nb FROM m{r - 1} m LEFT JOIN n{r} n USING (img, place))")
        out.append(f"m{r} AS (SELECT img, place, CASE WHEN done THEN ol ELSE nl END AS l, CASE WHEN done THEN oa ELSE na END AS a, CASE WHEN done THEN ob ELSE nb END AS b, done OR sum((nl - ol) * (nl - ol) + (na - oa) * (na - oa) + (nb - ob) * (nb - ob)) OVER (PARTITION BY img) < 10000000000 AS done FROM j{r})")
    milli = lambda c: f"floor({c} / 1000.0::DOUBLE + 0.5)::BIGINT AS {c}"
    return ", ".join(out) + f" SELECT img, place, {milli('l')}, {milli('a')}, {milli('b')} FROM m{rounds}"


@query("picture_centers", _centers_sql(3, 2))
def _(spark, d):
    """Three centres of each picture's colours, after two rounds, in thousandths."""
    px = A.pixels(spark, d).select("img", "r", "g", "b", (F.col("y").cast("long") * 65536 + F.col("x")).alias("pos"))
    return color.kmeans_by_picture(px, 3, 2).select("img", "place", *(X.round_half_up(F.col(c) / 1000.0).cast("long").alias(c) for c in "lab"))


def _font(spark):
    """Boxes of glyphs, by code; every fourth one has a hole."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = spark.range(33, 127).select(F.col("id").alias("c"), F.expr("char(id)").alias("char"))
    w, h = F.col("c") % 5 * 4 + 20, F.col("c") % 3 * 6 + 30
    zero, six = F.lit(0), F.lit(6)
    outer, hole = F.array(p(zero, -h), p(w, -h), p(w, zero), p(zero, zero)), F.array(p(six, -six), p(w - 6, -six), p(w - 6, 6 - h), p(six, 6 - h))
    letters = c.select("char", (w + 6).alias("advance"), F.when(F.col("c") % 4 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))
    return letters.unionByName(spark.range(1).select(F.lit(" ").alias("char"), F.lit(16).cast("long").alias("advance"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("rings")))


@query("text_regions", """WITH ch AS (SELECT p_partkey AS text_id, ascii(unnest(string_split(p_name, ''))) AS c FROM part), bx AS (SELECT text_id, c % 5 * 4 + 20 AS w, c % 3 * 6 + 30 AS h, c % 4 = 0 AS holed FROM ch WHERE c BETWEEN 33 AND 126)
SELECT text_id, cast(w * h - CASE WHEN holed THEN (w - 12) * (h - 12) ELSE 0 END AS BIGINT) AS area, cast(holed AS INTEGER) AS holes, count(*) AS n FROM bx GROUP BY ALL""")
def _(spark, d):
    """Areas and holes of the letters of each part's name, set along a line, scanned, and traced."""
    texts = A.table(spark, d, "part").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text"))
    r = scan.regions(scan.placed_outlines(texts, _font(spark), 84))
    return r.groupBy(F.col("img").alias("text_id"), F.col("area").cast("long").alias("area"), F.size("holes").alias("holes")).agg(F.count(F.lit(1)).alias("n"))


def _disc(spark, d):
    """The first label's pixels, and the sizes of pictures."""
    px = A.pixels(spark, d)
    sizes = px.select("img").distinct().select("img", F.lit(0).cast("long").alias("label"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    return stored(stretches.of_pixels(px.where("label = 0"))), sizes


def _summed(st):
    n = F.col("x2") - F.col("x1") + 1
    return st.groupBy("img").agg(F.sum(n).alias("pixels"), F.sum((F.col("x1") + F.col("x2")) * n * 31 + F.col("y") * n * 34).alias("check"))


@query("grown_pictures", f"""WITH {A.PIXELS_SQL}, dd AS (SELECT a.range AS dx, b.range AS dy FROM range(-3, 4) a, range(-3, 4) b WHERE a.range * a.range + b.range * b.range <= 9),
g AS (SELECT DISTINCT img, x + dx AS x, y + dy AS y FROM px, dd WHERE label = 0 AND x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 47) SELECT img, count(*) AS pixels, sum(x * 62 + y * 34)::BIGINT AS "check" FROM g GROUP BY img""")
def _(spark, d):
    st, sizes = _disc(spark, d)
    return _summed(stretches.grown(st, 3, sizes.drop("label")))


@query("shrunk_masks", f"""WITH {A.PIXELS_SQL}, dd AS (SELECT a.range AS dx, b.range AS dy FROM range(-2, 3) a, range(-2, 3) b WHERE a.range * a.range + b.range * b.range <= 4),
g AS (SELECT DISTINCT img, x + dx AS x, y + dy AS y FROM px, dd WHERE label <> 0) SELECT img, count(*) AS pixels, sum(x * 62 + y * 34)::BIGINT AS "check" FROM px WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.img = px.img AND g.x = px.x AND g.y = px.y) GROUP BY img""")
def _(spark, d):
    st, sizes = _disc(spark, d)
    return _summed(stretches.shrunk(st, 2, sizes))


#: The third label is white, and every seventh picture has a transparent spot.
_WHITE = f"""WITH RECURSIVE {A.PIXELS_SQL}, wp AS (SELECT img, x, y, img % 7 = 0 AND x BETWEEN 30 AND 33 AND y BETWEEN 22 AND 25 AS clear, label = 2 AS white FROM px),
op AS (SELECT *, clear OR white AS open FROM wp),
s0 AS (SELECT img, x, y, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS island FROM op WHERE open),
ss AS (SELECT img, y, min(x) AS x1, max(x) AS x2, y::BIGINT * {_ROW} + min(x) AS node FROM s0 GROUP BY img, y, island),
re(img, node) AS (
  SELECT img, node FROM ss WHERE y IN (0, 47) OR x1 = 0 OR x2 = 63
  UNION SELECT b.img, b.node FROM re JOIN ss a ON a.img = re.img AND a.node = re.node JOIN ss b ON b.img = a.img AND b.y IN (a.y - 1, a.y + 1) AND a.x1 <= b.x2 AND b.x1 <= a.x2
), hd AS (SELECT DISTINCT o.img, o.x, o.y FROM op o LEFT JOIN (SELECT ss.* FROM ss JOIN re USING (img, node)) s ON s.img = o.img AND s.y = o.y AND o.x BETWEEN s.x1 AND s.x2 WHERE o.clear OR s.img IS NOT NULL)"""


@query("background_pictures", _WHITE + ' SELECT img, count(*) AS pixels, sum(x * 62 + y * 34)::BIGINT AS "check" FROM hd GROUP BY img')
def _(spark, d):
    white = F.when(F.col("label") == 2, 255).otherwise(90)
    clear = (F.col("img") % 7 == 0) & F.col("x").between(30, 33) & F.col("y").between(22, 25)
    px = A.pixels(spark, d).select("img", "x", "y", *(white.alias(c) for c in "rgb"), F.when(clear, 0).otherwise(255).alias("a"))
    return _summed(stretches.background(px))


@query("part_filter", _STRETCHES + """, ar AS (SELECT img, label, part, sum(x2 - x1 + 1)::BIGINT AS area FROM lb GROUP BY img, label, part) SELECT img, label, part, area, area >= 300 OR area >= 10 AS kept FROM ar""")
def _(spark, d):
    """Of these colours each stands far from another."""
    labeled = stretches.parted(stored(stretches.of_pixels(A.pixels(spark, d))))
    colors = spark.createDataFrame(_COLORS, "label long, l double, a double, b double").select("label", F.struct("l", "a", "b").alias("lab"))
    return stretches.area_filter(stretches.parts(labeled), colors).select("img", "label", "part", "area", "kept")


@query("promoted_centers", f"""WITH RECURSIVE {A.PIXELS_SQL}, pq AS (SELECT img, x AS px, y AS py, r, g, b FROM px), lq AS ({_lab_sql('pq')}), pt AS (SELECT img, px AS x, py AS y, l, a, b2 AS b FROM lq),
cs AS (SELECT img, l, a, b FROM pt WHERE x = 0 AND y = 0), fa AS (SELECT p.* FROM pt p JOIN cs c USING (img) WHERE (p.l - c.l) * (p.l - c.l) + (p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b) > 1600000000000000),
s0 AS (SELECT img, x, y, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS island FROM fa), ss AS (SELECT img, y, min(x) AS x1, max(x) AS x2, y::BIGINT * {_ROW} + min(x) AS node FROM s0 GROUP BY img, y, island),
nb AS (SELECT a.img, a.node AS u, b.node AS v FROM ss a JOIN ss b ON a.img = b.img AND b.y IN (a.y - 1, a.y + 1) AND a.x1 <= b.x2 AND b.x1 <= a.x2),
re(img, seed, node) AS (SELECT img, node, node FROM ss WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.img = ss.img AND nb.u = ss.node AND nb.v < ss.node) UNION SELECT r.img, r.seed, n.v FROM re r JOIN nb n ON n.img = r.img AND n.u = r.node WHERE n.v > r.seed),
pp AS (SELECT img, node, min(seed) AS part FROM re GROUP BY img, node), bl AS (SELECT img, part, sum(x2 - x1 + 1) AS area FROM ss JOIN pp USING (img, node) GROUP BY img, part),
rk AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY area DESC, part) AS rank FROM bl WHERE area >= 4),
hit AS (SELECT f.img, rank, f.l, f.a, f.b FROM rk JOIN pp USING (img, part) JOIN ss USING (img, node) JOIN fa f ON f.img = ss.img AND f.y = ss.y AND f.x BETWEEN ss.x1 AND ss.x2 WHERE rank <= 4)
SELECT img, rank AS place, floor(avg(l) / 1000 + 0.5)::BIGINT AS l, floor(avg(a) / 1000 + 0.5)::BIGINT AS a, floor(avg(b) / 1000 + 0.5)::BIGINT AS b FROM hit GROUP BY img, rank""")
def _(spark, d):
    """Blobs that stand far from the colour of each picture's first pixel, in thousandths."""
    px = A.pixels(spark, d).select("img", "x", "y", "r", "g", "b")
    one = color.kmeans_by_picture(px.where("x = 0 and y = 0").withColumn("pos", F.lit(0)), 1, 1)
    return color.promoted(px, one, 40.0).select("img", F.col("place").cast("long").alias("place"), *(X.round_half_up(F.col(c) / 1000.0).cast("long").alias(c) for c in "lab"))


_KEYS = ["design_id", "block_idx", "run_idx"]


def _runs(spark, d):
    return A.stitches(spark, d).select(*_KEYS, F.col("seq").alias("i"), "x", "y")


_EDGES = f"""WITH {A.STITCHES_SQL}, ed AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(seq) OVER w IS NULL AS last FROM st WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)),
el AS (SELECT *, floor(sqrt((nx - x)::DOUBLE * (nx - x) + (ny - y)::DOUBLE * (ny - y)) * 1000 + 0.5)::BIGINT AS len FROM ed),
es AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY design_id, block_idx, run_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s0, coalesce(sum(len) OVER (PARTITION BY design_id, block_idx, run_idx), 0)::BIGINT AS total FROM el)"""


def _even_sql(spacing: int) -> str:
    return f""", en AS (SELECT *, greatest(1, floor(total / {1000 * spacing}.0::DOUBLE + 0.5))::BIGINT AS n FROM es),
ek AS (SELECT *, unnest(range((s0 * n + total - 1) // total, ((s0 + len) * n + total - 1) // total)) AS k FROM en WHERE total > 0 AND len > 0),
ev AS (SELECT design_id, block_idx, run_idx, k, x + (nx - x) * ((k * total - s0 * n)::DOUBLE / (n * len)::DOUBLE) AS x, y + (ny - y) * ((k * total - s0 * n)::DOUBLE / (n * len)::DOUBLE) AS y FROM ek WHERE k < n
  UNION ALL SELECT design_id, block_idx, run_idx, n, x, y FROM en WHERE last AND total > 0 UNION ALL SELECT design_id, block_idx, run_idx, 0, x, y FROM en WHERE seq = 0 AND total = 0)"""


@query("running_runs", _EDGES + _even_sql(25) + """, ps AS (SELECT *, max(k) OVER (PARTITION BY design_id, block_idx, run_idx) AS n, unnest(range(0, 3)) AS pass FROM ev),
q AS (SELECT *, pass * n + CASE pass % 2 WHEN 0 THEN k ELSE n - k END AS seq FROM ps)
SELECT design_id, block_idx, run_idx, seq, floor(x + 0.5)::INT AS x, floor(y + 0.5)::INT AS y FROM q WHERE pass = 0 OR seq > pass * n""")
def _(spark, d):
    """Runs sewn evenly, forth, back and forth again."""
    return paths.running(_runs(spark, d), _KEYS, 25, passes=3)


@query("stepped_runs", _EDGES + """, n AS (SELECT *, greatest(1, ceil(sqrt((nx - x)::DOUBLE * (nx - x) + (ny - y)::DOUBLE * (ny - y)) / 25))::BIGINT AS n FROM ed WHERE nx IS NOT NULL),
p AS (SELECT *, unnest(range(1, n + 1)) AS part FROM n)
SELECT design_id, block_idx, run_idx, seq AS i, part, floor((x + (nx - x) * (part::DOUBLE / n)) * 1000 + 0.5)::BIGINT AS x, floor((y + (ny - y) * (part::DOUBLE / n)) * 1000 + 0.5)::BIGINT AS y FROM p UNION ALL SELECT design_id, block_idx, run_idx, seq, 0, x * 1000, y * 1000 FROM st WHERE seq = 0""")
def _(spark, d):
    return paths.stepped(_runs(spark, d), _KEYS, 25).select(*_KEYS, "i", "part", X.milli("x").alias("x"), X.milli("y").alias("y"))


def _unit_sql(dx: str, dy: str, names: tuple[str, str]) -> str:
    size = f"sqrt(({dx})::DOUBLE * ({dx}) + ({dy})::DOUBLE * ({dy}))"
    return ", ".join(f"CASE WHEN {size} > 0 THEN ({v}) / {size} ELSE 0.0::DOUBLE END AS {n}" for v, n in zip((dx, dy), names, strict=True))


_NORMALS = f""", p0 AS (SELECT design_id, block_idx, run_idx, seq, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM st WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)),
p1 AS (SELECT design_id, block_idx, run_idx, seq, x, y FROM p0 WHERE px IS NULL OR px <> x OR py <> y),
p2 AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, count(*) OVER (PARTITION BY design_id, block_idx, run_idx) AS n FROM p1 WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)),
p3 AS (SELECT *, {_unit_sql('ax', 'ay', ('ux', 'uy'))}, {_unit_sql('bx', 'by_', ('vx', 'vy'))} FROM p2 WHERE n > 1),
p4 AS (SELECT *, {_unit_sql('coalesce(ux, 0) + coalesce(vx, 0)', 'coalesce(uy, 0) + coalesce(vy, 0)', ('mx', 'my'))} FROM p3)"""


@query("run_ribbons", f"WITH {A.STITCHES_SQL}" + _NORMALS + """, r AS (SELECT design_id, block_idx, run_idx, seq, unnest([1, -1]) AS side, x, y, mx, my, max(seq) OVER (PARTITION BY design_id, block_idx, run_idx) AS top FROM p4)
SELECT design_id, block_idx, run_idx, CASE side WHEN 1 THEN seq ELSE 2 * top + 1 - seq END AS i, floor((x - my * 5.0::DOUBLE * side) * 1000 + 0.5)::BIGINT AS x, floor((y + mx * 5.0::DOUBLE * side) * 1000 + 0.5)::BIGINT AS y FROM r""")
def _(spark, d):
    """Runs as strokes of a millimetre's width."""
    return paths.ribbon(_runs(spark, d), _KEYS, 5.0).select(*_KEYS, "i", X.milli("x").alias("x"), X.milli("y").alias("y"))


@query("run_columns", _EDGES + _even_sql(40) + f""", c0 AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lead(x) OVER w AS rx, lead(y) OVER w AS ry, count(*) OVER (PARTITION BY design_id, block_idx, run_idx) AS m FROM ev WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY k)),
c1 AS (SELECT *, {_unit_sql('coalesce(rx, x) - coalesce(lx, x)', 'coalesce(ry, y) - coalesce(ly, y)', ('mx', 'my'))} FROM c0 WHERE m > 1),
c2 AS (SELECT design_id, block_idx, run_idx, k, x - my * 30 / 2 AS ax, y + mx * 30 / 2 AS ay, x + my * 30 / 2 AS bx, y - mx * 30 / 2 AS by_ FROM c1),
c3 AS (SELECT *, lag(ax) OVER w AS pax, lag(ay) OVER w AS pay, lag(bx) OVER w AS pbx, lag(by_) OVER w AS pby FROM c2 WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY k)),
c4 AS (SELECT *, sqrt((ax - pax) * (ax - pax) + (ay - pay) * (ay - pay)) AS da, sqrt((bx - pbx) * (bx - pbx) + (by_ - pby) * (by_ - pby)) AS db FROM c3),
c5 AS (SELECT *, CASE WHEN pax IS NULL THEN 1 WHEN least(da, db) > 1 AND greatest(da, db) / least(da, db) >= 2 THEN least(floor(greatest(da, db) / least(da, db) + 0.5), 4) ELSE 1 END::BIGINT AS cut FROM c4),
c6 AS (SELECT *, unnest(range(1, cut + 1)) AS part FROM c5), c7 AS (SELECT *, unnest([0, 1]) AS side FROM c6)
SELECT design_id, block_idx, run_idx, row_number() OVER (PARTITION BY design_id, block_idx, run_idx ORDER BY k, part, side) - 1 AS seq,
floor(CASE side WHEN 0 THEN CASE WHEN pax IS NULL THEN ax ELSE pax + (ax - pax) * (part::DOUBLE / cut) END ELSE CASE WHEN pbx IS NULL THEN bx ELSE pbx + (bx - pbx) * (part::DOUBLE / cut) END END + 0.5)::INT AS x,
floor(CASE side WHEN 0 THEN CASE WHEN pay IS NULL THEN ay ELSE pay + (ay - pay) * (part::DOUBLE / cut) END ELSE CASE WHEN pby IS NULL THEN by_ ELSE pby + (by_ - pby) * (part::DOUBLE / cut) END END + 0.5)::INT AS y FROM c7""")
def _(spark, d):
    """Columns of satin along runs, three millimetres wide."""
    return paths.satin(_runs(spark, d), _KEYS, 30.0, 40)


@query("ready_runs", f"""WITH RECURSIVE {A.STITCHES_SQL}, sn AS (SELECT *, count(*) OVER (PARTITION BY design_id, block_idx, run_idx) AS n FROM (SELECT design_id, block_idx, run_idx, seq, floor(x / 20.0::DOUBLE)::INT * 4 AS x, floor(y / 20.0::DOUBLE)::INT * 4 AS y FROM st)),
kp(design_id, block_idx, run_idx, seq, x, y, kept, lx, ly) AS (
  SELECT design_id, block_idx, run_idx, seq, x, y, true, x, y FROM sn WHERE seq = 0 AND n > 1
  UNION ALL
  SELECT s.design_id, s.block_idx, s.run_idx, s.seq, s.x, s.y, k, CASE WHEN k THEN s.x ELSE lx END, CASE WHEN k THEN s.y ELSE ly END FROM (
    SELECT s.*, p.lx, p.ly, (s.x - p.lx) * (s.x - p.lx) + (s.y - p.ly) * (s.y - p.ly) >= 25 OR (s.seq = s.n - 1 AND (s.x <> p.lx OR s.y <> p.ly)) AS k FROM kp p JOIN sn s ON s.design_id = p.design_id AND s.block_idx = p.block_idx AND s.run_idx = p.run_idx AND s.seq = p.seq + 1) s
), kq AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM kp WHERE kept WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)),
kr AS (SELECT *, CASE WHEN sqrt((x - px)::DOUBLE * (x - px) + (y - py)::DOUBLE * (y - py)) > 121 THEN ceil(sqrt((x - px)::DOUBLE * (x - px) + (y - py)::DOUBLE * (y - py)) / 121) ELSE 1 END::BIGINT AS m FROM kq), ks AS (SELECT *, unnest(range(1, m + 1)) AS part FROM kr)
SELECT design_id, block_idx, run_idx, row_number() OVER (PARTITION BY design_id, block_idx, run_idx ORDER BY seq, part) - 1 AS seq, CASE WHEN px IS NULL THEN x ELSE floor(px + (x - px) * (part::DOUBLE / m) + 0.5) END::INT AS x, CASE WHEN py IS NULL THEN y ELSE floor(py + (y - py) * (part::DOUBLE / m) + 0.5) END::INT AS y FROM ks""")
def _(spark, d):
    """Runs on a coarse grid, of which some points lie on each other."""
    coarse = lambda c: F.expr(f"cast(floor({c} / 20.0) * 4 as int)").alias(c)
    return paths.finished(_runs(spark, d).select(*_KEYS, "i", coarse("x"), coarse("y")), _KEYS)


@query("inset_rings", f"""WITH {A.OUTLINES_SQL}, o AS (SELECT poly, i, x, y, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lead(x) OVER w AS rx, lead(y) OVER w AS ry, first_value(x) OVER v AS fx, first_value(y) OVER v AS fy, last_value(x) OVER v AS zx, last_value(y) OVER v AS zy FROM poly WHERE ring = 0
  WINDOW w AS (PARTITION BY poly ORDER BY i), v AS (PARTITION BY poly ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, {_unit_sql('x - coalesce(lx, zx)', 'y - coalesce(ly, zy)', ('ux', 'uy'))}, {_unit_sql('coalesce(rx, fx) - x', 'coalesce(ry, fy) - y', ('vx', 'vy'))} FROM o), m AS (SELECT *, {_unit_sql('ux + vx', 'uy + vy', ('mx', 'my'))} FROM u)
SELECT poly, i, floor((x - my * 8) * 1000 + 0.5)::BIGINT AS x, floor((y + mx * 8) * 1000 + 0.5)::BIGINT AS y FROM m""")
def _(spark, d):
    o = A.outlines(spark, d).where("ring = 0").select("poly", "i", "x", "y")
    return paths.offset(o, ["poly"], 8.0).select("poly", "i", X.milli("x").alias("x"), X.milli("y").alias("y"))


_RINGED = f"""WITH {A.STITCHES_SQL}, rg AS (SELECT *, count(*) OVER (PARTITION BY design_id, block_idx, run_idx) AS n FROM st),
re AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lag(x) OVER w, last_value(x) OVER v) AS px, coalesce(lag(y) OVER w, last_value(y) OVER v) AS py FROM rg
  WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq), v AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _side(o: tuple, q: tuple, r: tuple) -> str:
    return f"sign(({q[0]} - {o[0]})::BIGINT * ({r[1]} - {o[1]}) - ({q[1]} - {o[1]})::BIGINT * ({r[0]} - {o[0]}))"


_A, _AN, _B, _BN = ("a.x", "a.y"), ("a.nx", "a.ny"), ("b.x", "b.y"), ("b.nx", "b.ny")


@query("run_crossings", _RINGED + f"""SELECT design_id, block_idx, run_idx, a.seq AS i, b.seq AS j FROM re a JOIN re b USING (design_id, block_idx, run_idx) WHERE b.seq - a.seq >= 2 AND NOT (a.seq = 0 AND b.seq = a.n - 1)
AND {_side(_A, _AN, _B)} * {_side(_A, _AN, _BN)} < 0 AND {_side(_B, _BN, _A)} * {_side(_B, _BN, _AN)} < 0""")
def _(spark, d):
    """Runs as rings: where they cross themselves."""
    return paths.crossings(_runs(spark, d), _KEYS)


@query("cut_corners", _RINGED + """, tn AS (SELECT *, sqrt((x - px)::DOUBLE * (x - px) + (y - py)::DOUBLE * (y - py)) AS la, sqrt((nx - x)::DOUBLE * (nx - x) + (ny - y)::DOUBLE * (ny - y)) AS lb FROM re),
sh AS (SELECT *, la > 0 AND lb > 0 AND degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (la * lb))))) >= 60 AS sharp FROM tn)
SELECT design_id, block_idx, run_idx, seq AS i, part, floor((CASE WHEN sharp THEN x WHEN part = 0 THEN x + (px - x) * 0.25::DOUBLE ELSE x + (nx - x) * 0.25::DOUBLE END) * 1000 + 0.5)::BIGINT AS x, floor((CASE WHEN sharp THEN y WHEN part = 0 THEN y + (py - y) * 0.25::DOUBLE ELSE y + (ny - y) * 0.25::DOUBLE END) * 1000 + 0.5)::BIGINT AS y
FROM sh, (VALUES (0), (1)) t(part) WHERE part = 0 OR NOT sharp""")
def _(spark, d):
    return paths.corners_cut(_runs(spark, d), _KEYS).select(*_KEYS, "i", "part", X.milli("x").alias("x"), X.milli("y").alias("y"))


@query("pulled_rings", f"""WITH {A.OUTLINES_SQL}, b AS (SELECT poly, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM poly WHERE ring = 0 GROUP BY poly)
SELECT p.poly, i, CASE WHEN x = x0 THEN x0 + 3 ELSE x1 - 3 END::BIGINT AS x, CASE WHEN y = y0 THEN y0 - 4 ELSE y1 + 4 END::BIGINT AS y FROM poly p JOIN b USING (poly) WHERE ring = 0""")
def _(spark, d):
    """Outlines shortened by three units along level rows and widened by four across them, on each side."""
    o = A.outlines(spark, d).where("ring = 0").select("poly", "i", "x", "y")
    return paths.pulled(o, ["poly"], 4.0, 3.0).select("poly", "i", *(X.round_half_up(c).cast("long").alias(c) for c in "xy"))


@query("row_stitches", f"""WITH {A.PIXELS_SQL}, s0 AS (SELECT img, label, x, y, x - row_number() OVER (PARTITION BY img, y, label ORDER BY x) AS island FROM px), s1 AS (SELECT img, label::BIGINT AS label, y::BIGINT AS y, min(x) * 10 AS x1, max(x) * 10 + 10 AS x2 FROM s0 GROUP BY img, label, y, island),
s2 AS (SELECT *, x1 + CASE y % 2 WHEN 1 THEN 15 ELSE 30 END AS s FROM s1), s3 AS (SELECT *, greatest(0, ceil((x2 - 7.5::DOUBLE - s) / 30))::BIGINT AS n FROM s2), s4 AS (SELECT *, unnest(range(0, n + 2)) AS k, floor(y * 10 + 0.5::DOUBLE) * 0.137::DOUBLE + (y % 2) * 7 AS base FROM s3),
s5 AS (SELECT *, sin((base + (k - 1)) * 127.1::DOUBLE + 311.7::DOUBLE) * 43758.5453::DOUBLE AS q FROM s4)
SELECT img, label, y, x1, k, floor(CASE WHEN k = 0 THEN x1 WHEN k > n THEN x2 ELSE greatest(x1 + 7.5::DOUBLE, least(x2 - 7.5::DOUBLE, s + (k - 1) * 30 + ((q - floor(q)) * 2 - 1) * 6.0::DOUBLE)) END * 100 + 0.5)::BIGINT AS x100 FROM s5""")
def _(spark, d):
    """Stretches of labels, a millimetre a pixel, as rows of a fill."""
    st = stretches.of_pixels(A.pixels(spark, d)).select("img", "label", (F.col("y") * 10).alias("y"), F.col("y").alias("row"), (F.col("x1") * 10).alias("x1"), (F.col("x2") * 10 + 10).alias("x2"))
    return paths.row_points(st, 30.0).select("img", "label", F.col("row").alias("y"), "x1", "k", X.round_half_up(F.col("x") * 100).cast("long").alias("x100"))
