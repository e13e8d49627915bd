"""Registered queries of plans as documents and of designs that no one task holds, with SQL for the same values."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import edits, fits, library, nested, plan, raster, reading, simplify, wide
from threadloom.plans import queries as kernel_queries
from threadloom.sources import adapters as A
from threadloom.sources import formats
from threadloom.streaming import recompile
from threadloom.tables import current

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Queries that have the rows of another one, and so its SQL.
SAME_AS: dict[str, str] = {}


def query(name: str, sql: str | None = None, same_as: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        if same_as is not None:
            SAME_AS[name] = same_as
        return f

    return keep


@query("machine_ops_in_stretches", same_as="machine_ops")
def _(spark, d):
    return wide.operations(A.stitches(spark, d))


@query("sequence_in_stretches", same_as="sequence_view")
def _(spark, d):
    s = A.stitches(spark, d)
    return plan.sequence(s, wide.runs(s))


@query("flat_moves_in_stretches", same_as="flat_moves")
def _(spark, d):
    return wide.flat_moves(A.stitches(spark, d))


#: A run is empty, and so is a block, by its numbers.
_NESTED = f"""WITH {A.STITCHES_SQL}, rr0 AS (
  SELECT design_id, block_idx, run_idx, any_value(thread) AS thread, count(*) AS n, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1 FROM st GROUP BY ALL
), rr1 AS (
  SELECT *, lag(x1) OVER w AS px, lag(y1) OVER w AS py FROM rr0 WINDOW w AS (PARTITION BY design_id ORDER BY block_idx, run_idx)
), rr2 AS (
  SELECT *, CASE WHEN px IS NULL THEN 'trim' WHEN (x0 - px)::BIGINT * (x0 - px) + (y0 - py)::BIGINT * (y0 - py) < 900 THEN 'continuous' WHEN (x0 - px)::BIGINT * (x0 - px) + (y0 - py)::BIGINT * (y0 - py) < 250000 THEN 'jump' ELSE 'trim' END AS connection,
         (design_id + block_idx) % 7 = 0 AS no_block, (design_id + block_idx + run_idx) % 5 = 0 AS no_run FROM rr1
), held AS (SELECT * FROM rr2 WHERE NOT no_block),
sewn AS (SELECT design_id, block_idx, run_idx, connection, n, x0, y0, lag(x1) OVER w AS qx, lag(y1) OVER w AS qy, lag(block_idx) OVER w AS qblock FROM held WHERE NOT no_run WINDOW w AS (PARTITION BY design_id ORDER BY block_idx, run_idx)),
steps AS (SELECT *, (x0 - qx)::BIGINT * (x0 - qx) + (y0 - qy)::BIGINT * (y0 - qy) AS d2, run_idx = 0 OR qblock IS NULL OR qblock <> block_idx AS begins FROM sewn)"""


def _plans(spark, d):
    s = A.stitches(spark, d)
    r = plan.runs(s)
    no_block, no_run = (F.col("design_id") + F.col("block_idx")) % 7 == 0, (F.col("design_id") + F.col("block_idx") + F.col("run_idx")) % 5 == 0
    plans = nested.of_rows(s.where(~no_run), r)
    # an empty block keeps its thread
    empty = F.array().cast(plans.schema["blocks"].dataType.elementType["runs"].dataType)
    return plans.select("design_id", F.transform("blocks", lambda b, i: F.struct(b["thread"].alias("thread"), F.when((F.col("design_id") + i) % 7 == 0, empty).otherwise(b["runs"]).alias("runs"))).alias("blocks"))


@query("nested_counts", _NESTED + """, a AS (SELECT design_id, count(DISTINCT block_idx) AS palette FROM rr2 GROUP BY design_id),
b AS (SELECT design_id, count(*) FILTER (run_idx > 0 AND connection = 'trim') AS trims_marked FROM held GROUP BY design_id),
c AS (SELECT design_id, sum(n)::BIGINT AS stitches, count(*) FILTER (qx IS NOT NULL AND run_idx > 0 AND connection = 'trim') AS trims_sewn, count(*) FILTER (qx IS NOT NULL AND run_idx > 0 AND connection = 'jump') AS jumps,
      count(*) FILTER (CASE WHEN begins THEN block_idx > 0 ELSE connection = 'trim' END) AS trims_in_order, count(*) FILTER (qx IS NOT NULL AND CASE WHEN run_idx = 0 THEN d2 > 0 ELSE connection IN ('trim', 'jump') END) AS travels,
      coalesce(sum(floor(sqrt(d2::DOUBLE) * 1000 + 0.5)) FILTER (qx IS NOT NULL AND CASE WHEN run_idx = 0 THEN d2 > 0 ELSE connection IN ('trim', 'jump') END), 0)::BIGINT AS travel_total, count(DISTINCT block_idx) AS sewn_blocks FROM steps GROUP BY design_id)
SELECT design_id, coalesce(stitches, 0)::BIGINT AS stitches, coalesce(trims_marked, 0)::BIGINT AS trims_marked, coalesce(trims_sewn, 0)::BIGINT AS trims_sewn, coalesce(trims_in_order, 0)::BIGINT AS trims_in_order, coalesce(jumps, 0)::BIGINT AS jumps, coalesce(travels, 0)::BIGINT AS travels,
       coalesce(travel_total, 0)::BIGINT AS travel_total, greatest(palette - 1, 0)::BIGINT AS color_changes, greatest(coalesce(sewn_blocks, 0) - 1, 0)::BIGINT AS colors_sewn_changes, palette FROM a LEFT JOIN b USING (design_id) LEFT JOIN c USING (design_id)""")
def _(spark, d):
    return nested.counts(_plans(spark, d))


@query("nested_rows", _NESTED + """, bl AS (SELECT DISTINCT design_id, block_idx, thread, no_block FROM rr2)
SELECT b.design_id, b.block_idx, b.thread, r.run_idx, r.connection, s.seq, s.x, s.y FROM bl b LEFT JOIN held r ON r.design_id = b.design_id AND r.block_idx = b.block_idx AND NOT b.no_block
LEFT JOIN st s ON s.design_id = r.design_id AND s.block_idx = r.block_idx AND s.run_idx = r.run_idx AND NOT r.no_run""")
def _(spark, d):
    return nested.rows(_plans(spark, d))


@query("nested_gaps", _NESTED + """, gp AS (SELECT design_id, connection, no_run, lag(no_run) OVER w AS before, (x0 - lag(x1) OVER w)::BIGINT AS gx, (y0 - lag(y1) OVER w)::BIGINT AS gy FROM held WINDOW w AS (PARTITION BY design_id, block_idx ORDER BY run_idx)),
gd AS (SELECT design_id, count(*) FILTER (connection = 'continuous' AND gx * gx + gy * gy > 121 * 121) AS continuous_too_far, count(*) FILTER (connection = 'jump' AND gx * gx + gy * gy > 250000) AS long_jumps FROM gp WHERE NOT no_run AND NOT before GROUP BY design_id)
SELECT design_id, coalesce(continuous_too_far, 0)::BIGINT AS continuous_too_far, coalesce(long_jumps, 0)::BIGINT AS long_jumps FROM (SELECT DISTINCT design_id FROM rr2) LEFT JOIN gd USING (design_id)""")
def _(spark, d):
    return nested.gaps(_plans(spark, d))


@query("dst_points_in_stretches", f"""WITH {A.STITCHES_SQL} SELECT design_id, (row_number() OVER (PARTITION BY design_id ORDER BY block_idx, run_idx, seq) - 1)::BIGINT AS rec, x::BIGINT AS x, y::BIGINT AS y FROM st""")
def _(spark, d):
    """Moves of all stitches, added up again."""
    order = ["block_idx", "run_idx", "seq"]
    s = wide.scanned(wide.dealt(A.stitches(spark, d), ["design_id"], order), ["design_id"], order, sums={"no": F.lit(1)}, before={"px": "x", "py": "y"})
    moves = s.select("design_id", (F.col("no") - 1).alias("rec"), (F.col("x") - F.coalesce("px", F.lit(0))).alias("dx"), (F.coalesce("py", F.lit(0)) - F.col("y")).alias("dy"), F.lit("stitch").alias("kind"))
    return wide.dst_points(moves)


def _written(spark, d, kind):
    """Plans written as files of a kind and read back."""
    formats.register(spark)
    path = current(spark).new_path(kind)
    formats.clustered(kernel_queries.plan_rows(spark, d)).write.format(kind).mode("append").save(path)
    return spark.read.format(kind).load(path).withColumn("design_id", F.regexp_extract("file", r"design-(-?\d+)\.", 1).cast("long"))


@query("dst_source", same_as="file_roundtrip")
def _(spark, d):
    """Records of the files, and where their stitches land."""
    r = _written(spark, d, "dst")
    p = wide.scanned(wide.dealt(r, ["design_id"], ["rec"]), ["design_id"], ["rec"], sums={"x": "dx", "down": "dy"}).withColumn("y", -F.col("down"))
    sewn = F.col("kind") == "stitch"
    return p.groupBy("design_id").agg(F.count("rec").alias("dst_records"), F.count_if(F.col("kind") == "colorChange").alias("color_changes"), F.count_if(sewn).alias("dst_stitches"), F.sum(F.when(sewn, F.col("x") * 31 + F.col("y") * 17)).alias("dst_check"), F.count("error").alias("errors"))


@query("pes_source", same_as="file_roundtrip")
def _(spark, d):
    r = _written(spark, d, "pes")
    p = wide.scanned(wide.dealt(r, ["design_id"], ["rec"]), ["design_id"], ["rec"], sums={"x": "dx", "y": "dy"})
    sewn = F.col("kind") == "stitch"
    return p.groupBy("design_id").agg(F.count_if(sewn).alias("pes_stitches"), F.sum(F.when(sewn, F.col("x") * 31 + F.col("y") * 17)).alias("pes_check"), F.size(F.any_value("palette")).cast("long").alias("pes_colors"), F.count("error").alias("errors"))


#: What two sources have of that query's figures.
PART_OF = {"dst_source": "design_id, dst_records, color_changes, dst_stitches, dst_check, 0::BIGINT AS errors", "pes_source": "design_id, pes_stitches, pes_check, pes_colors, 0::BIGINT AS errors"}


_SIX_HOURS = 6 * 3600 * 1000


@query("debounced_edits", f"""WITH e AS (SELECT user_id AS design_id, epoch_us(ts) AS us, event_id FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY design_id ORDER BY us, event_id) <= {_SIX_HOURS * 1000} THEN 0 ELSE 1 END AS b FROM e),
s AS (SELECT *, sum(b) OVER (PARTITION BY design_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
t AS (SELECT design_id, min(us) AS first_us, max(us) AS last_us, count(*) AS edits FROM s GROUP BY design_id, k)
SELECT design_id, first_us, last_us, edits FROM t WHERE last_us // 1000 + {_SIX_HOURS} + 1 < (SELECT max(us) // 1000 FROM e)""")
def _(spark, d):
    """Events as edits: designs that were left alone for six hours."""
    out = recompile.run_stream(spark, d, lambda e: e.select(F.col("user_id").alias("design_id"), F.col("ts").cast("timestamp").alias("at")), _SIX_HOURS, "events.parquet")
    return out.select("design_id", F.unix_micros("first_edit").alias("first_us"), F.unix_micros("last_edit").alias("last_us"), "edits")


@query("library_pages", f"WITH {A.LIBRARY_SQL} SELECT id, row_number() OVER (ORDER BY updated DESC, id) AS rank, ((row_number() OVER (ORDER BY updated DESC, id)) - 1) // 50 + 1 AS page FROM lib")
def _(spark, d):
    return library.pages(A.library(spark, d).select("id", "updated")).select("id", "rank", "page")


@query("dominant_colors", f"""WITH {A.PIXELS_SQL}, g AS (SELECT img, r, g, b, count(*) AS n, min(y * 65536 + x) AS first FROM px GROUP BY img, r, g, b)
SELECT img, rank, r, g, b, n FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, first) AS rank FROM g) WHERE rank <= 8""")
def _(spark, d):
    return raster.dominant_colors(A.pixels(spark, d))


def _gap_sql(p: str, a: str, b: str) -> str:
    dx, dy, wx, wy = f"({b}.x - {a}.x)::DOUBLE", f"({b}.y - {a}.y)::DOUBLE", f"({p}.x - {a}.x)::DOUBLE", f"({p}.y - {a}.y)::DOUBLE"
    t = f"(CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({wx} * {dx} + {wy} * {dy}) / ({dx} * {dx} + {dy} * {dy}))) ELSE 0.0::DOUBLE END)"
    return f"({wx} - {t} * {dx}) * ({wx} - {t} * {dx}) + ({wy} - {t} * {dy}) * ({wy} - {t} * {dy})"


_TOLERANCE = 150


@query("run_nodes", f"""WITH RECURSIVE {A.STITCHES_SQL}, sp AS (SELECT design_id * 1000000 + block_idx * 10000 + run_idx AS path, seq, x, y FROM st),
seg(path, lo, hi) AS (
  SELECT path, 0::BIGINT, max(seq) FROM sp GROUP BY path
  UNION ALL
  SELECT path, CASE side WHEN 0 THEN lo ELSE m END, CASE side WHEN 0 THEN m ELSE hi END FROM (
    SELECT s.path, s.lo, s.hi, p.seq AS m, {_gap_sql('p', 'a', 'b')} AS gap, row_number() OVER (PARTITION BY s.path, s.lo ORDER BY {_gap_sql('p', 'a', 'b')} DESC, p.seq) AS k
    FROM seg s JOIN sp p ON p.path = s.path AND p.seq > s.lo AND p.seq < s.hi JOIN sp a ON a.path = s.path AND a.seq = s.lo JOIN sp b ON b.path = s.path AND b.seq = s.hi
  ) f, range(0, 2) t(side) WHERE k = 1 AND gap > {_TOLERANCE * _TOLERANCE}
), kept AS (SELECT DISTINCT path, lo AS seq FROM seg UNION SELECT path, hi FROM seg),
nd AS (SELECT st.*, kept.path, st.x - lag(st.x) OVER w AS ax, st.y - lag(st.y) OVER w AS ay, lead(st.x) OVER w - st.x AS bx, lead(st.y) OVER w - st.y AS by_ FROM kept JOIN st ON kept.path = design_id * 1000000 + block_idx * 10000 + run_idx AND kept.seq = st.seq WINDOW w AS (PARTITION BY kept.path ORDER BY kept.seq)),
tn AS (SELECT *, sqrt((ax * ax + ay * ay)::DOUBLE) AS la, sqrt((bx * bx + by_ * by_)::DOUBLE) AS lb FROM nd)
SELECT design_id, block_idx, run_idx, seq, x, y, NOT (ax IS NULL OR bx IS NULL OR (la > 0 AND lb > 0 AND degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ax * bx + ay * by_) / (la * lb))))) >= 50)) AS smooth FROM tn""")
def _(spark, d):
    """Runs without the points that lie near what is left, as nodes."""
    keys = ["design_id", "block_idx", "run_idx"]
    return simplify.nodes(A.stitches(spark, d).select(*keys, F.col("seq").alias("i"), "x", "y"), keys, float(_TOLERANCE)).withColumnRenamed("i", "seq")


_WIDTH = 7


@query("merged_strokes", f"""WITH RECURSIVE {A.STITCHES_SQL}, rn AS (SELECT design_id, block_idx, run_idx, count(*) AS n, arg_min(x, seq) / 100.0::DOUBLE AS ax, arg_min(y, seq) / 100.0::DOUBLE AS ay, arg_max(x, seq) / 100.0::DOUBLE AS zx, arg_max(y, seq) / 100.0::DOUBLE AS zy FROM st GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY block_idx, run_idx) AS pos, (1 + (design_id + run_idx * 3) % {_WIDTH}) * 0.5::DOUBLE AS width, n % 5 = 0 AS closed FROM rn),
m(design_id, pos, head, width, zx, zy, able) AS (
  SELECT design_id, pos, pos, width, zx, zy, NOT closed AND width >= 1.4 FROM f WHERE pos = 1
  UNION ALL
  SELECT design_id, pos, CASE WHEN goes THEN head ELSE pos END, CASE WHEN goes THEN hw ELSE width END, zx, zy, able FROM (
    SELECT f.*, m.head, m.width AS hw, NOT f.closed AND f.width >= 1.4 AS able,
           m.able AND NOT f.closed AND f.width >= 1.4 AND abs(m.width - f.width) <= greatest(0.3::DOUBLE, m.width * 0.2::DOUBLE) AND (f.ax - m.zx) * (f.ax - m.zx) + (f.ay - m.zy) * (f.ay - m.zy) < greatest(m.width, 1.5::DOUBLE) * greatest(m.width, 1.5::DOUBLE) AS goes
    FROM m JOIN f ON f.design_id = m.design_id AND f.pos = m.pos + 1)
)
SELECT m.design_id, m.head AS pos, count(*) AS parts, sum(f.n)::BIGINT - count(*) + 1 AS points, any_value(h.width) AS width FROM m JOIN f ON f.design_id = m.design_id AND f.pos = m.pos JOIN f h ON h.design_id = m.design_id AND h.pos = m.head GROUP BY m.design_id, m.head""")
def _(spark, d):
    """Runs as strokes of several widths, every fifth one closed; those that go on in one another are one."""
    from pyspark.sql import Window

    s = A.stitches(spark, d)
    point = F.struct("seq", (F.col("x") / 100.0).alias("x"), (F.col("y") / 100.0).alias("y"))
    r = s.groupBy("design_id", "block_idx", "run_idx").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    pos = F.row_number().over(Window.partitionBy("design_id").orderBy("block_idx", "run_idx")).cast("long")
    r = r.select("design_id", pos.alias("pos"), F.lit("stroke").alias("kind"), (F.size("points") % 5 == 0).alias("closed"), ((1 + (F.col("design_id") + F.col("run_idx") * 3) % _WIDTH) * 0.5).alias("width"), "points")
    return fits.merged(r).select("design_id", "pos", "parts", F.size("points").cast("long").alias("points"), "width")


_TURNS = f"""WITH {A.STITCHES_SQL}, t0 AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM st WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)),
t1 AS (SELECT *, ax::BIGINT * ax + ay::BIGINT * ay AS a2, bx::BIGINT * bx + by_::BIGINT * by_ AS b2, ax::BIGINT * bx + ay::BIGINT * by_ AS dot, (ax + bx)::BIGINT * (ax + bx) + (ay + by_)::BIGINT * (ay + by_) < 6.25 AS near FROM t0),
t2 AS (SELECT *, coalesce(dot < 0 AND a2 > 0 AND b2 > 0 AND 4 * dot * dot > a2 * b2, false) AS back FROM t1), t3 AS (SELECT *, near OR back AS turns, a2 >= 36 AND b2 >= 36 AS wide FROM t2)"""


@query("satin_columns", _TURNS + """, z AS (SELECT *, seq - row_number() OVER (PARTITION BY design_id, block_idx, run_idx ORDER BY seq) AS island FROM t3 WHERE ax IS NOT NULL AND bx IS NOT NULL AND turns AND wide)
SELECT design_id, block_idx, run_idx, min(seq) - 1 AS first, max(seq) + 1 AS last, count(*) AS turns FROM z GROUP BY design_id, block_idx, run_idx, island HAVING count(*) >= 5""")
def _(spark, d):
    return reading.columns(A.stitches(spark, d))


@query("run_looks", _TURNS + """, f0 AS (SELECT *, lag(ax) OVER w AS lx, lag(ay) OVER w AS ly FROM t3 WHERE a2 >= 36 WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)),
f1 AS (SELECT design_id, block_idx, run_idx, count(*) FILTER (ax::BIGINT * lx + ay::BIGINT * ly < 0 AND 4 * (ax::BIGINT * lx + ay::BIGINT * ly) * (ax::BIGINT * lx + ay::BIGINT * ly) > a2 * (lx::BIGINT * lx + ly::BIGINT * ly)) AS rows_back FROM f0 GROUP BY ALL), g AS (SELECT design_id, block_idx, run_idx, count(*) AS points, count(*) FILTER (back) AS reversals, count(*) FILTER (a2 > 0 AND b2 > 0) AS bends, coalesce(sum(floor(sqrt(a2::DOUBLE) * 1000 + 0.5)), 0)::BIGINT AS length,
floor(sqrt((max(x) - min(x))::DOUBLE * (max(x) - min(x)) + (max(y) - min(y))::DOUBLE * (max(y) - min(y))) * 1000 + 0.5)::BIGINT AS diagonal FROM t3 GROUP BY ALL)
SELECT design_id, block_idx, run_idx, points, reversals, length, diagonal, points >= 2 AND (bends = 0 OR reversals * 100 < bends * 15) AND length < 8 * greatest(diagonal, 10000) AS is_line, points >= 6 AND coalesce(rows_back, 0) >= 3 AND diagonal > 0 AND length > 3 * diagonal AS is_fill FROM g LEFT JOIN f1 USING (design_id, block_idx, run_idx)""")
def _(spark, d):
    return reading.looks(A.stitches(spark, d))


@query("spaced_runs", f"""WITH RECURSIVE {A.STITCHES_SQL}, kp(design_id, block_idx, run_idx, seq, x, y, kept, lx, ly) AS (
  SELECT design_id, block_idx, run_idx, seq, x, y, true, x, y FROM st WHERE seq = 0
  UNION ALL
  SELECT s.design_id, s.block_idx, s.run_idx, s.seq, s.x, s.y, k, CASE WHEN k THEN s.x ELSE lx END, CASE WHEN k THEN s.y ELSE ly END FROM (
    SELECT s.*, p.lx, p.ly, (s.x - p.lx)::BIGINT * (s.x - p.lx) + (s.y - p.ly)::BIGINT * (s.y - p.ly) >= 160000 AS k FROM kp p JOIN st s ON s.design_id = p.design_id AND s.block_idx = p.block_idx AND s.run_idx = p.run_idx AND s.seq = p.seq + 1) s
) SELECT design_id, block_idx, run_idx, row_number() OVER (PARTITION BY design_id, block_idx, run_idx ORDER BY seq) - 1 AS i, x, y FROM kp WHERE kept""")
def _(spark, d):
    """Runs without the points nearer than 400 units to the last one kept."""
    point = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("x", "y").alias("p")))), lambda e: e["p"])
    r = A.stitches(spark, d).groupBy("design_id", "block_idx", "run_idx").agg(point.alias("z"))
    return r.select("design_id", "block_idx", "run_idx", F.posexplode(edits.spaced_nodes("z", 400.0)).alias("i", "p")).select("design_id", "block_idx", "run_idx", F.col("i").cast("long").alias("i"), "p.x", "p.y")
