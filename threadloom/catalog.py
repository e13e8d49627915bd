"""The registered queries of the stitch-plan engine, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom import catalog_kernels, catalog_pictures, catalog_plans, catalog_records, catalog_shapes
from threadloom.functions import dims
from threadloom.functions import exprs as X
from threadloom.operators import color, geometry, layout, library, machine, plan, raster, report, rules, vector
from threadloom.plans import queries as kernel_queries
from threadloom.plans import samples
from threadloom.sources import adapters as A
from threadloom.streaming import simulate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_RUNS = f"""WITH {A.STITCHES_SQL}, rr0 AS (
  SELECT design_id, block_idx, run_idx, thread, count(*) AS n, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1 FROM st GROUP BY ALL
), rr1 AS (
  SELECT *, lag(x1) OVER w AS px, lag(y1) OVER w AS py, lag(block_idx) OVER w AS pblock, lead(n) OVER w IS NULL AS is_last, cast(row_number() OVER w - 1 AS BIGINT) AS order_no
  FROM rr0 WINDOW w AS (PARTITION BY design_id ORDER BY block_idx, run_idx)
), rr2 AS (
  SELECT *, cast(x0 - px AS BIGINT) * (x0 - px) + cast(y0 - py AS BIGINT) * (y0 - py) AS d2 FROM rr1
), rr AS (
  SELECT *, CASE WHEN px IS NULL THEN 'trim' WHEN d2 < 900 THEN 'continuous' WHEN d2 < 250000 THEN 'jump' ELSE 'trim' END AS connection FROM rr2
), stp AS (
  SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny
  FROM st WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)
), stl AS (SELECT *, cast(floor(sqrt(cast(dx AS DOUBLE) * dx + cast(dy AS DOUBLE) * dy) * 1000 + 0.5) AS BIGINT) AS len, cast(dx AS BIGINT) * dx + cast(dy AS BIGINT) * dy AS dd FROM stp
), tr AS (
  SELECT *, px IS NOT NULL AND run_idx > 0 AND connection = 'trim' AS is_trim, px IS NOT NULL AND run_idx > 0 AND connection = 'jump' AS is_jump,
         px IS NOT NULL AND CASE WHEN run_idx = 0 THEN d2 > 0 ELSE connection <> 'continuous' END AS is_travel, cast(floor(sqrt(cast(d2 AS DOUBLE)) * 1000 + 0.5) AS BIGINT) AS travel FROM rr
), cn AS (
  SELECT design_id, cast(sum(n) AS BIGINT) AS stitches, count(*) FILTER (run_idx > 0 AND connection = 'trim') AS trims, cast(greatest(0, count(DISTINCT block_idx) - 1) AS BIGINT) AS color_changes FROM rr GROUP BY design_id
), bd AS (SELECT design_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(x) - min(x) AS width, max(y) - min(y) AS height FROM st GROUP BY design_id
), tl AS (SELECT design_id, block_idx, thread, cast(coalesce(sum(len), 0) AS BIGINT) AS length_milli FROM stl GROUP BY ALL)
"""


@query("thread_length_by_block", _RUNS + "SELECT * FROM tl")
def _(spark, d):
    return plan.thread_length(A.stitches(spark, d))


@query("plan_counts", _RUNS + "SELECT * FROM cn")
def _(spark, d):
    return plan.counts(A.stitches(spark, d))


@query("plan_bounds", _RUNS + "SELECT * FROM bd")
def _(spark, d):
    return plan.bounds(A.stitches(spark, d))


_STATS = """, s1 AS (
  SELECT design_id, cast(sum(n) AS BIGINT) AS stitches, count(DISTINCT block_idx) AS colors, count(*) FILTER (is_trim) AS trims, count(*) FILTER (is_jump) AS jumps, count(*) FILTER (is_travel) AS travels,
         cast(coalesce(sum(travel) FILTER (is_travel), 0) AS BIGINT) AS travel_total, coalesce(max(travel) FILTER (is_travel), 0) AS travel_max FROM tr GROUP BY design_id
), s2 AS (
  SELECT design_id, cast(coalesce(sum(len), 0) AS BIGINT) AS length_total, coalesce(min(len), 0) AS step_min, coalesce(max(len), 0) AS step_max, count(dx) AS step_count FROM stl GROUP BY design_id
), sta AS (
  SELECT s1.design_id, stitches, colors, cast(greatest(0, colors - 1) AS BIGINT) AS color_changes, trims, jumps, travels, travel_total, travel_max, CASE WHEN travels > 0 THEN cast(floor(travel_total / travels + 0.5) AS BIGINT) ELSE 0 END AS travel_avg,
         cast(floor(stitches / 400.0::DOUBLE * 1000.0::DOUBLE + 0.5) AS BIGINT) AS minutes, width, height, length_total, step_min, step_max, CASE WHEN step_count > 0 THEN cast(floor(length_total / step_count + 0.5) AS BIGINT) ELSE 0 END AS step_avg,
         CASE WHEN width * height > 0 THEN cast(floor(stitches * 10000.0::DOUBLE / (width::DOUBLE * height) * 1000.0::DOUBLE + 0.5) AS BIGINT) ELSE 0 END AS density
  FROM s1 JOIN s2 USING (design_id) JOIN bd USING (design_id)
)
"""


@query("plan_stats", _RUNS + _STATS + "SELECT * FROM sta")
def _(spark, d):
    return plan.stats(A.stitches(spark, d))


@query("per_color_stats", _RUNS + "SELECT design_id, block_idx, thread, cast(sum(n) AS BIGINT) AS stitches, count(*) FILTER (is_trim) AS trims, count(*) AS runs, any_value(length_milli) AS length_milli FROM tr JOIN tl USING (design_id, block_idx, thread) GROUP BY ALL")
def _(spark, d):
    return plan.per_color(A.stitches(spark, d))


@query("run_travel", _RUNS + "SELECT design_id, block_idx, run_idx, coalesce(d2, 0) AS d2 FROM rr")
def _(spark, d):
    return plan.runs(A.stitches(spark, d)).select("design_id", "block_idx", "run_idx", F.coalesce("d2", F.lit(0)).alias("d2"))


@query("run_connection", _RUNS + "SELECT design_id, block_idx, run_idx, connection, CASE WHEN px IS NULL THEN 'trim' WHEN d2 < 900 THEN 'continuous' ELSE 'jump' END AS never, CASE WHEN px IS NULL THEN 'trim' WHEN d2 < 900 THEN 'continuous' ELSE 'trim' END AS always FROM rr")
def _(spark, d):
    first = F.col("px").isNull()
    return plan.runs(A.stitches(spark, d)).select("design_id", "block_idx", "run_idx", "connection", X.connection("d2", first, mode="never").alias("never"), X.connection("d2", first, mode="always").alias("always"))


_SEQ = """, sq AS (
  SELECT design_id, order_no, block_idx, run_idx, thread, n, connection, coalesce(d2, 0) AS travel2, x0, y0, x1, y1,
         (pblock IS NULL OR pblock <> block_idx OR run_idx = 0) AND block_idx > 0 AS color_change,
         CASE WHEN pblock IS NULL OR pblock <> block_idx OR run_idx = 0 THEN block_idx > 0 ELSE connection = 'trim' END AS trim FROM rr
)
"""


@query("sequence_view", _RUNS + _SEQ + "SELECT * FROM sq")
def _(spark, d):
    return plan.sequence(A.stitches(spark, d))


@query("sequence_trims_only", _RUNS + _SEQ + "SELECT design_id, order_no, block_idx, run_idx, coalesce(lag(block_idx) OVER (PARTITION BY design_id ORDER BY order_no) <> block_idx, true) AS heads_block FROM sq WHERE trim")
def _(spark, d):
    return plan.sequence_trims(A.stitches(spark, d))


@query("sequence_warnings", _RUNS + _SEQ + "SELECT design_id, order_no, travel2, trim FROM sq WHERE trim OR travel2 > 10000")
def _(spark, d):
    return plan.sequence(A.stitches(spark, d)).where("trim or travel2 > 10000").select("design_id", "order_no", "travel2", "trim")


@query("object_positions", _RUNS + _SEQ + """, ob AS (SELECT design_id, block_idx, run_idx % 3 AS object_id, min(order_no) AS first_no, max(order_no) AS last_no, count(*) AS entries FROM sq GROUP BY ALL)
SELECT *, cast(row_number() OVER (PARTITION BY design_id, block_idx ORDER BY first_no) - 1 AS BIGINT) AS place, count(*) OVER (PARTITION BY design_id, block_idx) AS objects FROM ob""")
def _(spark, d):
    return plan.object_positions(plan.sequence(A.stitches(spark, d)).withColumn("object_id", F.col("run_idx") % 3))


@query("sequence_by_object", _RUNS + _SEQ + "SELECT design_id, block_idx, run_idx % 3 AS object_id, string_agg(order_no::VARCHAR, ',' ORDER BY order_no) AS entries FROM sq GROUP BY ALL")
def _(spark, d):
    s = plan.sequence(A.stitches(spark, d)).withColumn("object_id", F.col("run_idx") % 3)
    return s.groupBy("design_id", "block_idx", "object_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("order_no")), lambda v: v.cast("string")), ",").alias("entries"))


@query("flat_moves", _RUNS + "SELECT design_id, block_idx, run_idx, seq, x, y, CASE WHEN seq = 0 AND run_idx = 0 THEN CASE WHEN block_idx = 0 THEN 2 ELSE 3 END WHEN seq = 0 AND connection = 'trim' THEN 2 WHEN seq = 0 AND connection = 'jump' THEN 1 ELSE 0 END AS move FROM st JOIN (SELECT design_id, block_idx, run_idx, connection FROM rr) USING (design_id, block_idx, run_idx)")
def _(spark, d):
    return plan.flat_moves(A.stitches(spark, d))


@query("long_stitch_split", _RUNS + """, lg AS (SELECT *, cast(ceil(greatest(abs(dx), abs(dy)) / 121) AS BIGINT) AS k FROM stp WHERE greatest(abs(dx), abs(dy)) > 121)
SELECT design_id, block_idx, run_idx, seq, i - 1 AS part, cast(px + floor(dx::DOUBLE * i / k + 0.5) AS INT) AS x, cast(py + floor(dy::DOUBLE * i / k + 0.5) AS INT) AS y FROM lg, LATERAL (SELECT unnest(generate_series(1, k)) AS i)""")
def _(spark, d):
    return plan.long_splits(A.stitches(spark, d))


@query("reorder_blocks", _RUNS + "SELECT design_id, CASE block_idx WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE block_idx END AS block_idx, thread, count(*) AS stitches FROM st GROUP BY ALL")
def _(spark, d):
    return plan.reorder_blocks(A.stitches(spark, d), 0, 2).groupBy("design_id", "block_idx", "thread").agg(F.count(F.lit(1)).alias("stitches"))


@query("dedup_points", _RUNS + "SELECT design_id, block_idx, run_idx, seq, x, y FROM stp WHERE px IS NULL OR px <> x OR py <> y")
def _(spark, d):
    return plan.dedup_points(A.stitches(spark, d)).drop("thread")


@query("turn_labels", _RUNS + """, tu AS (SELECT *, x - px AS ax, y - py AS ay, nx - x AS bx, ny - y AS bz, cast(nx - px AS BIGINT) * (nx - px) + cast(ny - py AS BIGINT) * (ny - py) AS nn FROM stp),
tv AS (SELECT *, cast(ax AS BIGINT) * bx + cast(ay AS BIGINT) * bz AS dot, (cast(ax AS BIGINT) * ax + cast(ay AS BIGINT) * ay) * (cast(bx AS BIGINT) * bx + cast(bz AS BIGINT) * bz) AS nrm FROM tu)
SELECT design_id, block_idx, run_idx, seq, CASE WHEN px IS NULL OR nx IS NULL THEN 'S' WHEN nn < 6.25 THEN 'R' WHEN nrm > 0 AND dot < 0 AND 4 * dot * dot > nrm THEN 'Z' ELSE 'S' END AS label FROM tv""")
def _(spark, d):
    return plan.turn_labels(A.stitches(spark, d))


@query("moving_average", _RUNS + """SELECT design_id, block_idx, run_idx, seq, cast(floor(cast(sum(x) OVER w AS DOUBLE) / count(*) OVER w * 1000.0::DOUBLE + 0.5) AS BIGINT) AS mx, cast(floor(cast(sum(y) OVER w AS DOUBLE) / count(*) OVER w * 1000.0::DOUBLE + 0.5) AS BIGINT) AS my
FROM st WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, d):
    return plan.moving_average(A.stitches(spark, d))


@query("principal_angle", _RUNS + """, pa AS (SELECT design_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x::BIGINT * x)::DOUBLE AS sxx, sum(y::BIGINT * y)::DOUBLE AS syy, sum(x::BIGINT * y)::DOUBLE AS sxy FROM st GROUP BY design_id)
SELECT design_id, cast(floor(0.5::DOUBLE * atan2(2.0::DOUBLE * (n * sxy - sx * sy), (n * sxx - sx * sx) - (n * syy - sy * sy)) * 1000.0::DOUBLE + 0.5) AS BIGINT) AS angle_milli FROM pa""")
def _(spark, d):
    return plan.principal_angles(A.stitches(spark, d))


_RULES = """, c0 AS (
  SELECT *, lag(n) OVER w AS bn, lag(x1) OVER w AS bx, lag(y1) OVER w AS bz FROM rr WINDOW w AS (PARTITION BY design_id, block_idx ORDER BY run_idx)
), c1 AS (
  SELECT *, cast(x0 - bx AS BIGINT) * (x0 - bx) + cast(y0 - bz AS BIGINT) * (y0 - bz) AS gap FROM c0
), c2 AS (
  SELECT design_id, count(*) FILTER (run_idx > 0 AND connection = 'trim') AS trims, count(*) FILTER (bn > 0 AND connection = 'continuous' AND gap > 14641) AS far_continuous,
         count(*) FILTER (bn > 0 AND connection = 'jump' AND gap > 250000) AS long_jumps, 0::BIGINT AS object_trims FROM c1 GROUP BY design_id
), c3 AS (
  SELECT design_id, count(*) AS stitches, count(*) FILTER (dd > 14641) AS long_steps, count(*) FILTER (dd > 0 AND dd < 25) AS short_steps, count(DISTINCT block_idx) AS colors FROM stl GROUP BY design_id
), ct AS (SELECT * FROM c2 JOIN c3 USING (design_id) JOIN bd USING (design_id)
), rules(severity, code, ord) AS (VALUES ('error', 'empty-plan', 0), ('error', 'out-of-hoop', 1), ('error', 'stitch-count-exceeded', 2), ('warning', 'long-stitch-in-run', 3), ('warning', 'continuous-too-far', 4),
  ('warning', 'short-stitches', 5), ('error', 'trim-in-object', 6), ('warning', 'long-jump', 7), ('warning', 'too-many-colors', 8), ('warning', 'too-many-trims', 9)
), iss AS (
  SELECT * FROM (SELECT design_id, severity, code, cast(CASE ord WHEN 0 THEN 0 WHEN 1 THEN (min_x < -500 OR max_x > 500 OR min_y < -500 OR max_y > 500)::BIGINT WHEN 2 THEN CASE WHEN stitches > 12000 THEN stitches ELSE 0 END WHEN 3 THEN long_steps
    WHEN 4 THEN far_continuous WHEN 5 THEN short_steps WHEN 6 THEN object_trims WHEN 7 THEN long_jumps WHEN 8 THEN CASE WHEN colors > 12 THEN colors ELSE 0 END ELSE CASE WHEN trims > greatest(1, colors) * 3 THEN trims ELSE 0 END END AS BIGINT) AS n
  FROM ct, rules) WHERE n > 0
)
"""


@query("validation_counters", _RUNS + _RULES + "SELECT * FROM ct")
def _(spark, d):
    return rules.counters(A.stitches(spark, d))


@query("validation_issues", _RUNS + _RULES + "SELECT * FROM iss")
def _(spark, d):
    return rules.issues(rules.counters(A.stitches(spark, d)))


@query("written_files", _RUNS + _RULES + """SELECT s.design_id, coalesce(string_agg(code, ',' ORDER BY code) FILTER (severity = 'error'), '') AS errors, count(*) FILTER (severity = 'error') = 0 AS written FROM (SELECT DISTINCT design_id FROM st) s LEFT JOIN iss USING (design_id) GROUP BY s.design_id""")
def _(spark, d):
    """Files of designs; one that breaks a rule has none."""
    r, g, b = report.thread_color("thread")
    s = A.stitches(spark, d)
    st = s.join(plan.runs(s).select(*plan.RUN, "connection"), plan.RUN).withColumns({"r": r, "g": g, "b": b}).drop("thread")
    out = samples.written(st)
    return out.select("design_id", F.array_join("errors", ",").alias("errors"), F.col("dst").isNotNull().alias("written"))


@query("diagnostics", _RUNS + _RULES + _STATS + """, dg AS (
  SELECT design_id, CASE severity WHEN 'error' THEN 'critical' ELSE 'notice' END AS level, code, n FROM iss
  UNION ALL SELECT design_id, 'notice', 'near-stitch-limit', stitches FROM sta WHERE stitches <= 12000 AND stitches > 10800
  UNION ALL SELECT design_id, 'notice', 'long-travel', travel_max FROM sta WHERE travel_max > 500000
), dh AS (SELECT * FROM dg UNION ALL SELECT design_id, 'ok', 'ok', stitches FROM sta WHERE design_id NOT IN (SELECT design_id FROM dg)),
di AS (SELECT *, CASE level WHEN 'critical' THEN 0 WHEN 'notice' THEN 1 ELSE 2 END AS rank FROM dh)
SELECT *, min(rank) OVER (PARTITION BY design_id) AS overall_rank FROM di""")
def _(spark, d):
    return rules.diagnoses(A.stitches(spark, d))


_LOCK = lambda x, y, tx, ty: f"CASE WHEN {tx} IS NOT NULL AND least(10.0::DOUBLE, sqrt(({tx} - {x})::DOUBLE * ({tx} - {x}) + ({ty} - {y})::DOUBLE * ({ty} - {y}))) >= 5 THEN [{{'kind': 'stitch', 'x': floor({x} + ({tx} - {x}) / sqrt(({tx} - {x})::DOUBLE * ({tx} - {x}) + ({ty} - {y})::DOUBLE * ({ty} - {y})) * least(10.0::DOUBLE, sqrt(({tx} - {x})::DOUBLE * ({tx} - {x}) + ({ty} - {y})::DOUBLE * ({ty} - {y}))) + 0.5)::INT, 'y': floor({y} + ({ty} - {y}) / sqrt(({tx} - {x})::DOUBLE * ({tx} - {x}) + ({ty} - {y})::DOUBLE * ({ty} - {y})) * least(10.0::DOUBLE, sqrt(({tx} - {x})::DOUBLE * ({tx} - {x}) + ({ty} - {y})::DOUBLE * ({ty} - {y}))) + 0.5)::INT}}, {{'kind': 'stitch', 'x': {x}, 'y': {y}}}] ELSE [] END"
_SPLIT = lambda kind, x0, y0, x1, y1: f"list_transform(generate_series(1, greatest(1, ceil(greatest(abs({x1} - {x0}), abs({y1} - {y0})) / 121.0::DOUBLE))::BIGINT), lambda i: {{'kind': '{kind}', 'x': ({x0} + floor(({x1} - {x0})::DOUBLE * i / greatest(1, ceil(greatest(abs({x1} - {x0}), abs({y1} - {y0})) / 121.0::DOUBLE)) + 0.5))::INT, 'y': ({y0} + floor(({y1} - {y0})::DOUBLE * i / greatest(1, ceil(greatest(abs({x1} - {x0}), abs({y1} - {y0})) / 121.0::DOUBLE)) + 0.5))::INT}})"
_ONE = lambda kind: f"[{{'kind': '{kind}', 'x': NULL::INT, 'y': NULL::INT}}]"
_OPS = f""", m0 AS (
  SELECT *, first_value(x) OVER w AS sx, first_value(y) OVER w AS sy, px IS NOT NULL AND (px <> x OR py <> y) AS moved FROM stp WINDOW w AS (PARTITION BY design_id, block_idx, run_idx ORDER BY seq)
), m1 AS (
  SELECT design_id, block_idx, run_idx, arg_min(x, seq) FILTER (x <> sx OR y <> sy) AS tx, arg_min(y, seq) FILTER (x <> sx OR y <> sy) AS ty, arg_max(px, seq) FILTER (moved) AS kx, arg_max(py, seq) FILTER (moved) AS ky FROM m0 GROUP BY ALL
), m2 AS (
  SELECT rr.*, tx, ty, coalesce(kx, px) AS bx, coalesce(ky, py) AS bz, pblock IS NULL OR pblock <> rr.block_idx AS new_block FROM rr JOIN m1 USING (design_id, block_idx, run_idx)
), m3 AS (
  SELECT *, lag(bx) OVER w AS qx, lag(bz) OVER w AS qy, x0 <> px OR y0 <> py AS apart FROM m2 WINDOW w AS (PARTITION BY design_id ORDER BY order_no)
), m4 AS (
  SELECT design_id, order_no, -2::BIGINT AS spot, CASE WHEN px IS NULL THEN {_SPLIT('jump', '0', '0', 'x0', 'y0')}
    WHEN new_block THEN list_concat(list_concat({_LOCK('px', 'py', 'qx', 'qy')}, {_ONE('colorChange')}), CASE WHEN apart THEN {_SPLIT('jump', 'px', 'py', 'x0', 'y0')} ELSE [] END)
    WHEN NOT apart THEN [] WHEN connection = 'continuous' THEN {_SPLIT('stitch', 'px', 'py', 'x0', 'y0')}
    WHEN connection = 'trim' THEN list_concat(list_concat({_LOCK('px', 'py', 'qx', 'qy')}, {_ONE('trim')}), {_SPLIT('jump', 'px', 'py', 'x0', 'y0')}) ELSE {_SPLIT('jump', 'px', 'py', 'x0', 'y0')} END AS ops FROM m3
  UNION ALL SELECT design_id, order_no, 0, CASE WHEN px IS NULL OR new_block OR connection = 'trim' THEN {_LOCK('x0', 'y0', 'tx', 'ty')} ELSE [] END FROM m3
  UNION ALL SELECT design_id, order_no, 4611686018427387904, list_concat({_LOCK('x1', 'y1', 'bx', 'bz')}, {_ONE('end')}) FROM m3 WHERE is_last
  UNION ALL SELECT m0.design_id, m2.order_no, CASE WHEN seq = 0 THEN -1 ELSE seq END, CASE WHEN m0.px IS NULL THEN [{{'kind': 'stitch', 'x': x, 'y': y}}] WHEN moved THEN {_SPLIT('stitch', 'm0.px', 'm0.py', 'x', 'y')} ELSE [] END FROM m0 JOIN m2 USING (design_id, block_idx, run_idx)
), m5 AS (
  SELECT design_id, order_no, spot, generate_subscripts(ops, 1) AS k, unnest(ops) AS op FROM m4 WHERE len(ops) > 0
), ops AS (
  SELECT design_id, cast(row_number() OVER (PARTITION BY design_id ORDER BY order_no, spot, k) - 1 AS BIGINT) AS op_seq, op.kind AS kind, op.x AS x, op.y AS y FROM m5
)
"""


@query("machine_ops", _RUNS + _OPS + "SELECT * FROM ops")
def _(spark, d):
    return machine.operations(A.stitches(spark, d))


_FRAMES = lambda src: f""", f0 AS (SELECT *, coalesce(count(*) FILTER (kind = 'stitch') OVER (PARTITION BY design_id ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM {src}
), f1 AS (SELECT design_id, island, max(op_seq) FILTER (kind = 'stitch') AS op_seq, max(x) FILTER (kind = 'stitch') AS x, max(y) FILTER (kind = 'stitch') AS y, count(*) FILTER (kind = 'colorChange') AS changes, count(*) FILTER (kind = 'jump') > 0 AS from_jump, count(*) FILTER (kind = 'trim') > 0 AS after_trim FROM f0 GROUP BY ALL
), f2 AS (SELECT *, cast(sum(changes) OVER (PARTITION BY design_id ORDER BY island) AS BIGINT) AS color_index FROM f1)
SELECT design_id, island + 1 AS stitch_no, x, y, color_index, from_jump, after_trim, changes > 0 AS color_changed FROM f2 WHERE op_seq IS NOT NULL"""  # noqa: E731


@query("sim_frames", _RUNS + _OPS + _FRAMES("ops"))
def _(spark, d):
    return machine.frames(machine.operations(A.stitches(spark, d)))


_EVENT_OPS = """eo AS (SELECT user_id AS design_id, event_id AS op_seq, CASE event_id % 7 WHEN 0 THEN 'jump' WHEN 3 THEN 'trim' WHEN 5 THEN 'colorChange' ELSE 'stitch' END AS kind,
  cast(event_id % 1000 AS INT) - 500 AS x, cast(event_id % 777 AS INT) - 388 AS y FROM events)"""


@query("sim_event_frames", "WITH " + _EVENT_OPS + _FRAMES("eo"))
def _(spark, d):
    return machine.frames(simulate.event_ops(A.table(spark, d, "events")))


@query("sim_stream_frames", "WITH " + _EVENT_OPS + _FRAMES("eo"))
def _(spark, d):
    return simulate.run_stream(spark, d, "events.parquet")


def _dst_sql() -> str:
    parts = ["0", "0", "CASE kind WHEN 'jump' THEN 131 WHEN 'colorChange' THEN 195 ELSE 3 END"]
    for value, bits in (("dx", machine.DST_X), ("dy", machine.DST_Y)):
        for k, (byte, plus, minus) in enumerate(bits):
            parts[byte] += f" + CASE (({value} + 121) // {3**k}) % 3 WHEN 2 THEN {plus} WHEN 0 THEN {minus} ELSE 0 END"
    return f"""WITH r AS (SELECT a.range AS dx, b.range AS dy, ['stitch', 'jump', 'colorChange'][(a.range + b.range + 242) % 3 + 1] AS kind FROM range(-121, 122) a, range(-121, 122) b)
SELECT dx::INT AS dx, dy::INT AS dy, kind, ({parts[0]})::INT AS b0, ({parts[1]})::INT AS b1, ({parts[2]})::INT AS b2, dx::INT AS rx, dy::INT AS ry, kind AS rkind FROM r"""


@query("dst_record_bits", _dst_sql())
def _(spark, d):
    r = spark.range(243 * 243).select((F.expr("id div 243") - 121).cast("int").alias("dx"), (F.col("id") % 243 - 121).cast("int").alias("dy"))
    kinds = F.array(F.lit("stitch"), F.lit("jump"), F.lit("colorChange"))
    r = r.withColumn("kind", F.element_at(kinds, (F.col("dx") + F.col("dy") + 242) % 3 + 1))
    b0, b1, b2 = machine.dst_bytes()
    r = r.withColumns({"b0": b0.cast("int"), "b1": b1.cast("int"), "b2": b2.cast("int")})
    rx, ry, kind = machine.dst_values()
    return r.withColumns({"rx": rx.cast("int"), "ry": ry.cast("int"), "rkind": kind})


@query("dst_delta_roundtrip", _RUNS + _OPS + """, z AS (SELECT design_id, op_seq, x, y FROM ops WHERE kind = 'stitch'), zn AS (SELECT design_id, count(*) AS n, cast(sum(x::BIGINT * 31 + y * 17) AS BIGINT) AS checksum FROM z GROUP BY design_id)
SELECT *, true AS same FROM zn""")
def _(spark, d):
    ops = machine.operations(A.stitches(spark, d))
    moves = machine.dst_moves(ops)
    b0, b1, b2 = machine.dst_bytes()
    back = moves.select("design_id", "rec", b0.alias("b0"), b1.alias("b1"), b2.alias("b2"))
    dx, dy, kind = machine.dst_values()
    points = machine.dst_points(back.select("design_id", "rec", dx.alias("dx"), dy.alias("dy"), kind.alias("kind")))
    digest = lambda df: df.groupBy("design_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("long") * 31 + F.col("y") * 17).alias("checksum"))
    want = digest(ops.where("kind = 'stitch'")).withColumnsRenamed({"n": "_n", "checksum": "_c"})
    return digest(points).join(want, "design_id").select("design_id", "n", "checksum", ((F.col("n") == F.col("_n")) & (F.col("checksum") == F.col("_c"))).alias("same"))


query("file_roundtrip", _RUNS + _OPS + kernel_queries.FILE_SQL)(kernel_queries.file_roundtrip)


_EDGES = f"""WITH {A.OUTLINES_SQL}, eg AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM poly WINDOW w AS (PARTITION BY design_id, poly, ring ORDER BY i)
), ar AS (SELECT design_id, poly, ring, cast(sum(x * ny - nx * y) AS BIGINT) AS area2 FROM eg GROUP BY ALL
), bx AS (SELECT design_id, poly, any_value(thread) AS thread, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM poly WHERE ring = 0 GROUP BY ALL
), na AS (SELECT design_id, poly, cast(sum(CASE ring WHEN 0 THEN abs(area2) ELSE -abs(area2) END) AS BIGINT) AS net2 FROM ar GROUP BY ALL)
"""


@query("shoelace_area", _EDGES + "SELECT * FROM ar")
def _(spark, d):
    return geometry.areas(A.outlines(spark, d))


@query("net_area", _EDGES + "SELECT design_id, poly, net2, least(bx1 - bx0, by1 - by0) AS min_extent FROM na JOIN bx USING (design_id, poly)")
def _(spark, d):
    return geometry.net_areas(A.outlines(spark, d))


@query("drop_small_regions", _EDGES + "SELECT design_id, poly, net2, least(bx1 - bx0, by1 - by0) AS min_extent FROM na JOIN bx USING (design_id, poly) WHERE net2 >= 8000")
def _(spark, d):
    return geometry.drop_small(A.outlines(spark, d), 8000)


@query("centroid", _EDGES + """, ce AS (SELECT design_id, poly, ring, sum(x * ny - nx * y) AS a, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy FROM eg GROUP BY ALL)
SELECT design_id, poly, ring, cast(floor(sx::DOUBLE / (3.0::DOUBLE * a) * 1000.0::DOUBLE + 0.5) AS BIGINT) AS cx, cast(floor(sy::DOUBLE / (3.0::DOUBLE * a) * 1000.0::DOUBLE + 0.5) AS BIGINT) AS cy FROM ce""")
def _(spark, d):
    return geometry.centroids(A.outlines(spark, d))


@query("block_order_by_area", _EDGES + """, co AS (SELECT design_id, thread, cast(sum(net2) AS BIGINT) AS net2, min(poly) AS first_poly, count(*) AS polys FROM na JOIN bx USING (design_id, poly) GROUP BY ALL)
SELECT *, cast(row_number() OVER (PARTITION BY design_id ORDER BY CASE thread WHEN 'MACHINERY' THEN 1 END NULLS LAST, net2 DESC, first_poly) - 1 AS BIGINT) AS place FROM co""")
def _(spark, d):
    return geometry.color_order(A.outlines(spark, d), ["MACHINERY"])


@query("point_in_polygon", _EDGES + """SELECT design_id, poly, gx, gy FROM bx, (SELECT range * 50 AS gx FROM range(-20, 21)), (SELECT range * 50 AS gy FROM range(-20, 21))
WHERE gx >= bx0 AND gx < bx1 AND gy >= by0 AND gy < by1 AND NOT (poly % 3 = 0 AND gx >= (bx0 + bx1) / 2 - 5 AND gx < (bx0 + bx1) / 2 + 5 AND gy >= (by0 + by1) / 2 - 5 AND gy < (by0 + by1) / 2 + 5)""")
def _(spark, d):
    return geometry.grid_hits(A.rings(spark, d))


@query("containment_depth", _EDGES + """SELECT p.design_id, p.poly, count(o.poly) AS depth FROM bx p LEFT JOIN bx o ON p.design_id = o.design_id AND p.poly <> o.poly AND p.bx0 >= o.bx0 AND p.bx0 < o.bx1 AND p.by0 >= o.by0 AND p.by0 < o.by1 GROUP BY ALL""")
def _(spark, d):
    return geometry.depths(A.rings(spark, d))


@query("hole_assignment", _EDGES + """, ho AS (SELECT design_id, poly AS hole_poly, (bx0 + bx1) / 2 + poly % 7 * 60 AS hx, (by0 + by1) / 2 AS hy FROM bx WHERE poly % 3 = 0),
hi AS (SELECT h.design_id, hole_poly, arg_min(o.poly, (bx1 - bx0) * (by1 - by0) * 100000000 + o.poly) AS outer_poly, count(*) AS holders FROM ho h JOIN bx o ON h.design_id = o.design_id AND hx >= bx0 AND hx < bx1 AND hy >= by0 AND hy < by1 AND (bx1 - bx0) * (by1 - by0) > 100 GROUP BY ALL),
hl AS (SELECT h.design_id, hole_poly, o.poly, sqrt(((bx0 + bx1) / 2 - hx) * ((bx0 + bx1) / 2 - hx) + ((by0 + by1) / 2 - hy) * ((by0 + by1) / 2 - hy)) AS far FROM ho h ANTI JOIN hi USING (hole_poly) JOIN bx o ON h.design_id = o.design_id)
SELECT * FROM hi UNION ALL SELECT design_id, hole_poly, poly, 0 FROM (SELECT *, row_number() OVER (PARTITION BY hole_poly ORDER BY far, poly) AS k FROM hl) WHERE k = 1""")
def _(spark, d):
    """Holes lie up to 36 mm beside their own outline, so some are in another one and some in none."""
    r = A.rings(spark, d)
    return geometry.holes_to_outers(r.withColumn("hole", F.transform("hole", lambda p: F.struct((p["x"] + F.col("poly") % 7 * 60).alias("x"), p["y"].alias("y")))))


@query("scan_rows", _EDGES + """, sr AS (SELECT *, greatest(1, floor((by1 - by0) / 10)) AS n FROM eg JOIN bx USING (design_id, poly) WHERE y <> ny
), sc AS (SELECT design_id, poly, range AS row, by0 + (range + 0.5::DOUBLE) * 10 AS ry, x, y, nx, ny FROM sr, range(0, 100) WHERE range < n AND by0 + (range + 0.5::DOUBLE) * 10 >= least(y, ny) AND by0 + (range + 0.5::DOUBLE) * 10 < greatest(y, ny)
), sd AS (SELECT design_id, poly, row, cast(floor(ry * 1000 + 0.5) AS BIGINT) AS row_y, cast(floor((x + (nx - x) * (ry - y) / (ny - y)) * 1000 + 0.5) AS BIGINT) AS c FROM sc
), se AS (SELECT *, (row_number() OVER (PARTITION BY design_id, poly, row ORDER BY c) - 1) // 2 AS seg FROM sd)
SELECT design_id, poly, row, row_y, seg, min(c) AS x1, max(c) AS x2 FROM se GROUP BY ALL HAVING count(*) = 2""")
def _(spark, d):
    return geometry.scan_rows(A.outlines(spark, d))


@query("radial_copies", _EDGES + """, cp AS (SELECT design_id, poly, range::INT AS copy, ring, i, x - 10.0::DOUBLE AS x, y + 20.0::DOUBLE AS y, range * 2.0::DOUBLE * pi() / 6 AS a FROM poly, range(0, 6))
SELECT design_id, poly, copy, ring, i, cast(floor((10.0::DOUBLE + x * cos(a) - y * sin(a)) * 1000.0::DOUBLE + 0.5) AS BIGINT) AS x, cast(floor((-20.0::DOUBLE + x * sin(a) + y * cos(a)) * 1000.0::DOUBLE + 0.5) AS BIGINT) AS y FROM cp""")
def _(spark, d):
    return geometry.radial(A.rings(spark, d), 6, 10.0, -20.0)


@query("orbit_copies", _EDGES + """, mc AS (SELECT design_id, poly, avg(x) AS mx, avg(y) AS my FROM poly WHERE ring = 0 GROUP BY ALL), oc AS (SELECT p.*, range::INT AS copy, mx, my, range * 2.0::DOUBLE * pi() / 5 AS a FROM poly p JOIN mc USING (design_id, poly), range(0, 5))
SELECT design_id, poly, copy, ring, i, cast(floor((x + (mx * cos(a) - my * sin(a) - mx)) * 1000.0::DOUBLE + 0.5) AS BIGINT) AS x, cast(floor((y + (mx * sin(a) + my * cos(a) - my)) * 1000.0::DOUBLE + 0.5) AS BIGINT) AS y FROM oc""")
def _(spark, d):
    return geometry.radial(A.rings(spark, d), 5, turn_each=False)


@query("mirror_copies", _EDGES + "SELECT design_id, poly, 0 AS copy, ring, i, x * 1000 AS x, y * 1000 AS y FROM poly UNION ALL SELECT design_id, poly, 1, ring, 3 - i, (20 - x) * 1000, y * 1000 FROM poly")
def _(spark, d):
    return geometry.mirror(A.rings(spark, d), at=10)


@query("kaleidoscope_copies", _EDGES + """, kp AS (SELECT design_id, poly, range::INT AS segment, f AS flip, ring, i, x, y, range * 2.0::DOUBLE * pi() / 6 AS a FROM poly, range(0, 6), (VALUES (0), (1)) v(f)),
kq AS (SELECT *, x * cos(a) + y * sin(a) AS lx, y * cos(a) - x * sin(a) AS ly FROM kp)
SELECT design_id, poly, segment, flip, ring, CASE flip WHEN 1 THEN 3 - i ELSE i END AS i, cast(floor(CASE flip WHEN 0 THEN x * cos(a) - y * sin(a) ELSE -lx * cos(a) - ly * sin(a) END * 1000.0::DOUBLE + 0.5) AS BIGINT) AS x, cast(floor(CASE flip WHEN 0 THEN x * sin(a) + y * cos(a) ELSE -lx * sin(a) + ly * cos(a) END * 1000.0::DOUBLE + 0.5) AS BIGINT) AS y FROM kq""")
def _(spark, d):
    return geometry.kaleidoscope(A.rings(spark, d))


@query("local_recommend", _EDGES + """, lr AS (SELECT design_id, thread, net2, least(bx1 - bx0, by1 - by0) < 30 OR net2 * 10 < (bx1 - bx0) * (by1 - by0) * 6 AS thin, poly % 3 = 1 AND poly % 50 < 5 AS white FROM na JOIN bx USING (design_id, poly)
), ls AS (SELECT design_id, count(*) AS regions, count(DISTINCT thread) AS colors, sum(net2) AS total2, coalesce(sum(net2) FILTER (thin), 0) AS thin2, max(net2) AS max2, coalesce(max(net2) FILTER (white), 0) AS white2 FROM lr GROUP BY design_id
), lt AS (SELECT *, CASE WHEN thin2 * 10 > total2 * 6 THEN 'satin' WHEN (total2 - thin2) * 10 > total2 * 7 AND max2 > 20000 THEN 'tatami' ELSE 'auto' END AS fill_type FROM ls)
SELECT design_id, regions, cast(greatest(2, least(12, colors)) AS BIGINT) AS color_count, fill_type, CASE WHEN max2 > 60000 THEN 'edge,tatami' WHEN total2 > thin2 AND max2 > 16000 THEN 'edge' ELSE '' END AS underlay, CASE fill_type WHEN 'satin' THEN 'center' ELSE 'auto' END AS satin_underlay,
  CASE WHEN design_id % 4 = 0 OR design_id % 7 = 0 THEN 1.25 ELSE 1.0 END::DOUBLE AS density_scale, white2 * 4 > total2 AS remove_white FROM lt""")
def _(spark, d):
    """Some regions are white; some designs have a plan of too many stitches, and some too dense a one."""
    p, k = A.outlines(spark, d), F.col("design_id")
    stats = p.select("design_id").distinct().select("design_id", F.when(k % 4 == 0, 10_001).otherwise(10_000).alias("stitches"), F.when(k % 7 == 0, 700_001).otherwise(700_000).alias("density"))
    return geometry.recommend(p, (F.col("poly") % 3 == 1) & (F.col("poly") % 50 < 5), stats)


_NEAREST = f"""WITH {A.COLORS_SQL}, {dims.PALETTE_SQL}, nd AS (SELECT id, r, g, b, pec_index, pname, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS d2 FROM rgb, palette)
SELECT id, r, g, b, arg_min(pec_index, d2 * 100 + pec_index) AS pec_index, arg_min(pname, d2 * 100 + pec_index) AS name, min(d2) AS d2 FROM nd GROUP BY ALL"""


@query("nearest_palette", _NEAREST)
def _(spark, d):
    return color.assign_threads(A.colors(spark, d))


@query("nearest_center_embedding", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, sum(floor(v * 1000000 + 0.5)) / count(*) / 1000000.0::DOUBLE AS mean FROM e GROUP BY ALL),
d AS (SELECT e.vec_id, c.label AS center, sum((e.v - c.mean) * (e.v - c.mean)) AS d2 FROM e JOIN c USING (pos) GROUP BY ALL), f AS (SELECT *, cast(floor(d2 * 1000 + 0.5) AS BIGINT) AS m FROM d)
SELECT vec_id, arg_min(center, m * 1000 + center) AS center, min(m) AS d2_milli FROM f GROUP BY vec_id""")
def _(spark, d):
    return color.nearest_center(A.table(spark, d, "embeddings"))


_LAB = f"""WITH {A.COLORS_SQL}, l0 AS (SELECT *, CASE WHEN r / 255.0::DOUBLE <= 0.04045 THEN r / 255.0::DOUBLE / 12.92 ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS lr, CASE WHEN g / 255.0::DOUBLE <= 0.04045 THEN g / 255.0::DOUBLE / 12.92 ELSE pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS lg,
  CASE WHEN b / 255.0::DOUBLE <= 0.04045 THEN b / 255.0::DOUBLE / 12.92 ELSE pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS lb FROM rgb
), l1 AS (SELECT *, (lr * 0.4124 + lg * 0.3576 + lb * 0.1805) / 0.95047 AS x, lr * 0.2126 + lg * 0.7152 + lb * 0.0722 AS y, (lr * 0.0193 + lg * 0.1192 + lb * 0.9505) / 1.08883 AS z FROM l0
), l2 AS (SELECT *, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16.0::DOUBLE / 116 END AS fx, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16.0::DOUBLE / 116 END AS fy, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16.0::DOUBLE / 116 END AS fz FROM l1
), lab AS (SELECT id, r, g, b, 116 * fy - 16 AS ll, 500 * (fx - fy) AS la, 200 * (fy - fz) AS lbb FROM l2)
"""


@query("rgb_to_lab", _LAB + "SELECT id, cast(floor(ll * 1000 + 0.5) AS BIGINT) AS l, cast(floor(la * 1000 + 0.5) AS BIGINT) AS a, cast(floor(lbb * 1000 + 0.5) AS BIGINT) AS b FROM lab")
def _(spark, d):
    return color.lab_table(A.colors(spark, d))


@query("high_contrast_semi", _LAB + "SELECT p.id, p.id % 400 AS grp FROM lab p WHERE EXISTS (SELECT 1 FROM lab q WHERE q.id % 400 = p.id % 400 AND (p.ll - q.ll) ** 2 + (p.la - q.la) ** 2 + (p.lbb - q.lbb) ** 2 > 7225)")
def _(spark, d):
    return color.high_contrast(A.colors(spark, d).withColumn("grp", F.col("id") % 400), limit=7225.0).select("id", "grp")


@query("css_color_parse", """WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS f, p_partkey % 256 AS a, p_partkey * 7 % 256 AS b FROM part)
SELECT k, CASE f WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN k % 4096 // 256 * 17 WHEN 3 THEN 255 WHEN 5 THEN 128 WHEN 6 THEN 0 END::INT AS r, CASE f WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN k % 256 // 16 * 17 WHEN 3 THEN 0 WHEN 5 THEN 128 WHEN 6 THEN 0 END::INT AS g, CASE f WHEN 0 THEN 3 WHEN 1 THEN 9 WHEN 2 THEN k % 16 * 17 WHEN 3 THEN 0 WHEN 5 THEN 128 WHEN 6 THEN 0 END::INT AS b FROM p""")
def _(spark, d):
    """rgb() with odd spaces, six and three hexadecimal digits, names, what is no colour, what is none that is known, and nothing."""
    k = F.col("k")
    a, b, none = k % 256, k * 7 % 256, F.lit(None).cast("string")
    forms = F.array(
        F.concat(F.lit("rgb( "), a.cast("string"), F.lit(" ,"), b.cast("string"), F.lit(",3 )")), F.lower(F.format_string("#%02X%02x09", a, b)), F.format_string("#%03x", k % 4096), F.lit(" Red "), F.lit("none"), F.lit("GREY"), F.lit("nonsense"), none
    )
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("k")).withColumn("c", X.css_color(F.element_at(forms, (k % 8 + 1).cast("int"))))
    return p.select("k", "c.r", "c.g", "c.b")


@query("mm_round_table", f"WITH {dims.FABRIC_SQL} SELECT id, " + ", ".join(f"cast(floor({c}::DOUBLE / 0.1::DOUBLE + 0.5) AS BIGINT) AS {n}" for c, n in (("row_mm", "row_u"), ("satin_mm", "satin_u"), ("length_mm", "length_u"), ("pull_mm", "pull_u"), ("push_mm", "push_u"), ("min_mm", "min_u"), ("trim_mm", "trim_u"))) + " FROM fabric")
def _(spark, d):
    u = X.mm_to_units
    return dims.fabrics(spark).select("id", u("row_spacing_mm").alias("row_u"), u("satin_spacing_mm").alias("satin_u"), u("stitch_length_mm").alias("length_u"), u("pull_mm").alias("pull_u"), u("push_mm").alias("push_u"), u("min_object_mm").alias("min_u"), u("trim_distance_mm").alias("trim_u"))


@query("fabric_lookup_default", f"""WITH {dims.FABRIC_SQL}, o AS (SELECT o_orderkey, ['denim', 'towel', 'felt', 'silk', 'standard', NULL][o_orderkey % 6 + 1] AS want FROM orders)
SELECT o_orderkey, coalesce(f.id, 'standard') AS fabric, cast(floor(coalesce(f.row_mm, 0.4)::DOUBLE / 0.1::DOUBLE + 0.5) AS BIGINT) AS row_u, coalesce(f.needle, '75/11') AS needle FROM o LEFT JOIN fabric f ON o.want = f.id""")
def _(spark, d):
    wants = F.array(*(F.lit(x) for x in ("denim", "towel", "felt", "silk", "standard")), F.lit(None).cast("string"))
    o = A.table(spark, d, "orders").select("o_orderkey", F.element_at(wants, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("want"))
    return report.fabric_or_standard(o, "want").select("o_orderkey", "fabric", "row_u", "needle")


@query("density_spacing", _EDGES + "SELECT design_id, poly, cast(floor(CASE WHEN net2 / 2 < 100 OR net2 / 2 >= 15000 THEN 4.0::DOUBLE ELSE 4 * (1 + (1 - net2 / 2 / 15000.0::DOUBLE) * 0.4) END * 1000 + 0.5) AS BIGINT) AS spacing FROM na")
def _(spark, d):
    return geometry.net_areas(A.outlines(spark, d)).select("design_id", "poly", X.milli(X.density_spacing(F.col("net2") / 2.0, 4)).alias("spacing"))


_BANDS = f"""WITH {A.PIXELS_SQL}, lu AS (SELECT *, greatest(0, least(1, ((0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255.0::DOUBLE - 0.5) * 1.0::DOUBLE + 0.5 + 0.0)) AS v FROM px
), bn AS (SELECT img, x, y, cast(floor(v * 1000.0::DOUBLE + 0.5) AS BIGINT) AS lum_milli, CASE WHEN v < 0.92 THEN cast(least(2, floor(v * 3 / 0.92::DOUBLE)) AS BIGINT) END AS band FROM lu)
"""


@query("luminance_bands", _BANDS + "SELECT * FROM bn")
def _(spark, d):
    return raster.luminance_bands(A.pixels(spark, d))


@query("band_segments", _BANDS + ", bi AS (SELECT *, x - row_number() OVER (PARTITION BY img, y, band ORDER BY x) AS k FROM bn WHERE band IS NOT NULL) SELECT img, y, band, min(x) AS x1, max(x) AS x2 FROM bi GROUP BY img, y, band, k")
def _(spark, d):
    return raster.band_segments(raster.luminance_bands(A.pixels(spark, d)))


@query("majority_smooth", f"""WITH {A.PIXELS_SQL}, vo AS (SELECT p.img, p.x, p.y, q.label, sum(CASE WHEN q.x = p.x AND q.y = p.y THEN 2 ELSE 1 END) AS votes, min((q.y - p.y) * 3 + q.x - p.x) AS turn
  FROM px p JOIN px q ON p.img = q.img AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL)
SELECT img, x, y, arg_max(label, votes * 100 - turn) AS smooth FROM vo GROUP BY ALL""")
def _(spark, d):
    return raster.majority(A.pixels(spark, d).select("img", "x", "y", "label"))


@query("morph_close", f"""WITH {A.PIXELS_SQL}, k0 AS (SELECT img, x, y, label, (label = 1)::INT AS m FROM px), k1 AS (SELECT img, x, y, label, max(m) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM k0),
k2 AS (SELECT img, x, y, label, max(m) OVER (PARTITION BY img, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM k1), k3 AS (SELECT img, x, y, label, min(m) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM k2)
SELECT img, x, y, label, min(m) OVER (PARTITION BY img, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS closed FROM k3""")
def _(spark, d):
    return raster.closing(A.pixels(spark, d), 1)


@query("boundary_edges", f"""WITH {A.PIXELS_SQL}, s(way, sx, sy, ex, ey) AS (VALUES (0, 0, 0, 1, 0), (1, 1, 0, 1, 1), (2, 1, 1, 0, 1), (3, 0, 1, 0, 0)),
near AS (SELECT *, [lag(label) OVER c, lead(label) OVER r, lead(label) OVER c, lag(label) OVER r] AS beside FROM px WINDOW c AS (PARTITION BY img, x ORDER BY y), r AS (PARTITION BY img, y ORDER BY x))
SELECT img, label, x + sx AS sx, y + sy AS sy, x + ex AS ex, y + ey AS ey FROM near, s WHERE beside[way + 1] IS DISTINCT FROM label""")
def _(spark, d):
    return raster.boundary_edges(A.pixels(spark, d))


@query("palette_means", f"""WITH {A.PIXELS_SQL}, pm AS (SELECT img, label, cast(floor(sum(r) / count(*) + 0.5) AS BIGINT) AS r, cast(floor(sum(g) / count(*) + 0.5) AS BIGINT) AS g, cast(floor(sum(b) / count(*) + 0.5) AS BIGINT) AS b, min(y * 65536 + x) AS f FROM px GROUP BY ALL)
SELECT img, label, r, g, b, cast(row_number() OVER (PARTITION BY img ORDER BY f) - 1 AS BIGINT) AS place FROM pm""")
def _(spark, d):
    return raster.palette_of(A.pixels(spark, d))


@query("white_background", f"WITH {A.PIXELS_SQL} SELECT img, count(*) FILTER (r >= 200 AND g >= 120 AND b >= 60) >= 3 AND img <> 3 AS white FROM px WHERE x IN (0, 63) AND y IN (0, 47) GROUP BY img")
def _(spark, d):
    """The fourth image has a transparent corner."""
    px = A.pixels(spark, d).select("img", "x", "y", F.when(F.col("r") >= 200, 255).otherwise(0).alias("r"), F.when(F.col("g") >= 120, 255).otherwise(0).alias("g"), F.when(F.col("b") >= 60, 255).otherwise(0).alias("b"))
    return raster.white_background(px.withColumn("a", F.when((F.col("img") == 3) & (F.col("x") == 63) & (F.col("y") == 0), 0).otherwise(255)))


_LIB = f"WITH {A.LIBRARY_SQL}"


@query("library_search", _LIB + " SELECT id, name, favorite, updated, stitch_count FROM lib WHERE (contains(lower(coalesce(name, '')), 'the') OR contains(lower(coalesce(note, '')), 'the') OR len(list_filter(tags, lambda t: contains(lower(coalesce(t, '')), 'the'))) > 0) AND list_contains(tags, 'en')")
def _(spark, d):
    return library.search(A.library(spark, d), "The", ["en"]).select("id", "name", "favorite", "updated", "stitch_count")


@query("library_favorites", _LIB + " SELECT id, name, updated FROM lib WHERE favorite")
def _(spark, d):
    return library.search(A.library(spark, d), favorites=True).select("id", "name", "updated")


@query("library_tags", _LIB + " SELECT DISTINCT unnest(tags) AS tag FROM lib")
def _(spark, d):
    return library.tags(A.library(spark, d))


_RECENT = """, rc AS (SELECT user_id, event_id % 1500 AS id, max(event_id) AS used FROM events GROUP BY ALL), rd AS (SELECT user_id, id, cast(row_number() OVER (PARTITION BY user_id ORDER BY used DESC, id) - 1 AS BIGINT) AS place FROM rc)"""


@query("library_recent", _LIB + _RECENT + " SELECT user_id, place, id, name, favorite FROM rd JOIN lib USING (id) WHERE place < 12")
def _(spark, d):
    uses = A.table(spark, d, "events").select("user_id", (F.col("event_id") % 1500).alias("id"), F.col("event_id").alias("at"))
    return library.recent_entries(library.recent(uses), A.library(spark, d))


@query("library_upsert", _LIB + " SELECT id, CASE WHEN id % 10 = 3 THEN 'changed' ELSE name END AS name, CASE WHEN id % 10 = 3 THEN true ELSE favorite END AS favorite FROM lib UNION ALL SELECT -1 - id, 'added', false FROM lib WHERE id % 10 = 4")
def _(spark, d):
    lib = A.library(spark, d)
    changed = lib.where("id % 10 = 3").withColumns({"name": F.lit("changed"), "favorite": F.lit(True)})
    added = lib.where("id % 10 = 4").withColumns({"id": -1 - F.col("id"), "name": F.lit("added"), "favorite": F.lit(False)})
    return library.upsert(lib, changed.unionByName(added)).select("id", "name", "favorite")


@query("library_toggle", _LIB + " SELECT id, favorite <> (id % 5 = 0) AS favorite FROM lib WHERE id % 7 <> 0")
def _(spark, d):
    lib = A.library(spark, d)
    return library.toggle_favorite(library.remove(lib, lib.where("id % 7 = 0").select("id")), lib.where("id % 5 = 0").select("id")).select("id", "favorite")


def _glyphs(spark, d):
    """A customer's name and, on a second line, its market segment; letters are 30 to 53 wide."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("text_id"), F.concat_ws("\n", "c_name", "c_mktsegment").alias("s"))
    g = c.select("text_id", F.posexplode(F.split("s", "")).alias("pos", "char")).where("char <> ''")
    return g.withColumn("advance", (F.ascii("char") % 24 + 30).cast("long"))


_GLYPHS = "WITH tx AS (SELECT c_custkey AS text_id, concat_ws(chr(10), c_name, c_mktsegment) AS s FROM customer), gl AS (SELECT text_id, (i - 1)::INT AS pos, s[i] AS char, (ascii(s[i]) % 24 + 30)::BIGINT AS advance FROM (SELECT text_id, s, unnest(generate_series(1, length(s))) AS i FROM tx))"


@query("text_layout_horizontal", _GLYPHS + """, g1 AS (SELECT *, count(*) FILTER (char = chr(10)) OVER (PARTITION BY text_id ORDER BY pos) AS line FROM gl),
g2 AS (SELECT *, 2 * coalesce(sum(advance + 4) OVER (PARTITION BY text_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + advance AS hx, line * 168 AS hy FROM g1 WHERE char <> chr(10))
SELECT text_id, pos, char, cast(2 * hx - min(hx) OVER (PARTITION BY text_id) - max(hx) OVER (PARTITION BY text_id) AS BIGINT) AS x4, cast(2 * hy - min(hy) OVER (PARTITION BY text_id) - max(hy) OVER (PARTITION BY text_id) AS BIGINT) AS y4 FROM g2""")
def _(spark, d):
    return layout.horizontal(_glyphs(spark, d), 84, 4)


@query("text_layout_vertical", _GLYPHS + """, g1 AS (SELECT *, count(*) FILTER (char = chr(10)) OVER (PARTITION BY text_id ORDER BY pos) AS line FROM gl),
g2 AS (SELECT *, -line * 168 AS hx, (row_number() OVER (PARTITION BY text_id, line ORDER BY pos) - 1) * 128 + 60 AS hy FROM g1 WHERE char <> chr(10))
SELECT text_id, pos, char, cast(2 * hx - min(hx) OVER (PARTITION BY text_id) - max(hx) OVER (PARTITION BY text_id) AS BIGINT) AS x4, cast(2 * hy - min(hy) OVER (PARTITION BY text_id) - max(hy) OVER (PARTITION BY text_id) AS BIGINT) AS y4 FROM g2""")
def _(spark, d):
    return layout.vertical(_glyphs(spark, d), 60, 84, 4)


@query("text_layout_arc", _GLYPHS + """, g1 AS (SELECT *, sum(advance + 4) OVER (PARTITION BY text_id) - 4 AS total, coalesce(sum(advance + 4) OVER (PARTITION BY text_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM gl WHERE char <> chr(10)),
g2 AS (SELECT *, (done + advance / 2.0::DOUBLE - total / 2.0::DOUBLE) / 600.0::DOUBLE AS a FROM g1), g3 AS (SELECT *, sin(a) * 600.0::DOUBLE AS ax, cos(a) * -600.0::DOUBLE AS ay FROM g2)
SELECT text_id, pos, char, cast(floor((ax * 2 - (min(ax) OVER w + max(ax) OVER w)) / 2 * 1000.0::DOUBLE + 0.5) AS BIGINT) AS x, cast(floor((ay * 2 - (min(ay) OVER w + max(ay) OVER w)) / 2 * 1000.0::DOUBLE + 0.5) AS BIGINT) AS y, cast(floor(-a * 1000.0::DOUBLE + 0.5) AS BIGINT) AS rotation FROM g3 WINDOW w AS (PARTITION BY text_id)""")
def _(spark, d):
    return layout.arc(_glyphs(spark, d), 600.0, 0.0, 4)


@query("text_quality", "SELECT p_partkey, p_size::BIGINT * 3 AS font_size, p_partkey % 2 = 0 AS puffy, concat_ws(',', CASE WHEN p_size * 3 * 0.1::DOUBLE < CASE WHEN p_partkey % 2 = 0 THEN 8.0 ELSE 5.0 END THEN 'critical:height' END, CASE WHEN p_size * 3 * 0.1::DOUBLE * 0.12::DOUBLE < 1.0 THEN 'notice:stem' END, CASE WHEN p_partkey % 2 = 0 AND p_size * 3 * 0.1::DOUBLE < 10.0 THEN 'notice:puffy' END) AS warnings FROM part")
def _(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("long") * 3).alias("font_size"), (F.col("p_partkey") % 2 == 0).alias("puffy"))
    return layout.quality(p).withColumn("warnings", F.array_join("warnings", ","))


@query("ascii_label", r"SELECT doc_id, rpad(substr(regexp_replace(text, '[^\x20-\x7e]', '_', 'g'), 1, 16), 16, ' ') AS label, upper(substr(source, 1, 8)) AS base FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.label_text("text").alias("label"), F.upper(F.substring("source", 1, 8)).alias("base"))


@query("work_order", _RUNS + """SELECT design_id, stitches, colors, color_changes, trims, width, height, cast(floor(stitches / 400.0::DOUBLE * 1000.0::DOUBLE + 0.5) AS BIGINT) AS minutes, thread_milli,
  concat_ws(';', CASE WHEN stitches > 12000 THEN 'too many stitches' END, CASE WHEN width > 1000 OR height > 1000 THEN 'over the hoop' END) AS notes
FROM cn JOIN bd USING (design_id) JOIN (SELECT design_id, cast(sum(length_milli) AS BIGINT) AS thread_milli, count(*) AS colors FROM tl GROUP BY design_id) USING (design_id)""")
def _(spark, d):
    return report.work_order(A.stitches(spark, d))


_THREADS = ", ".join(f"('{t}', {h >> 16 & 255}, {h >> 8 & 255}, {h & 255})" for t in ("click", "view", "purchase", "scroll", "signup", "add_to_cart", "error", "search", "login", "logout") for h in [__import__("zlib").crc32(t.encode())])


@query("thread_usage", _RUNS + f""", {dims.PALETTE_SQL}, tc(thread, r, g, b) AS (VALUES {_THREADS}), tp AS (SELECT thread, arg_min(pec_index, ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) * 100 + pec_index) AS pec_index, arg_min(pname, ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) * 100 + pec_index) AS name FROM tc, palette GROUP BY thread),
un AS (SELECT design_id, block_idx, thread, count(*) AS stitches FROM st GROUP BY ALL)
SELECT design_id, block_idx + 1 AS sew_order, thread, pec_index, name, stitches, length_milli FROM un JOIN tl USING (design_id, block_idx, thread) JOIN tp USING (thread)""")
def _(spark, d):
    return report.usage(A.stitches(spark, d))


@query("hidden_ratio", _EDGES.replace("WITH ", f"WITH {A.STITCHES_SQL.strip()}, ", 1) + """, hp AS (SELECT design_id, block_idx, run_idx, seq, x, y FROM st)
SELECT s.design_id, s.block_idx, s.run_idx, count(*) AS points, count(*) FILTER (EXISTS (SELECT 1 FROM bx b WHERE b.design_id = s.design_id % 50 AND b.poly % 7 > s.block_idx AND s.x >= b.bx0 AND s.x < b.bx1 AND s.y >= b.by0 AND s.y < b.by1)) AS hidden FROM hp s GROUP BY ALL""")
def _(spark, d):
    """Points of runs under outlines that are sewn later (layer over their block): points meet the rings of their cells only, then a join by
    point."""
    s = A.stitches(spark, d)
    keys = ["plan", "block_idx", "run_idx"]
    q = s.select((F.col("design_id") % 50).alias("design_id"), F.col("design_id").alias("plan"), "block_idx", "run_idx", F.col("seq").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    # of outlines that lie on each other the last layer hides, and points in one place lie under the same ones
    layers = A.rings(spark, d).groupBy("design_id", "outer").agg(F.max(F.col("poly") % 7).alias("layer"))
    top = vector.holders(vector.places(q), layers).groupBy("design_id", "qx", "qy").agg(F.max("layer").alias("layer"))
    return q.join(top, ["design_id", "qx", "qy"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if(F.coalesce(F.col("layer") > F.col("block_idx"), F.lit(False))).alias("hidden")).withColumnRenamed("plan", "design_id")


@query("arc_length", _RUNS + "SELECT design_id, block_idx, run_idx, seq, cast(coalesce(sum(len) OVER (PARTITION BY design_id, block_idx, run_idx ORDER BY seq), 0) AS BIGINT) AS along FROM stl")
def _(spark, d):
    w = Window.partitionBy(*plan.RUN).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = plan.steps(A.stitches(spark, d)).withColumn("len", X.milli(X.distance("dx", "dy")))
    return s.select(*plan.RUN, "seq", F.coalesce(F.sum("len").over(w), F.lit(0)).alias("along"))


@query("angle_mode", _RUNS + """, am AS (SELECT design_id, cast(floor((degrees(atan2(dy::DOUBLE, dx::DOUBLE)) + 360) % 180 / 5) AS BIGINT) % 36 AS bin, sum(len) AS total FROM stl WHERE dd > 0 GROUP BY ALL)
SELECT design_id, arg_max(bin, total * 100 - bin) * 5 AS angle FROM am GROUP BY design_id""")
def _(spark, d):
    """The direction of most stitched length, in bins of five degrees; the first on ties."""
    s = plan.steps(A.stitches(spark, d)).where("dx <> 0 or dy <> 0")
    s = s.withColumn("bin", (F.floor(X.stitch_angle("dx", "dy") / 5) % 36).cast("long")).groupBy("design_id", "bin").agg(F.sum(X.milli(X.distance("dx", "dy"))).alias("total"))
    return s.groupBy("design_id").agg((F.max_by("bin", F.struct("total", -F.col("bin"))) * 5).alias("angle"))


for _part in (kernel_queries, catalog_shapes, catalog_records, catalog_kernels, catalog_pictures, catalog_plans):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
SQL |= {name: f"SELECT {catalog_plans.PART_OF.get(name, '*')} FROM ({SQL[other]})" for name, other in catalog_plans.SAME_AS.items()}
