"""Registered queries of elements, objects, undo logs, names, settings, recommendations and exports, with SQL for the same values."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators import records as R
from threadloom.sources import adapters as A
from threadloom.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


_ST = f"WITH {A.STITCHES_SQL}"
_RUNS = _ST + """, er AS (SELECT design_id, block_idx, run_idx, any_value(thread) AS thread, count(*) AS n, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1 FROM st GROUP BY ALL),
eo AS (SELECT *, sum(n) OVER w AS to_pos, lag(x1) OVER v AS px, lag(y1) OVER v AS py FROM er WINDOW w AS (PARTITION BY design_id ORDER BY block_idx, run_idx ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY design_id ORDER BY block_idx, run_idx))"""


@query("element_ranges", _RUNS + "SELECT design_id, run_idx % 3 AS object_id, cast(sum(n) AS BIGINT) AS n, cast(min(to_pos - n) AS BIGINT) AS from_pos, cast(max(to_pos) AS BIGINT) AS to_pos FROM eo GROUP BY ALL")
def _(spark, d):
    return R.element_ranges(A.stitches(spark, d).withColumn("object_id", F.col("run_idx") % 3))


@query("layer_counts", _ST + "SELECT design_id, block_idx % 2 AS layer, count(*) AS stitches FROM st GROUP BY ALL")
def _(spark, d):
    return R.layer_counts(A.stitches(spark, d).withColumn("layer", F.col("block_idx") % 2))


@query("compile_stats", _RUNS + """, ed AS (SELECT *, cast(x0 - px AS BIGINT) * (x0 - px) + cast(y0 - py AS BIGINT) * (y0 - py) AS d2 FROM eo), ec AS (SELECT *, CASE WHEN px IS NULL THEN 'trim' WHEN d2 < 900 THEN 'continuous' WHEN d2 < 250000 THEN 'jump' ELSE 'trim' END AS how FROM ed),
eg AS (SELECT design_id, cast(sum(n) AS BIGINT) AS stitches, count(DISTINCT thread) AS colors, greatest(0, count(DISTINCT block_idx) - 1) AS color_changes, count(*) FILTER (run_idx > 0 AND how = 'trim') AS trims, count(*) FILTER (run_idx > 0 AND how = 'jump') AS jumps, coalesce(max(d2) FILTER (run_idx > 0 AND how <> 'continuous'), 0) AS d2 FROM ec GROUP BY design_id),
eb AS (SELECT design_id, max(x) - min(x) AS width, max(y) - min(y) AS height FROM st GROUP BY design_id)
SELECT design_id, stitches, colors, color_changes, trims, jumps, width, height, cast(floor(stitches / 400.0::DOUBLE * 10 + 0.5) AS BIGINT) AS minutes_tenths, cast(floor(sqrt(d2::DOUBLE) + 0.5) AS BIGINT) AS longest_jump FROM eg JOIN eb USING (design_id)""")
def _(spark, d):
    return R.compile_stats(A.stitches(spark, d))


def _numbered(spark, d):
    from pyspark.sql import Window

    c = A.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("design_id"), F.col("c_custkey").alias("k"))
    return c.withColumn("region_idx", (F.row_number().over(Window.partitionBy("design_id").orderBy("k")) - 1).cast("int"))


_NUMBERED = "WITH rn AS (SELECT c_custkey % 50 AS design_id, c_custkey AS k, cast(row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey) - 1 AS INT) AS region_idx FROM customer)"


@query("restored_objects", _NUMBERED + """, sv AS (SELECT design_id, region_idx, CASE WHEN region_idx % 4 <> 3 THEN k * 10 END AS object_id FROM rn WHERE design_id % 5 <> 0 OR region_idx > 0),
sz AS (SELECT design_id, max(object_id) AS top FROM sv GROUP BY design_id), j AS (SELECT r.*, design_id % 5 <> 0 AS same, CASE WHEN design_id % 5 <> 0 THEN s.object_id END AS known, top FROM rn r LEFT JOIN sv s USING (design_id, region_idx) LEFT JOIN sz USING (design_id))
SELECT design_id, k, region_idx, coalesce(known, CASE WHEN same THEN top ELSE -1 END + row_number() OVER (PARTITION BY design_id, known IS NULL ORDER BY region_idx)) AS object_id FROM j""")
def _(spark, d):
    """Saved ids by position; one in four is missing, and a design in five has lost an object."""
    r = _numbered(spark, d)
    saved = r.where("design_id % 5 <> 0 or region_idx > 0").select("design_id", F.col("region_idx").alias("pos"), F.when(F.col("region_idx") % 4 != 3, F.col("k") * 10).alias("object_id"))
    return R.restored(r, saved).select("design_id", "k", "region_idx", "object_id")


@query("appended_regions", _NUMBERED + """, pt AS (SELECT design_id, k, 'fill' AS kind, 0 AS part, region_idx FROM rn WHERE k % 3 <> 0 UNION ALL SELECT design_id, k, 'stroke', 1, region_idx FROM rn WHERE k % 3 = 0 UNION ALL SELECT design_id, k, 'restored', 2, region_idx FROM rn WHERE k % 7 = 0)
SELECT design_id, k, kind, cast(row_number() OVER (PARTITION BY design_id ORDER BY part, region_idx) - 1 AS INT) AS region_idx FROM pt""")
def _(spark, d):
    r = _numbered(spark, d)
    kind = lambda name, where: r.where(where).withColumn("kind", F.lit(name))
    return R.appended(kind("fill", "k % 3 <> 0"), kind("stroke", "k % 3 = 0"), kind("restored", "k % 7 = 0")).select("design_id", "k", "kind", "region_idx")


@query("moved_objects", _NUMBERED + """, od AS (SELECT design_id, region_idx % 2 AS block_idx, cast(region_idx // 2 AS BIGINT) AS place, k AS object_id FROM rn), mv AS (SELECT design_id, min(k) AS object_id, CASE design_id % 3 WHEN 0 THEN -1 ELSE 1 END AS way FROM rn GROUP BY design_id),
lm AS (SELECT o.*, max(CASE WHEN m.object_id IS NOT NULL THEN place END) OVER w AS spot, max(way) OVER w AS way, max(place) OVER w AS last FROM od o LEFT JOIN mv m USING (design_id, object_id) WINDOW w AS (PARTITION BY design_id, block_idx))
SELECT design_id, block_idx, CASE WHEN spot IS NULL OR spot + way < 0 OR spot + way > last THEN place WHEN place = spot THEN spot + way WHEN place = spot + way THEN spot ELSE place END AS place, object_id FROM lm""")
def _(spark, d):
    """Each design's first object moved back where it can't go, or forth."""
    r = _numbered(spark, d)
    order = r.select("design_id", (F.col("region_idx") % 2).alias("block_idx"), F.floor(F.col("region_idx") / 2).alias("place"), F.col("k").alias("object_id"))
    moves = r.groupBy("design_id").agg(F.min("k").alias("object_id")).withColumn("way", F.when(F.col("design_id") % 3 == 0, -1).otherwise(1))
    return R.moved_in_color(order, moves)


@query("undo_states", """WITH l AS (SELECT c_custkey AS design_id, 1 + c_custkey % 45 AS n, c_custkey % 37 AS u, c_custkey % 3 AS r FROM customer), m AS (SELECT *, least(u, 30, n - 1) AS back FROM l), o AS (SELECT *, least(r, back) AS forth FROM m)
SELECT design_id, 's' || (n - back + forth) AS state, least(30, n - 1) - back + forth AS can_undo, back - forth AS can_redo FROM o""")
def _(spark, d):
    """Some records (each twice, which counts once), some undos, some redos."""
    k = F.col("c_custkey")
    step = lambda action, count, at, state: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), count), lambda i: i > 0), lambda i: F.struct((F.lit(at) + i).alias("seq"), F.lit(action).alias("action"), state(i).alias("state")))
    name = lambda i: F.concat(F.lit("s"), i.cast("string"))
    none = lambda i: F.lit(None).cast("string")
    twice = F.flatten(F.transform(step("record", 1 + k % 45, 0, name), lambda s: F.array(F.struct((s["seq"] * 2).alias("seq"), s["action"].alias("action"), s["state"].alias("state")), F.struct((s["seq"] * 2 + 1).alias("seq"), s["action"].alias("action"), s["state"].alias("state")))))
    log = F.concat(twice, step("undo", k % 37, 1000, none), step("redo", k % 3, 2000, none))
    c = A.dealt(A.table(spark, d, "customer").select(k), "c_custkey").select(k.alias("design_id"), F.explode(log).alias("l"))
    return R.undo_states(c.select("design_id", "l.*"))


@query("design_names", r"""SELECT p_partkey, coalesce(nullif(substr(regexp_replace(CASE WHEN p_partkey % 5 = 0 THEN '!?' ELSE p_name END, '[^A-Za-z0-9_-]', '', 'g'), 1, 8), ''), 'SKETCH') AS name,
upper(substr(CASE p_partkey % 3 WHEN 0 THEN 'design' WHEN 1 THEN p_name ELSE p_name || '.v2' END, 1, 8)) AS base, 'TL-' || upper(to_base(1700000000000 + p_partkey * 977, 36)) || '-' || upper(to_base(p_partkey % 65536, 36)) AS id FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    file = F.when(k % 3 == 0, ".png").when(k % 3 == 1, F.concat("p_name", F.lit(".png"))).otherwise(F.concat("p_name", F.lit(".v2.png")))
    return A.table(spark, d, "part").select("p_partkey", R.design_name(F.when(k % 5 == 0, "!?").otherwise(F.col("p_name"))).alias("name"), R.base_name(file, F.lit("")).alias("base"), R.short_id(F.lit(1_700_000_000_000) + k * 977, k % 65536).alias("id"))


_ANSWERS = """WITH a AS (SELECT p_partkey AS k, ['photo', 'logo', 'sculpture', NULL][p_partkey % 4 + 1] AS kind, p_partkey % 17 - 1 + 0.5 AS colors, p_partkey % 5 AS satins, p_partkey % 4 AS tatamis, ['low', 'high', 'dense'][p_partkey % 3 + 1] AS density, p_partkey % 40 AS jump FROM part)"""


@query("analysis_answers", _ANSWERS + """, s AS (SELECT *, satins + tatamis AS parts, satins * CASE density WHEN 'low' THEN 1.5 WHEN 'high' THEN 0.9 ELSE 1.0 END + tatamis AS total FROM a WHERE kind IN ('photo', 'logo')),
m AS (SELECT *, CASE WHEN parts > 0 THEN total::DOUBLE / parts ELSE 1.0::DOUBLE END AS mean FROM s),
n1 AS (SELECT *, CASE WHEN abs(0.9::DOUBLE - mean) < abs(1.0::DOUBLE - mean) THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS b1 FROM m), n2 AS (SELECT *, CASE WHEN abs(1.25::DOUBLE - mean) < abs(b1 - mean) THEN 1.25::DOUBLE ELSE b1 END AS b2 FROM n1)
SELECT k, kind, greatest(2, least(12, floor(colors + 0.5)))::INT AS colors, greatest(1, least(30, jump))::DOUBLE AS max_jump_mm, CASE WHEN satins > 2 * tatamis THEN 'satin' WHEN tatamis > 2 * satins THEN 'tatami' ELSE 'auto' END AS fill_type,
CASE WHEN abs(1.5::DOUBLE - mean) < abs(b2 - mean) THEN 1.5::DOUBLE ELSE b2 END AS density, k % 6 = 0 AS remove_white FROM n2""")
def _(spark, d):
    """Answers as JSON, some of no known kind, with numbers out of bounds and densities of no known name."""
    k = F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (k % n + 1).cast("int"))
    part = lambda n, kind, density: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i > 0), lambda i: F.struct(F.lit(kind).alias("stitch_type"), density.alias("density")))
    body = F.struct(
        pick(("photo", "logo", "sculpture", None), 4).alias("image_type"), F.struct((k % 17 - 1 + 0.5).alias("target_color_count")).alias("color_reduction_plan"), F.struct((k % 40).alias("max_jump_before_trim_mm")).alias("thread_trim_plan"),
        F.concat(part(k % 5, "satin", pick(("low", "high", "dense"), 3)), part(k % 4, "tatami", F.lit("medium"))).alias("stitch_plan"), F.when(k % 6 == 0, F.array(F.struct(F.lit("sky").alias("reason")))).alias("transparent_or_empty_regions"),
    )
    a = A.table(spark, d, "part").select(k.alias("k"), R.analysis(F.to_json(body)).alias("a")).where("a is not null").withColumn("r", R.recommended("a"))
    return a.select("k", F.col("a.image_type").alias("kind"), F.col("a.colors").alias("colors"), F.col("a.max_jump_mm").alias("max_jump_mm"), "r.fill_type", "r.density", "r.remove_white")


@query("project_settings", """SELECT c_custkey::VARCHAR AS file, CASE WHEN c_custkey % 4 = 0 THEN 'untitled' ELSE c_name END AS name, c_custkey % 5 BETWEEN 1 AND 3 AS ok, CASE c_custkey % 5 WHEN 0 THEN 'no version' WHEN 4 THEN 'version 4 is later than 3' END AS error,
CASE WHEN c_custkey % 3 = 0 THEN 45 ELSE c_custkey % 180 END::DOUBLE AS angle, CASE WHEN c_custkey % 3 = 0 THEN 'standard' ELSE 'denim' END AS fabric, CASE WHEN c_custkey % 3 <> 0 THEN '{"deep":1}' END AS extra, CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 10 END - 1 AS n_settings FROM customer""")
def _(spark, d):
    """Projects without a version or of a later one, without settings, or with some of them and one that no version knows."""
    k = F.col("c_custkey")
    settings = F.struct((k % 180).cast("double").alias("angleDeg"), F.lit("denim").alias("fabricId"), F.struct(F.lit(1).alias("deep")).alias("extra"))
    body = F.struct(F.when(k % 5 != 0, k % 5).alias("version"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 3 != 0, settings).alias("settings"))
    p = files.projects(A.table(spark, d, "customer").select(k.cast("string").alias("file"), F.to_json(body).alias("content")))
    return p.select("file", "name", "ok", "error", F.col("angleDeg").alias("angle"), F.col("fabricId").alias("fabric"), F.element_at("settings", "extra").alias("extra"), F.size("settings").alias("n_settings"))


@query("exported_csv", _ST + "SELECT design_id, 'csv' AS format, count(*) AS lines, cast(sum(strlen(x::VARCHAR) + strlen(y::VARCHAR) + 2) AS BIGINT) AS bytes FROM st GROUP BY design_id")
def _(spark, d):
    """A format of one's own: a line for each stitch."""
    files.register_exporter("csv", lambda plan: "".join(f"{x},{y}\n" for b in plan["blocks"] for r in b["runs"] for x, y in r["stitches"]).encode())
    rgb = {c: F.lit(0) for c in "rgb"}
    out = files.exported(A.stitches(spark, d).withColumns(rgb | {"connection": F.lit("jump")}), "csv")
    return out.select("design_id", "format", (F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1).cast("long").alias("lines"), F.length("content").cast("long").alias("bytes"))


@query("answers_or_local", """SELECT c_custkey AS design_id, c_custkey % 3 = 0 AS answered, CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 7 END::BIGINT AS color_count, CASE WHEN c_custkey % 3 = 0 THEN 'satin' ELSE 'auto' END AS fill_type, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'edge' END AS underlay, CASE WHEN c_custkey % 3 = 0 THEN 1.5 ELSE 1.25 END::DOUBLE AS density_scale, false AS remove_white FROM customer""")
def _(spark, d):
    """A model's answer for one design in three, none or one of no known kind for the others, which take the local recommendation."""
    k = F.col("design_id")
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("design_id"))
    local = c.select("design_id", F.lit(7).cast("long").alias("color_count"), F.lit("auto").alias("fill_type"), F.lit("edge").alias("underlay"), F.lit(1.25).alias("density_scale"), F.lit(False).alias("remove_white"))
    good = '{"image_type":"logo","color_reduction_plan":{"target_color_count":4},"stitch_plan":[{"stitch_type":"satin","density":"low"}]}'
    answers = c.select("design_id", F.when(k % 3 == 0, good).when(k % 3 == 1, '{"image_type":"sculpture"}').alias("answer"))
    return R.with_fallback(answers, local).withColumn("color_count", F.col("color_count").cast("long"))


@query("project_files", """SELECT c_custkey::VARCHAR AS file, c_name AS name, 3 AS version, c_custkey % 180 + 0.5::DOUBLE AS angle, CASE WHEN c_custkey % 2 = 0 THEN '2020-02-0' || (1 + c_custkey % 9) || 'T00:00:00.000Z' ELSE '2024-03-01T12:30:00.250Z' END AS created, '2024-03-01T12:30:00.250Z' AS updated FROM customer""")
def _(spark, d):
    """Projects written as JSON, every second one for the first time, and what the text holds."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), F.to_json(F.struct(F.lit(1).alias("version"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("2020-02-0"), 1 + F.col("c_custkey") % 9, F.lit("T00:00:00.000Z"))).alias("createdAt"), F.struct((F.col("c_custkey") % 180 + 0.5).alias("angleDeg")).alias("settings"))).alias("content"))
    out = files.project_json(files.projects(c), F.expr("make_timestamp(2024, 3, 1, 12, 30, 0.25, 'UTC')"))
    at = lambda path: F.get_json_object("content", path)
    return out.select("file", at("$.name").alias("name"), at("$.version").cast("int").alias("version"), at("$.settings.angleDeg").cast("double").alias("angle"), at("$.createdAt").alias("created"), at("$.updatedAt").alias("updated"))
