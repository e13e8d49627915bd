"""Stitch plans, outlines, colours, pixels and a library, as views of the generic test tables.

These adapters are ours: they give the operators deterministic input.  Each comes with the same view in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A gap of four days in a user's events of one type begins a new run.
RUN_BREAK_US = 345_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as the session shuffles to.  For kernels that take long over rows that are few and small: Spark reads a
    file of them as one split, or a row group as one, and adaptive execution would put what was shuffled into one task again."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def stitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """design_id, thread, block_idx, run_idx, seq, x, y: a user is a design, an event type a colour block.  One shuffle, by
    design; all windows over parts of a design reuse it."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev = ev.select(
        F.col("user_id").alias("design_id"), F.col("event_type").alias("thread"), "event_id",
        (F.floor(F.col("value") * 10.0 + 0.5).cast("long") % 1001 - 500).cast("int").alias("x"),
        (F.get_json_object("props", "$.k").cast("int") * 10 - 500).alias("y"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    ).repartition("design_id")
    in_block = Window.partitionBy("design_id", "block_idx").orderBy("event_id")
    ev = ev.withColumn("block_idx", (F.dense_rank().over(Window.partitionBy("design_id").orderBy("thread")) - 1).cast("long"))
    ev = ev.withColumn("_break", F.when(F.col("us") - F.lag("us").over(in_block) > RUN_BREAK_US, 1).otherwise(0))
    ev = ev.withColumn("run_idx", F.sum("_break").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    ev = ev.withColumn("seq", (F.row_number().over(Window.partitionBy("design_id", "block_idx", "run_idx").orderBy("event_id")) - 1).cast("long"))
    return ev.select("design_id", "thread", "block_idx", "run_idx", "seq", "x", "y")


STITCHES_SQL = f"""
ev0 AS (
  SELECT user_id AS design_id, event_type AS thread, event_id, epoch_us(ts) AS us,
         cast(cast(floor(value * 10.0 + 0.5) AS BIGINT) % 1001 - 500 AS INT) AS x, cast(regexp_extract(props, '([0-9]+)', 1) AS INT) * 10 - 500 AS y,
         cast(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS BIGINT) AS block_idx FROM events
), ev1 AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY design_id, block_idx ORDER BY event_id) > {RUN_BREAK_US} THEN 1 ELSE 0 END AS b FROM ev0
), ev2 AS (
  SELECT *, cast(sum(b) OVER (PARTITION BY design_id, block_idx ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_idx FROM ev1
), st AS (
  SELECT design_id, thread, block_idx, run_idx, cast(row_number() OVER (PARTITION BY design_id, block_idx, run_idx ORDER BY event_id) - 1 AS BIGINT) AS seq, x, y FROM ev2
)"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """design_id, poly, thread, ring (0: outer, 1: hole), i, x, y: a customer is a box, every third one with a hole."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("thread"))
    k = F.col("k")
    c = c.select((k % 50).alias("design_id"), k.alias("poly"), "thread", ((k * 37) % 801 - 400).alias("cx"), ((k * 53) % 801 - 400).alias("cy"), (k % 60 + 20).alias("w"), ((k * 7) % 60 + 20).alias("h"))
    corner = lambda ring, i, sx, sy, w, h: F.struct(F.lit(ring).alias("ring"), F.lit(i).alias("i"), (F.col("cx") + sx * w).alias("x"), (F.col("cy") + sy * h).alias("y"))
    outer = [corner(0, i, sx, sy, F.col("w"), F.col("h")) for i, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))]
    hole = [corner(1, i, sx, sy, F.lit(5), F.lit(5)) for i, (sx, sy) in enumerate(((-1, -1), (-1, 1), (1, 1), (1, -1)))]
    points = F.when(F.col("poly") % 3 == 0, F.array(*outer, *hole)).otherwise(F.array(*outer))
    return c.select("design_id", "poly", "thread", F.explode(points).alias("p")).select("design_id", "poly", "thread", "p.*")


_CORNERS = [(0, 0, -1, -1), (0, 1, 1, -1), (0, 2, 1, 1), (0, 3, -1, 1), (1, 0, -1, -1), (1, 1, -1, 1), (1, 2, 1, 1), (1, 3, 1, -1)]
OUTLINES_SQL = f"""
pc AS (SELECT c_custkey AS k, c_mktsegment AS thread FROM customer),
corner(ring, i, sx, sy) AS (VALUES {", ".join(map(str, _CORNERS))}),
poly AS (
  SELECT k % 50 AS design_id, k AS poly, thread, ring, i, (k * 37) % 801 - 400 + sx * CASE ring WHEN 0 THEN 20 + k % 60 ELSE 5 END AS x,
         (k * 53) % 801 - 400 + sy * CASE ring WHEN 0 THEN 20 + (k * 7) % 60 ELSE 5 END AS y
  FROM pc, corner WHERE ring = 0 OR k % 3 = 0
)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """design_id, poly, thread, outer, hole: rings as arrays of points, computed in place, without a shuffle."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("thread"))
    k = F.col("k")
    cx, cy, w, h = (k * 37) % 801 - 400, (k * 53) % 801 - 400, k % 60 + 20, (k * 7) % 60 + 20
    at = lambda sx, sy, w, h: F.struct((cx + sx * w).alias("x"), (cy + sy * h).alias("y"))
    outer = F.array(*(at(sx, sy, w, h) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    hole = F.array(*(at(sx, sy, F.lit(5), F.lit(5)) for sx, sy in ((-1, -1), (-1, 1), (1, 1), (1, -1))))
    return c.select((k % 50).alias("design_id"), k.alias("poly"), "thread", outer.alias("outer"), F.when(k % 3 == 0, hole).alias("hole"))


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, r, g, b of each part."""
    k = F.col("p_partkey")
    channel = lambda a, b: ((k * a + b) % 256).cast("int")
    return table(spark, sf_dir, "part").select(k.alias("id"), channel(37, 0).alias("r"), channel(91, 13).alias("g"), channel(151, 7).alias("b"))


COLORS_SQL = "rgb AS (SELECT p_partkey AS id, cast((p_partkey * 37) % 256 AS INT) AS r, cast((p_partkey * 91 + 13) % 256 AS INT) AS g, cast((p_partkey * 151 + 7) % 256 AS INT) AS b FROM part)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, x, y, label, r, g, b: an image of 64 by 48 for each supplier, with a disc (0), a ring (1), background (2) and some specks."""
    i = F.explode(F.sequence(F.lit(0), F.lit(64 * 48 - 1)))
    # pictures are dealt before they are spread, and what is grouped or ordered within a picture stays where it is
    px = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("img")), "img").select("img", i.alias("i"))
    px = px.select("img", (F.col("i") % 64).cast("int").alias("x"), F.expr("cast(i div 64 as int)").alias("y"))
    d = (F.col("x") - 32) * (F.col("x") - 32) + (F.col("y") - 24) * (F.col("y") - 24)
    label = F.when((F.col("x") * 7 + F.col("y") * 13 + F.col("img") * 5) % 97 == 0, (F.col("x") + F.col("y")) % 3).when(d < 100, 0).when(d < 400, 1).otherwise(2)
    px = px.withColumn("label", label.cast("int"))
    shade = lambda a, b: ((F.col("label") * a + F.col("x") + F.col("img") * b) % 256).cast("int")
    return px.select("*", shade(90, 3).alias("r"), shade(60, 11).alias("g"), shade(33, 7).alias("b"))


PIXELS_SQL = """
px0 AS (SELECT cast(s_suppkey AS INT) AS img, cast(i % 64 AS INT) AS x, cast(i // 64 AS INT) AS y FROM supplier, range(3072) t(i)),
px1 AS (
  SELECT *, cast(CASE WHEN (x * 7 + y * 13 + img * 5) % 97 = 0 THEN (x + y) % 3 WHEN (x - 32) * (x - 32) + (y - 24) * (y - 24) < 100 THEN 0
         WHEN (x - 32) * (x - 32) + (y - 24) * (y - 24) < 400 THEN 1 ELSE 2 END AS INT) AS label FROM px0
),
px AS (SELECT *, (label * 90 + x + img * 3) % 256 AS r, (label * 60 + x + img * 11) % 256 AS g, (label * 33 + x + img * 7) % 256 AS b FROM px1)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, note, tags, favorite, updated: a document is an entry."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang", "n_chars")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("note"), F.array("lang", "source").alias("tags"), (F.coalesce("quality", F.lit(0)) == 1).alias("favorite"),
        (F.col("doc_id") * 7919 % 100_003).alias("updated"), F.col("n_chars").alias("stitch_count"),
    )


LIBRARY_SQL = """
lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
lib AS (
  SELECT d.doc_id AS id, source AS name, text AS note, [lang, source] AS tags, coalesce(quality, 0) = 1 AS favorite, d.doc_id * 7919 % 100003 AS updated, n_chars AS stitch_count
  FROM documents d LEFT JOIN lb ON d.doc_id = lb.doc_id
)"""
