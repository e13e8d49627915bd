"""Mixing sources to target weights along a time-varying curriculum, native DataFrame operations only.

Training time runs from 0 to 1.  Source s is fed at the rate T_s * (1 + a_s * (2t - 1)): a_s < 0 fades it out, a_s > 0
fades it in, and the integral over the whole run is its target T_s whatever a_s is.  Cumulative demand up to t is
D_s(t) = T_s * (t + a_s * (t*t - t)).  A source's documents form a stream in the order of md5(doc_id), repeated until T_s
words are taken (the last one partly); the copy whose middle lies after d words is read at the t where D_s(t) = d, a root
of a quadratic.  Positions of all sources together are range-sorted.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating.  A target stops at 2 times its source's size
and the excess is reshared by weight.  The fixed point is min(2 * S_s, L * w_s), found by one running sum over the sources in
the order of S_s / w_s.

Rows that are alike in doc_id, text and source are summed first and go on as one, with a count.  Running sums over a source's documents
are split: each source is cut into buckets by its order, which is that of a digest of doc_id and text, sums of buckets are accumulated,
and each bucket is accumulated alone, so a source with a third of all rows, or as many rows without a doc_id, spreads over many tasks.

Cases: null and empty texts have size 0 and are never taken; a text of any length is one document; a null source is a source of its own;
documents that share a doc_id (or have none) are ordered by their texts, and repeated rows take turns, the first the earliest positions;
an empty table gives an empty result.  `mix` and `scheduled` give their own columns only; `mix_documents` hands on all columns, whatever
their names, and deals the turns of repeated rows by a hash of all their columns, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORDS, forget, only, partitions, stored, text_or_empty

WEIGHTS = (5, 2, 1)
#: a_s, in the order of the sources, repeating.
SLOPES = (-0.5, 0.0, 0.5)
SHARE, CAP = 1.5, 2
#: A bucket of a source is meant to hold so many rows.
BUCKET_ROWS = 500
#: Repeated rows are dealt out in runs of so many.
RUN = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, source_size), a row each: weight, slope, target."""
    pick = lambda xs, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in xs)), F.pmod(F.col("_k") - 1, F.lit(len(xs))).cast("int") + 1)
    # these windows run over one row for each source
    ranked = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumns({"weight": pick(weights, "long"), "slope": pick(slopes, "double"), "_all": F.sum("source_size").over(Window.partitionBy())})
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "_k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"_s": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_w": F.coalesce(F.sum("weight").over(before), F.lit(0)), "_sumw": F.sum("weight").over(Window.partitionBy())})
    level = (F.lit(float(share)) * F.col("_all") - F.lit(cap) * F.col("_s")) / (F.col("_sumw") - F.col("_w"))
    # where all sources before are at their caps, this one is not if the level times its weight stays under its cap
    ranked = ranked.withColumns({"_level": level, "_free": level * F.col("weight") < F.lit(float(cap)) * F.col("source_size")})
    ranked = ranked.withColumn("_l", F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("_l").isNull(), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("_l") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", "slope", target.alias("target"))


def _at(done, target, slope):
    """The t in 0..1 at which `done` words of the source have been fed."""
    u = F.when(target > 0, F.least(F.lit(1.0), done / target)).otherwise(F.lit(0.0))
    b = F.lit(1.0) - slope
    root = F.lit(2.0) * u / (b + F.sqrt(b * b + F.lit(4.0) * slope * u))
    return F.coalesce(root, F.lit(0.0))


def _text_key(text: str):
    return F.md5(text_or_empty(f"`{text}`"))


def _row_key(text_key, source):
    """What rows that are alike, but for their doc_id, share."""
    return F.concat(text_key, F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit("")))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", bucket_rows: int = BUCKET_ROWS, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """A thin row for each document: doc_id, text_key, source, size, source_size, target, taken, positions, an array of (t, words), one
    for each copy that the mix reads, and turn: the number of the row among `alike` rows that are."""
    thin = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.regexp_count(text_or_empty(f"`{text}`"), F.lit(WORDS)).cast("long").alias("size"), _text_key(text).alias("text_key")
    )
    thin = thin.groupBy("doc_id", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("alike"))
    thin = stored(thin.withColumn("_order", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), "text_key"))))
    sizes = thin.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"))
    goals = stored(targets(sizes, weights, slopes))
    n_rows = thin.count()
    bits = min(20, max(0, (max(1, n_rows) // bucket_rows).bit_length()))
    # md5 is uniform, so its first bits cut a source into even, ordered buckets
    rows = thin.withColumn("_b", F.shiftright(F.conv(F.substring("_order", 1, 5), 16, 10).cast("int"), 20 - bits))
    sums = rows.groupBy("source", "_b").agg(F.sum(F.col("size") * F.col("alike")).alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sums = sums.join(goals, sums.source.eqNullSafe(goals.source)).drop(goals.source)
    inside = Window.partitionBy("source", "_b").orderBy("_order", F.col("doc_id").asc_nulls_last(), "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.col("size") * F.col("alike")).over(inside), F.lit(0)))
    left, right = rows.alias("r"), sums.alias("s")
    rows = left.join(right, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._b") == F.col("s._b"))).select(
        "r.doc_id", "r.text_key", "r.source", "r.size", "r.alike", "s.source_size", "s.target", "s.slope", (F.col("r._start") + F.col("s._base")).alias("_start")
    )
    # each of the rows that are alike again, in two steps, so that no array is long
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / RUN))).alias("_run"))
    rows = rows.select("*", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("alike") - 1, F.col("_run") * RUN + RUN - 1))).alias("turn"))
    rows = rows.withColumn("_start", F.col("_start") + F.col("turn") * F.col("size"))
    goal = F.floor(F.col("target") + F.lit(0.5))
    part = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), goal - F.lit(k) * F.col("source_size") - F.col("_start")))
    middle = lambda k: F.col("_start") + F.lit(k) * F.col("source_size") + part(k) / F.lit(2.0)
    copies = F.array(*(F.struct(_at(middle(k), F.col("target"), F.col("slope")).alias("t"), part(k).alias("words")) for k in range(CAP)))
    rows = rows.withColumn("positions", F.filter(copies, lambda c: c["words"] > 0))
    return rows.select("doc_id", "text_key", "source", "size", "source_size", "target", F.aggregate("positions", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"), "positions", "alike", "turn")


def scheduled(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by its position in training; a document that the mix leaves out has one row, at the end,
    with no position and 0 words."""
    copies = mixed.select("*", F.explode_outer("positions").alias("_p")).drop("positions")
    copies = copies.select("*", F.col("_p.t").alias("position"), F.coalesce("_p.words", F.lit(0).cast("long")).alias("words")).drop("_p")
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("turn")]
    return stored(copies).repartitionByRange(partitions(mixed.sparkSession), *order).sortWithinPartitions(*order)


def in_order(mixed: DataFrame) -> DataFrame:
    """A row for each document, range-sorted by the position at which it is read first (first_position; last_position and n_copies
    with it), those left out at the end."""
    t = lambda c: c["t"]
    rows = mixed.withColumns({"first_position": F.array_min(F.transform("positions", t)), "last_position": F.array_max(F.transform("positions", t)), "n_copies": F.size("positions").cast("long")}).drop("positions")
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("turn")]
    # written first, as a range sort reads its rows twice
    return stored(rows).repartitionByRange(partitions(mixed.sparkSession), *order).sortWithinPartitions(*order)


def _turns(rows: DataFrame) -> DataFrame:
    """rows (row, id, key) of keys that several rows have, with turn: 0, 1, ... within their key, by a hash of all columns.  Counts of
    equal hashes are summed first and accumulated in 256 parts; rows with equal hashes are equal, and number themselves by task."""
    rows = stored(rows.select("*", F.xxhash64("row").alias("_h"), F.spark_partition_id().alias("_task")))
    each = rows.groupBy("id", "key", "_h", "_task").agg(F.count(F.lit(1)).alias("_n"))
    part = F.shiftright("_h", 56)
    parts = each.groupBy("id", "key", part.alias("_part")).agg(F.sum("_n").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_base", before(Window.partitionBy("id", "key").orderBy("_part"))).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "_part", "_base")
    each = each.withColumn("_part", part).withColumn("_start", before(Window.partitionBy("id", "key", "_part").orderBy("_h", "_task"))).drop("_n")
    each = each.join(parts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (each["_part"] == parts["_part"])).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("_h").alias("_eh"), F.col("_task").alias("_etask"), (F.col("_start") + F.col("_base")).alias("_start"))
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy("id", "key", "_h", "_task").orderBy(F.lit(0))) - 1)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("_h") == F.col("_eh")) & (F.col("_task") == F.col("_etask"))
    return rows.join(each, same).select("row", "id", "key", (F.col("_start") + F.col("_own")).alias("turn"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Whole documents as the curriculum reads them: a row for each copy, range-sorted by position.  A copy of which the
    mix takes less than half (one for each source at most) is left out, one of which it takes more stays whole."""
    copies = F.filter("positions", lambda c: c["words"] * 2 >= F.col("size"))
    plan = stored(mix(docs).select(F.col("doc_id").alias("_id"), _row_key(F.col("text_key"), F.col("source")).alias("_key"), F.col("turn").alias("_turn"), "alike", copies.alias("copies")))
    taken = F.size("copies") > 0
    # all columns of a row travel as one, so none of ours can clash with them
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), F.col("doc_id").alias("id"), _row_key(_text_key("text"), F.col("source")).alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    out = rows.join(plan.where(taken & (F.col("alike") == 1)), same).select("row", "id", "copies")
    repeated = plan.where((F.col("alike") > 1) & (F.col("_turn") == 0)).select("_id", "_key")
    if not repeated.isEmpty():
        turns = _turns(rows.join(repeated, same, "left_semi"))
        out = out.unionByName(turns.join(plan.where(taken & (F.col("alike") > 1)), same & (F.col("turn") == F.col("_turn"))).select("row", "id", "copies"))
    out = out.select("row", "id", F.explode("copies").alias("copy"))
    return out.repartitionByRange(partitions(docs.sparkSession), F.col("copy.t"), "id").sortWithinPartitions("copy.t", "id").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    return in_order(mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "n_copies", "first_position", "last_position")


SQL = r"""
WITH thin AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || md5(coalesce(text, ''))) AS o, md5(coalesce(text, '')) AS k FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM thin GROUP BY source
), ranked AS (
  SELECT *, ([5, 2, 1])[(rk - 1) % 3 + 1]::BIGINT AS weight, ([-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE])[(rk - 1) % 3 + 1] AS slope FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sizes)
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked WINDOW before AS (ORDER BY source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fixed AS (
  SELECT *, first(CASE WHEN level * weight < 2.0 * source_size THEN level END IGNORE NULLS) OVER (ORDER BY source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM levels
), goals AS (
  SELECT source, source_size, slope, CASE WHEN l IS NULL THEN 2.0::DOUBLE * source_size ELSE l * weight END::DOUBLE AS target FROM fixed
), placed AS (
  SELECT doc_id, size, g.source_size, g.target, slope, coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY o, doc_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, floor(g.target + 0.5)::BIGINT AS goal, row_number() OVER () AS r
  FROM thin t JOIN goals g ON t.source IS NOT DISTINCT FROM g.source
), parts AS (
  SELECT *, greatest(0, least(size, goal - c * source_size - s))::BIGINT AS words FROM placed, range(0, 2) t(c)
), timed AS (
  SELECT *, CASE WHEN target > 0 THEN least(1.0::DOUBLE, (s + c * source_size + words / 2.0::DOUBLE)::DOUBLE / target) ELSE 0 END AS u FROM parts
), met AS (
  SELECT *, coalesce(2.0::DOUBLE * u / (1.0::DOUBLE - slope + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * u)), 0) AS t FROM timed
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, sum(words)::BIGINT AS taken,
       count(*) FILTER (words > 0) AS n_copies, min(t) FILTER (words > 0) AS first_position, max(t) FILTER (words > 0) AS last_position FROM met GROUP BY r, doc_id
"""
