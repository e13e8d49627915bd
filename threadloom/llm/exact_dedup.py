"""Exact deduplication by two-pass Bloom filtering, native DataFrame operations only.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one space; null counts as empty.

Pass 1 throws every row's digest at two bit arrays and keeps the bits that were hit at least twice, as bitmaps of PAGE bits.  Cells, not
bitmaps, meet in the shuffle, summed within a task first: a task's own bitmap would be nearly empty and as long as the whole array.
Pass 2 reads the rows again and probes both arrays, which are broadcast: a row of which either bit was hit once is unique for certain and
passes straight through.  Of the rest, rows of groups that hold over 1/HEAVY of all rows (fewer than HEAVY groups) meet their group by a
broadcast, and the others are the only rows that shuffle.

An array has BITS_PER_ROW bits for each row, and ARRAY_BITS at most, which bounds the broadcast at ARRAY_BITS / 4 bytes for both.  There is
no other way beyond: a fuller filter lets more unique rows through to the shuffle, where they turn out to be alone.

Cases: rows with null or empty text form one group; texts of any length are digested whole; a null doc_id sorts after all others, so it
stays only if the group has no other id; repeated rows count in group_size, and of rows that share the smallest doc_id (ties) exactly one
is kept; an empty table gives an empty result; extra columns pass through untouched.  A column that bears the name of one of the four
added ones (ADDED) is replaced by it; `drop_copies` adds none and keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forget, free_name, one_spaced, stored

#: Bits of an array for each row, and of an array at all.
BITS_PER_ROW = 8
ARRAY_BITS = 1 << 30
#: Bits of a bitmap of Spark's bitmap functions.
PAGE = 32768
#: A group with over 1/HEAVY of all rows is joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1000

ADDED = ("text_sha256", "keep_id", "group_size", "kept")


def digest(text: str = "text") -> Column:
    return F.sha2(F.encode(one_spaced(f"`{text}`"), "UTF-8"), 256)


def _cell(of: Column, array: int, bits: int) -> Column:
    """Where a digest falls in an array: 15 hex digits of it for each."""
    return F.pmod(F.conv(F.substring(of, 1 + 16 * array, 15), 16, 10).cast("long"), F.lit(bits))


def repeated_bits(digests: DataFrame, name: str, bits: int) -> DataFrame:
    """(array, page, bitmap): bits that at least two rows have hit."""
    of = F.col(name)
    both = digests.select(F.explode(F.array(*(F.struct(F.lit(a).alias("array"), _cell(of, a, bits).alias("cell")) for a in (0, 1)))).alias("x"))
    twice = both.groupBy("x.array", "x.cell").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return twice.groupBy("array", F.bitmap_bucket_number("cell").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))


def _probe(df: DataFrame, name: str, filters: DataFrame, bits: int, flag: str) -> DataFrame:
    """The rows and `flag`: whether both of their bits were hit twice."""
    hits, names = [], [F.col(f"`{c}`") for c in df.columns]
    for array in (0, 1):
        page, bitmap = free_name(df, f"page{array}"), free_name(df, f"bitmap{array}")
        cell = _cell(F.col(f"`{name}`"), array, bits)
        side = filters.where(F.col("array") == array).select(F.col("page").alias(page), F.col("bitmap").alias(bitmap))
        df = df.withColumn(page, F.bitmap_bucket_number(cell)).join(F.broadcast(side), page, "left")
        at = F.bitmap_bit_position(cell)
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hits.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return df.select(*names, (hits[0] & hits[1]).alias(flag))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digests: str | None = None, added: tuple[str, ...] = ADDED) -> DataFrame:
    """The rows with text_sha256, keep_id, group_size, kept, under the names in `added`.  digests: a column that has the digest
    already; else it is made from the text."""
    col = lambda n: F.col(f"`{n}`")
    sha, keep, size, kept = added
    docs = docs.drop(*(c for c in added if c != digests))
    names = [c for c in docs.columns if c != sha]
    hashed = docs.withColumn(sha, digest(text) if digests is None else col(digests))
    thin = hashed.select(col(sha).alias("sha"), col(doc_id).alias("id"))
    thin = stored(thin) if digests is None else thin
    n_rows = thin.count()
    bits = min(ARRAY_BITS, 1 << max(15, (BITS_PER_ROW * max(1, n_rows) - 1).bit_length()))
    filters = stored(repeated_bits(thin, "sha", bits))

    by_id = _probe(thin, "sha", filters, bits, "maybe").where("maybe").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = by_id.groupBy("sha").agg(F.min("id").alias("keep"), F.sum("n").alias("size"), F.coalesce(F.min_by("n", "id"), F.sum("n")).alias("ties"))
    groups = stored(groups.where("size > 1"))
    if digests is None:
        forget(thin)

    over = max(1, n_rows // HEAVY)
    maybe, ties, found = (free_name(hashed, x) for x in ("maybe", "ties", "found"))
    joined = lambda side: side.select(F.col("sha").alias(sha), F.col("keep").alias(f"{found}_id"), F.col("size").alias(f"{found}_size"), F.col("ties").alias(ties))
    rows = _probe(hashed, sha, filters, bits, maybe).join(F.broadcast(joined(groups.where(F.col("size") > over))), sha, "left")
    there = col(ties).isNotNull()
    straight = rows.where(~col(maybe) | there)
    light = rows.where(col(maybe) & ~there).drop(f"{found}_id", f"{found}_size", ties).join(joined(groups.where(F.col("size") <= over)), sha, "left")
    every = straight.unionByName(light)
    # rows without a group are alone in theirs
    out = [*(col(c) for c in names), col(sha)]
    stays = F.when(there, col(doc_id).eqNullSafe(col(f"{found}_id"))).otherwise(F.lit(True))
    every = every.select(*out, F.when(there, col(f"{found}_id")).otherwise(col(doc_id)).alias(keep), F.coalesce(col(f"{found}_size"), F.lit(1)).cast("long").alias(size), stays.alias(kept), col(ties))
    out = [*(col(c) for c in names), *(col(c) for c in added)]
    if groups.where("ties > 1").isEmpty():
        return every.select(*out)
    # rows that share the smallest id of their group: one of them, picked by a number that is written down first
    shared, number = col(kept) & (F.coalesce(col(ties), F.lit(1)) > 1), free_name(every, "number")
    tied = stored(every.where(shared).select(*out).withColumn(number, F.monotonically_increasing_id()))
    best = tied.groupBy(sha).agg(F.min(number).alias(f"{number}_least"))
    tied = tied.join(best, sha).withColumn(kept, col(number) == col(f"{number}_least"))
    return every.where(~shared).select(*out).unionByName(tied.select(*out))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, as they are."""
    added = tuple(free_name(docs, c) for c in ADDED)
    return exact_dedup(docs, text, doc_id, added=added).where(F.col(added[3])).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", digest().alias("text_sha256"))
    return exact_dedup(stored(docs), digests="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
