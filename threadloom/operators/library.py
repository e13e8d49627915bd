"""A library of designs: search, tags, recent entries, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wide


def search(lib: DataFrame, query: str | None = None, tags: list[str] | None = None, favorites: bool = False) -> DataFrame:
    """All tags, and the query somewhere in name, note or a tag, without regard to case; newest first."""
    if favorites:
        lib = lib.where("favorite")
    for t in tags or ():
        lib = lib.where(F.array_contains("tags", t))
    if query:
        q = query.lower()
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
        lib = lib.where(has(F.col("name")) | has(F.col("note")) | F.exists("tags", has))
    return lib.orderBy(F.desc("updated"), "id")


def pages(lib: DataFrame, size: int = 50) -> DataFrame:
    """Entries newest first, by id on ties, with their rank and page from 1: sorted by range, so that no task holds the whole order, and numbered
    by what the stretches before have."""
    order = ["_newest", "id"]
    ranked = wide.scanned(wide.dealt(lib.withColumn("_newest", -F.col("updated")), [], order), [], order, sums={"rank": F.lit(1)})
    return ranked.drop("_newest", "_part").withColumn("page", F.floor((F.col("rank") - 1) / size) + 1)


def tags(lib: DataFrame) -> DataFrame:
    return lib.select(F.explode("tags").alias("tag")).distinct()


def recent(events: DataFrame, limit: int = 12) -> DataFrame:
    """The last `limit` ids of each user, by last use: (user_id, id, place)."""
    last = events.groupBy("user_id", "id").agg(F.max("at").alias("at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("at"), "id")
    return last.withColumn("place", (F.row_number().over(w) - 1).cast("long")).where(F.col("place") < limit).select("user_id", "id", "place")


def recent_entries(recents: DataFrame, lib: DataFrame) -> DataFrame:
    """Recent ids with their entries; ids without one are left out and the order stays."""
    return recents.join(lib, "id").select("user_id", "place", "id", "name", "favorite")


def upsert(lib: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries replaced or added by id; changes come once for each id."""
    return lib.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def remove(lib: DataFrame, ids: DataFrame) -> DataFrame:
    return lib.join(ids, "id", "left_anti")


def toggle_favorite(lib: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return lib.join(hit, "id", "left").withColumn("favorite", F.col("favorite") != F.coalesce("_hit", F.lit(False))).drop("_hit")
