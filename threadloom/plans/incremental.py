"""Regeneration of designs that have changed: a content hash of all that a plan depends on decides what is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .digitize import OPTIONAL, Options, digitize_designs


def with_hash(regions: DataFrame, options: Options) -> DataFrame:
    """(design_id, hash): of all regions of a design, in order, and the options; a plan depends on the order of its objects, so a design
    is what is kept or made anew."""
    fields = [c for c in ("region_idx", "outer", "holes", "r", "g", "b", *OPTIONAL) if c in regions.columns]
    one = regions.select("design_id", "region_idx", F.xxhash64(F.to_json(F.struct(*fields))).alias("h"))
    return one.groupBy("design_id").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("region_idx", "h"))), F.lit(repr(options))).alias("hash"))


def regenerate(regions: DataFrame, kept: DataFrame, options: Options = Options(), plans: Callable[[DataFrame, Options], DataFrame] = digitize_designs) -> DataFrame:
    """Stitches with a hash column: those in `kept` (from an earlier call) where nothing has changed, new ones elsewhere.  plans: what makes them,
    digitize_runs for a run a row."""
    hashes = with_hash(regions, options)
    same = hashes.join(kept.select("design_id", "hash").distinct(), ["design_id", "hash"])
    fresh = regions.join(same.select("design_id"), "design_id", "left_anti")
    made = plans(fresh, options).join(hashes, "design_id")
    return kept.join(same, ["design_id", "hash"], "left_semi").select(*made.columns).unionByName(made)
