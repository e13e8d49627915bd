"""Edits of paths and plans as expressions over arrays of points, and as joins with tables of overrides. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X


def insert_node(path, at: int, point: Column) -> Column:
    p = X.col(path)
    return F.concat(F.slice(p, 1, at), F.array(point), F.slice(p, at + 1, F.greatest(F.size(p) - at, F.lit(0))))


def delete_node(path, at: int, least: int = 2) -> Column:
    """Unless that leaves fewer than `least`."""
    p = X.col(path)
    return F.when(F.size(p) > least, F.filter(p, lambda v, i: i != at)).otherwise(p)


def move_node(path, at: int, dx: float, dy: float) -> Column:
    return F.transform(X.col(path), lambda v, i: F.when(i == at, F.struct((v["x"] + dx).alias("x"), (v["y"] + dy).alias("y"))).otherwise(F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"))))


def soft_move(path, at: int, dx: float, dy: float, radius: float) -> Column:
    """Neighbours follow by (1 - (d / radius)^2)^2 of the way, d being their distance."""
    p = X.col(path)
    anchor = F.element_at(p, at + 1)

    def moved(v):
        d2 = (v["x"] - anchor["x"]) * (v["x"] - anchor["x"]) + (v["y"] - anchor["y"]) * (v["y"] - anchor["y"])
        part = F.greatest(F.lit(0.0), F.lit(1.0) - d2 / (radius * radius))
        return F.struct((v["x"] + part * part * dx).alias("x"), (v["y"] + part * part * dy).alias("y"))

    return F.transform(p, moved)


def split_path(path, at: int) -> Column:
    """Two paths that share a node."""
    p = X.col(path)
    return F.array(F.slice(p, 1, at + 1), F.slice(p, at + 1, F.size(p) - at))


def join_paths(first, second) -> Column:
    """One path, a shared end once."""
    a, b = X.col(first), X.col(second)
    return F.when(F.element_at(a, -1) == b[0], F.concat(a, F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))))).otherwise(F.concat(a, b))


def subdivided(path) -> Column:
    """A node more in the middle of every edge."""
    p = X.col(path)
    middle = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.array(a, F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))))
    return F.concat(F.flatten(middle), F.slice(p, F.size(p), 1))


def spaced_nodes(path, gap: float) -> Column:
    """Without nodes nearer than `gap` to the last one kept: a fold, since what is kept decides what comes next."""
    p = X.col(path)
    empty = F.slice(p, 1, 0)
    last = lambda kept: F.element_at(kept, -1)
    far = lambda kept, v: (v["x"] - last(kept)["x"]) * (v["x"] - last(kept)["x"]) + (v["y"] - last(kept)["y"]) * (v["y"] - last(kept)["y"]) >= gap * gap
    return F.aggregate(p, empty, lambda kept, v: F.when(F.size(kept) == 0, F.array(v)).when(far(kept, v), F.concat(kept, F.array(v))).otherwise(kept))


def baked(generated: DataFrame, overrides: DataFrame) -> DataFrame:
    """Stitches of objects, those in `overrides` (design_id, object_id and the same columns) instead of the generated ones."""
    keys = ["design_id", "object_id"]
    return generated.join(overrides.select(*keys).distinct(), keys, "left_anti").unionByName(overrides)


def restyled(regions: DataFrame, changes: DataFrame) -> DataFrame:
    """Regions with fill types, colours and angles replaced where `changes` (design_id, region_idx, and nulls for what stays) has some."""
    keys = ["design_id", "region_idx"]
    c = changes.select(*keys, *(F.col(k).alias(f"_{k}") for k in changes.columns if k not in keys))
    fields = [k for k in changes.columns if k not in keys]
    return regions.join(c, keys, "left").withColumns({k: F.coalesce(f"_{k}", k) for k in fields}).drop(*(f"_{k}" for k in fields))


def reconciled(regions: DataFrame, known: DataFrame) -> DataFrame:
    """Object ids for new regions: those of known objects (design_id, key, object_id) with the same content, and numbers after the
    largest for the others. Regions have a content key."""
    from pyspark.sql import Window

    top = known.groupBy("design_id").agg(F.max("object_id").alias("_top"))
    j = regions.join(known, ["design_id", "key"], "left").join(top, "design_id", "left")
    new = F.row_number().over(Window.partitionBy("design_id", F.col("object_id").isNull()).orderBy("region_idx"))
    return j.withColumn("object_id", F.coalesce("object_id", F.coalesce("_top", F.lit(-1)) + new)).drop("_top")
