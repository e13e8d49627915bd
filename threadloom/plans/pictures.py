"""Picture files to regions, and on to plans: what a user does with a picture, for a table of them."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.kernels import images as I
from threadloom.kernels import pictures as P

from . import digitize as D

REGION_ROWS = "design_id bigint, region_idx int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, r int, g int, b int, area double, kept boolean, error string"
LABEL_ROWS = "design_id bigint, place int, r int, g int, b int, pixels bigint, error string"


def white_corners(rgba: np.ndarray, white: int = 240) -> bool:
    """Whether three corners are near white and none is transparent."""
    c = rgba[[0, 0, -1, -1], [0, -1, 0, -1]]
    return bool((c[:, 3] >= 128).all() and (c[:, :3] >= white).all(1).sum() >= 3)


def read(content: bytes, colors: int):
    """(labels, palette) of a picture file, at most MOST pixels a side."""
    rgba = P.shrunk(P.decode(bytes(content)))
    return I.quantized(rgba, colors, white_corners(rgba))


def _points(z: np.ndarray) -> list[dict]:
    return [{"x": float(p.real), "y": float(p.imag)} for p in z]


def _each(files: DataFrame, rows, schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.replace("array<struct<x:double,y:double>>", "points").split(", ")]

    def run(batches):
        for pdf in batches:
            for key, content in zip(pdf["design_id"], pdf["content"], strict=True):
                try:
                    out = [(key, *r, None) for r in rows(content)]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a picture is said in its row
                    out = [(key, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                if out:
                    yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("design_id", "content").mapInPandas(run, schema)


def picture_labels(files: DataFrame, colors: int = 6) -> DataFrame:
    """The palette of each picture (design_id, content) in the order of first pixels, with how many pixels have each colour."""

    def rows(content):
        labels, palette = read(content, colors)
        n = np.bincount(labels[labels >= 0], minlength=len(palette))
        return [(k, *c, int(n[k])) for k, c in enumerate(palette)]

    return _each(files, rows, LABEL_ROWS)


def picture_regions(files: DataFrame, colors: int = 6, size_mm: float = 80.0) -> DataFrame:
    """Regions of each picture (design_id, content), its longer side `size_mm`; those that are too small aren't kept."""

    def rows(content):
        labels, palette = read(content, colors)
        if not palette:
            return []
        kept, left = I.regions(labels, palette, size_mm * 10 / max(labels.shape))
        every = [(r, True) for r in kept] + [(r, False) for r in left]
        return [(k, _points(r["outer"]), [_points(h) for h in r["holes"]], *(int(v) for v in r["color"]), float(r["area"]), ok) for k, (r, ok) in enumerate(every)]

    return _each(files, rows, REGION_ROWS)


def pictures_to_plans(files: DataFrame, colors: int = 6, size_mm: float = 80.0, options: D.Options = D.Options()) -> DataFrame:
    """Stitches of each picture's plan.  Pictures are read where they lie, then regions meet by design; a broken picture has no plan.
    Colours go by the area of their pixels, which smoothing an outline doesn't change; of equal ones the brighter red, green, blue is first."""
    regions = picture_regions(files, colors, size_mm).where("error is null and kept").drop("kept", "error")
    color = F.col("r").cast("long") * 65536 + F.col("g") * 256 + F.col("b")
    ordered = (F.lit(0xFFFFFF) - color) * F.lit(1 << 32) + F.col("region_idx")
    return D.digitize_designs(regions.withColumns({"object_id": F.col("region_idx").cast("long"), "region_idx": ordered}), options)


REDUCED_ROWS = f"{D.RUN_ROWS}, steps string"


def reduced_runs(regions: DataFrame, options: D.Options = D.Options(), limit: int = D.MAX_STITCHES, shrink: bool = False) -> DataFrame:
    """Runs of the first plan of each design that is within the limit, and the steps taken for it."""

    def made(key, own):
        runs, steps = D.reduced_runs(own, options, limit, shrink)
        yield from D.run_frames(key, runs, steps=",".join(steps))

    return D.each_plan(regions, made, REDUCED_ROWS)


def reduced_designs(regions: DataFrame, options: D.Options = D.Options(), limit: int = D.MAX_STITCHES, shrink: bool = False) -> DataFrame:
    """Their stitches."""
    return D.in_stitches(reduced_runs(regions, options, limit, shrink))


TARGET_ROWS = f"{D.STITCH_ROWS}, factor double"


def designs_for_target(regions: DataFrame, target: int, options: D.Options = D.Options()) -> DataFrame:
    """Stitches of the densest plan of each design at or under a number of stitches, and by how much its rows are spread."""

    def made(key, rows):
        plan, factor = D.for_target([D.region_of(r) for r in rows], replace(options), target)
        yield from D.stitch_frames(key, plan, factor=factor)

    return D.each_design(regions, made, TARGET_ROWS)
