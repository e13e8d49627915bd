"""Appliqué: a placement line where the fabric goes, a tackdown inside it, and a satin edge over both, each a block of its own, so that
the machine stops in between."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.kernels import fills as G
from threadloom.kernels import shapes as S

from . import digitize as D

GUIDE = (120, 120, 120)
STEPS = ("placement", "tackdown", "satin")
SATIN_MM, INSET_MM, WIDEST_MM = 2.5, 1.5, 6.0


def blocks(region: dict, satin_mm: float = SATIN_MM, inset_mm: float = INSET_MM, guide: tuple = GUIDE) -> list[dict]:
    """The three blocks of one region, with the step of each."""
    outer = region["outer"]
    made = (
        ("placement", guide, "running", G.running(outer, closed=True)),
        ("tackdown", guide, "running", G.running(S.inset(outer, D.units(inset_mm)), closed=True)),
        ("satin", region["color"], "satin", G.satin_line(np.append(outer, outer[0]), D.units(satin_mm)) if len(outer) > 1 else []),
    )
    out = []
    for step, thread, kind, runs in made:
        full = [z for z in (G.finish(r) for r in runs) if len(z) >= 2]
        if full:
            out.append({"step": step, "thread": thread, "runs": [{"stitches": z, "connection": "trim", "object_id": region.get("object_id", 0), "stitch_type": kind} for z in full]})
    return out


STEP_ROWS = f"{D.STITCH_ROWS}, step string"


def applique_designs(regions: DataFrame, satin_mm: float = SATIN_MM, inset_mm: float = INSET_MM) -> DataFrame:
    """Stitches of each design as appliqué, with their step: rows as digitize_designs takes them, a region after the other."""

    def made(key, rows):
        plan = [b for r in rows for b in blocks(D.region_of(r), satin_mm, inset_mm)]
        yield from D.stitch_frames(key, plan, step=[b["step"] for b in plan])

    return D.each_design(regions, made, STEP_ROWS)


def width_warning(satin_mm) -> Column:
    """A notice where the edge is too wide to hold, else null."""
    return F.when(X.col(satin_mm) > WIDEST_MM, F.concat(F.lit("satin edge of "), X.col(satin_mm).cast("string"), F.lit(" mm is over 6 mm")))
