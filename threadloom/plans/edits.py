"""Drawings and baked stitches: what a user makes by hand, as regions that digitising takes as they are."""

from __future__ import annotations

import numpy as np

from threadloom.kernels import fills as G
from threadloom.kernels import shapes as S


def pen_finished(points, fill: bool, color: tuple = (0, 0, 0)) -> dict | None:
    """A region from drawn points: an area of three points or more, or a line of two or more, which is sewn as it was drawn; else none."""
    z = S.ring(points)
    if len(z) < (3 if fill else 2):
        return None
    if fill:
        return {"outer": S.wound(z, True), "holes": [], "color": color}
    return {"outer": z, "holes": [], "color": color, "baked": G.running(z)}


def bake(blocks: list[dict], object_id: int) -> list[np.ndarray]:
    """The runs of an object of a plan, to be kept as they are."""
    return [r["stitches"] for b in blocks for r in b["runs"] if r["object_id"] == object_id and len(r["stitches"])]


def edited(baked: list[np.ndarray], run: int, at: int, to: complex | None = None, insert: bool = False) -> list[np.ndarray]:
    """Baked runs with one stitch moved to a place, one put in after it, or, without a place, one taken out while two are left."""
    if not 0 <= run < len(baked) or not 0 <= at < len(baked[run]):
        return baked
    z = baked[run]
    if to is None:
        new = np.delete(z, at) if len(z) > 2 else z
    else:
        p = S.rounded(np.array([to], complex))
        new = np.concatenate([z[: at + 1], p, z[at + 1 :]]) if insert else np.concatenate([z[:at], p, z[at + 1 :]])
    return [*baked[:run], new, *baked[run + 1 :]]
