"""Regions that are strokes: rails between the two tips of an outline, widths and a middle line; orders of lines that may be turned round."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import shapes as S


@dataclass(frozen=True)
class Stroke:
    """Two rails with as many points, the line between them, and the gaps."""

    left: np.ndarray
    right: np.ndarray

    @property
    def middle(self) -> np.ndarray:
        return (self.left + self.right) / 2

    @property
    def widths(self) -> np.ndarray:
        return np.abs(self.left - self.right)

    @property
    def width(self) -> float:
        """The upper median."""
        return float(np.sort(self.widths)[len(self.left) // 2])

    @property
    def length(self) -> float:
        return float(np.abs(np.diff(self.middle)).sum())


def analyze(outer: S.Ring, holes=(), samples: int | None = None) -> Stroke | None:
    """The rails of an outline without holes, between its first and last points along its long axis."""
    n = len(outer)
    if holes or n < 4:
        return None
    along = (outer - outer.mean()) * np.exp(-1j * S.axis_angle(outer))
    i, j = int(along.real.argmin()), int(along.real.argmax())
    if i == j:
        return None
    turned = np.roll(outer, -i)
    k = (j - i) % n
    count = max(16, min(256, samples or 2 * n))
    back = np.append(turned[k:], turned[0])
    return Stroke(S.resample(turned[: k + 1], count=count), S.resample(back, count=count)[::-1])


def looks_like_stroke(s: Stroke | None, widest: float = 70.0, elongation: float = 3.0) -> bool:
    return s is not None and 1e-6 <= s.width <= widest and s.length / s.width >= elongation


def centerline(outer: S.Ring, holes=(), spacing: float = 5.0) -> np.ndarray:
    """The middles of slices across the long axis, of the widest part where there are several."""
    from . import fills as G

    angle = S.axis_angle(outer) + np.pi / 2
    scan, _ = G.rows(outer, holes, spacing, angle)
    widest = [(y, max(segs, key=lambda s: s[1] - s[0])) for y, segs in scan if segs]
    return S.rounded(np.array([complex((s[0] + s[1]) / 2, y) for y, s in widest]) * np.exp(1j * angle))


def line_underlay(middle: np.ndarray, width: float, kinds) -> list[np.ndarray]:
    """Below a satin line, along its middle: once, as a narrow zigzag, or there and back."""
    from . import fills as G

    made = {"center": lambda: G.running(middle), "zigzag": lambda: G.satin_line(middle, width * 0.6, 15.0), "edge": lambda: G.running(middle, passes=2)}
    return [r for k in kinds if k in made for r in made[k]()]


def line_order(paths: list[np.ndarray], start: complex | None = None) -> list[tuple[int, bool]]:
    """(number, turned round) of each line of two points or more, the one with the nearest end next; of equally near ones the first, and
    its head before its tail."""
    left = np.array([k for k, p in enumerate(paths) if len(p) > 1], int)
    ends = np.array([(paths[k][0], paths[k][-1]) for k in left]).reshape(-1, 2)
    out, here = [], start
    while len(left):
        k, tail = divmod(int(np.abs(ends - here).argmin()) if here is not None else 0, 2)
        out.append((int(left[k]), bool(tail)))
        here = complex(ends[k, 1 - tail])
        left, ends = np.delete(left, k), np.delete(ends, k, 0)
    return out


def zigzag_line(path: np.ndarray, width: float, spacing: float | None = None) -> list[np.ndarray]:
    from . import fills as G

    return G.satin_line(path, width, G.SATIN_SPACING if spacing is None else spacing)


#: Strokes up to this width are sewn along their middle.
THIN = 16.0


def stroke_stitch(outer: S.Ring, holes=(), spacing: float | None = None) -> list[np.ndarray]:
    """A region that looks like a stroke: along its middle where it is thin, else a column between its rails; nothing else is sewn."""
    from . import fills as G

    s = analyze(outer, holes)
    if not looks_like_stroke(s):
        return []
    if s.width <= THIN:
        return G.running(s.middle)
    gap = G.SATIN_SPACING if spacing is None else spacing
    n = max(2, int(s.length / gap + 0.5) + 1)
    rails = [S.resample(r, count=n) for r in (s.left, s.right)]
    return [G.zigzag(*rails)]


def as_stroke(points, color) -> dict:
    """Hand-set stitches (millimetres) as a thin running stroke: without locks, simplified, closed where they end as they began."""
    z = S.ring(points)
    a, b = 0, len(z) - 1
    for way in (1, -1):
        for _ in range(3):
            i = a if way == 1 else b
            if b - a < 3 or abs(z[i] - z[i + 2 * way]) >= 0.15 or abs(z[i] - z[i + way]) > 1.2:
                break
            a, b = (a + 2, b) if way == 1 else (a, b - 2)
    z = S.simplify(z[a : b + 1], 0.05)
    closed = len(z) > 3 and abs(z[0] - z[-1]) < 0.3
    z = z[:-1] if closed else z
    return {"kind": "stroke", "points": [[float(p.real), float(p.imag)] for p in z], "closed": bool(closed), "width": 0.5, "style": "running", "color": list(color)}
