"""Scalar functions as Column expressions; every one of them stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def round_half_up(x) -> Column:
    """floor(x + 0.5): halves go up, for negative values too."""
    return F.floor(col(x) + F.lit(0.5))


def mm_to_units(x) -> Column:
    """Millimetres to units of 0.1 mm; the division comes first, as binary fractions decide halves."""
    return round_half_up(col(x) / F.lit(0.1))


def milli(x) -> Column:
    """Thousandths, as a whole number: what is compared instead of fractions."""
    return round_half_up(col(x) * F.lit(1000.0)).cast("long")


def distance(dx, dy) -> Column:
    dx, dy = col(dx).cast("double"), col(dy).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def squared(dx, dy) -> Column:
    dx, dy = col(dx).cast("long"), col(dy).cast("long")
    return dx * dx + dy * dy


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment."""
    px, py, ax, ay, bx, by = (col(v).cast("double") for v in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n)))
    return distance(px - (ax + t * dx), py - (ay + t * dy))


def connection(d2, first, same_object=False, mode: str = "auto", trim_above: int = 500) -> Column:
    """continuous, jump or trim, from the squared gap to the run before. The order of the tests matters."""
    same = col(same_object) if not isinstance(same_object, bool) else F.lit(same_object)
    far = {"never": F.lit("jump"), "always": F.lit("trim")}.get(mode, F.when(col(d2) < trim_above * trim_above, "jump").otherwise("trim"))
    return F.when(col(first), F.when(same, "jump").otherwise("trim")).when(col(d2) < 900, "continuous").when(same, "jump").otherwise(far)


def turn_degrees(ax, ay, bx, by) -> Column:
    """Angle between two directions, 0 where one has no length."""
    la, lb = distance(ax, ay), distance(bx, by)
    cos = (col(ax) * col(bx) + col(ay) * col(by)) / (la * lb)
    return F.when((la < 1e-9) | (lb < 1e-9), 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def stitch_angle(dx, dy) -> Column:
    """Direction of a vector in [0, 180)."""
    deg = F.degrees(F.atan2(col(dy).cast("double"), col(dx).cast("double")))
    return F.when((col(dx) == 0) & (col(dy) == 0), 0.0).otherwise(F.pmod(F.pmod(deg, F.lit(180.0)) + 180.0, F.lit(180.0)))


def noise(seed) -> Column:
    """A fixed pseudo-random fraction for a number."""
    v = F.sin(col(seed) * F.lit(127.1) + F.lit(311.7)) * F.lit(43758.5453)
    return v - F.floor(v)


def _linear(c: Column) -> Column:
    u = c.cast("double") / 255.0
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(F.lit(7.787) * t + 16.0 / 116.0)


def rgb_to_lab(r, g, b) -> Column:
    """struct l, a, b of CIE L*a*b* (D65)."""
    r, g, b = (_linear(col(c)) for c in (r, g, b))
    x = _lab_f((r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047)
    y = _lab_f(r * 0.2126 + g * 0.7152 + b * 0.0722)
    z = _lab_f((r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883)
    return F.struct((y * 116.0 - 16.0).alias("l"), ((x - y) * 500.0).alias("a"), ((y - z) * 200.0).alias("b"))


def delta_e2(p: Column, q: Column) -> Column:
    d = [p[k] - q[k] for k in ("l", "a", "b")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


# Colour names.
NAMED_COLORS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "orange": (255, 165, 0),
    "purple": (128, 0, 128), "pink": (255, 192, 203), "brown": (165, 42, 42), "gray": (128, 128, 128), "grey": (128, 128, 128), "cyan": (0, 255, 255), "magenta": (255, 0, 255),
}


def css_color(text) -> Column:
    """struct r, g, b of a CSS colour: #rgb, #rrggbb, rgb(), a name; none, transparent and empty give null, others black."""
    s = F.lower(F.trim(col(text)))
    part = lambda k, n: F.conv(F.substring(s, k, n), 16, 10).cast("int")
    rgb = lambda r, g, b: F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))
    # what stands between the brackets, commas counting as spaces
    parts = F.filter(F.split(F.translate(F.substring_index(F.substring_index(s, "(", -1), ")", 1), ",", " "), " "), lambda x: x != "")
    decimal = F.startswith(s, F.lit("rgb")) & F.endswith(s, F.lit(")")) & F.contains(s, F.lit("(")) & (F.size(parts) == 3) & F.forall(parts, lambda x: x.rlike("^[0-9]+$"))
    out = F.when(s.isNull() | s.isin("", "none", "transparent"), F.lit(None))
    out = out.when(s.rlike("^#[0-9a-f]{3}$"), rgb(*(part(k, 1) * 17 for k in (2, 3, 4)))).when(s.rlike("^#[0-9a-f]{6}$"), rgb(*(part(k, 2) for k in (2, 4, 6))))
    out = out.when(decimal, rgb(*(F.element_at(parts, k) for k in (1, 2, 3))))
    for name, (r, g, b) in NAMED_COLORS.items():
        out = out.when(s == name, rgb(F.lit(r), F.lit(g), F.lit(b)))
    return out.otherwise(rgb(F.lit(0), F.lit(0), F.lit(0)))


def luminance(r, g, b, contrast: float = 1.0, brightness: float = 0.0) -> Column:
    v = (F.lit(0.299) * col(r) + F.lit(0.587) * col(g) + F.lit(0.114) * col(b)) / 255.0
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - 0.5) * contrast + 0.5 + brightness))


def density_spacing(area, base, on: bool = True) -> Column:
    """Row spacing widened on small areas: by up to 0.4 of itself under 15000 square units; not under 100."""
    if not on:
        return col(base)
    a = col(area)
    return F.when((a < 100) | (a >= 15000), col(base).cast("double")).otherwise(col(base) * (1 + (1 - a / 15000.0) * 0.4))


# Rings are arrays of struct(x, y).


def _next(ring: Column, i: Column) -> Column:
    return F.element_at(ring, (F.pmod(i + 1, F.size(ring)) + 1).cast("int"))


def doubled_area(ring) -> Column:
    """Twice the signed area; whole for whole coordinates."""
    r = col(ring)
    cross = F.transform(r, lambda p, i: p["x"] * _next(r, i)["y"] - _next(r, i)["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)


def ring_bounds(ring) -> Column:
    r = col(ring)
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


def point_in_ring(px, py, ring) -> Column:
    """Even-odd ray cast, lower ends of edges included."""
    r, px, py = col(ring), col(px), col(py)

    def crosses(a, i):
        b = F.element_at(r, (F.pmod(i - 1 + F.size(r), F.size(r)) + 1).cast("int"))
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0)) + a["x"])

    hits = F.size(F.filter(F.transform(r, crosses), lambda v: v))
    return hits % 2 == 1


def transform_ring(ring, tx=0.0, ty=0.0, rotation: float = 0.0, scale: float = 1.0, flip_x: bool = False, flip_y: bool = False) -> Column:
    """Scale and flip, then rotate, then move."""
    c, s = F.cos(F.lit(rotation)), F.sin(F.lit(rotation))
    sx, sy = (-scale if flip_x else scale), (-scale if flip_y else scale)
    point = lambda x, y: F.struct((x * c - y * s + col(tx)).alias("x"), (x * s + y * c + col(ty)).alias("y"))
    return F.transform(col(ring), lambda p: point(p["x"] * sx, p["y"] * sy))


def chaikin(ring) -> Column:
    """One round of corner cutting on a closed path: a quarter and three quarters of each edge."""
    r = col(ring)
    on = lambda p, q, t: F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
    return F.flatten(F.transform(r, lambda p, i: F.array(on(p, _next(r, i), 0.25), on(p, _next(r, i), 0.75))))


def outer_winding(ring) -> Column:
    """Turned round if its area is negative."""
    return F.when(doubled_area(ring) < 0, F.reverse(col(ring))).otherwise(col(ring))


def split_move(x0, y0, x1, y1, longest: int = 121) -> Column:
    """Points that end moves of at most `longest` on both axes, the target last."""
    dx, dy = (col(x1) - col(x0)).cast("double"), (col(y1) - col(y0)).cast("double")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / longest)).cast("int")
    at = lambda v0, d, i: (col(v0) + F.floor(d * i / n + 0.5)).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at(x0, dx, i).alias("x"), at(y0, dy, i).alias("y")))


def label_text(text, length: int = 16) -> Column:
    """Printable ASCII, others as _, cut and padded to a length."""
    return F.rpad(F.substring(F.regexp_replace(col(text), r"[^\x20-\x7e]", "_"), 1, length), length, " ")
