"""Regions to stitch plans: one design at a time is sequential, since each object starts where the last one ended; designs run in
parallel, as groups of a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.dims import FABRICS
from threadloom.kernels import fills as G
from threadloom.kernels import images as I
from threadloom.kernels import order as O
from threadloom.kernels import shapes as S
from threadloom.model import CONTRAST, MAX_STITCHES, NEVER_TRIM_BELOW, ROW_SPACING, SATIN_MAX_WIDTH, SATIN_SPACING, STITCH_LENGTH, TRIM_ABOVE


@dataclass(frozen=True)
class Options:
    """Lengths in units of 0.1 mm."""

    angle_deg: float = 45.0
    row_spacing: float = ROW_SPACING
    satin_spacing: float = SATIN_SPACING
    stitch_length: float = STITCH_LENGTH
    fill_type: str = "tatami"
    underlay: tuple = ()
    satin_underlay: str = "auto"
    underlay_min_extent: float = 25.0
    trim_mode: str = "auto"
    trim_distance: float = TRIM_ABOVE
    optimize: bool = True
    min_extent: float = 0.0
    pull: float = 0.0
    push: float = 0.0
    auto_density: bool = False
    color_order: tuple = field(default_factory=tuple)
    object_order: tuple = field(default_factory=tuple)


def units(mm: float) -> int:
    return int(np.floor(mm / 0.1 + 0.5))


def of_fabric(name: str) -> Options:
    f = next((f for f in FABRICS if f[0] == name), FABRICS[0])
    return Options(row_spacing=units(f[1]), satin_spacing=units(f[2]), stitch_length=units(f[3]), underlay=f[4], pull=units(f[5]), push=units(f[6]), min_extent=units(f[7]), trim_distance=units(f[8]), auto_density=f[10])


def connection(last: complex | None, to: complex, same: bool, mode: str = "auto", trim: float = TRIM_ABOVE) -> str:
    if last is None:
        return "jump" if same else "trim"
    gap = abs(to - last)
    if gap < NEVER_TRIM_BELOW:
        return "continuous"
    if same or mode == "never":
        return "jump"
    return "trim" if mode == "always" or gap >= trim else "jump"


def _area(region: dict) -> float:
    return abs(S.area(region["outer"])) - sum(abs(S.area(h)) for h in region["holes"])


def _prepared(region: dict, o: Options):
    """What a region's runs are wherever the needle comes from: (runs, begin, fill). fill(start, leave) gives the rest, None if there is none,
    and begins where the underlays end, if there are any (begin)."""
    outer, holes = region["outer"], region["holes"]
    kind, angle = region.get("fill_type") or o.fill_type, region.get("angle_deg")
    angle = o.angle_deg if angle is None else angle
    narrow = S.min_extent(outer) <= SATIN_MAX_WIDTH and not holes
    if kind == "outline":
        bright = min(region["color"]) > 235
        return _finished([] if bright else [("running", r) for r in G.outline(outer, holes, o.stitch_length)]), None, None
    if kind == "satin" or (kind == "auto" and narrow):
        wide, inner = G.compensated_column(outer, holes, o.pull)
        made, branched, _ = G.satin(wide, inner, o.satin_spacing)
        if made and not branched:
            return _finished([("underlay", r) for r in G.satin_underlay(made[0], o.underlay, o.satin_underlay)] + [("satin", r) for r in made]), None, None
    outer, holes = G.compensated(outer, holes, o.pull, o.push, np.radians(angle))
    runs = []
    if o.underlay and S.min_extent(outer) >= o.underlay_min_extent:
        runs = [("underlay", r) for r in G.fill_underlay(outer, holes, o.underlay, angle)]
    spacing = G.spaced(_area({"outer": outer, "holes": holes}), o.row_spacing, o.auto_density)
    lines = region.get("angle_lines") or ()
    rows = G.Rows(outer, holes, angle, spacing, o.stitch_length) if len(lines) < 2 else None

    def fill(start, leave):
        made = G.turning(outer, holes, lines, spacing, o.stitch_length, start) if rows is None else []
        made = made or (rows or G.Rows(outer, holes, angle, spacing, o.stitch_length)).sewn(start, leave) or G.micro(outer, o.stitch_length)
        return _finished([("tatami", r) for r in made])

    return _finished(runs), complex(runs[-1][1][-1]) if runs else None, fill


def _finished(runs: list[tuple[str, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
    return [(t, f) for t, f in ((t, G.finish(r)) for t, r in runs) if len(f) >= 2]


def object_runs(region: dict, o: Options, start: complex | None = None, leave: complex | None = None) -> list[tuple[str, np.ndarray]]:
    """(stitch type, run) of one region: underlays first. auto takes satin for narrow regions without holes."""
    runs, begin, fill = _prepared(region, o)
    return runs + (fill(start if begin is None else begin, leave) if fill else [])


#: Stitches that are kept to be taken again for an object of the same shape, and of the same shape between the same places; rows count fivefold.
KEPT_STITCHES = 2_000_000


class _Shapes:
    """Regions by outline and holes, so that what hangs on these alone is worked out once for each shape, and an object's runs once for each
    shape and the places that it is sewn between."""

    def __init__(self, regions: list[dict], o: Options):
        self.regions, self.o = regions, o
        number: dict[tuple, int] = {}
        self.of = [number.setdefault((r["outer"].tobytes(), *(h.tobytes() for h in r["holes"])), len(number)) for r in regions]
        self.first: dict[int, dict] = {}
        for n, r in zip(self.of, regions, strict=True):
            self.first.setdefault(n, r)
        self.known: dict[str, dict[int, float | complex]] = {}
        self.rows, self.runs, self.held = {}, {}, [0, 0]

    def value(self, name: str, f, k: int):
        known = self.known.setdefault(name, {})
        n = self.of[k]
        if n not in known:
            known[n] = f(self.first[n])
        return known[n]

    def _kept(self, which: int, key: tuple, make, weight):
        table = (self.rows, self.runs)[which]
        if key not in table:
            if self.held[which] > KEPT_STITCHES:
                table.clear()
                self.held[which] = 0
            table[key] = make()
            self.held[which] += weight(table[key])
        return table[key]

    def object_runs(self, k: int, start: complex | None, leave: complex | None) -> list[tuple[str, np.ndarray]]:
        r = self.regions[k]
        lines = r.get("angle_lines")
        key = (self.of[k], r.get("fill_type"), r.get("angle_deg"), min(r["color"]) > 235, None if lines is None else tuple(x.tobytes() for x in lines))
        size = lambda runs: sum(len(z) for _, z in runs)
        runs, begin, fill = self._kept(0, key, lambda: _prepared(r, self.o), lambda p: 1000 + 5 * size(p[0]) if p[2] is None else 1000)
        if fill is None:
            return runs
        start = start if begin is None else begin
        return runs + self._kept(1, (*key, start, leave), lambda: fill(start, leave), size)


def sewn(regions: list[dict], o: Options = Options()) -> Iterator[tuple[tuple, dict]]:
    """(colour, run) of a plan, one after the other: a run is {"stitches", "connection", "object_id", "stitch_type"}.  Colours by area, larger
    first, objects by the shortest tour from where the needle is, unless orders are given. A region with "baked" runs keeps them."""
    ids = [r.get("object_id", k) for k, r in enumerate(regions)]
    shapes = _Shapes(regions, o)
    # how far the farthest colour is, of each colour once
    every = list(dict.fromkeys(tuple(r["color"]) for r in regions))
    lab = I.lab(np.array(every).reshape(-1, 3))
    stands_out = {c: ((lab - v) ** 2).sum(1).max(initial=0) > CONTRAST**2 for c, v in zip(every, lab, strict=True)}
    keep = [k for k, r in enumerate(regions) if shapes.value("extent", lambda r: S.min_extent(r["outer"]), k) >= o.min_extent or r.get("baked") or stands_out[tuple(r["color"])]]
    groups: dict[tuple, list[int]] = {}
    for k in keep:
        groups.setdefault(tuple(regions[k]["color"]), []).append(k)
    colors = list(groups)
    size = {c: sum(regions[k]["area"] if regions[k].get("area") is not None else shapes.value("area", _area, k) for k in ks) for c, ks in groups.items()}
    if o.color_order:
        rank = {c: k for k, c in enumerate(o.color_order)}
        colors.sort(key=lambda c: (rank.get(c, len(rank)), -size[c]))
    elif o.optimize:
        colors.sort(key=lambda c: -size[c])
    here = None
    for c in colors:
        ks = groups[c]
        centers = {k: shapes.value("center", lambda r: S.centroid(r["outer"]), k) for k in ks}
        if o.object_order:
            rank = {v: k for k, v in enumerate(o.object_order)}
            ks = sorted(ks, key=lambda k: rank.get(ids[k], len(rank)))
        elif o.optimize:
            ks = [ks[k] for k in O.tour(np.array([centers[k] for k in ks]), here)]
        for n, k in enumerate(ks):
            leave = centers[ks[n + 1]] if o.optimize and n + 1 < len(ks) else None
            baked = [("manual", S.ring(b)) for b in regions[k].get("baked") or () if len(b)]
            trim = max(o.trim_distance, 800) if (regions[k].get("fill_type") or o.fill_type) == "outline" else o.trim_distance
            for j, (kind, z) in enumerate(baked or shapes.object_runs(k, here, leave)):
                yield c, {"stitches": z, "connection": connection(here, complex(z[0]), j > 0, o.trim_mode, trim), "object_id": ids[k], "stitch_type": kind}
                here = complex(z[-1])


def in_blocks(runs: Iterable[tuple[tuple, dict]]) -> list[dict]:
    blocks: list[dict] = []
    for c, run in runs:
        if not blocks or blocks[-1]["thread"] != c:
            blocks.append({"thread": c, "runs": []})
        blocks[-1]["runs"].append(run)
    return blocks


def digitize(regions: list[dict], o: Options = Options()) -> list[dict]:
    """Blocks of a plan: {"thread": (r, g, b), "runs": [...]}, as `sewn` gives them."""
    return in_blocks(sewn(regions, o))


def count(blocks: list[dict]) -> int:
    return sum(len(r["stitches"]) for b in blocks for r in b["runs"])


def within(regions: list[dict], o: Options, limit: int) -> list[tuple[tuple, dict]] | None:
    """A plan's runs if it is within the limit.  One that is over it is left where it gets there."""
    runs, n = [], 0
    for c, run in sewn(regions, o):
        n += len(run["stitches"])
        if n > limit:
            return None
        runs.append((c, run))
    return runs


def reduced_runs(regions: list[dict], o: Options = Options(), limit: int = MAX_STITCHES, shrink: bool = False) -> tuple[Iterable[tuple[tuple, dict]], list[str]]:
    """The runs of the first plan within the limit, else of the last one, and the steps taken: wider rows, small regions dropped, longer
    stitches, and a smaller design if that is allowed."""
    left = ["spacing", "spacing", "drop5", "drop10", "length", *(("shrink9", "shrink8") if shrink else ())]
    steps: list[str] = []
    while left:
        runs = within(regions, o, limit)
        if runs is not None:
            return runs, steps
        step = left.pop(0)
        if step == "spacing":
            o = replace(o, row_spacing=o.row_spacing * 1.2)
        elif step.startswith("drop"):
            regions = [r for r in regions if _area(r) >= int(step[4:]) * 100]
        elif step == "length":
            o = replace(o, stitch_length=o.stitch_length * 1.3)
        else:
            f = int(step[6:]) / 10
            regions = [r | {"outer": r["outer"] * f, "holes": [h * f for h in r["holes"]]} for r in regions]
        steps.append(step)
    return sewn(regions, o), steps


def reduced(regions: list[dict], o: Options = Options(), limit: int = MAX_STITCHES, shrink: bool = False) -> tuple[list[dict], list[str]]:
    """Blocks of the plan that `reduced_runs` ends with, and the steps taken."""
    runs, steps = reduced_runs(regions, o, limit, shrink)
    return in_blocks(runs), steps


def for_target(regions: list[dict], o: Options, target: int) -> tuple[list[dict], float]:
    """The densest plan at or under a number of stitches: rows spread from 1.05 to 2.0 times."""
    plan, factor = digitize(regions, o), 1.0
    while count(plan) > target and factor < 2.0:
        factor = round(factor + 0.05, 2)
        plan = digitize(regions, replace(o, row_spacing=o.row_spacing * factor))
    return plan, factor


STITCH_ROWS = "design_id bigint, block_idx bigint, run_idx bigint, seq bigint, x int, y int, r int, g int, b int, connection string, object_id bigint, stitch_type string"


#: Rows of a frame that goes to Spark at once: a plan is some bytes a stitch, its rows as a frame are hundreds.
FRAME_ROWS = 100_000


def stitch_frames(design_id: int, blocks: list[dict], **more) -> Iterator[pd.DataFrame]:
    """A plan's rows, frame by frame.  more: further columns, of one value, or of one for each block."""
    names = [c.split()[0] for c in STITCH_ROWS.split(", ")]
    runs = [(bi, ri, run) for bi, b in enumerate(blocks) for ri, run in enumerate(b["runs"])]
    at = 0
    while at < len(runs):
        end, n = at, 0
        while end < len(runs) and (end == at or n + len(runs[end][2]["stitches"]) <= FRAME_ROWS):
            n += len(runs[end][2]["stitches"])
            end += 1
        part, at = runs[at:end], end
        size = [len(r["stitches"]) for *_, r in part]
        each = lambda values: np.repeat(np.array(values), size)  # noqa: B023, E731
        text = lambda key: np.repeat(np.array([r[key] for *_, r in part], object), size)  # noqa: B023, E731
        z = np.concatenate([r["stitches"] for *_, r in part])
        out = {"design_id": design_id, "block_idx": each([bi for bi, *_ in part]), "run_idx": each([ri for _, ri, _ in part]), "seq": np.concatenate([np.arange(k) for k in size]), "x": z.real.astype(int), "y": z.imag.astype(int)}
        out |= {c: each([blocks[bi]["thread"][k] for bi, *_ in part]) for k, c in enumerate("rgb")}
        out |= {"connection": text("connection"), "object_id": each([r["object_id"] for *_, r in part]), "stitch_type": text("stitch_type")}
        out |= {c: np.repeat(np.array([v[bi] for bi, *_ in part], object), size) if isinstance(v, list) else v for c, v in more.items()}
        yield pd.DataFrame(out)[[*names, *more]]


def stitch_rows(design_id: int, blocks: list[dict]) -> pd.DataFrame:
    frames = list(stitch_frames(design_id, blocks))
    return pd.concat(frames) if frames else pd.DataFrame(columns=[c.split()[0] for c in STITCH_ROWS.split(", ")])


#: A run is a row here, its points two arrays: a stitch is eight bytes on its way to Spark, not a row.
RUN_ROWS = "design_id bigint, block_idx bigint, run_idx bigint, r int, g int, b int, connection string, object_id bigint, stitch_type string, xs array<int>, ys array<int>"


def run_frames(design_id: int, runs: Iterable[tuple[tuple, dict]], **more) -> Iterator[pd.DataFrame]:
    """A plan's runs as they are sewn, in frames of some FRAME_ROWS stitches, so no more of a plan is held.  more: further columns."""
    names = [c.split()[0] for c in RUN_ROWS.split(", ")]
    rows, n, block, place, color = [], 0, -1, 0, None
    frame = lambda: pd.DataFrame(rows, columns=names).assign(**more)
    for c, run in runs:
        if c != color:
            block, place, color = block + 1, 0, c
        z = run["stitches"]
        rows.append((design_id, block, place, *c, run["connection"], run["object_id"], run["stitch_type"], z.real.astype(np.int32), z.imag.astype(np.int32)))
        place, n = place + 1, n + len(z)
        if n >= FRAME_ROWS:
            yield frame()
            rows, n = [], 0
    if rows:
        yield frame()


def in_stitches(runs: DataFrame) -> DataFrame:
    """A stitch a row, from a run a row."""
    names = [c.split()[0] for c in STITCH_ROWS.split(", ")]
    more = [c for c in runs.columns if c not in (*names, "xs", "ys")]
    own = [c for c in names if c not in ("seq", "x", "y")]
    z = runs.select(*own, *more, F.posexplode(F.arrays_zip("xs", "ys")).alias("seq", "z"))
    return z.withColumns({"seq": F.col("seq").cast("long"), "x": F.col("z.xs"), "y": F.col("z.ys")}).select(*names, *more)


def each_design(regions: DataFrame, made, schema: str) -> DataFrame:
    """Frames that `made` gives for each design, from its rows in order.  Designs are dealt to as many tasks as the session shuffles to, and their
    stitches leave a frame at a time, so a task holds a plan but not all of its rows."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("region_idx").to_dict("records")
        yield from made(int(rows[0]["design_id"]), rows)

    tasks = max(1, int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return regions.repartition(tasks, "design_id").groupBy("design_id").applyInPandas(one, schema)


def each_plan(regions: DataFrame, made, schema: str) -> DataFrame:
    """Frames that `made` gives for each design, from its regions in order; a region is an outline's points as soon as its batch has come."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            key = int(pdf["design_id"].iloc[0]) if key is None and len(pdf) else key
            held += [(row["region_idx"], region_of(row)) for row in pdf.to_dict("records")]
        held.sort(key=lambda r: r[0])
        yield from made(key, [r for _, r in held])

    tasks = max(1, int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return regions.repartition(tasks, "design_id").groupBy("design_id").applyInPandas(one, schema)


#: What a region may have besides outer, holes, r, g, b: its number elsewhere, its fill, the row angle, pairs of points that rows turn
#: between, runs of stitches (arrays of points) that are kept as they are, and the area that its colour is ordered by, if not its outline's.
OPTIONAL = ("object_id", "area", "fill_type", "angle_deg", "angle_lines", "baked")


def region_of(row) -> dict:
    """From a row with region_idx, outer, holes, r, g, b, and any of OPTIONAL."""
    there = {k: row[k] for k in OPTIONAL if k in row and row[k] is not None and not (isinstance(row[k], float) and row[k] != row[k])}
    holes = row["holes"] if row["holes"] is not None else []
    out = {"outer": S.wound(S.ring(row["outer"]), True), "holes": [S.wound(S.ring(h), False) for h in holes], "color": (int(row["r"]), int(row["g"]), int(row["b"]))}
    lists = {k: [S.ring(x) for x in there.pop(k)] for k in ("angle_lines", "baked") if k in there}
    return out | {"fill_type": None, "angle_deg": None} | there | lists | {"object_id": int(there.get("object_id", row["region_idx"]))}


def digitize_runs(regions: DataFrame, options: Options = Options()) -> DataFrame:
    """Runs of each design, a row each (RUN_ROWS), from rows (design_id, region_idx, outer, holes, r, g, b and any of OPTIONAL); a design is
    one group, of which a task holds the outlines and a frame of runs."""
    return each_plan(regions, lambda key, own: run_frames(key, sewn(own, options)), RUN_ROWS)


def digitize_designs(regions: DataFrame, options: Options = Options()) -> DataFrame:
    """Stitches of each design, from rows as `digitize_runs` takes them."""
    return in_stitches(digitize_runs(regions, options))
