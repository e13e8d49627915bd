"""Queries that run a sequential kernel for each row or design, on figures of which SQL can work out the results in closed form."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from threadloom.kernels import codec, pictures, qr
from threadloom.kernels import fills as G
from threadloom.kernels import images as I
from threadloom.kernels import order as O
from threadloom.kernels import shapes as S
from threadloom.operators import plan as P
from threadloom.operators import report
from threadloom.sources import adapters as A

from . import digitize as D
from . import pictures as C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_POLY = f"WITH {A.OUTLINES_SQL}"
#: Half sides and centre of each outline.
_BOX = _POLY + ", bb AS (SELECT design_id, poly, any_value(thread) AS thread, (max(x) - min(x)) // 2 AS w, (max(y) - min(y)) // 2 AS h, (max(x) + min(x)) // 2 AS cx, (max(y) + min(y)) // 2 AS cy FROM poly WHERE ring = 0 GROUP BY ALL)"


def _tasks(spark) -> int:
    """Rows are few and small but take long, so they are dealt by number: else adaptive execution would put them into one task."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("tour_order", "SELECT c_custkey % 50 AS design_id, c_custkey AS poly, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY (c_custkey * 37) % 801, c_custkey) - 1 AS place, max((c_custkey * 37) % 801) OVER (PARTITION BY c_custkey % 50) + 600 AS cost FROM customer")
def _(spark, d):
    """Objects on a line, from a needle at its far end: the shortest way goes from one to the next."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("poly")
        z = ((pdf["poly"] * 37) % 801 - 400).to_numpy() + 0j
        tour = O.tour(z, -1000 + 0j)
        return pd.DataFrame({"design_id": pdf["design_id"].iloc[0], "poly": pdf["poly"].to_numpy()[tour], "place": np.arange(len(tour)), "cost": round(O.cost(z, tour, -1000 + 0j))})

    return A.rings(spark, d).select("design_id", "poly").groupBy("design_id").applyInPandas(one, "design_id bigint, poly bigint, place bigint, cost bigint")


@query("tatami_runs", _BOX + """, tr AS (SELECT *, greatest(1, h // 2) AS n FROM bb)
SELECT poly, 1::BIGINT AS runs, cast((n + 1) // 2 * (2 + greatest(0, ceil((2 * w - 37.5::DOUBLE) / 30))) + n // 2 * (2 + greatest(0, ceil((2 * w - 22.5::DOUBLE) / 30))) AS BIGINT) AS stitches,
cx - w AS min_x, cx + w AS max_x, cy - h + 2 AS min_y, cy - h + 4 * n - 2 AS max_y, CASE WHEN poly % 3 = 0 THEN 0 END::BIGINT AS in_hole FROM tr""")
def _(spark, d):
    """Level rows over whole outlines: how many stitches, and how far they reach; with their holes none is in a hole."""

    def run(batches):
        for pdf in batches:
            out = []
            for poly, outer, hole in zip(pdf["poly"], pdf["outer"], pdf["hole"], strict=True):
                o = S.ring(outer)
                runs = G.tatami(o, [], 0.0)
                z = runs[0]
                inner = None
                if hole is not None:
                    h = S.ring(hole)
                    around = G.tatami(o, [h], 0.0)[0] - h.mean()
                    inner = int((np.maximum(np.abs(around.real), np.abs(around.imag)) < np.ptp(h.real) / 2).sum())
                out.append((poly, len(runs), len(z), int(z.real.min()), int(z.real.max()), int(z.imag.min()), int(z.imag.max()), inner))
            yield pd.DataFrame(out, columns=["poly", "runs", "stitches", "min_x", "max_x", "min_y", "max_y", "in_hole"]).astype({"in_hole": "Int64"})

    return A.dealt(A.rings(spark, d).select("poly", "outer", "hole"), "poly").mapInPandas(run, "poly bigint, runs bigint, stitches bigint, min_x bigint, max_x bigint, min_y bigint, max_y bigint, in_hole bigint")


def _regions(spark, d):
    r, g, b = report.thread_color("thread")
    holes = F.when(F.col("hole").isNotNull(), F.array("hole")).otherwise(F.array())
    return A.rings(spark, d).repartition(_tasks(spark), "design_id").select("design_id", F.col("poly").cast("int").alias("region_idx"), "outer", holes.alias("holes"), r.alias("r"), g.alias("g"), b.alias("b"))


_SEGMENTS = ", ".join(f"('{t}', {h >> 16 & 255}, {h >> 8 & 255}, {h & 255})" for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD") for h in [zlib.crc32(t.encode())])


@query("digitize_designs", _BOX + f""", tc(thread, r, g, b) AS (VALUES {_SEGMENTS}), ca AS (SELECT design_id, thread, sum(4 * w * h - CASE WHEN poly % 3 = 0 THEN 100 ELSE 0 END) AS area, min(poly) AS first_poly, count(*) AS objects FROM bb GROUP BY ALL)
SELECT design_id, row_number() OVER (PARTITION BY design_id ORDER BY area DESC, first_poly) - 1 AS block_idx, r, g, b, objects, 0::BIGINT AS trims_in_objects, true AS within_limits FROM ca JOIN tc USING (thread)""")
def _(spark, d):
    """Plans of whole designs: a block for each colour, by area; every object sewn, none with a trim inside, no stitch over 12.1 mm."""
    runs = D.digitize_runs(_regions(spark, d), D.of_fabric("standard"))
    from pyspark.sql import Window

    n = F.size("xs")
    steps = lambda c: F.zip_with(F.slice(c, 2, n), F.slice(c, 1, n - 1), lambda to, at: F.abs(to - at))
    far = F.size(F.filter(F.zip_with(steps("xs"), steps("ys"), lambda dx, dy: F.greatest(dx, dy)), lambda v: v > 121))
    r = runs.select("design_id", "block_idx", "run_idx", "object_id", "connection", "r", "g", "b", n.alias("n"), far.alias("_far"))
    w = Window.partitionBy("design_id", "block_idx").orderBy("run_idx")
    r = r.withColumn("_same", F.lag("object_id").over(w) == F.col("object_id"))
    g = r.groupBy("design_id", "block_idx", "r", "g", "b").agg(F.count_distinct("object_id").alias("objects"), F.count_if(F.col("_same") & (F.col("connection") == "trim")).alias("trims_in_objects"), F.min("n").alias("_n"), F.sum("_far").alias("_far"))
    return g.select("design_id", "block_idx", "r", "g", "b", "objects", "trims_in_objects", ((F.col("_n") >= 2) & (F.col("_far") == 0)).alias("within_limits"))


def plan_rows(spark, d):
    st = A.stitches(spark, d)
    r, g, b = report.thread_color("thread")
    runs = P.runs(st).select(*P.RUN, "connection")
    return st.join(runs, P.RUN).select("design_id", "block_idx", "run_idx", "seq", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), "connection")


def file_roundtrip(spark, d):
    """Plans written to both machine formats and read back: sizes, records, and sums over where the needle goes in."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from threadloom.sources.files import plan_of

        plan = plan_of(pdf, "Round trip ü")
        dst, pes = codec.write_dst(plan), codec.write_pes(plan)
        d, p = codec.read_dst(dst), codec.read_pes(pes)
        z, q = np.array(codec.dst_points(d["records"])), np.array(codec.pes_points(p["ops"]))
        check = lambda a: int((a[:, 0] * 31 + a[:, 1] * 17).sum())
        row = {"design_id": pdf["design_id"].iloc[0], "dst_bytes": len(dst), "dst_records": d["stitches"], "color_changes": d["color_changes"], "dst_stitches": len(z), "dst_check": check(z), "dst_label": d["label"]}
        row |= {"min_x": z[:, 0].min(), "max_x": z[:, 0].max(), "min_y": z[:, 1].min(), "max_y": z[:, 1].max(), "pes_bytes": len(pes), "pes_stitches": len(q), "pes_check": check(q), "pes_colors": len(p["palette"])}
        return pd.DataFrame([row])

    schema = "design_id bigint, dst_bytes bigint, dst_records bigint, color_changes bigint, dst_stitches bigint, dst_check bigint, dst_label string, min_x bigint, max_x bigint, min_y bigint, max_y bigint, pes_bytes bigint, pes_stitches bigint, pes_check bigint, pes_colors bigint"
    return plan_rows(spark, d).groupBy("design_id").applyInPandas(one, schema)


#: To follow the operations of plans (ops: design_id, op_seq, kind, x, y). A trim is three records of DST; in PES a jump that was landed
#: is anchored by a stitch in its place, and short moves take two bytes.
FILE_SQL = """, fm AS (SELECT *, kind IN ('stitch', 'jump') AS moves FROM ops),
fp AS (SELECT *, coalesce(last_value(CASE WHEN moves THEN x END IGNORE NULLS) OVER w, 0) AS px, coalesce(last_value(CASE WHEN moves THEN y END IGNORE NULLS) OVER w, 0) AS py, last_value(CASE WHEN kind <> 'trim' THEN kind END IGNORE NULLS) OVER w AS before
  FROM fm WINDOW w AS (PARTITION BY design_id ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fa AS (SELECT *, coalesce(before = 'jump' AND kind IN ('stitch', 'colorChange'), false) AS anchor, CASE kind WHEN 'stitch' THEN CASE WHEN x - px BETWEEN -64 AND 63 AND y - py BETWEEN -64 AND 63 THEN 2 ELSE 4 END WHEN 'jump' THEN 4 WHEN 'colorChange' THEN 3 WHEN 'end' THEN 1 ELSE 0 END AS bytes FROM fp),
fs AS (SELECT design_id, count(*) FILTER (kind <> 'end') + 2 * count(*) FILTER (kind = 'trim') AS dst_records, count(*) FILTER (kind = 'colorChange') AS color_changes, count(*) FILTER (kind = 'stitch') AS dst_stitches, cast(sum(x::BIGINT * 31 + y * 17) FILTER (kind = 'stitch') AS BIGINT) AS dst_check,
  min(x) FILTER (kind = 'stitch') AS min_x, max(x) FILTER (kind = 'stitch') AS max_x, min(y) FILTER (kind = 'stitch') AS min_y, max(y) FILTER (kind = 'stitch') AS max_y, count(*) FILTER (anchor) AS anchors, cast(coalesce(sum(px::BIGINT * 31 + py * 17) FILTER (anchor), 0) AS BIGINT) AS anchor_check, cast(sum(bytes) AS BIGINT) AS body FROM fa GROUP BY design_id)
SELECT design_id, 512 + 3 * dst_records + 3 AS dst_bytes, dst_records, color_changes, dst_stitches, dst_check, 'Round trip _' AS dst_label, min_x::BIGINT AS min_x, max_x::BIGINT AS max_x, min_y::BIGINT AS min_y, max_y::BIGINT AS max_y,
  22 + 512 + 20 + body + 2 * anchors + 228 * (color_changes + 2) AS pes_bytes, dst_stitches + anchors AS pes_stitches, dst_check + anchor_check AS pes_check, color_changes + 1 AS pes_colors FROM fs"""


@query("qr_roundtrip", "SELECT c_custkey, c_name AS text, c_name AS back, CASE WHEN strlen(c_name) <= 14 THEN 21 WHEN strlen(c_name) <= 26 THEN 25 ELSE 29 END::BIGINT AS side FROM customer")
def _(spark, d):
    def run(batches):
        for pdf in batches:
            made = [qr.encode(t) for t in pdf["text"]]
            yield pdf.assign(back=[qr.decode(m) for m in made], side=[m.shape[0] for m in made])

    return A.dealt(A.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("text")), "c_custkey").mapInPandas(run, "c_custkey bigint, text string, back string, side bigint")


#: A picture for each supplier, 64 by 48: a red and a blue box on white, and a green one in the red.
_PAINTED = """WITH pk AS (SELECT s_suppkey AS design_id, 3 + s_suppkey % 4 AS ax, 3 + s_suppkey % 5 AS ay, 20 + s_suppkey % 9 AS aw, 18 + s_suppkey % 11 AS ah, 36 + s_suppkey % 3 AS bx, 5 + s_suppkey % 7 AS by_, 14 + s_suppkey % 8 AS bw, 15 + s_suppkey % 13 AS bh FROM supplier)"""


def _painted(k: int) -> np.ndarray:
    a = np.full((48, 64, 4), 255, np.uint8)
    ax, ay, aw, ah, bx, by, bw, bh = 3 + k % 4, 3 + k % 5, 20 + k % 9, 18 + k % 11, 36 + k % 3, 5 + k % 7, 14 + k % 8, 15 + k % 13
    a[ay : ay + ah, ax : ax + aw, :3] = (220, 30, 30)
    a[ay + 5 : ay + 13, ax + 5 : ax + 15, :3] = (30, 150, 70)
    a[by : by + bh, bx : bx + bw, :3] = (30, 60, 200)
    return a


def _picture_files(spark, d):
    def run(batches):
        for pdf in batches:
            yield pdf.assign(content=[pictures.encode_png(_painted(int(k))) for k in pdf["design_id"]])

    return A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("design_id")).repartition(_tasks(spark), "design_id").mapInPandas(run, "design_id bigint, content binary")


# the vote of a box's corner pixel is a tie that the pixel met first decides: at all corners but the lower right one that is the
# surroundings, so a box on white loses three pixels; within another colour far ones keep theirs
@query("quantize_labels", _PAINTED + """, pb AS (SELECT design_id, 220 AS r, 30 AS g, 30 AS b, aw * ah - 80 - 3 AS pixels, ay * 64 + ax AS met FROM pk UNION ALL SELECT design_id, 30, 60, 200, bw * bh - 3, by_ * 64 + bx FROM pk UNION ALL SELECT design_id, 30, 150, 70, 80, (ay + 5) * 64 + ax + 5 FROM pk)
SELECT design_id, cast(row_number() OVER (PARTITION BY design_id ORDER BY met) - 1 AS INT) AS place, r, g, b, pixels, NULL::VARCHAR AS error FROM pb""")
def _(spark, d):
    """PNG files to palettes: colours in the order in which they are met, and how many pixels have each."""
    return C.picture_labels(_picture_files(spark, d))


@query("trace_regions", _PAINTED + """SELECT design_id, 'outer' AS kind, r, area::BIGINT AS area FROM (SELECT design_id, 220 AS r, 100 * aw * ah AS area FROM pk UNION ALL SELECT design_id, 30, 100 * bw * bh FROM pk UNION ALL SELECT design_id, 31, 8000 FROM pk) UNION ALL SELECT design_id, 'hole', 220, -8000 FROM pk""")
def _(spark, d):
    """Label maps to outlines and holes, with their areas (a pixel is 10 by 10 units)."""

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["s_suppkey"].tolist():
                rgb = _painted(k)[..., :3].astype(int)
                labels = np.where(rgb.sum(-1) == 765, -1, np.where(rgb[..., 0] == 220, 0, np.where(rgb[..., 2] == 200, 1, 2)))
                kept, _ = I.regions(labels, [(220, 30, 30), (30, 60, 200), (31, 150, 70)], 10.0)
                for r in kept:
                    out.append((k, "outer", r["color"][0], round(S.area(r["outer"]))))
                    out += [(k, "hole", r["color"][0], round(S.area(h))) for h in r["holes"]]
            yield pd.DataFrame(out, columns=["design_id", "kind", "r", "area"])

    return A.dealt(A.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").mapInPandas(run, "design_id bigint, kind string, r int, area bigint")


@query("pictures_to_plans", _PAINTED + """, pa AS (SELECT design_id, 220 AS r, 30 AS g, 30 AS b, aw * ah - 80 AS area, 0 AS k FROM pk UNION ALL SELECT design_id, 30, 60, 200, bw * bh, 1 FROM pk UNION ALL SELECT design_id, 30, 150, 70, 80, 2 FROM pk)
SELECT design_id, row_number() OVER (PARTITION BY design_id ORDER BY area DESC, k) - 1 AS block_idx, r, g, b, 1::BIGINT AS objects, 0::BIGINT AS trims FROM pa""")
def _(spark, d):
    """PNG files to plans: the colours' blocks, the largest first, one object in each."""
    st = C.pictures_to_plans(_picture_files(spark, d))
    return st.groupBy("design_id", "block_idx", "r", "g", "b").agg(F.count_distinct("object_id").alias("objects"), F.count_if((F.col("run_idx") > 0) & (F.col("connection") == "trim") & (F.col("seq") == 0)).alias("trims"))


@query("branch_walk", "SELECT c_custkey AS poly, 1::BIGINT AS runs, 200 * (3 + c_custkey % 10) - 200 AS length, 3 + c_custkey % 10 AS ends FROM customer")
def _(spark, d):
    """Three to twelve spokes of 10 mm from a common middle: one run from the end of one to the end of another, all others there and back."""
    spokes = [complex(x, y) for x, y in ((100, 0), (80, 60), (60, 80), (0, 100), (-60, 80), (-80, 60), (-100, 0), (-80, -60), (-60, -80), (0, -100), (60, -80), (80, -60))]

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["poly"]:
                ends = spokes[: 3 + k % 10]
                runs = O.branch_runs([np.array([0j, e]) for e in ends], join=0.5)
                out.append((k, len(runs), round(sum(np.abs(np.diff(r)).sum() for r in runs)), sum(e in runs[0] for e in ends)))
            yield pd.DataFrame(out, columns=["poly", "runs", "length", "ends"])

    return A.dealt(A.rings(spark, d).select("poly"), "poly").mapInPandas(run, "poly bigint, runs bigint, length bigint, ends bigint")


@query("satin_runs", "SELECT c_custkey AS poly, 1::BIGINT AS runs, false AS branched, 20 + c_custkey % 30 AS width, 2 * ((100 + c_custkey % 60) // 3) AS stitches, 0::BIGINT AS min_y, 20 + c_custkey % 30 AS max_y FROM customer")
def _(spark, d):
    """Satin columns across narrow boxes: as wide as their short side, a stitch to each side for each row."""

    def run(batches):
        for pdf in batches:
            out = []
            for poly in pdf["poly"]:
                w, h = 100 + poly % 60, 20 + poly % 30
                runs, branched, width = G.satin(S.ring([(0, 0), (w, 0), (w, h), (0, h)]))
                z = runs[0]
                out.append((poly, len(runs), branched, round(width), len(z), round(z.imag.min()), round(z.imag.max())))
            yield pd.DataFrame(out, columns=["poly", "runs", "branched", "width", "stitches", "min_y", "max_y"])

    return A.dealt(A.rings(spark, d).select("poly"), "poly").mapInPandas(run, "poly bigint, runs bigint, branched boolean, width bigint, stitches bigint, min_y bigint, max_y bigint")


@query("svg_import", """WITH s AS (SELECT p_partkey, 40 + p_partkey % 50 AS w, p_partkey % 4096 AS c FROM part), t AS (SELECT *, 1000.0::DOUBLE / greatest(p_partkey % 7 + 2 * w, 87) AS f, (p_partkey % 7 + 2 * w) / 2.0::DOUBLE AS mx FROM s)
SELECT p_partkey, 2::BIGINT AS regions, 1::BIGINT AS holes, (c // 256 * 17)::INT AS r, (c // 16 % 16 * 17)::INT AS g, (c % 16 * 17)::INT AS b, 255 AS stroke_r, cast(floor(120 * w * f * f * 1000 + 0.5) AS BIGINT) AS outer_area, cast(floor(400 * f * f * 1000 + 0.5) AS BIGINT) AS hole_area,
cast(floor((p_partkey % 7 - mx) * f * 1000 + 0.5) AS BIGINT) AS min_x, cast(floor((3 - 46.5) * f * 1000 + 0.5) AS BIGINT) AS min_y FROM t""")
def _(spark, d):
    """A drawing for each part: a box with a square hole and a stroke, fitted to the hoop; areas and corners in thousandths."""
    from threadloom.kernels import svg

    def run(batches):
        milli = lambda v: int(np.floor(v * 1000 + 0.5 + 1e-6))
        for pdf in batches:
            out = []
            for k in pdf["p_partkey"].tolist():
                w = 40 + k % 50
                text = f'<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate({k % 7},3) scale(2)"><path fill="#{k % 4096:03x}" d="M0 0h{w}v30h-{w}zM10 10v10h10v-10z"/></g><path d="M0 90 q 20 -30 {w} 0" fill="none" stroke="red" stroke-width="4"/></svg>'
                r = svg.regions(text)
                o = r[0]["outer"]
                out.append((k, len(r), sum(len(x["holes"]) for x in r), *r[0]["color"], r[1]["color"][0], milli(abs(S.area(o))), milli(abs(S.area(r[0]["holes"][0]))), milli(o.real.min()), milli(o.imag.min())))
            yield pd.DataFrame(out, columns=["p_partkey", "regions", "holes", "r", "g", "b", "stroke_r", "outer_area", "hole_area", "min_x", "min_y"])

    return A.dealt(A.table(spark, d, "part").select("p_partkey"), "p_partkey").mapInPandas(run, "p_partkey bigint, regions bigint, holes bigint, r int, g int, b int, stroke_r int, outer_area bigint, hole_area bigint, min_x bigint, min_y bigint")


@query("photo_stitch", """WITH g AS (SELECT s_suppkey, s_suppkey * 7 % 200 AS grey FROM supplier)
SELECT s_suppkey, 92::BIGINT AS thread, 30::BIGINT AS runs, cast(30 * (1 + ceil(63.0::DOUBLE / ((16.0::DOUBLE + 24.0::DOUBLE * ((grey * 0.299::DOUBLE + grey * 0.587::DOUBLE + grey * 0.114::DOUBLE) / 255)) / 10))) AS BIGINT) AS stitches, -320::BIGINT AS min_x, 310::BIGINT AS max_x FROM g""")
def _(spark, d):
    """Even grey pictures: thirty rows, the lighter the longer their stitches."""

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["s_suppkey"].tolist():
                a = np.full((48, 64, 4), k * 7 % 200, np.uint8)
                a[..., 3] = 255
                grey, runs = I.photo(a, 10.0, bands=1)[0]
                z = np.concatenate(runs)
                out.append((k, grey, len(runs), len(z), round(z.real.min()), round(z.real.max())))
            yield pd.DataFrame(out, columns=["s_suppkey", "thread", "runs", "stitches", "min_x", "max_x"])

    return A.dealt(A.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").mapInPandas(run, "s_suppkey bigint, thread bigint, runs bigint, stitches bigint, min_x bigint, max_x bigint")


@query("sketch_compile", """WITH k AS (SELECT c_custkey AS doc, 200 + 10 * (c_custkey % 5) AS w FROM customer)
SELECT doc, 2::BIGINT AS blocks, 2::BIGINT AS elements, cast(25 * (2 + greatest(0, ceil((w - 37.5::DOUBLE) / 30))) + 25 * (2 + greatest(0, ceil((w - 22.5::DOUBLE) / 30))) - 49 AS BIGINT) AS fill_stitches, 'tatami' AS fill_type, ['running', 'running', 'satin'][doc % 3 + 1] AS stroke_type, -100::BIGINT AS min_x, -100 + w AS max_x, w / 10.0::DOUBLE - 10 AS corner FROM k""")
def _(spark, d):
    """A sketch for each customer, compiled, written with its document to a PES file, and opened again: the fill's stitches (a row's first
    is merged with the last one of the row before), and a corner of the reopened document."""
    from . import sketch

    def run(batches):
        for pdf in batches:
            out = []
            for k in pdf["doc"].tolist():
                doc = sketch.load(sketch.save({"layers": [{"elements": [
                    {"kind": "fill", "outer": [[-10, -10], [10 + k % 5, -10], [10 + k % 5, 10], [-10, 10]], "holes": [], "color": [220, 30, 30], "angle": 0},
                    {"kind": "stroke", "points": [[-20, 20], [0, 25 + k % 7], [20, 20]], "width": (0.5, 1.0, 2.5)[k % 3], "color": [30, 60, 200]},
                ]}]}))
                blocks = sketch.compile_document(doc)
                plan = {"name": f"S{k}", "blocks": [{"thread": dict(zip("rgb", b["thread"], strict=True)), "runs": [{"stitches": [(int(p.real), int(p.imag)) for p in r["stitches"]], "connection": r["connection"]} for r in b["runs"]]} for b in blocks]}
                back = sketch.import_pes(codec.write_pes(plan, codec.with_document(sketch.save(doc))))
                fill, z = blocks[0]["runs"][0], blocks[0]["runs"][0]["stitches"]
                elements = back["layers"][0]["elements"]
                out.append((k, len(blocks), len(elements), len(z), fill["stitch_type"], blocks[1]["runs"][-1]["stitch_type"], round(z.real.min()), round(z.real.max()), float(elements[0]["outer"][1][0])))
            yield pd.DataFrame(out, columns=["doc", "blocks", "elements", "fill_stitches", "fill_type", "stroke_type", "min_x", "max_x", "corner"])

    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("doc")).repartition(_tasks(spark), "doc").mapInPandas(run, "doc bigint, blocks bigint, elements bigint, fill_stitches bigint, fill_type string, stroke_type string, min_x bigint, max_x bigint, corner double")


@query("scan_rows_turned", _BOX + """, tu AS (SELECT poly, w, h, 2 * w * 0.5::DOUBLE AS a, 2 * h * sqrt(0.75::DOUBLE) AS b FROM bb), tv AS (SELECT *, floor((a + b) / 2)::BIGINT AS n FROM tu), tw AS (SELECT *, (range + 0.5::DOUBLE) * 2 AS d FROM tv, range(0, 200) WHERE range < n)
SELECT poly, any_value(n) AS rows, cast(floor(sum(least(d, a + b - d, a, b)) / (0.5::DOUBLE * sqrt(0.75::DOUBLE)) * 10 + 0.5) AS BIGINT) AS length FROM tw GROUP BY poly""")
def _(spark, d):
    """Rows at 30 degrees through boxes, and their length in tenths: a row's chord grows from one corner on, stays, and shrinks."""

    def run(batches):
        for pdf in batches:
            out = []
            for poly, outer in zip(pdf["poly"], pdf["outer"], strict=True):
                scan, _ = G.rows(S.ring(outer), [], 2.0, np.radians(30))
                total = sum(s[1] - s[0] for _, row in scan for s in row)
                out.append((poly, len(scan), int(np.floor(total * 10 + 0.5))))
            yield pd.DataFrame(out, columns=["poly", "rows", "length"])

    return A.dealt(A.rings(spark, d).select("poly", "outer"), "poly").mapInPandas(run, "poly bigint, rows bigint, length bigint")


@query("reduced_designs", _BOX + """SELECT design_id, 'spacing,spacing,drop5,drop10,length' AS steps, count(*) FILTER (4 * w * h - CASE WHEN poly % 3 = 0 THEN 100 ELSE 0 END >= 1000) AS objects FROM bb GROUP BY design_id""")
def _(spark, d):
    """Designs under a limit that none can meet: all steps are taken, and small objects go."""
    runs = C.reduced_runs(_regions(spark, d), limit=50)
    return runs.groupBy("design_id", "steps").agg(F.count_distinct("object_id").alias("objects"))


__all__ = ["FILE_SQL", "QUERIES", "SQL", "file_roundtrip", "plan_rows"]
