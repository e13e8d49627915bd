"""Kernels on plain arrays: invariants, round trips, and small cases worked out by hand."""

import itertools

import numpy as np
import pytest

from threadloom.kernels import codec, qr, svg
from threadloom.kernels import fills as G
from threadloom.kernels import images as I
from threadloom.kernels import order as O
from threadloom.kernels import shapes as S
from threadloom.plans import digitize as D
from threadloom.plans import sketch

CIRCLE = np.exp(2j * np.pi * np.arange(72) / 72)
RED, BLUE, GREEN = (220, 30, 30), (30, 60, 200), (30, 150, 70)


def box(cx, cy, w, h):
    return S.ring([(cx - w / 2, cy - h / 2), (cx + w / 2, cy - h / 2), (cx + w / 2, cy + h / 2), (cx - w / 2, cy + h / 2)])


def region(outer, color=RED, holes=(), **more):
    return {"outer": outer, "holes": list(holes), "color": color} | more


# Geometry


def test_area_centroid_and_winding():
    z = box(10, 20, 40, 30)
    assert S.area(z) == 1200 and S.area(z[::-1]) == -1200
    assert abs(S.centroid(z) - (10 + 20j)) < 1e-9
    assert S.centroid(np.array([5 + 5j, 6 + 6j, 7 + 7j])) == 5 + 5j
    assert S.area(S.wound(z[::-1], True)) > 0 and S.min_extent(z) == 30


def test_inside_is_half_open_and_sees_holes():
    z = box(0, 0, 20, 20)
    assert S.inside(np.array([0j, 9 + 9j, 11 + 0j]), z).tolist() == [True, True, False]
    assert S.in_shape(np.array([0j, 8 + 0j]), z, [box(0, 0, 6, 6)]).tolist() == [False, True]


def test_simplify_keeps_what_matters():
    line = np.array([0, 1 + 0.01j, 2, 3 + 5j, 4, 5])
    assert S.simplify(line, 0.1).tolist() == [0, 2, 3 + 5j, 4, 5]
    ring = S.resample(np.append(box(0, 0, 40, 40), box(0, 0, 40, 40)[0]), 1)[:-1]
    assert len(S.simplify_ring(ring, 0.5)) == 4


def test_corner_cutting_keeps_corners():
    assert len(S.rounded_corners(box(0, 0, 10, 10), 2)) == 4
    assert len(S.rounded_corners(CIRCLE, 1)) == 144


def test_resampling_is_even():
    z = S.resample(np.array([0, 100, 100 + 100j]), 10)
    assert len(z) == 21 and np.allclose(np.abs(np.diff(z)), 10)


def test_ribbons():
    outer, holes = S.ribbon(np.array([0, 100 + 0j]), 5)
    assert abs(S.area(outer) - 1000) < 1e-6 and not holes
    outer, holes = S.ribbon(CIRCLE * 50, 5, closed=True)
    assert S.area(outer) > 0 > S.area(holes[0])
    assert S.ribbon(np.array([1 + 1j]), 5) is None


def test_crossing():
    assert not S.crossing(box(0, 0, 10, 10)) and S.crossing(np.array([0, 10 + 10j, 10, 10j]))


def test_track_walks_the_shorter_way():
    t = S.Track(box(0, 0, 20, 20))
    path = t.walk(2, 78)
    assert np.abs(np.diff(path)).sum() == pytest.approx(4)
    assert t.nearest(0 - 30j)[1] == pytest.approx(20)


# Generators


@pytest.mark.parametrize("angle", [0, 30, 45, 90])
@pytest.mark.parametrize("shape", ["circle", "donut", "c", "neck"])
def test_one_region_is_one_run(shape, angle):
    holes = []
    outer = {
        "circle": CIRCLE * 300, "donut": CIRCLE * 320, "c": S.wound(S.ring([(0, 0), (300, 0), (300, 60), (80, 60), (80, 220), (300, 220), (300, 280), (0, 280)]), True),
        "neck": S.wound(S.ring([(0, 0), (100, 0), (100, 45), (200, 45), (200, 0), (300, 0), (300, 100), (200, 100), (200, 55), (100, 55), (100, 100), (0, 100)]), True),
    }[shape]
    if shape == "donut":
        holes = [(CIRCLE * 150)[::-1]]
    runs = G.tatami(outer, holes, angle)
    assert len(runs) == 1
    z = G.finish(runs[0])
    assert np.abs(np.diff(z)).max() <= 121.01
    c = (outer.max() + outer.min()) / 2
    assert S.inside((z - c) * 0.98 + c, outer).all() or shape in ("c", "neck")
    if holes:
        assert not S.inside(z * 1.03, holes[0])[np.abs(z) < 140].any()


def test_fills_are_deterministic_and_dense():
    a, b = G.tatami(CIRCLE * 100)[0], G.tatami(CIRCLE * 100)[0]
    assert np.array_equal(a, b)
    assert len(G.rows(CIRCLE * 100, [], 4)[0]) == 50


def test_fill_starts_and_ends_near():
    z = G.tatami(box(0, 0, 200, 100), angle_deg=0, start=-100 - 50j, leave=100 - 50j)[0]
    assert abs(z[0] - (-100 - 50j)) < 30 and abs(z[-1] - (100 - 50j)) < 30


def test_satin_width_and_splits():
    runs, branched, width = G.satin(box(0, 0, 300, 40))
    assert not branched and abs(width - 40) < 1
    left = np.array([0, 20, 40, 60 + 0j])
    assert len(G.zigzag(left, left + 30j)) == 8
    arc = np.exp(1j * np.linspace(0, 1, 8))
    assert len(G.zigzag(arc * 30, arc * 90)) > 16


def test_running_and_outline():
    z = G.running(np.array([0, 100 + 0j]))[0]
    assert z.tolist() == [0, 25, 50, 75, 100]
    assert len(G.running(np.array([0, 100 + 0j]), passes=3)[0]) == 13
    z = G.outline(CIRCLE * 50)[0]
    n = (len(z) + 2) // 3
    assert (z[:n] == z[n - 1 : 2 * n - 1][::-1]).all() and (z[:n] == z[-n:]).all() and z[0] == z[-1]


def test_turning_fill_is_one_run_inside():
    r = G.turning(CIRCLE * 200, [], [(-100 - 100j, -100 + 100j), (100 - 100j, 160 + 100j)])
    assert len(r) == 1 and np.abs(r[0]).max() < 206
    assert G.turning(CIRCLE * 200, [], [(0, 1j)]) == []


def test_finish_merges_and_splits():
    z = G.finish(np.array([0, 2, 4, 300 + 0j]))
    assert z[0] == 0 and z[-1] == 300 and np.abs(np.diff(z)).max() <= 121 and len(z) == 4


def test_compensation():
    wide, _ = G.compensated(box(0, 0, 100, 100), [], 4, 2, 0.0)
    assert np.ptp(wide.imag) == pytest.approx(108) and np.ptp(wide.real) == pytest.approx(96)
    same, _ = G.compensated(box(0, 0, 100, 15), [], 4, 2, 0.0)
    assert np.ptp(same.imag) == 15
    column, _ = G.compensated_column(box(0, 0, 100, 10), [], 2)
    assert np.ptp(column.imag) == pytest.approx(14)
    assert G.spaced(50, 4, True) == 4 == G.spaced(20000, 4, True) and G.spaced(7500, 4, True) == pytest.approx(4.8)


def test_underlays():
    assert len(G.fill_underlay(box(0, 0, 200, 200), [], ("edge", "tatami"), 45)) == 2
    run = G.satin(box(0, 0, 300, 40))[0][0]
    assert len(G.satin_underlay(run, ("edge", "tatami"))) == 2 and len(G.satin_underlay(run, ("edge",))) == 1
    assert G.satin_underlay(G.satin(box(0, 0, 100, 8))[0][0], ("edge",)) == [] and G.satin_underlay(run, (), "none") == []


def test_registry():
    G.register("dots", lambda outer, holes, p: [outer])
    assert set(G.REGISTRY) >= {"tatami", "satin", "dots"} and len(G.REGISTRY["tatami"](box(0, 0, 50, 50), [], {})) == 1
    del G.REGISTRY["dots"]


# Orders


def test_tours_are_permutations_and_no_longer():
    for n in range(1, 12):
        z = np.array([complex(round(400 * np.sin(2.39 * i)), round(400 * np.cos(5.07 * i))) for i in range(n)])
        for start in (None, 0j):
            t = O.tour(z, start)
            assert sorted(t) == list(range(n)) and O.cost(z, t, start) <= O.cost(z, list(range(n)), start) + 1e-9


def test_small_tours_are_near_the_best():
    z = np.array([0, 50 + 10j, 20 + 40j, 80, 90 + 60j, 10 + 90j])
    best = min(O.cost(z, list(p), 0j) for p in itertools.permutations(range(6)))
    assert O.cost(z, O.tour(z, 0j), 0j) <= 1.1 * best


def test_branches():
    y = [np.array([0, 100 + 0j]), np.array([100 + 0j, 200 + 100j]), np.array([100 + 0j, 200 - 100j])]
    runs = O.branch_runs(y)
    assert len(runs) == 1 and {0j, 200 + 100j, 200 - 100j} <= set(runs[0].tolist())
    assert len(O.branch_runs([*y, np.array([900, 1000 + 0j])])) == 2


# Files


def test_every_dst_record():
    for dx in range(-121, 122):
        for dy in (-121, -40, -1, 0, 2, 13, 121):
            for kind in ("stitch", "jump", "colorChange"):
                assert codec.dst_move(codec.dst_record(dx, dy, kind)) == (dx, dy, kind)
    with pytest.raises(ValueError):
        codec.dst_record(122, 0)


def plan(*blocks):
    return {"name": "Tést", "blocks": [{"thread": dict(zip("rgb", c, strict=True)), "runs": [{"stitches": s, "connection": how} for how, s in runs]} for c, runs in blocks]}


PLAN = plan((RED, [("trim", [(0, 0), (100, 0), (100, -100)]), ("trim", [(400, 0), (430, 10)]), ("jump", [])]), (GREEN, []), (BLUE, [("trim", [(-50, -50), (-20, -20)]), ("continuous", [(-10, -20), (5, 5)])]))


@pytest.mark.parametrize("locks", [True, False])
def test_operations(locks):
    ops = codec.operations(PLAN, locks)
    kinds = [k for k, *_ in ops]
    assert kinds.count("colorChange") == 1 and kinds.count("trim") == 1 and kinds[-1] == "end" and kinds[0] == "jump"
    for k, kind in enumerate(kinds):
        if kind == "trim":
            assert kinds[k + 1] == "jump"
    at = (0, 0)
    for kind, x, y in ops:
        if kind in ("stitch", "jump"):
            assert max(abs(x - at[0]), abs(y - at[1])) <= 121
            at = (x, y)
    assert {(0, 0), (100, -100), (430, 10), (5, 5)} <= {(x, y) for k, x, y in ops if k == "stitch"}


def test_round_trips():
    want = [(x, y) for k, x, y in codec.operations(PLAN) if k == "stitch"]
    dst = codec.read_dst(codec.write_dst(PLAN))
    assert codec.dst_points(dst["records"]) == want and dst["label"] == "T_st" and dst["color_changes"] == 1
    pes = codec.read_pes(codec.write_pes(PLAN))
    # a landed jump is anchored by a stitch of its own
    assert set(codec.pes_points(pes["ops"])) == set(want) and len(pes["palette"]) == 3
    assert [c for c, *_ in codec.runs_of(pes["ops"])] == [0, 0, 1]


def test_edge_plans():
    for p in (plan(), plan((RED, [])), plan((RED, [("trim", [(5, 5)])])), plan((RED, []), (BLUE, [("trim", [(500, 500), (-500, -500)])]))):
        assert codec.read_dst(codec.write_dst(p))["color_changes"] == 0
        assert len(codec.write_pes(p)) > 512 and codec.svg_preview(p).startswith("<svg")


def test_pec_layout():
    data = codec.write_pes(PLAN, b"extra")
    pes = codec.read_pes(data)
    at = pes["pec_offset"]
    assert at == 27 and data[at + 48] == 2 and data[at + 512 : at + 514] == b"\x00\x00"
    size = int.from_bytes(data[at + 514 : at + 517], "little")
    assert data[at + 512 + size - 1] == 0xFF and len(data) == at + 512 + size + 4 * 228


def test_nearest_thread_takes_the_first_of_equals():
    assert codec.nearest_thread({"r": 0, "g": 0, "b": 0}) == 20 and codec.nearest_thread({"r": 255, "g": 255, "b": 0}) == 13


def test_documents_in_files():
    data = codec.write_pes(PLAN, codec.with_document('{"x":1}'))
    assert codec.embedded_document(data) == '{"x":1}' and codec.embedded_document(codec.write_pes(PLAN)) is None and codec.embedded_document(b"no") is None


@pytest.mark.parametrize("text", ["A", "hello world", "https://example.org/x?y=12345", "x" * 42, "é" * 20])
def test_qr(text):
    m = qr.encode(text)
    assert qr.decode(m) == text and len(m) in (21, 25, 29) and qr.svg(m).startswith("<svg")
    with pytest.raises(ValueError):
        qr.encode("y" * 43)


def test_qr_remainder_of_a_known_word():
    # the standard's example for version 1-M
    data = [16, 32, 12, 86, 97, 128, 236, 17, 236, 17, 236, 17, 236, 17, 236, 17]
    assert qr.correction(data, 10) == [165, 36, 212, 193, 237, 54, 199, 135, 44, 85]
    assert qr._format(0b101) == 0b100000011001110


# Images


def picture(*boxes, size=120):
    a = np.full((size, size, 4), 255, np.uint8)
    for y, x, h, w, c in boxes:
        a[y : y + h, x : x + w, :3] = c
    return a


def test_background_floods_from_the_border_only():
    a = picture((20, 20, 60, 60, RED), (40, 40, 10, 10, (255, 255, 255)))
    hidden = I.background(a, True)
    assert hidden[0, 0] and not hidden[45, 45] and not hidden[25, 25]
    a[0, 0, 3] = 0
    assert I.background(a, False).sum() == 1


def test_three_colors_become_three_regions():
    a = picture((10, 10, 40, 40, RED), (60, 20, 50, 40, BLUE), (20, 70, 70, 40, GREEN))
    labels, palette = I.quantized(a, 6)
    assert sorted(palette) == sorted([RED, BLUE, GREEN]) and labels[0, 0] == -1
    kept, left = I.regions(labels, palette, 8.0)
    assert len(kept) == 3 and not left


def test_donut_has_a_hole():
    y, x = np.mgrid[0:100, 0:100]
    r = np.hypot(x - 50, y - 50)
    a = np.zeros((100, 100, 4), np.uint8)
    a[(r < 45) & (r > 20)] = [200, 0, 0, 255]
    kept, _ = I.regions(*I.quantized(a, 2, False), 10.0)
    assert len(kept) == 1 and S.area(kept[0]["outer"]) > 0 and [S.area(h) < 0 for h in kept[0]["holes"]] == [True]


def test_bright_specks_stay_and_dull_ones_go():
    dark = picture((10, 10, 100, 100, (40, 30, 30)), (50, 50, 3, 3, (250, 250, 250)))
    assert len(I.quantized(dark, 4)[1]) == 2
    dull = picture((10, 10, 100, 100, (100, 100, 100)), (50, 50, 3, 3, (108, 104, 100)))
    assert len(I.quantized(dull, 4)[1]) == 1


def test_parts_against_flooding():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, (20, 30))
    ids, n = I.parts(a)
    seen = np.zeros_like(a)
    count = 0
    for y, x in np.ndindex(a.shape):
        if seen[y, x]:
            continue
        count += 1
        todo = [(y, x)]
        seen[y, x] = 1
        while todo:
            v, u = todo.pop()
            assert ids[v, u] == ids[y, x]
            for p, q in ((v + 1, u), (v - 1, u), (v, u + 1), (v, u - 1)):
                if 0 <= p < 20 and 0 <= q < 30 and not seen[p, q] and a[p, q] == a[y, x]:
                    seen[p, q] = 1
                    todo.append((p, q))
    assert count == n


def test_loops_cover_the_area():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.random((12, 15)) < 0.6
        assert sum(S.area(z) for z in I.loops(m)) == m.sum()


def test_closing_fills_narrow_gaps():
    a = np.full((30, 30), -1)
    a[5:25, 5:14] = 0
    a[5:25, 16:25] = 0
    out = I.closed_gaps(a, 1)
    assert (out[10:20, 14:16] == 0).all() and out[0, 0] == -1


def test_bucket():
    ring = (np.append(CIRCLE, CIRCLE[0]) * 20, 1.0)
    assert I.bucket([ring], 0j)[0] == "ok" and abs(abs(S.area(I.bucket([ring], 0j)[1][0])) - np.pi * 400) < 120
    assert I.bucket([(CIRCLE[:40] * 20, 1.0)], 0j)[0] == "open" and I.bucket([ring], 20 + 0j)[0] == "on-line"
    small_gap = (CIRCLE * np.exp(0.001j) * 7, 0.6)
    assert I.bucket([small_gap], 0j)[0] == "ok"
    _, rings = I.bucket([ring, (np.append(CIRCLE, CIRCLE[0]) * 5, 1.0)], 12 + 0j)
    assert sorted(S.area(z) > 0 for z in rings) == [False, True]


def test_photo():
    a = np.zeros((60, 80, 4), np.uint8)
    a[..., 3] = 255
    a[..., :3] = (np.arange(80) / 79 * 255).astype(np.uint8)[None, :, None]
    out = I.photo(a, 8.0, most=1500)
    assert len(out) == 3 and sum(len(z) for _, runs in out for z in runs) <= 1500
    assert [g for g, _ in out] == sorted(g for g, _ in out)


# SVG


def test_svg():
    text = '<svg xmlns="http://www.w3.org/2000/svg"><g transform="scale(2)"><rect width="40" height="20" fill="#f00"/></g><path fill-rule="evenodd" d="M100 0h30v30h-30zM110 10h10v10h-10z"/><path d="M0 60 L 80 60" fill="none" stroke="green" stroke-width="4"/><path d="M0 0h1"/><line x1="0" y1="0" x2="5" y2="5" stroke="red"/></svg>'
    r = svg.regions(text)
    assert [(x["color"], len(x["holes"])) for x in r] == [((255, 0, 0), 0), ((0, 0, 0), 1), ((0, 128, 0), 0)]
    p = np.concatenate([x["outer"] for x in r])
    assert np.ptp(p.real) == pytest.approx(1000, abs=40)
    assert svg.regions("<svg/>") == []


def test_path_commands():
    (a, closed), = svg.path("m10,10 l10 0 v10 h-10 z")
    assert a.tolist() == [10 + 10j, 20 + 10j, 20 + 20j, 10 + 20j] and closed
    assert len(svg.path("M0 0 C 0 10 10 10 10 0 S 20 -10 20 0")[0][0]) == 49
    assert len(svg.path("M0 0 Q 5 10 10 0 T 20 0")[0][0]) == 49
    (z, _), = svg.path("M0 0 A 10 10 0 0 1 20 0")
    assert abs(z[-1] - 20) < 1e-9 and np.allclose(np.abs(z[1:] - 10), 10) and z.imag.min() < -9
    assert svg.path("M0 0 L 5") == [] and len(svg.path("M0 0 1 1 2 2")[0][0]) == 3
    assert np.allclose(svg.matrix("translate(3) rotate(90) scale(2,1)") @ [1, 0, 1], [3, 2, 1])


# Plans


def test_digitized_plans():
    flower = [region(CIRCLE * 80 + 280 * np.exp(2j * np.pi * k / 5), RED) for k in range(5)] + [region(CIRCLE * 100, (240, 200, 40))] + [region(CIRCLE * 50 + complex(-300 + 300 * k, 400), GREEN) for k in range(3)]
    for regions, colors in (([region(CIRCLE * 300)], 1), ([region(CIRCLE * 320, BLUE, [(CIRCLE * 150)[::-1]]), region(CIRCLE * 90, (240, 200, 40))], 2), (flower, 3)):
        blocks = D.digitize(regions)
        assert len(blocks) == colors and D.count(blocks) > 500
        for b in blocks:
            for p, q in itertools.pairwise(b["runs"]):
                assert not (q["connection"] == "trim" and p["object_id"] == q["object_id"])
        z = np.concatenate([r["stitches"] for b in blocks for r in b["runs"]])
        assert max(np.abs(z.real).max(), np.abs(z.imag).max()) <= 500


def test_order_and_trims():
    near = [region(box(k * 220 - 220, 0, 200, 200)) for k in range(3)]
    assert sum(r["connection"] == "trim" for r in D.digitize(near)[0]["runs"][1:]) == 0
    far = [region(box(-400, 0, 100, 100)), region(box(400, 0, 100, 100))]
    for mode, n in (("auto", 1), ("never", 0), ("always", 1)):
        assert sum(r["connection"] == "trim" for r in D.digitize(far, D.Options(trim_mode=mode))[0]["runs"][1:]) == n
    blocks = D.digitize([region(box(0, 0, 50, 50), RED), region(box(0, 200, 200, 200), BLUE)])
    assert [b["thread"] for b in blocks] == [BLUE, RED]
    assert [b["thread"] for b in D.digitize([region(box(0, 0, 50, 50), RED), region(box(0, 200, 200, 200), BLUE)], D.Options(color_order=(RED,)))] == [RED, BLUE]


def test_small_objects_and_baked_ones():
    o = D.Options(min_extent=30)
    assert D.digitize([region(box(0, 0, 20, 20)), region(box(100, 0, 90, 90))], o)[0]["runs"][0]["object_id"] == 1
    assert len(D.digitize([region(box(0, 0, 20, 20), (250, 250, 250)), region(box(100, 0, 90, 90))], o)) == 2
    baked = D.digitize([region(box(0, 0, 20, 20), baked=[[(0, 0), (30, 0)]])], o)
    assert baked[0]["runs"][0]["stitch_type"] == "manual"


def test_fill_types():
    narrow, wide = box(0, 0, 300, 40), box(0, 0, 300, 300)
    kinds = lambda outer, **o: {r["stitch_type"] for b in D.digitize([region(outer)], D.Options(**o)) for r in b["runs"]}
    assert kinds(narrow, fill_type="auto") == {"satin"} and kinds(wide, fill_type="auto") == {"tatami"}
    assert kinds(narrow, fill_type="auto", underlay=("edge",)) == {"satin", "underlay"} and kinds(wide, underlay=("edge",)) == {"tatami", "underlay"}
    assert kinds(wide, fill_type="outline") == {"running"} and kinds(box(0, 0, 3, 3)) <= {"tatami"}


def test_reducing():
    regions = [region(CIRCLE * 450)]
    full = D.count(D.digitize(regions))
    plan_, steps = D.reduced(regions, limit=int(full * 0.75))
    assert D.count(plan_) <= full * 0.75 and steps[:1] == ["spacing"]
    plan_, factor = D.for_target(regions, D.Options(), int(full * 0.8))
    assert D.count(plan_) <= full * 0.8 and 1 < factor <= 2


def test_fabric_options():
    o = D.of_fabric("denim")
    assert (o.row_spacing, o.satin_spacing, o.stitch_length, o.trim_distance) == (4, 4, 32, 120) and D.of_fabric("nothing") == D.of_fabric("standard")
    assert [D.units(v) for v in (0.35, 0.38, 0.40, 0.42, 0.45, 0.15, 0.25)] == [3, 4, 4, 4, 5, 1, 3]


@pytest.mark.parametrize(("gap", "same", "mode", "want"), [(20, False, "auto", "continuous"), (30, True, "always", "jump"), (400, False, "auto", "jump"), (500, False, "auto", "trim"), (900, False, "never", "jump"), (40, False, "always", "trim")])
def test_connections(gap, same, mode, want):
    assert D.connection(0j, complex(gap), same, mode) == want
    assert D.connection(None, 0j, same) == ("jump" if same else "trim")


# Sketches


def test_sketch_round_trip_and_styles():
    doc = sketch.load('{"layers":[{"elements":[{"kind":"stroke","points":[[0,0],[10,0.12345]],"width":2,"color":[1,2,3]}]}]}')
    assert sketch.load(sketch.save(doc))["layers"][0]["elements"][0]["points"][1][1] == 0.123
    assert [sketch.stroke_style(w) for w in (0.5, 1.0, 2.0)] == ["running", "triple", "satin"]
    with pytest.raises(ValueError):
        sketch.load('{"version": 99}')


def test_sketch_order_layers_then_kinds():
    line = lambda y, c: {"kind": "stroke", "points": [[0, y], [10, y]], "width": 0.5, "color": c}
    fill = {"kind": "fill", "outer": [[0, 0], [9, 0], [9, 9]], "color": list(BLUE)}
    doc = {"layers": [{"elements": [line(0, RED), fill]}, {"elements": [line(5, RED), line(7, BLUE), line(9, RED)]}, {"hidden": True, "elements": [line(1, RED)]}]}
    assert [(e["kind"], tuple(e["color"])) for e in sketch.sewing_order(doc)] == [("fill", BLUE), ("stroke", RED), ("stroke", RED), ("stroke", RED), ("stroke", BLUE)]


def test_hidden_moves_are_sewn():
    under = lambda x: {"kind": "stroke", "points": [[x, 0], [x + 2, 0]], "width": 0.5, "color": list(RED)}
    cover = {"kind": "fill", "outer": [[-30, -5], [30, -5], [30, 5], [-30, 5]], "color": list(BLUE)}
    doc = sketch.load(sketch.save({"layers": [{"elements": [under(-20), under(15)]}, {"elements": [cover]}]}))
    assert sketch.compile_document(doc)[0]["runs"][1]["connection"] == "continuous"
    del doc["layers"][1]
    assert sketch.compile_document(doc)[0]["runs"][1]["connection"] == "trim"


def test_stitches_read_back_as_elements():
    satin = G.satin_line(np.array([0, 200 + 0j]), 30, 4)[0] / 10
    e = sketch.reconstruct(satin, RED)
    assert e[0]["style"] == "satin" and abs(e[0]["width"] - 3) < 0.3
    rows = G.tatami(box(0, 0, 200, 150), angle_deg=0)[0] / 10
    kinds = [x["kind"] for x in sketch.reconstruct(rows, RED)]
    assert "fill" in kinds
    triple = G.running(np.array([0, 100 + 0j]))[0] / 10
    z = np.concatenate([triple[:1], np.stack([triple[1:], triple[:-1], triple[1:]], 1).ravel()])
    assert sketch.reconstruct(z, RED)[0]["style"] == "triple"
    thin = {"kind": "stroke", "points": [[0, 0], [5, 0]], "width": 0.5, "style": "auto", "color": list(RED)}
    over = {"kind": "fill", "outer": [[-1, -1], [9, -1], [9, 1], [-1, 1]], "color": list(RED)}
    assert sketch.without_hidden([thin, over]) == [over] and sketch.without_hidden([over, thin]) == [over, thin]
