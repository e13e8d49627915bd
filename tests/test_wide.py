"""Windows in stretches against windows by design, and plans as documents by hand."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import machine, nested, plan, wide

STITCHES = "design_id long, block_idx long, run_idx long, seq long, x int, y int"


@pytest.fixture(scope="module")
def stitches(spark):
    """One design of 6,000 stitches in runs of 1 to 900, and some small ones."""
    rng = random.Random(3)
    rows = []
    for design in (0, *range(10, 16)):
        left, block = 6000 if design == 0 else rng.randint(1, 20), 0
        while left > 0:
            for run in range(rng.randint(1, 4)):
                n = min(left, rng.choice([1, 2, 40, 900]))
                x, y = rng.randint(-400, 400), rng.randint(-400, 400)
                for seq in range(n):
                    rows.append((design, block, run, seq, x, y))
                    x, y = x + rng.choice([0, 0, 30, -140, 200]), y + rng.choice([0, 0, 25, -25])
                left -= n
                if left <= 0:
                    break
            block += 1
    return spark.createDataFrame(rows, STITCHES).repartition(3).withColumn("thread", F.concat(F.lit("t"), "block_idx"))


def same(a, b):
    rows = lambda df: sorted(df.select(*sorted(df.columns)).collect(), key=repr)
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_one_design_is_many_stretches(spark, stitches):
    d = wide.dealt(stitches, ["design_id"], wide.ORDER, 12)
    n = {r._part: r["count"] for r in d.groupBy("design_id", "_part").count().where("design_id = 0").collect()}
    assert len(n) >= 10 and max(n.values()) <= 2 * 6000 / 12


@pytest.mark.parametrize("locks", [True, False])
def test_operations(spark, stitches, locks):
    same(wide.operations(stitches, locks), machine.operations(stitches, locks))


def test_runs_sequence_and_moves(spark, stitches):
    same(wide.runs(stitches), plan.runs(stitches))
    same(plan.sequence(stitches, wide.runs(stitches)), plan.sequence(stitches))
    same(wide.flat_moves(stitches), plan.flat_moves(stitches))


def test_points(spark, stitches):
    moves = machine.dst_moves(machine.operations(stitches))
    same(wide.dst_points(moves), machine.dst_points(moves))


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_all_that_is_carried(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, 1, 1, 1, 2]), k, rng.choice([None, None, None, k])) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = wide.scanned(wide.dealt(df, ["k"], ["o"], parts), ["k"], ["o"], sums={"total": "v"}, before={"b": "v", "bo": "o"}, after={"a": "v", "ao": "o"}, latest={"seen": "v"})
    expected = []
    for key in (None, 1, 2):
        own = [r for r in rows if r[0] == key]
        for i, (_, o, v) in enumerate(own):
            values = [x for *_, x in own[:i] if x is not None]
            b, a = own[i - 1] if i else (None,) * 3, own[i + 1] if i + 1 < len(own) else (None,) * 3
            expected.append((key, o, v, sum(values) + (v or 0), b[2], b[1], a[2], a[1], values[-1] if values else None))
    assert sorted(map(repr, map(tuple, got.drop("_part").collect()))) == sorted(map(repr, expected))


def test_nothing_and_one_row(spark, stitches):
    assert wide.operations(stitches.where("false")).count() == 0
    one = stitches.where("design_id = 0").limit(1)
    same(wide.operations(one), machine.operations(one))


PLANS = "design_id long, blocks array<struct<thread:string,runs:array<struct<connection:string,stitches:array<struct<x:int,y:int>>>>>>"


def run(connection, *points):
    return (connection, list(points))


def by_loops(blocks):
    """The figures as loops over a document give them."""
    out = dict.fromkeys(("stitches", "trims_marked", "trims_sewn", "trims_in_order", "jumps", "travels"), 0)
    end, total, last, sewn = None, 0, None, set()
    for b, (_, runs) in enumerate(blocks):
        for i, (connection, points) in enumerate(runs):
            out["trims_marked"] += i > 0 and connection == "trim"
            if not points:
                continue
            out["stitches"] += len(points)
            sewn.add(b)
            starts = i == 0 or last != b
            out["trims_in_order"] += b > 0 if starts else connection == "trim"
            if end is not None:
                d = ((points[0][0] - end[0]) ** 2 + (points[0][1] - end[1]) ** 2) ** 0.5
                goes = d > 0 if i == 0 else connection in ("trim", "jump")
                out["trims_sewn"] += i > 0 and connection == "trim"
                out["jumps"] += i > 0 and connection == "jump"
                out["travels"] += goes
                total += int(d * 1000 + 0.5) if goes else 0
            end, last = points[-1], b
    return out | {"travel_total": total, "color_changes": max(0, len(blocks) - 1), "colors_sewn_changes": max(0, len(sewn) - 1), "palette": len(blocks)}


def test_counts_with_empty_runs_and_blocks(spark):
    rng = random.Random(9)
    plans = [(0, []), (1, [("red", [])]), (2, [("red", []), ("blue", [run("jump", (0, 0))])]), (3, [("red", [run("trim"), run("trim", (0, 0), (5, 5)), run("trim"), run("trim", (90, 0))])]), (4, [("red", [run("jump", (0, 0))]), ("blue", []), ("green", [run("jump", (0, 0)), run("jump")])])]
    for k in range(5, 60):
        plans.append((k, [("t", [run(rng.choice(["trim", "jump", "continuous"]), *((rng.randint(-9, 9), rng.randint(-9, 9)) for _ in range(rng.randint(0, 2)))) for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(0, 4))]))
    df = spark.createDataFrame(plans, PLANS)
    for r in nested.counts(df).collect():
        assert r.asDict() == by_loops(dict(plans)[r.design_id]) | {"design_id": r.design_id}
    # rows and back: nothing that was empty is lost
    rows = nested.rows(df).collect()
    for k, blocks in plans:
        own = [r for r in rows if r.design_id == k]
        assert len(own) == sum(max(1, sum(max(1, len(points)) for _, points in runs)) for _, runs in blocks)
        assert {(r.block_idx, r.run_idx) for r in own if r.seq is None} == {(b, None) for b, (_, runs) in enumerate(blocks) if not runs} | {(b, i) for b, (_, runs) in enumerate(blocks) for i, (_, points) in enumerate(runs) if not points}


def test_gaps_are_measured_to_the_run_next_before(spark):
    far, near = (600, 0), (0, 0)
    plans = [(0, [("t", [run("jump", near), run("jump", far), run("continuous", near)])]), (1, [("t", [run("jump", near), run("jump"), run("jump", far)])]), (2, [("t", [run("jump", near)]), ("u", [run("jump", far)])]), (3, [])]
    got = {r.design_id: (r.continuous_too_far, r.long_jumps) for r in nested.gaps(spark.createDataFrame(plans, PLANS)).collect()}
    assert got == {0: (1, 1), 1: (0, 0), 2: (0, 0), 3: (0, 0)}
