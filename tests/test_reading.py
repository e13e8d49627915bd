"""What runs look like, against the arrays' kernels."""

import numpy as np
import pytest

from threadloom.operators import reading
from threadloom.plans import sketch


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(12)
    out = [np.array([0]), np.array([0, 50, 100]), np.array([0, 0, 0])]
    # columns with lines at both ends, lines, wide fills, and anything
    for width in (4, 8, 30):
        out.append(np.concatenate([np.arange(0, 100, 20), 100 + np.arange(14) * 3 + 1j * np.where(np.arange(14) % 2, width, 0), np.arange(150, 300, 25)]))
    out.append(np.concatenate([np.arange(0, 200, 30) + 1j * 4 * k if k % 2 else np.arange(0, 200, 30)[::-1] + 1j * 4 * k for k in range(9)]))
    out += [np.cumsum(rng.integers(-30, 31, 25) + 1j * rng.integers(-30, 31, 25)) for _ in range(20)]
    return [np.asarray(z, complex) for z in out]


@pytest.fixture(scope="module")
def stitches(spark, runs):
    return spark.createDataFrame([(0, 0, k, i, int(p.real), int(p.imag)) for k, z in enumerate(runs) for i, p in enumerate(z)], "design_id long, block_idx long, run_idx long, seq long, x int, y int")


def test_turns(stitches, runs):
    got = {}
    for r in reading.turns(stitches).orderBy("run_idx", "seq").collect():
        got.setdefault(r.run_idx, []).append(r.turn)
    for k, z in enumerate(runs):
        assert got[k] == sketch.turn_labels(z / 10).tolist(), k


def test_columns(stitches, runs):
    got = {}
    for r in reading.columns(stitches).orderBy("run_idx", "first").collect():
        got.setdefault(r.run_idx, []).append((r.first, r.last))
    found = 0
    for k, z in enumerate(runs):
        mark, gap = sketch.turn_labels(z / 10), np.abs(np.diff(z)) / 10
        zig = np.zeros(len(z), bool)
        zig[1:-1] = np.isin(mark[1:-1], ["Z", "R"]) & (gap[1:] >= 0.6) & (gap[:-1] >= 0.6)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], zig.astype(int), [0]])))
        expected = [(a - 1, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 5]
        assert got.get(k, []) == expected, k
        found += len(expected)
    assert found >= 2


def test_lines_and_fills(stitches, runs):
    got = {r.run_idx: r for r in reading.looks(stitches).collect()}
    assert {r.is_line for r in got.values()} == {r.is_fill for r in got.values()} == {True, False}
    for k, z in enumerate(runs):
        assert got[k].is_fill == sketch.looks_like_fill(z / 10), k
        assert got[k].points == len(z) and abs(got[k].length / 1000 - np.abs(np.diff(z)).sum()) < 0.1
