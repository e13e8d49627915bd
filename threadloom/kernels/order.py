"""Orders: tours of objects, and continuous runs through branching lines."""

from __future__ import annotations

import numpy as np


def tour(points: np.ndarray, start: complex | None = None, sweeps: int = 50) -> list[int]:
    """Nearest first, then stretches are turned round as long as that shortens the open path: for each beginning the stretch that gains
    most, where one could also take the first that gains, which ends in other tours of much the same length.  Points in one place are
    visited one after the other, in their order, so places are all that is compared."""
    if len(points) < 2:
        return list(range(len(points)))
    points = np.asarray(points, complex)
    _, first, of = np.unique(points, return_index=True, return_inverse=True)
    # places in the order of their first points
    by_first = np.argsort(first)
    rank = np.empty(len(first), int)
    rank[by_first] = np.arange(len(first))
    of = rank[of.ravel()]
    members = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of))
    tour_of_places = _tour(points[first[by_first]], start, sweeps)
    return np.concatenate([members[(ends[k - 1] if k else 0) : ends[k]] for k in tour_of_places]).tolist()


def _tour(points: np.ndarray, start: complex | None, sweeps: int) -> np.ndarray:
    n = len(points)
    order, here, left = [], start, np.arange(n)
    if here is None:
        order.append(0)
        here, left = points[0], left[1:]
    while len(left):
        j = int(np.abs(points[left] - here).argmin())
        order.append(int(left[j]))
        here = points[left[j]]
        left = np.delete(left, j)
    order = np.array(order)
    for _ in range(sweeps):
        better = False
        for i in range(n - 1):
            # all stretches that begin at i, at once
            z = points[order]
            before = start if i == 0 else z[i - 1]
            after = np.append(z[i + 2 :], np.nan)
            tail = lambda a: np.where(np.isnan(after), 0, np.abs(after - a))  # noqa: E731, B023
            head = 0 if before is None else np.abs(z[i + 1 :] - before) - abs(z[i] - before)
            gain = head + tail(z[i]) - tail(z[i + 1 :])
            j = int(np.argmin(gain))
            if gain[j] < -1e-9:
                order[i : i + j + 2] = order[i : i + j + 2][::-1].copy()
                better = True
        if not better:
            break
    return order


def cost(points: np.ndarray, order: list[int], start: complex | None = None) -> float:
    z = points[order]
    return float(np.abs(np.diff(np.concatenate([[start], z]) if start is not None else z)).sum())


def branch_runs(paths: list[np.ndarray], join: float = 5.0) -> list[np.ndarray]:
    """Lines that share ends (within `join`) as one run for each connected part: a walk that goes down every line, deepest first, and
    comes back over lines it has sewn where it must."""
    nodes: list[complex] = []
    # nodes by cells as wide as they reach, so that an end is compared with those around it only
    cells: dict[tuple[int, int], list[int]] = {}
    side = max(join, 1e-9)

    def node(p: complex) -> int:
        x, y = int(p.real // side), int(p.imag // side)
        near = [k for u in (x - 1, x, x + 1) for v in (y - 1, y, y + 1) for k in cells.get((u, v), ()) if abs(p - nodes[k]) <= join]
        if near:
            return min(near)
        nodes.append(complex(p))
        cells.setdefault((x, y), []).append(len(nodes) - 1)
        return len(nodes) - 1

    ends = [(node(p[0]), node(p[-1])) for p in paths]
    at: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(k)
        at.setdefault(b, []).append(k)
    used, runs = set(), []
    while len(used) < len(paths):
        free = [n for n in at if any(k not in used for k in at[n])]
        # a loose end if there is one
        root = min(free, key=lambda n: (len([k for k in at[n] if k not in used]) != 1, n))
        out, trail, here = [], [], root
        while True:
            nxt = [k for k in at[here] if k not in used]
            if nxt:
                # dead ends first, so that the walk can end where it is longest
                k = min(nxt, key=lambda k: (len([e for e in at[ends[k][1] if ends[k][0] == here else ends[k][0]] if e not in used]) - 1, len(paths[k])))
                used.add(k)
                forth = ends[k][0] == here
                out.append(paths[k] if forth else paths[k][::-1])
                trail.append((k, here))
                here = ends[k][1] if forth else ends[k][0]
            elif trail and any(e not in used for _, n in trail for e in at[n]):
                k, back = trail.pop()
                out.append(paths[k][::-1] if ends[k][0] == back else paths[k])
                here = back
            else:
                break
        z = np.concatenate(out)
        runs.append(z[np.concatenate([[True], np.abs(np.diff(z)) > 1e-9])])
    return runs
