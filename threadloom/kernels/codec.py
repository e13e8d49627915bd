"""Machine files: DST and PES bytes from plans, and back. A plan is {"name", "blocks": [{"thread": {r, g, b, ...}, "runs": [{"stitches":
[(x, y)], "connection", ...}]}]}; an op is (kind, x, y)."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

from threadloom.functions.dims import PALETTE
from threadloom.model import LOCK_LENGTH, MAX_STITCH, MIN_STITCH
from threadloom.operators.machine import DST_KIND, DST_X, DST_Y


def _half_up(v: float) -> int:
    return int(np.floor(v + 0.5))


def split(a, b, most: int = MAX_STITCH) -> list[tuple[int, int]]:
    dx, dy = b[0] - a[0], b[1] - a[1]
    # most moves are short ones between whole points
    if type(dx) is int and type(dy) is int and -most <= dx <= most and -most <= dy <= most:
        return [(a[0] + dx, a[1] + dy)]
    n = max(1, -(-max(abs(dx), abs(dy)) // most))
    return [(a[0] + _half_up(dx * k / n), a[1] + _half_up(dy * k / n)) for k in range(1, n + 1)]


def lock(at, towards) -> list[tuple]:
    if at is None or towards is None:
        return []
    d = float(np.hypot(towards[0] - at[0], towards[1] - at[1]))
    n = min(LOCK_LENGTH, d)
    if n < MIN_STITCH:
        return []
    out = tuple(_half_up(at[k] + (towards[k] - at[k]) / d * n) for k in (0, 1))
    return [("stitch", *out), ("stitch", *at)]


def operations(plan: dict, locks: bool = True) -> list[tuple]:
    """Stitches, jumps, trims and colour changes of a plan, with locks where a thread begins or ends; the same as
    operators.machine.operations makes of tables."""
    ops: list[tuple] = []
    last, before = None, None  # where the needle is, and where it came from
    tie = lock if locks else (lambda *_: [])
    for block in plan["blocks"]:
        full = [r for r in block["runs"] if len(r["stitches"])]
        for k, run in enumerate(full):
            points = [(int(x), int(y)) for x, y in run["stitches"]]
            how = run["connection"] if k else "jump"
            fresh = k == 0 or how == "trim"
            if k == 0 and last is not None:
                ops += [*tie(last, before), ("colorChange", None, None)]
            if last is None:
                ops += [("jump", *p) for p in split((0, 0), points[0])]
            elif last != points[0]:
                if how == "trim":
                    ops += [*tie(last, before), ("trim", None, None)]
                ops += [("stitch" if how == "continuous" else "jump", *p) for p in split(last, points[0])]
            before, last = last, points[0]
            ops.append(("stitch", *last))
            if fresh:
                ops += tie(last, next((p for p in points if p != last), None))
            for p in points[1:]:
                if p != last:
                    ops += [("stitch", *q) for q in split(last, p)]
                    before, last = last, p
    return [*ops, *tie(last, before), ("end", None, None)]


# DST


def dst_record(dx: int, dy: int, kind: str = "stitch") -> bytes:
    if max(abs(dx), abs(dy)) > 121:
        raise ValueError(f"a DST move is at most 121 each way: {dx}, {dy}")
    out = [0, 0, DST_KIND[kind]]
    for value, bits in ((dx, DST_X), (dy, DST_Y)):
        for k, (byte, plus, minus) in enumerate(bits):
            digit = (value + 121) // 3**k % 3
            out[byte] |= (minus, 0, plus)[digit]
    return bytes(out)


def dst_move(b: bytes) -> tuple[int, int, str]:
    total = [sum((bool(b[byte] & plus) - bool(b[byte] & minus)) * 3**k for k, (byte, plus, minus) in enumerate(bits)) for bits in (DST_X, DST_Y)]
    return total[0], total[1], "colorChange" if b[2] & 0xC0 == 0xC0 else "jump" if b[2] & 0x80 else "stitch"


def dst_moves(ops: list[tuple]) -> list[tuple[int, int, str]]:
    out, x, y = [], 0, 0
    for kind, a, b in ops:
        if kind in ("stitch", "jump"):
            out.append((a - x, y - b, kind))
            x, y = a, b
        elif kind == "trim":
            out += [(2, 2, "jump"), (-4, -4, "jump"), (2, 2, "jump")]
        elif kind == "colorChange":
            out.append((0, 0, "colorChange"))
    return out


def label(name: str) -> str:
    return re.sub(r"[^\x20-\x7e]", "_", name)[:16].ljust(16)


def write_dst(plan: dict) -> bytes:
    moves = dst_moves(operations(plan))
    at = np.cumsum([(0, 0), *((dx, dy) for dx, dy, _ in moves)], 0)
    hi, lo, end = at.max(0), at.min(0), at[-1]
    sign = lambda v: ("-" if v < 0 else "+") + f"{abs(v):5d}"
    fields = [
        ("LA:", label(plan["name"])), ("ST:", f"{len(moves):7d}"), ("CO:", f"{sum(k == 'colorChange' for *_, k in moves):3d}"), ("+X:", f"{hi[0]:5d}"), ("-X:", f"{-lo[0]:5d}"), ("+Y:", f"{hi[1]:5d}"), ("-Y:", f"{-lo[1]:5d}"),
        ("AX:", sign(end[0])), ("AY:", sign(end[1])), ("MX:", sign(0)), ("MY:", sign(0)), ("PD:", "******"),
    ]
    head = b"".join((k + v).encode() + b"\r" for k, v in fields) + b"\x1a"
    return head.ljust(512, b" ") + b"".join(dst_record(*m) for m in moves) + b"\x00\x00\xf3"


def read_dst(data: bytes) -> dict:
    head = data[:512].decode("ascii", "replace")
    field = lambda k, default: (m := re.search(k + r":\s*([^\r]*)\r", head)) and m[1].strip() or default
    records = []
    for k in range(512, len(data) - 2, 3):
        if data[k + 2] == 0xF3:
            break
        records.append(dst_move(data[k : k + 3]))
    return {"label": field("LA", ""), "stitches": int(field("ST", -1)), "color_changes": int(field("CO", -1)), "records": records}


def dst_points(records) -> list[tuple[int, int]]:
    out, x, y = [], 0, 0
    for dx, dy, kind in records:
        x, y = x + dx, y + dy
        if kind == "stitch":
            out.append((x, -y))
    return out


# PES and PEC


def nearest_thread(color: dict) -> int:
    """The PEC number of the palette colour nearest to one."""
    return _nearest_thread(color["r"], color["g"], color["b"])


@lru_cache(4096)
def _nearest_thread(r: int, g: int, b: int) -> int:
    return min(PALETTE, key=lambda p: ((r - p[1]) ** 2 + (g - p[2]) ** 2 + (b - p[3]) ** 2, p[0]))[0]


JUMP, TRIM = 0x10, 0x20


def _long(v: int, flag: int) -> bytes:
    return struct.pack(">H", v & 0xFFF | 0x8000 | flag << 8)


def pec_stitches(ops: list[tuple]) -> bytes:
    """Short moves in two bytes, others in four; a trim marks the jump after it, a landed jump is anchored, colours alternate."""
    out, x, y, landed, cut, second = bytearray(), 0, 0, False, False, True
    for kind, a, b in ops:
        if kind in ("stitch", "jump"):
            dx, dy = a - x, b - y
            x, y = a, b
        if kind in ("stitch", "colorChange") and landed:
            out += b"\x00\x00"
            landed = False
        if kind == "stitch":
            out += bytes([dx & 0x7F, dy & 0x7F]) if -64 <= dx <= 63 and -64 <= dy <= 63 else _long(dx, 0) + _long(dy, 0)
        elif kind == "jump":
            flag = TRIM if cut else JUMP
            out += _long(dx, flag) + _long(dy, flag)
            landed, cut = True, False
        elif kind == "trim":
            cut = True
        elif kind == "colorChange":
            out += bytes([0xFE, 0xB0, 2 if second else 1])
            cut, second = False, not second
        else:
            out.append(0xFF)
    return bytes(out)


def _all_points(plan: dict, block: int | None = None) -> np.ndarray:
    return np.array([p for k, b in enumerate(plan["blocks"]) if block in (None, k) for r in b["runs"] for p in r["stitches"]], int).reshape(-1, 2)


def thumbnail(plan: dict, block: int | None = None) -> bytes:
    """48 by 38 pixels, one bit each, the lowest bit leftmost: where the needle goes in."""
    return _drawn(_all_points(plan), _all_points(plan, block))


def _drawn(every: np.ndarray, own: np.ndarray) -> bytes:
    image = np.zeros((38, 48), np.uint8)
    if len(own):
        lo = every.min(0)
        size = np.maximum(1, every.max(0) - lo)
        scale = min(44 / size[0], 34 / size[1])
        at = np.floor((own - lo) * scale + (np.array([48, 38]) - size * scale) / 2 + 0.5).astype(int)
        ok = ((at >= 0) & (at < [48, 38])).all(1)
        image[at[ok, 1], at[ok, 0]] = 1
    return np.packbits(image, axis=1, bitorder="little").tobytes()


def write_pec(plan: dict) -> bytes:
    threads = [nearest_thread(b["thread"]) for b in plan["blocks"]]
    head = b"LA:" + label(plan["name"]).encode() + b"\r" + b" " * 12 + bytes([0xFF, 0, 6, 38]) + b" " * 12 + bytes([(len(threads) - 1) & 0xFF, *threads])
    points = _all_points(plan)
    lo, hi = (points.min(0), points.max(0)) if len(points) else (np.zeros(2, int), np.zeros(2, int))
    body = pec_stitches(operations(plan))
    size = (hi - lo).tolist()
    section = b"\x31\xff\xf0" + struct.pack("<HHHH", *size, 0x1E0, 0x1B0) + struct.pack(">HH", *(0x9000 | (-int(v) & 0xFFF) for v in lo)) + body
    section = b"\x00\x00" + struct.pack("<I", len(section) + 5)[:3] + section
    # a plan of one block looks like its block
    whole = _drawn(points, points)
    return head.ljust(512, b" ") + section + whole + (whole if len(threads) == 1 else b"".join(_drawn(points, _all_points(plan, k)) for k in range(len(threads))))


def write_pes(plan: dict, extra: bytes = b"") -> bytes:
    return b"#PES0001" + struct.pack("<IHHHHH", 22 + len(extra), 1, 0, 0, 0xFFFF, 0) + extra + write_pec(plan)


def read_pes(data: bytes) -> dict:
    """Label, palette numbers and moves of the PEC part; whatever the version, byte 8 on says where it lies."""
    if data[:4] != b"#PES":
        raise ValueError("not a PES file")
    at = struct.unpack_from("<I", data, 8)[0]
    if data[at : at + 3] != b"LA:":
        raise ValueError(f"no PEC part at {at}")
    n = data[at + 48] + 1
    out = {"label": data[at + 3 : at + 19].decode("ascii", "replace").rstrip(), "palette": list(data[at + 49 : at + 49 + n]), "ops": [], "pec_offset": at}
    k = at + 512 + 20

    def value(k):
        if data[k] & 0x80:
            v = (data[k] & 0x0F) << 8 | data[k + 1]
            return k + 2, v - 4096 if v > 2047 else v, data[k] & 0x30
        v = data[k] & 0x7F
        return k + 1, v - 128 if v > 63 else v, 0

    while k < len(data) and data[k] != 0xFF:
        if data[k : k + 2] == b"\xfe\xb0":
            out["ops"].append(("colorChange", 0, 0))
            k += 3
            continue
        k, dx, fx = value(k)
        k, dy, fy = value(k)
        out["ops"].append(("trim" if (fx | fy) & TRIM else "jump" if (fx | fy) & JUMP else "stitch", dx, dy))
    return out


def pes_points(ops) -> list[tuple[int, int]]:
    out, x, y = [], 0, 0
    for kind, dx, dy in ops:
        x, y = x + dx, y + dy
        if kind == "stitch":
            out.append((x, y))
    return out


def runs_of(ops) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(colour, connection, points) of decoded ops: cut at jumps, trims and colour changes; repeated points once."""
    out: list[tuple[int, str, list]] = []
    x = y = color = 0
    how, points = "trim", []
    for kind, dx, dy in [*ops, ("end", 0, 0)]:
        x, y = x + dx, y + dy
        if kind == "stitch":
            if not points or points[-1] != (x, y):
                points.append((x, y))
            continue
        if len(points) > 1:
            out.append((color, how, points))
            how = kind if kind in ("jump", "trim") else "trim"
        elif kind == "trim":
            how = "trim"
        points = []
        color += kind == "colorChange"
    return out


MAGIC = b"TLDOC1\x00\x00"


def with_document(document: str) -> bytes:
    """A document to put between a PES file's head and its PEC part."""
    data = document.encode()
    return MAGIC + struct.pack("<I", len(data)) + data


def embedded_document(data: bytes) -> str | None:
    if data[:4] != b"#PES" or len(data) < 12:
        return None
    at = data.find(MAGIC, 0, struct.unpack_from("<I", data, 8)[0])
    if at < 0:
        return None
    n = struct.unpack_from("<I", data, at + len(MAGIC))[0]
    return data[at + len(MAGIC) + 4 : at + len(MAGIC) + 4 + n].decode()


def svg_preview(plan: dict, size: int = 400, travel: bool = True) -> str:
    """Runs as lines in their colours, moves between them dashed."""
    points = _all_points(plan)
    lo, hi = (points.min(0) - 20, points.max(0) + 20) if len(points) else (np.array([-500, -500]), np.array([500, 500]))
    w, h = (hi - lo).tolist()
    parts, last = [], None
    for b in plan["blocks"]:
        c = "#{r:02x}{g:02x}{b:02x}".format(**{k: b["thread"][k] for k in "rgb"})
        for r in b["runs"]:
            if not len(r["stitches"]):
                continue
            if travel and last is not None:
                (x0, y0), (x1, y1) = last, r["stitches"][0]
                parts.append(f'<line x1="{x0}" y1="{y0}" x2="{x1}" y2="{y1}" stroke="#999" stroke-width="2" stroke-dasharray="8 8"/>')
            parts.append(f'<polyline fill="none" stroke="{c}" stroke-width="3" points="{" ".join(f"{x},{y}" for x, y in r["stitches"])}"/>')
            last = r["stitches"][-1]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{max(1, round(size * h / max(1, w)))}" viewBox="{lo[0]} {lo[1]} {w} {h}">{"".join(parts)}</svg>'
