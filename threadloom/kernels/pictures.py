"""Picture files to pixels and back, with nothing but zlib: PNG (8 bits a channel, grey, RGB, palette, with or without alpha, not
interlaced) and binary PGM and PPM."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: The longer side that pictures are shrunk to.
MOST = 600


def _chunks(data: bytes):
    at = len(PNG)
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(raw: bytes, h: int, stride: int, size: int) -> np.ndarray:
    """Rows of bytes from filtered ones; `size` bytes are a pixel."""
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    if (rows[:, 0] == 2).all():
        return np.add.accumulate(rows[:, 1:], 0, dtype=np.uint8)
    out = np.zeros((h + 1, stride), np.uint8)
    for y in range(h):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + up
        elif kind == 1:
            # what stands left adds up along each channel
            pad = np.zeros(-(-stride // size) * size, np.uint8)
            pad[:stride] = line
            out[y + 1] = np.cumsum(pad.reshape(-1, size), 0, dtype=np.uint8).ravel()[:stride]
        elif kind in (3, 4):
            cur, above, src = bytearray(stride), up.tolist(), line.tolist()
            for x in range(stride):
                a, b, c = (cur[x - size], above[x], above[x - size]) if x >= size else (0, above[x], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                cur[x] = (src[x] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(cur), np.uint8)
        else:
            raise ValueError(f"no filter is {kind}")
    return out[1:]


def _png(data: bytes) -> np.ndarray:
    head, palette, clear, body = None, None, b"", []
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None:
        raise ValueError("a PNG file without a head")
    w, h, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlaced:
        raise ValueError(f"PNG of depth {depth}, colour type {color}, interlace {interlaced}")
    px = _unfiltered(zlib.decompress(b"".join(body)), h, w * channels, channels).reshape(h, w, channels)
    if color == 6:
        return px
    out = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette), :3] = palette
        table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return table[px[..., 0]]
    out[..., :3] = px[..., :3] if channels >= 3 else px[..., :1]
    if channels in (2, 4):
        out[..., 3] = px[..., -1]
    return out


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    n = 3 if data[:2] == b"P6" else 1
    if top != 255:
        raise ValueError(f"samples up to {top}")
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = np.frombuffer(data, np.uint8, w * h * n, at + 1).reshape(h, w, n)
    return out


def decode(data: bytes) -> np.ndarray:
    """RGBA, of the size it has."""
    if data[:8] == PNG:
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    raise ValueError("neither PNG nor PGM nor PPM")


def shrunk(rgba: np.ndarray, most: int = MOST) -> np.ndarray:
    """With a longer side of at most `most`: each pixel the mean of those that fall on it, by area."""
    h, w = rgba.shape[:2]
    scale = min(1.0, most / max(h, w))
    if scale == 1.0:
        return rgba
    for axis, n in ((0, h), (1, w)):
        m = max(1, int(np.floor(n * scale + 0.5)))
        if n % m == 0:
            # whole pixels fall on each: sums of slices, one for each pixel that falls on one
            step = n // m
            each = [rgba[(slice(None),) * axis + (slice(j, None, step),)] for j in range(step)]
            total = each[0].astype(float)
            for e in each[1:]:
                total += e
            rgba = total / step
            continue
        edges = np.arange(m + 1) * n / m
        total = np.concatenate([np.zeros_like(rgba.take([0], axis), float), np.cumsum(rgba, axis, dtype=float)], axis)
        low = np.minimum(edges.astype(int), n - 1)
        shape = [-1 if a == axis else 1 for a in range(3)]
        at = total.take(low, axis) + np.take(rgba, low, axis) * (edges - low).reshape(shape)
        rgba = np.diff(at, axis=axis) / (n / m)
    return np.clip(np.floor(rgba + 0.5), 0, 255).astype(np.uint8)


def encode_png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    # rows as differences from the one above
    up = np.concatenate([np.zeros((1, w * 4), np.uint8), rgba.reshape(h, -1)[:-1]])
    rows = np.concatenate([np.full((h, 1), 2, np.uint8), rgba.reshape(h, -1) - up], 1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
