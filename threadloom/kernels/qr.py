"""QR symbols: bytes, error correction level M, versions 1 to 3 (42 bytes at most)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the standard: of each version, data and correction code words (one block), and where the alignment pattern is.
VERSIONS = {1: (16, 10, None), 2: (28, 16, 18), 3: (44, 26, 22)}
LEVEL_M = 0b00
FORMAT_POLY, FORMAT_MASK, FIELD_POLY = 0x537, 0x5412, 0x11D
MASKS = (
    lambda y, x: (y + x) % 2 == 0, lambda y, x: y % 2 == 0, lambda y, x: x % 3 == 0, lambda y, x: (y + x) % 3 == 0,
    lambda y, x: (y // 2 + x // 3) % 2 == 0, lambda y, x: y * x % 2 + y * x % 3 == 0, lambda y, x: (y * x % 2 + y * x % 3) % 2 == 0, lambda y, x: ((y + x) % 2 + y * x % 3) % 2 == 0,
)

_EXP = [1]
for _ in range(254):
    _EXP.append(_EXP[-1] << 1 ^ (FIELD_POLY if _EXP[-1] & 0x80 else 0))
_LOG = {v: k for k, v in enumerate(_EXP)}


def _times(a: int, b: int) -> int:
    return _EXP[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


@lru_cache
def _generator(n: int) -> tuple[int, ...]:
    """Logarithms of the coefficients of the product of (x - a^k), k < n, after the first; none of them is 0."""
    g = [1]
    for k in range(n):
        g = [p ^ _times(q, _EXP[k]) for p, q in zip([*g, 0], [0, *g], strict=True)]
    return tuple(_LOG[c] for c in g[1:])


def correction(data: list[int], n: int) -> list[int]:
    """The remainder of the data, times x^n, by the product of (x - a^k)."""
    rest, logs = [*data, *[0] * n], _generator(n)
    for k in range(len(data)):
        if rest[k]:
            lead = _LOG[rest[k]]
            for j, c in enumerate(logs, k + 1):
                rest[j] ^= _EXP[(c + lead) % 255]
    return rest[-n:]


def _frame(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Modules that don't depend on data, and where they are."""
    n = 17 + 4 * version
    m, fixed = np.zeros((n, n), bool), np.zeros((n, n), bool)
    eye = np.ones((7, 7), bool)
    eye[1:6, 1:6], eye[2:5, 2:5] = False, True
    for y, x in ((0, 0), (0, n - 7), (n - 7, 0)):
        m[y : y + 7, x : x + 7] = eye
        fixed[max(0, y - 1) : y + 8, max(0, x - 1) : x + 8] = True
    line = np.arange(8, n - 8)
    m[6, line] = m[line, 6] = line % 2 == 0
    fixed[6, :] = fixed[:, 6] = True
    at = VERSIONS[version][2]
    if at:
        m[at - 2 : at + 3, at - 2 : at + 3] = eye[1:6, 1:6] | np.pad(np.zeros((3, 3), bool), 1, constant_values=True)
        m[at - 1 : at + 2, at - 1 : at + 2] = False
        m[at, at] = True
        fixed[at - 2 : at + 3, at - 2 : at + 3] = True
    fixed[:9, 8] = fixed[8, :9] = fixed[8, n - 8 :] = fixed[n - 8 :, 8] = True
    m[n - 8, 8] = True
    return m, fixed


def _format_places(n: int):
    a = [(8, k) for k in (0, 1, 2, 3, 4, 5, 7, 8)] + [(k, 8) for k in (7, 5, 4, 3, 2, 1, 0)]
    b = [(n - 1 - k, 8) for k in range(7)] + [(8, n - 8 + k) for k in range(8)]
    return a, b


def _format(mask: int) -> int:
    v = (LEVEL_M << 3 | mask) << 10
    rest = v
    for k in range(14, 9, -1):
        if rest >> k & 1:
            rest ^= FORMAT_POLY << (k - 10)
    return (v | rest) ^ FORMAT_MASK


def _data_places(fixed: np.ndarray):
    n = len(fixed)
    columns = [x for x in range(n - 1, 0, -2) if x > 6] + [x for x in (5, 3, 1)]
    for k, x in enumerate(columns):
        for y in range(n - 1, -1, -1) if k % 2 == 0 else range(n):
            for c in (x, x - 1):
                if not fixed[y, c]:
                    yield y, c


@lru_cache
def _layout(version: int):
    """Where data goes, what each mask has there, and a frame for each mask with its format word; they depend on the version alone."""
    frame, fixed = _frame(version)
    ys, xs = (np.array(v) for v in zip(*_data_places(fixed), strict=True))
    masks = np.array([[bool(rule(y, x)) for y, x in zip(ys.tolist(), xs.tolist(), strict=True)] for rule in MASKS])
    frames = np.repeat(frame[None], len(MASKS), 0)
    for k in range(len(MASKS)):
        word = _format(k)
        for where in _format_places(len(frame)):
            for j, (y, x) in enumerate(where):
                frames[k, y, x] = word >> (14 - j) & 1
    return ys, xs, masks, frames


def penalties(m: np.ndarray) -> np.ndarray:
    """Of symbols of one size (an array of them): stretches of five and more alike, patterns like an eye's, squares of four alike, and too
    much of one colour."""
    n = m.shape[1]
    lines = np.concatenate([m, m.transpose(0, 2, 1)], 1)
    change = lines[..., 1:] != lines[..., :-1]
    # a stretch of n >= 5 has n - 4 windows of five, one of them at its beginning
    five = ~(change[..., :-3] | change[..., 1:-2] | change[..., 2:-1] | change[..., 3:])
    begins = five.copy()
    begins[..., 1:] &= change[..., : five.shape[2] - 1]
    total = five.sum((1, 2)) + 2 * begins.sum((1, 2))
    codes = np.zeros((*lines.shape[:2], n - 10), int)
    for j in range(11):
        codes = codes << 1 | lines[..., j : j + n - 10]
    total += 40 * ((codes == 0b10111010000) | (codes == 0b00001011101)).sum((1, 2))
    same = (m[:, 1:, 1:] == m[:, :-1, :-1]) & (m[:, 1:, :-1] == m[:, :-1, 1:]) & (m[:, 1:, 1:] == m[:, 1:, :-1])
    return total + 3 * same.sum((1, 2)) + 10 * (np.abs(m.mean((1, 2)) * 100 - 50) // 5).astype(int)


def penalty(m: np.ndarray) -> int:
    return int(penalties(m[None])[0])


def encode(text: str) -> np.ndarray:
    """Modules, True for dark; the mask with the least penalty, the first of equals."""
    data = text.encode()
    version = next((v for v, (n, *_) in VERSIONS.items() if len(data) + 2 <= n), None)
    if version is None:
        raise ValueError("at most 42 bytes")
    words, n_check, _ = VERSIONS[version]
    # the mode 0100, the length, the bytes and the mode 0000, four bits aside from whole bytes
    halves = [4, len(data) >> 4, len(data) & 15, *(h for b in data for h in (b >> 4, b & 15)), 0]
    code = [halves[k] << 4 | halves[k + 1] for k in range(0, len(halves), 2)]
    code += [(0xEC, 0x11)[k % 2] for k in range(words - len(code))]
    ys, xs, masks, frames = _layout(version)
    bits = np.zeros(len(ys), bool)
    stream = np.unpackbits(np.array(code + correction(code, n_check), np.uint8)).astype(bool)
    bits[: len(stream)] = stream
    made = frames.copy()
    made[:, ys, xs] = bits ^ masks
    return made[int(penalties(made).argmin())]


def decode(m: np.ndarray) -> str:
    """The text of undamaged modules."""
    version = (len(m) - 17) // 4
    ys, xs, masks, _ = _layout(version)
    word = 0
    for y, x in _format_places(len(m))[0]:
        word = word << 1 | int(m[y, x])
    words, n_check, _ = VERSIONS[version]
    bits = m[ys, xs] ^ masks[(word ^ FORMAT_MASK) >> 10 & 7]
    code = np.packbits(bits[: (words + n_check) * 8]).tolist()
    if correction(code[:words], n_check) != code[words:]:
        raise ValueError("the symbol is damaged")
    n = (code[0] & 15) << 4 | code[1] >> 4
    return bytes((code[1 + k] & 15) << 4 | code[2 + k] >> 4 for k in range(n)).decode()


def svg(m: np.ndarray, pixel: int = 4, margin: int = 4) -> str:
    n = (len(m) + 2 * margin) * pixel
    cells = "".join(f"M{(x + margin) * pixel},{(y + margin) * pixel}h{pixel}v{pixel}h-{pixel}z" for y, x in np.argwhere(m))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{n}" height="{n}"><rect width="{n}" height="{n}" fill="#fff"/><path d="{cells}"/></svg>'
