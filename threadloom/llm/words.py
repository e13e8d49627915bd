"""Words of whole texts as NumPy arrays, many documents at a time.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Separators are ASCII,
so splitting UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: For terms without the punctuation at their edges: ASCII letters and digits, and all bytes over 127.
TERMS = np.zeros(256, bool)
TERMS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Words of more bytes are hashed one by one, so that a word of megabytes takes no more steps than a short one.
LONG = 128
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: The first k bytes of a little-endian block of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk:
    """Some documents' bytes, end to end.

    buf: uint8; offsets: int64, one more than documents; fold: A-Z to lower case; table: which bytes words are made of.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold: bool = False, table: np.ndarray = IS_WORD):
        self.buf = _FOLD[buf] if fold else buf
        self.offsets = offsets
        self.n_docs = len(offsets) - 1
        inside = table[buf]
        # a break stands between two bytes, or where a document begins
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: of each document, where its words begin in starts; one more than documents
        self.word_at = np.searchsorted(self.starts, offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def hashes(self, first: int | None = None, family: int = 0, words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A 64-bit hash of each word (or of those at `words`), or of its first bytes: blocks of eight bytes, each mixed into what came before, so no
        difference between two words cancels out as it can in a sum of powers. The two families share nothing but the words."""
        starts = self.starts[words]
        sizes = self.ends[words] - starts
        if first is not None:
            sizes = np.minimum(sizes, first)
        out = mix(sizes.astype(np.uint64) + np.uint64(_SEEDS[family]))
        if not len(sizes):
            return out
        padded = np.empty(len(self.buf) + 8, np.uint8)
        padded[:-8], padded[-8:] = self.buf, 0
        blocks = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))
        out = mix(out ^ (blocks[starts] & _FIRST[np.minimum(sizes, 8)]))
        at = np.flatnonzero((sizes > 8) & (sizes <= LONG))
        done = 8
        while len(at):
            out[at] = mix(out[at] * _ODD ^ (blocks[starts[at] + done] & _FIRST[np.minimum(sizes[at] - done, 8)]))
            done += 8
            at = at[sizes[at] > done]
        for k in np.flatnonzero(sizes > LONG).tolist():
            word = self.buf[starts[k] : starts[k] + sizes[k]]
            out[k] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8, salt=b"%d" % family).digest(), "little")
        return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two hashes as one. The factors differ by an odd multiple of two, so that two exchanged hashes give another one."""
    return mix(a * _ODD + b * np.uint64(_SEEDS[0]))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive values, across documents too: len - width + 1. Windows of 1, 2, 4, ... values
    are made of two halves each, and those that `width` is the sum of are joined."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    half, size, out, done = hashes, 1, None, 0
    while True:
        if width & size:
            out = half[:n] if out is None else _joined(out, half[done : done + n])
            done += size
        if done == width:
            return out if width > 1 else mix(out)
        half, size = _joined(half[:-size], half[size:]), 2 * size


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if off is not None and n else np.zeros(n + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buf, offsets - lo


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `size` bytes of text (one row at least): rows, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
