"""Substring deduplication by fixed-block anchors.

A window of WINDOW consecutive words of one document is removed where the same words also start in a document with a smaller
doc_id.  Any window of 2B - 1 words or more holds a whole block of B words that begins at a multiple of B in its document,
so with B = WINDOW / 2 a repeat can't pass the blocks by:

1. Index and probe.  Each document's non-overlapping blocks are indexed, and every rolling window of B words of every
   document is looked up in the index.  A block of which the words are found again anywhere is an anchor.
2. Extend.  Only windows of WINDOW words whose own blocks are anchors can be repeats.  For each such text the smallest doc_id
   is found; runs of windows that some smaller document has are the maximal repeats, and their words go.

Documents are packed into chunks of about CHUNK bytes (a longer document is one), written once to the shared folder.  A chunk sends each
distinct hash once, several chunks' hashes for one part of their range in one message, and gets back a bit, or a smaller doc_id, for those
that are found elsewhere; texts that a third of all documents share thus cost a hash a chunk, and no pair of documents is ever formed.  Anchors are proposed by short hashes, which only let
too much through; the windows that decide are compared by two hashes, of two independent hashes of their words, that together
have twice as many bits as would tell all windows apart, and 16 more.

Cases: null and empty texts have no words, and no kept words; texts under WINDOW words stay whole; a text longer than CHUNK is a
chunk by itself and is hashed whole; a null doc_id counts as larger than all others; rows that share a doc_id (repeated rows,
ties) don't remove each other's words; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions, small_batches, stored
from .words import Chunk, slices, windows

WINDOW = 50
CHUNK = 1 << 20
#: Hashes that meet in one group of the reduction, about.
GROUP = 2_000_000
#: Hashes that a message to a group carries on average: chunks are put together until it does, or until a task holds BUFFER hashes.
#: Both bounds and GROUP grow with an executor's memory: at these, messages stay this full up to about 0.7 TB of text, at ten times
#: these up to 70 TB; beyond, they carry fewer, and what a hash costs on its way approaches the overhead of a message.
MESSAGE, BUFFER = 64, 4_000_000
NO_ID = np.int64(2**63 - 1)


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """The first n_bytes of 64-bit values, byte by byte of all values, which compresses well when they are sorted."""
    kept = (values >> np.uint64(64 - 8 * n_bytes)) if n_bytes < 8 else values
    return np.ascontiguousarray(kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def unplanes(data: bytes, n_bytes: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(n_bytes, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :n_bytes] = raw.T
    return out.view("<u8").ravel()


def pack(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text)."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch, buf, offsets in slices(batches, size=CHUNK):
            ids = batch.column(0)
            known = np.array(ids.is_valid().to_numpy(zero_copy_only=False), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([int(Chunk(buf, offsets).n_words.sum())], pa.int64()), pa.array([len(buf)], pa.int64()),
                    pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), pa.array([np.packbits(known).tobytes()], pa.binary()),
                    pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([codec.compress(buf.tobytes(), asbytes=True)], pa.binary()),
                ],
                ["chunk", "n_words", "n_bytes", "ids", "known", "offsets", "body"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "chunk long, n_words long, n_bytes long, ids binary, known binary, offsets binary, body binary")


class _Packed:
    """A chunk's documents and the hashes of their words."""

    def __init__(self, row: dict):
        codec = pa.Codec("zstd")
        self.data = codec.decompress(row["body"], row["n_bytes"], asbytes=True) if row["n_bytes"] else b""
        self.c = Chunk(np.frombuffer(self.data, np.uint8), np.frombuffer(row["offsets"], "<i8"))
        ids = np.frombuffer(row["ids"], "<i8")
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(ids)).astype(bool)
        self.ids = np.where(self.known, ids, NO_ID)
        self.hashes = self.c.hashes()
        self.doc = self.c.doc_of_word()
        self.block = WINDOW // 2
        #: place of a word in its document
        self.place = np.arange(len(self.doc)) - self.c.word_at[self.doc]

    def whole(self, width: int) -> np.ndarray:
        """Words at which a window of one document begins."""
        n = len(self.doc)
        return np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of rolling windows, in order; which of them are blocks, which occur twice; words at which blocks
        begin, and the places of their hashes."""
        at = self.whole(self.block)
        h = windows(self.hashes, self.block)[at]
        order = np.argsort(h)
        ordered = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        is_block = self.place[at] % self.block == 0
        blocks = np.zeros(len(first), bool)
        blocks[number[is_block]] = True
        twice = np.diff(np.append(first, len(h))) > 1
        return ordered[first], blocks, twice, at[is_block], number[is_block]

    def candidates(self, hit: np.ndarray, block_words: np.ndarray) -> np.ndarray:
        """Words at which windows begin whose own blocks are all anchors. hit: of each block."""
        anchors = np.zeros(len(self.doc) + WINDOW, bool)
        anchors[block_words[hit]] = True
        at = self.whole(WINDOW)
        r = self.place[at] % self.block
        near = at + (-r) % self.block
        return at[anchors[near] & ((r != 0) | anchors[near + self.block])]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at `at`, made of the words that they cover and no others."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        edge = np.zeros(len(self.doc) + 1, np.int32)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        covered = np.flatnonzero(inside)
        # windows across the gaps between stretches are made too, and not looked at
        place = (np.cumsum(inside) - 1)[at]
        return windows(self.hashes[covered], WINDOW)[place], windows(self.c.hashes(family=1, words=covered), WINDOW)[place]


def _cuts(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the hashes of each part begin; one more than parts."""
    edges = np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def _columns(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(names)], [n for n, _ in names])


PROBE = "part int, chunks binary, sizes binary, n int, hashes binary, blocks binary, twice binary"
BITS = "chunk long, part int, bits binary"
WINDOWS = "part int, chunk long, n int, first binary, second binary, ids binary"
FOUND = "chunk long, part int, places binary, ids binary"


def anchors(chunks: DataFrame, parts: int, n_bytes: int) -> DataFrame:
    """(chunk, part, bits): which of the chunk's distinct hashes in the part are blocks that are found again."""

    def sent(held):
        cuts = [_cuts(h, parts) for _, h, _, _ in held]
        for p in range(parts):
            own = [(k, c[p], c[p + 1]) for k, c in enumerate(cuts) if c[p] < c[p + 1]]
            if own:
                joined = [np.concatenate([held[k][j][a:b] for k, a, b in own]) for j in (1, 2, 3)]
                ids, sizes = np.array([held[k][0] for k, _, _ in own], "<i8"), np.array([b - a for _, a, b in own], "<i4")
                yield p, ids.tobytes(), sizes.tobytes(), len(joined[0]), planes(joined[0], n_bytes), np.packbits(joined[1]).tobytes(), np.packbits(joined[2]).tobytes()

    def probe(batches):
        held, total = [], 0
        for batch in batches:
            for row in _columns(batch):
                h, blocks, twice, _, _ = _Packed(row).probes()
                if not len(h):
                    continue
                held.append((row["chunk"], h, blocks, twice))
                total += len(h)
                if total >= min(BUFFER, MESSAGE * parts):
                    yield _rows(PROBE, list(sent(held)))
                    held, total = [], 0
        if held:
            yield _rows(PROBE, list(sent(held)))

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        h = np.concatenate([unplanes(r["hashes"], n_bytes) for r in rows])
        unpack = lambda k: np.concatenate([np.unpackbits(np.frombuffer(r[k], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        blocks, twice = unpack("blocks"), unpack("twice")
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        first = np.flatnonzero(new)
        again = (np.diff(np.append(first, len(h))) > 1) | np.logical_or.reduceat(twice[order], first)
        hit = np.empty(len(h), bool)
        hit[order] = np.repeat(again, np.diff(np.append(first, len(h))))
        hit &= blocks
        out, at = [], 0
        for r in rows:
            for chunk, n in zip(np.frombuffer(r["chunks"], "<i8").tolist(), np.frombuffer(r["sizes"], "<i4").tolist(), strict=True):
                own = hit[at : at + n]
                at += n
                if own.any():
                    out.append((chunk, r["part"], np.packbits(own).tobytes()))
        return pa.Table.from_batches([_rows(BITS, out)])

    return chunks.mapInArrow(probe, PROBE).groupBy("part").applyInArrow(meet, BITS)


def _hits(packed: _Packed, found: list[dict] | None, parts: int) -> np.ndarray:
    """Windows that may be repeats, by the bits that came back."""
    h, _, _, block_words, number = packed.probes()
    hit = np.zeros(len(h), bool)
    cuts = _cuts(h, parts)
    for x in found or ():
        a, b = int(cuts[x["part"]]), int(cuts[x["part"] + 1])
        hit[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
    return packed.candidates(hit[number], block_words)


def _distinct(packed: _Packed, at: np.ndarray):
    """Of the windows at `at`: distinct keys in order, second keys, smallest doc_ids; each window's number among them."""
    first, second = packed.keys(at)
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(new) - 1
    ids = packed.ids[packed.doc[at]]
    least = np.minimum.reduceat(ids[order], starts) if len(starts) else ids
    return a[starts], b[starts], least, number


def smallest(chunks: DataFrame, parts: int, probe_parts: int, second_bytes: int) -> DataFrame:
    """(chunk, part, places, ids): where another chunk has a window in a document with a smaller doc_id, and that id."""

    def send(batches):
        for batch in batches:
            for row in _columns(batch):
                if not row["found"]:
                    continue
                packed = _Packed(row)
                a, b, least, _ = _distinct(packed, _hits(packed, row["found"], probe_parts))
                cuts = _cuts(a, parts)
                yield _rows(WINDOWS, [(p, row["chunk"], y - x, planes(a[x:y], 8), planes(b[x:y], second_bytes), planes(least[x:y].astype(np.uint64), 8)) for p, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if x < y])

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        a = np.concatenate([unplanes(r["first"], 8) for r in rows])
        b = np.concatenate([unplanes(r["second"], second_bytes) for r in rows])
        ids = np.concatenate([unplanes(r["ids"], 8) for r in rows]).astype(np.int64)
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        starts = np.flatnonzero(new)
        least = np.empty(len(a), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(a))))
        out, at = [], 0
        for r in rows:
            own = slice(at, at + r["n"])
            at += r["n"]
            places = np.flatnonzero(least[own] < ids[own])
            if len(places):
                out.append((r["chunk"], r["part"], planes(places.astype(np.uint64) << np.uint64(32), 4), planes(least[own][places].astype(np.uint64), 8)))
        return pa.Table.from_batches([_rows(FOUND, out)])

    return chunks.mapInArrow(send, WINDOWS).groupBy("part").applyInArrow(meet, FOUND)


OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def _removed(row: dict, parts: int, probe_parts: int):
    packed = _Packed(row)
    at = _hits(packed, row["found"], probe_parts) if row["found"] else np.zeros(0, np.int64)
    gone = np.zeros(len(packed.doc) + 1, np.int64)
    if len(at):
        a, _, least, number = _distinct(packed, at)
        least, cuts = least.copy(), _cuts(a, parts)
        for x in row["smaller"] or ():
            places = (unplanes(x["places"], 4)).astype(np.int64) + int(cuts[x["part"]])
            least[places] = unplanes(x["ids"], 8).astype(np.int64)
        repeats = at[least[number] < packed.ids[packed.doc[at]]]
        np.add.at(gone, repeats, 1)
        np.subtract.at(gone, repeats + WINDOW, 1)
    return packed, np.cumsum(gone[:-1]) > 0


def substring_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, spans of removed words, and the kept words joined by one space."""
    spark = docs.sparkSession
    small_batches(spark)
    chunks = stored(pack(docs))
    n = chunks.select(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    log = math.log2(max(2, n))
    parts = max(4 * partitions(spark), -(-n // GROUP))
    n_bytes = min(8, max(5, math.ceil((log + 13) / 8)))
    second_bytes = min(8, max(1, math.ceil((2 * log + 16 - 64) / 8)))
    bits = stored(anchors(chunks, parts, n_bytes).groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("found")))
    probed = chunks.join(bits, "chunk", "left")
    smaller = stored(smallest(probed, parts, parts, second_bytes).groupBy("chunk").agg(F.collect_list(F.struct("part", "places", "ids")).alias("smaller")))

    def run(batches):
        for batch in batches:
            for row in _columns(batch):
                packed, gone = _removed(row, parts, parts)
                c, data = packed.c, packed.data
                ids, texts, removed, spans = [], [], [], []
                for k in range(c.n_docs):
                    lo, hi = int(c.word_at[k]), int(c.word_at[k + 1])
                    own = gone[lo:hi]
                    words = data[c.offsets[k] : c.offsets[k + 1]].split()
                    total = int(own.sum())
                    here = []
                    if total:
                        words = compress(words, (~own).tolist())
                        edges = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                        here = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]
                    texts.append(b" ".join(words))
                    removed.append(total)
                    spans.append(here)
                ids = pa.array([int(i) if ok else None for i, ok in zip(packed.ids, packed.known, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(c.n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
                )

    return probed.join(smaller, "chunk", "left").mapInArrow(run, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS i)),
f AS (SELECT k, min(doc_id) AS m FROM p GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM p JOIN f USING (k), range(0, 50) t(j) WHERE m < doc_id),
h AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN y ON w.doc_id = y.doc_id
"""
