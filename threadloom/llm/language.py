"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts, of order 3 and less.  After a context that it has seen T times, followed by D
different bytes, a byte seen n times costs log2((T + D) / n) bits; a byte not seen there costs an escape, log2((T + D) / D),
and what it costs after the context shorter by one; below order 0 every byte costs 8 bits.  (No bytes are excluded after an
escape, so costs add up along shorter contexts.)  Statistics are frozen after training, and a document goes to the language
in which its whole text takes the fewest bits.

Fitting: on about ROWS documents of every language, drawn by a hash of doc_id among the rows that `learn` lets through, whole texts.  Trees
are pruned by count: a context of three bytes branches if it was seen once in SHARE bytes of its group of languages, so that there are
SHARE of them at most.  Languages are held TOGETHER at a time: each group of them has tables of its own, of a bounded
size, and a text is read once for each group.  Scoring covers every document, in runs of SEGMENT bytes.

Cases: null texts and texts without a letter are `und` with score 0; with nothing to learn from all are `und`; a text of any length is
coded whole, in bounded memory; of languages that take equally many bits (ties) the first in code point order wins; repeated rows and shared
or null doc_ids change nothing (rows without doc_id aren't learned from); an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forget, small_batches, stored
from .words import slices

ROWS = 300
SHARE = 1 << 17
TOGETHER = 16
SEGMENT = 1 << 20
_LETTER = regex.compile(r"\p{L}").search


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def _grams(buf: np.ndarray, offsets: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """At each byte from lo to hi, it and the three before, the last in the low byte; before a text stand line feeds."""
    hi = len(buf) if hi is None else hi
    g = np.zeros(hi - lo, np.uint32)
    near = offsets[np.searchsorted(offsets, lo - 3) : np.searchsorted(offsets, hi)]
    ends = offsets[1:][np.searchsorted(offsets[1:], near, "right")] if len(near) else near
    for k in range(4):
        b = np.full(hi - lo, 10, np.uint32)
        skip = max(0, k - lo)
        b[skip:] = buf[lo + skip - k : hi - k]
        for j in range(k):
            at = near + j
            at = at[(at < ends) & (at >= lo) & (at < hi)]
            b[at - lo] = 10
        g |= b << np.uint32(8 * k)
    return g


class Trees:
    """Frozen code lengths, a column for each language."""

    def __init__(self, langs: list[str], counts: dict[int, np.ndarray]):
        """counts: of each gram of four bytes, how often each language has it."""
        n = len(langs)
        self.langs = langs
        keys = np.array(sorted(counts), np.uint32)
        ns = np.array([counts[int(k)] for k in keys], float).reshape(len(keys), n)

        def level(keys, ns, bits):
            """Grams cut to their last `bits` bits: keys, counts."""
            k, inverse = np.unique(keys & np.uint32((1 << bits) - 1), return_inverse=True)
            out = np.zeros((len(k), n))
            np.add.at(out, inverse, ns)
            return k, out

        def contexts(keys, ns):
            """All but the last byte: context of each gram, and each context's T and D."""
            c, inverse = np.unique(keys >> np.uint32(8), return_inverse=True)
            t, d = np.zeros((len(c), n)), np.zeros((len(c), n))
            np.add.at(t, inverse, ns)
            np.add.at(d, inverse, ns > 0)
            return c, inverse, t, d

        def cost(ns, t, d, shorter):
            with np.errstate(divide="ignore", invalid="ignore"):
                seen, escape = np.log2((t + d) / ns), np.where(t > 0, np.log2((t + d) / d), 0)
            return np.where(ns > 0, seen, escape + shorter), escape

        escape_of = lambda t, d: np.log2(np.where(t > 0, (t + d) / np.maximum(d, 1), 1.0))
        k1, n1 = level(keys, ns, 8)
        full = np.zeros((256, n))
        full[k1] = n1
        zero, _ = cost(full, full.sum(0), (full > 0).sum(0), 8.0)
        k2, n2 = level(keys, ns, 16)
        c, inv, t, d = contexts(k2, n2)
        _, escape = cost(n2, t[inv], d[inv], 0)
        one = np.tile(zero, (256, 1))  # by context and byte
        esc = np.zeros((256, n))
        esc[c] = escape_of(t, d)
        one += np.repeat(esc, 256, 0)
        one[k2], _ = cost(n2, t[inv], d[inv], zero[k2 & 255])
        self.two_bytes = one.astype(np.float32)

        k3, n3 = level(keys, ns, 24)
        # the start of a text is a context, too, though nothing ends with it
        start = 0x0A0A0A
        if start not in k3:
            at = int(np.searchsorted(k3, start))
            k3, n3 = np.insert(k3, at, np.uint32(start)), np.insert(n3, at, 0.0, axis=0)
        c, inv, t, d = contexts(k3, n3)
        self.context2 = np.zeros(65536, np.int32)
        self.context2[c] = np.arange(1, len(c) + 1)
        three, _ = cost(n3, t[inv], d[inv], one[k3 & 0xFFFF])
        self.escape2 = np.vstack([np.zeros(n), escape_of(t, d)]).astype(np.float32)
        self.node3 = np.zeros((len(c) + 1) * 256, np.int32)
        self.node3[self.context2[k3 >> 8] * 256 + (k3 & 255)] = np.arange(1, len(k3) + 1)
        self.three = np.vstack([np.zeros(n), three]).astype(np.float32)

        c, inv, t, d = contexts(keys, ns)
        keep = t.sum(1) >= ns.sum() / SHARE
        mine = keep[inv]
        k4, n4, inv4 = keys[mine], ns[mine], inv[mine]
        place = np.cumsum(keep)
        # a context of three bytes is a node of order 2
        at3 = lambda g: self.node3[self.context2[(g >> 8) & 0xFFFF] * 256 + (g & 255)]
        self.context3 = np.zeros(len(k3) + 1, np.int32)
        self.context3[at3(c[keep])] = place[keep]
        self.context3[0] = 0
        four, _ = cost(n4, t[inv4], d[inv4], three[at3(k4 & 0xFFFFFF) - 1])
        self.escape3 = np.vstack([np.zeros(n), escape_of(t, d)[keep]]).astype(np.float32)
        self.node4 = np.zeros((int(keep.sum()) + 1) * 256, np.int32)
        self.node4[place[inv4] * 256 + (k4 & 255)] = np.arange(1, len(k4) + 1)
        self.four = np.vstack([np.zeros(n), four]).astype(np.float32)

    def bits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of documents by languages."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for lo in range(0, len(buf), SEGMENT):
            hi = min(len(buf), lo + SEGMENT)
            costs = self._costs(_grams(buf, offsets, lo, hi))
            # the documents that have a byte here
            first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            own = np.arange(first, last)
            own = own[offsets[own] < offsets[own + 1]]
            out[own] += np.add.reduceat(costs, np.maximum(offsets[own] - lo, 0), axis=0, dtype=np.float64)
        return out

    def _costs(self, g: np.ndarray) -> np.ndarray:
        """Bits of each byte by languages, from it and the three before it."""
        low3 = lambda x: self.node3[self.context2[(x >> np.uint32(8)) & np.uint32(0xFFFF)] * 256 + (x & np.uint32(255)).astype(np.int64)]
        context3 = self.context3[low3(g >> np.uint32(8))]
        node4 = self.node4[context3.astype(np.int64) * 256 + (g & np.uint32(255))]
        costs = self.four[node4]
        no4 = np.flatnonzero(node4 == 0)
        g4 = g[no4]
        low = low3(g4)
        less = self.three[low] + self.escape3[context3[no4]]
        no3 = np.flatnonzero(low == 0)
        g3 = g4[no3]
        less[no3] += self.escape2[self.context2[(g3 >> np.uint32(8)) & np.uint32(0xFFFF)]] + self.two_bytes[g3 & np.uint32(0xFFFF)]
        costs[no4] = less
        return costs


class Forest:
    """Trees of languages, TOGETHER at a time."""

    def __init__(self, groups: list[Trees]):
        self.groups = groups
        self.langs = [lang for g in groups for lang in g.langs]

    def bits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.hstack([g.bits(buf, offsets) for g in self.groups])


def fit(docs: DataFrame, learn: Column, rows: int = ROWS, together: int = TOGETHER) -> Forest | None:
    """Trees from docs (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    can = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # ids are drawn from a thin table, and go to where the texts are: about `rows` of them for each language
    thin = can.select("doc_id", "lang")
    sizes = thin.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("_n"))
    # a row for each language; the trees that come of them go to every task anyway
    ids = thin.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) < share * 1_000_003).select("doc_id", "lang").distinct()
    drawn = can.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])

    def run(batches):
        sums: dict[str, Counter] = {}
        for batch, buf, offsets in slices(batches):
            grams, langs = _grams(buf, offsets), np.array(batch.column(1).to_pylist(), object)
            of = np.repeat(langs, np.diff(offsets))
            for lang in set(langs.tolist()):
                k, n = np.unique(grams[of == lang], return_counts=True)
                sums.setdefault(lang, Counter()).update(dict(zip(k.tolist(), n.tolist(), strict=True)))
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    grams = stored(drawn.select(F.col("text").cast("string").alias("text"), "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    names = sorted(r.lang for r in grams.select("lang").distinct().collect())
    groups = []
    for at in range(0, len(names), together):
        own = names[at : at + together]
        found = grams.where(F.col("lang").isin(own)).toArrow()
        keys, inverse = np.unique(found["gram"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(keys), len(own)))
        place = {lang: k for k, lang in enumerate(own)}
        counts[inverse, np.array([place[x] for x in found["lang"].to_pylist()], np.int64)] = found["n"].to_numpy()
        groups.append(Trees(own, dict(zip(keys.tolist(), counts, strict=True))))
    forget(grams)
    return Forest(groups) if groups else None


OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, trees: Forest | None, hold: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the best language's posterior, all being as likely before)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # of a size bounded for each language by SHARE and ROWS

    def run(batches):
        trees = shared.value
        for batch, buf, offsets in slices(batches):
            texts = batch.column(1).to_pylist()
            letters = np.array([t is not None and _LETTER(t) is not None for t in texts], bool)
            if trees is None:
                best, score = np.array(["und"] * len(texts), object), np.zeros(len(texts))
            else:
                bits = trees.bits(buf, offsets)
                k = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                best = np.where(letters, np.array(trees.langs, object)[k], "und")
                score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    hold = F.lit(False) if hold is None else hold
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(hold, F.lit(False)).alias("held_out")).mapInArrow(run, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit(docs, ~held_out()), held_out())
