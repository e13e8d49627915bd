"""Quality classifier: a factorization machine over hashed words, statistics of structure, and metadata.

A document's features are its words (runs of letters and digits, A-Z folded), each in one of BUCKETS places by its hash, with the logarithm of
its count as value, all of them together of length one; of each statistic of structure the interval that it lies in (STATISTICS: sizes, shares
of capitals, digits, symbols, marks, repeated words, words next to themselves, lines found before, and so on); and of each metadata column the
order of magnitude of its value.  The score is the sigmoid of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs take linear time, as
half of |sum v_i x_i|^2 - sum |v_i x_i|^2.  So a word may weigh more among short lines than in prose.  There is no choice of words: the table has a place
for each, and its size is the same whatever the corpus holds.

Fitting: on about SAMPLE labelled rows, drawn by a hash of doc_id among those that `learn` lets through, and on fewer, by the same hash, where their
features would be more than SAMPLE_FEATURES; of texts with equal features one is used, with the label that most of them have (1 on a tie).
Scoring covers every document's whole text.

Cases: null and empty texts have no words and the lowest interval of each statistic; a text of any length is scored whole; without labels, or with
labels of one kind, every score is the share of good labels (1/2 without any); labels repeated for a doc_id (ties) count once, the larger one; rows that
share a doc_id share its label; null doc_ids and null labels aren't learned from; null metadata has an interval of its own; repeated rows score the
same; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forget, small_batches, stored
from .words import TERMS, Chunk, mix, slices

BUCKETS = 1 << 16
FACTORS = 8
SAMPLE, SAMPLE_FEATURES = 12_000, 8_000_000
THRESHOLD = 0.7
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 3e-4

#: Where shares are cut into intervals, and sizes (by powers of two).
_SHARES = np.array([1e-9, 0.003, 0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.23, 0.32, 0.43, 0.57, 0.75, 0.9])
_POWERS = 2.0 ** np.arange(0, 15)
INTERVALS = 16
STATISTICS = ("words", "bytes a word", "words a line", "capitals", "digits", "symbols", "exclamation marks", "bars", "ends of sentences", "bytes over 127", "distinct words", "words next to themselves", "lines found before", "shortest lines")


def _marked(*characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for x in characters:
        out[list(x.encode())] = True
    return out


_UPPER, _LOWER, _DIGITS = _marked("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marked("abcdefghijklmnopqrstuvwxyz"), _marked("0123456789")
_SYMBOLS, _SHOUTS, _BARS, _ENDS = _marked("#*$%&<>=_~^@{}[]\\"), _marked("!"), _marked("|"), _marked(".?!")
_HIGH, _LINES = np.arange(256) >= 128, np.arange(256) != 10


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(c: Chunk, hashes: np.ndarray) -> np.ndarray:
    """How many different words each document has."""
    doc = c.doc_of_word()
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.bincount(doc[order][new], minlength=c.n_docs).astype(float)


def statistics(buf: np.ndarray, offsets: np.ndarray, words: Chunk) -> np.ndarray:
    """Documents by STATISTICS, as intervals."""
    n, size = words.n_words.astype(float), np.diff(offsets).astype(float)
    hashes, lines = words.hashes(), Chunk(buf, offsets, table=_LINES)
    n_lines, doc = lines.n_words.astype(float), words.doc_of_word()
    beside = np.zeros(len(doc))
    beside[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    begins = np.zeros(len(buf), np.int64)
    begins[words.starts] = 1
    in_line = np.add.reduceat(begins, lines.starts) if len(lines.starts) else np.zeros(0)
    few = np.bincount(lines.doc_of_word(), in_line <= 3, words.n_docs).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    upper, letters = _count(_UPPER[buf], offsets), _count((_UPPER | _LOWER)[buf], offsets)
    sizes = [n, share(size, n), share(n, n_lines)]
    shares = [
        share(upper, letters), share(_count(_DIGITS[buf], offsets), size), share(_count(_SYMBOLS[buf], offsets), size), share(_count(_SHOUTS[buf], offsets), n), share(_count(_BARS[buf], offsets), n),
        share(_count(_ENDS[buf], offsets), n), share(_count(_HIGH[buf], offsets), size), share(_distinct(words, hashes), n), share(np.bincount(doc, beside, words.n_docs), n),
        share(n_lines - _distinct(lines, lines.hashes()), n_lines), share(few, n_lines),
    ]
    return np.stack([np.searchsorted(_POWERS, x, "right") for x in sizes] + [np.searchsorted(_SHARES, x, "right") for x in shares], 1)


def features(buf: np.ndarray, offsets: np.ndarray, meta: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of features, document by document, and where each document's begin (one more than documents)."""
    terms, words = Chunk(buf, offsets, fold=True, table=TERMS), Chunk(buf, offsets, fold=True)
    doc = terms.doc_of_word()
    keys, counts = np.unique(doc * BUCKETS + (mix(terms.hashes()) & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    value = 1 + np.log(counts)
    length = np.sqrt(np.bincount(keys // BUCKETS, value**2, terms.n_docs))
    value = value / length[keys // BUCKETS]
    kinds = statistics(buf, offsets, words)
    for column in meta:
        x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        kinds = np.column_stack([kinds, np.where(np.isnan(x), INTERVALS - 1, np.minimum(np.searchsorted(_POWERS, x, "right"), INTERVALS - 2))])
    n, m = kinds.shape
    places = BUCKETS + np.arange(m) * INTERVALS + kinds
    of = np.concatenate([keys // BUCKETS, np.repeat(np.arange(n), m)])
    order = np.argsort(of, kind="stable")
    place = np.concatenate([keys % BUCKETS, places.ravel()])[order]
    return place.astype(np.int32), np.concatenate([value, np.full(n * m, 1 / np.sqrt(m))])[order].astype(np.float32), np.searchsorted(of[order], np.arange(n + 1))


class Machine:
    """bias; w: weights; v: factors, a row for each place."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def scores(self, place: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(starts) - 1
        of = np.repeat(np.arange(n), np.diff(starts))
        z = self.bias + np.bincount(of, self.w[place] * value, n)
        for v in self.v.T:
            x = v[place] * value
            s = np.bincount(of, x, n)
            z += 0.5 * (s * s - np.bincount(of, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(place: np.ndarray, value: np.ndarray, starts: np.ndarray, labels: np.ndarray, size: int, seed: int = 11) -> Machine:
    """By AdaGrad, in a fixed order."""
    n, good = len(labels), float(labels.sum())
    if not n or good in (0, n):
        share = min(max(good / n if n else 0.5, 1e-9), 1 - 1e-9)
        return Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)))
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(good / (n - good))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))
    gb, gw, gv = 1e-3, np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            lengths = starts[rows + 1] - starts[rows]
            edges = np.cumsum(lengths)
            e = np.arange(edges[-1]) - np.repeat(edges - lengths - starts[rows], lengths)
            t, x, k = place[e], value[e].astype(float), np.repeat(np.arange(len(rows)), lengths)
            vx = v[t] * x[:, None]
            s = np.add.reduceat(vx, edges - lengths)
            z = bias + np.bincount(k, w[t] * x, len(rows)) + 0.5 * (s * s - np.add.reduceat(vx * vx, edges - lengths)).sum(1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]
            by = np.argsort(t, kind="stable")
            t, x, k, vx = t[by], x[by], k[by], vx[by]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            touched, gx = t[first], g[k] * x
            dw = np.add.reduceat(gx, first) / BATCH + DECAY * w[touched]
            dv = np.add.reduceat(gx[:, None] * (s[k] - vx), first) / BATCH + DECAY * v[touched]
            db = g.mean()
            gb += db * db
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            bias -= RATE * db / np.sqrt(gb)
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
    return Machine(bias, w, v)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def _columns(docs: DataFrame, meta: tuple[str, ...]) -> list[Column]:
    return [F.col("text").cast("string").alias("text"), *(F.col(f"`{m}`").try_cast("double").alias(f"meta{k}") for k, m in enumerate(meta))]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, meta: tuple[str, ...] = (), label: str = "quality", sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> Machine:
    """docs: doc_id, text and metadata columns; labels: doc_id and the label."""
    small_batches(docs.sparkSession)
    size = BUCKETS + (len(STATISTICS) + len(meta)) * INTERVALS
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("good"))
    n, whole = known.count(), 1_000_003
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(whole))).where(F.col("draw") < F.lit(min(1.0, sample / max(1, n)) * whole))
    # about `sample` rows of three numbers
    rows = docs.select("doc_id", *_columns(docs, meta)).join(F.broadcast(drawn), "doc_id").select("good", "draw", "text", *(f"meta{k}" for k in range(len(meta))))

    def run(batches):
        for batch, buf, offsets in slices(batches):
            place, value, starts = features(buf, offsets, [batch.column(3 + k) for k in range(len(meta))])
            own = [(place[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            n_own = np.diff(starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_own, pa.int64()), pa.array([p for p, _ in own], pa.binary()), pa.array([x for _, x in own], pa.binary())], ["good", "draw", "n", "places", "found"])

    found = stored(rows.mapInArrow(run, "good int, draw long, n long, places binary, found binary"))
    total, least = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("draw")).first()
    if total > most:
        found_few = found.where(F.col("draw") < F.lit((least + 1) * most / total))
    else:
        found_few = found
    one = found_few.groupBy(F.sha2(F.concat("places", "found"), 256).alias("digest")).agg((F.avg("good") >= 0.5).cast("int").alias("good"), F.first("places").alias("places"), F.first("found").alias("found"))
    rows = one.orderBy("digest").collect()
    forget(found)
    place = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r.places, np.int32) for r in rows)])
    value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r.found, np.float32) for r in rows)])
    starts = np.concatenate([[0], np.cumsum([len(r.places) // 4 for r in rows], dtype=np.int64)]).astype(np.int64)
    return train(place, value, starts, np.array([float(r.good) for r in rows]), size)


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Machine, meta: tuple[str, ...] = (), hold: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    # BUCKETS and some hundred rows, whatever the corpus holds
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, buf, offsets in slices(batches):
            p = shared.value.scores(*features(buf, offsets, [batch.column(3 + k) for k in range(len(meta))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    text, *rest = _columns(docs, meta)
    hold = F.lit(False) if hold is None else hold
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.coalesce(hold, F.lit(False)).alias("held_out"), *rest).mapInArrow(run, OUT)


#: What the registered query has as metadata: neither labels nor lang, source or doc_id.
METADATA = ("n_chars",)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *METADATA)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, fit(docs, labels, ~held_out(), METADATA), METADATA, held_out())
