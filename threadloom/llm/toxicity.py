"""Toxicity: a factorization machine over hashed terms.

Terms are runs of letters and digits, ASCII and Latin-1 letters folded, hashed to 62 bits, and the first PREFIXES bytes of longer
ones, so that inflected forms meet; a document's features are the terms that it has once, twice, and LEVELS times or more.  The
score is the sigmoid of w0 + sum w_i + sum over pairs <v_i, v_j>, so an insult and a group mention can weigh more together
than apart.  The pairwise sum takes linear time: half of |sum v|^2 - sum |v|^2.

Fitting: on about SAMPLE labelled rows, drawn by a hash of doc_id among those that `learn` lets through; of texts with equal features one
is used.  A term enters the model by itself if its chi-square against the label reaches CHI2 and at least MIN_DOCS sampled documents have
it (the TERMS_KEPT strongest); or by a pair: of the PAIR_TERMS terms that divide the sample most evenly all pairs are counted, and the two
terms of a pair enter if the chi-square of having both, or of having just one of them, exceeds those of the terms by PAIR_CHI2 (the
PAIRS_KEPT strongest).  So terms that say nothing alone, and much together, are learned too; the model's size is bounded whatever the corpus
holds.  Scoring covers every document's whole text.

Cases: null and empty texts have no terms and score sigmoid(w0); a text of any length is scored whole; without labels, or with labels of
one kind, every score is the share of toxic labels (0 without any); labels repeated for a doc_id (ties) count once, the larger one; rows
that share a doc_id share its label; null doc_ids and null labels aren't learned from; repeated rows score the same; an empty table gives
an empty result; extra columns are ignored by `score`, and `drop_toxic` hands all columns on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forget, small_batches, stored
from .words import TERMS, Chunk, mix, slices

PREFIXES = (5, 7)
LEVELS = 3
SAMPLE = 12_000
CHI2 = 12.0
MIN_DOCS = 4
TERMS_KEPT = 4000
PAIR_TERMS, PAIR_CHI2, PAIRS_KEPT = 1024, 50.0, 500
FACTORS = 8
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


_BASE = ~np.uint64(3)


def folded(buf: np.ndarray, offsets: np.ndarray) -> Chunk:
    """Terms with letters of U+00C0 to U+00DE in lower case, too."""
    out = buf.copy()
    upper = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
    out[upper] += 0x20
    return Chunk(out, offsets, fold=True, table=TERMS)


def _bases(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of terms and of their beginnings, with two bits free for a level, and the documents they are in."""
    doc, size = c.doc_of_word(), c.ends - c.starts
    hashes, docs = [c.hashes()], [doc]
    for k in PREFIXES:
        long = size > k
        hashes.append(mix(c.hashes(k)[long] + np.uint64(k)))
        docs.append(doc[long])
    return np.concatenate(hashes) & _BASE, np.concatenate(docs)


def _leveled(bases: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs: level k of a base where the document has it k times or more."""
    order = np.lexsort((bases, docs))
    b, d = bases[order], docs[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(b)))
    b, d = b[first], d[first]
    return np.concatenate([d[counts >= k] for k in range(1, LEVELS + 1)]), np.concatenate([b[counts >= k] | np.uint64(k) for k in range(1, LEVELS + 1)])


class Machine:
    """terms: sorted features; w: weights; v: factors, a row for each."""

    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.bias, self.w, self.v = terms, bias, w, v
        self.bases = np.unique(terms & _BASE)

    def features(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(document, place of feature) pairs, each once."""
        if not len(self.terms) or not len(c.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bases, docs = _bases(c)
        hit = self.bases[np.minimum(np.searchsorted(self.bases, bases), len(self.bases) - 1)] == bases
        doc, f = _leveled(bases[hit], docs[hit])
        at = np.minimum(np.searchsorted(self.terms, f), len(self.terms) - 1)
        hit = self.terms[at] == f
        return doc[hit], at[hit]

    def scores(self, c: Chunk) -> np.ndarray:
        doc, term = self.features(c)
        z = np.full(c.n_docs, self.bias)
        np.add.at(z, doc, self.w[term])
        for v in self.v.T:
            s = np.bincount(doc, v[term], c.n_docs)
            z += 0.5 * (s * s - np.bincount(doc, v[term] ** 2, c.n_docs))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(terms: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, steps: int = 4000, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """From sorted features, those that each document has, and its label, 0 or 1."""
    n, pos = len(docs), float(labels.sum())
    if not n or pos in (0, n):
        share = min(max(pos / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Machine(np.zeros(0, np.uint64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    of = np.repeat(np.arange(n), [len(d) for d in docs])
    term = np.searchsorted(terms, np.concatenate(docs))
    starts = np.searchsorted(of, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors)), 0.0
    gw, gv, gb = np.full(len(terms), 1e-8), np.full((len(terms), factors), 1e-8), 1e-8
    for _ in range(max(10, steps * 64 // n)):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            rows = order[at : at + 64]
            sizes = starts[rows + 1] - starts[rows]
            t = np.concatenate([term[starts[r] : starts[r + 1]] for r in rows])
            k = np.repeat(np.arange(len(rows)), sizes)
            s = np.zeros((len(rows), factors))
            np.add.at(s, k, v[t])
            q = np.zeros((len(rows), factors))
            np.add.at(q, k, v[t] ** 2)
            z = bias + np.bincount(k, w[t], len(rows)) + 0.5 * (s * s - q).sum(1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]
            gb += (g.sum()) ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
            dw = np.bincount(t, g[k], len(terms))
            touched = np.unique(t)
            dw = dw[touched] + decay * len(rows) * w[touched]
            dv = np.zeros((len(terms), factors))
            np.add.at(dv, t, g[k, None] * (s[k] - v[t]))
            dv = dv[touched] + decay * len(rows) * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate * dv / np.sqrt(gv[touched])
    return Machine(terms, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Machine:
    """docs: doc_id, text; labels: doc_id, toxic."""
    small_batches(docs.sparkSession)
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) < F.lit(min(1.0, sample / max(1, n)) * 1_000_003))
    # about `sample` rows of two numbers
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")

    def run(batches):
        for batch, buf, offsets in slices(batches):
            doc, f = _leveled(*_bases(folded(buf, offsets)))
            order = np.lexsort((f, doc))
            f, at = f[order], np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            own = [f[at[k] : at[k + 1]].astype(np.int64) for k in range(batch.num_rows)]
            digests = [int(mix(x.astype(np.uint64)).sum().astype(np.int64)) for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(digests, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["toxic", "digest", "features"])

    found = rows.select("doc_id", "text", "toxic").mapInArrow(run, "toxic int, digest long, features array<long>")
    found = stored(found.groupBy("digest").agg(F.max("toxic").alias("toxic"), F.first("features").alias("features")))
    n, pos = found.select(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    each = found.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("m"))
    # the fourfold table: a, b toxic and others with the feature; c, d without
    each = each.withColumns({"b": F.col("m") - F.col("a"), "c": F.lit(float(pos)) - F.col("a")}).withColumn("d", F.lit(float(n - pos)) - F.col("b"))
    chi2 = F.lit(float(n)) * F.pow(F.expr("a * d - b * c"), 2) / F.expr("(a + b) * (c + d) * (a + c) * (b + d)")
    each = each.where(F.col("m") >= MIN_DOCS)
    best = each.where(F.expr("c + d > 0 and a + c > 0 and b + d > 0")).withColumn("chi2", chi2).where(F.col("chi2") >= CHI2)
    of = lambda df: np.sort(np.array([r.f for r in df.select("f").collect()], np.int64).astype(np.uint64))
    strong = of(best.orderBy(F.desc("chi2"), "f").limit(TERMS_KEPT))
    even = of(each.orderBy(F.desc(F.col("m") * (F.lit(float(n)) - F.col("m"))), "f").limit(PAIR_TERMS))
    wanted = docs.sparkSession.sparkContext.broadcast(np.union1d(strong, even))  # TERMS_KEPT + PAIR_TERMS numbers at most

    def choose(batches):
        for batch in batches:
            kept = [np.array(x, np.int64).astype(np.uint64) for x in batch.column(2).to_pylist()]
            kept = [x[np.isin(x, wanted.value)].tobytes() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], ["digest", "toxic", "terms"])

    drawn = found.select("digest", "toxic", "features").mapInArrow(choose, "digest long, toxic int, terms binary").orderBy("digest").collect()
    forget(found)
    owned, toxic = [np.frombuffer(r.terms, np.uint64) for r in drawn], np.array([float(r.toxic > 0) for r in drawn])
    terms = np.union1d(strong, paired(even, owned, toxic))
    return train(terms, [x[np.isin(x, terms)] for x in owned], toxic)


def _chi2(pos_in: np.ndarray, n_in: np.ndarray, pos: float, n: float) -> np.ndarray:
    """Of indicators that hold in n_in documents, pos_in of them toxic, out of n, pos of them toxic."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = n * (pos_in * n - n_in * pos) ** 2 / (n_in * (n - n_in) * pos * (n - pos))
    return np.where((n_in > 0) & (n_in < n), out, 0.0)


def paired(terms: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, least: float = PAIR_CHI2, kept: int = PAIRS_KEPT) -> np.ndarray:
    """Those of sorted terms that tell more about the label in a pair than by themselves."""
    n, pos, m = len(docs), float(labels.sum()), len(terms)
    if m < 2 or pos in (0, n):
        return terms[:0]
    both, toxic = np.zeros((m, m)), np.zeros((m, m))
    for at in range(0, n, 1000):
        x = np.array([np.isin(terms, d) for d in docs[at : at + 1000]], np.float32)
        both += x.T @ x
        x = x[labels[at : at + 1000] > 0]
        toxic += x.T @ x
    alone_n, alone_pos = np.diag(both), np.diag(toxic)
    alone = _chi2(alone_pos, alone_n, pos, n)
    one_n, one_pos = alone_n[:, None] + alone_n - 2 * both, alone_pos[:, None] + alone_pos - 2 * toxic
    # a pair has to be there often enough, and to be absent often enough, to be told from chance
    enough = (np.minimum(both, one_n) >= MIN_DOCS) | (one_n >= MIN_DOCS)
    gain = np.maximum(_chi2(toxic, both, pos, n), _chi2(one_pos, one_n, pos, n)) - np.maximum(alone[:, None], alone)
    a, b = np.nonzero(np.triu(enough & (gain >= least), 1))
    first = np.argsort(-gain[a, b], kind="stable")[:kept]
    return np.unique(terms[np.concatenate([a[first], b[first]])])


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Machine, hold: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS_KEPT rows at most

    def run(batches):
        for batch, buf, offsets in slices(batches):
            p = shared.value.scores(folded(buf, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    hold = F.lit(False) if hold is None else hold
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(hold, F.lit(False)).alias("held_out")).mapInArrow(run, OUT)


def drop_toxic(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, buf, offsets in slices(batches):
            p = shared.value.scores(folded(buf, offsets))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, fit(docs, labels, ~held_out()), held_out())
