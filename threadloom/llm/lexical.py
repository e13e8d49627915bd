"""Ranked lexical search: the documents that score highest for each item, by Fagin's threshold algorithm.

Terms are maximal runs of ASCII letters and digits and of characters over U+007F, A-Z in lower case.  With N documents that have a term, L
terms in all of them, n in one, df documents that hold a term and tf of it in the document, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1)));
a document's m is 25 + (75 n N) div L, and its score the sum over the item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 8 m)).

Method: one pass over the texts writes a forward index, a thin row for each document with those of its terms that an item has; N, L and df are
summed from it.  Each task then takes some of its rows at a time (SHARD_POSTINGS of them), sorts each term's documents by impact, and goes
through an item's lists in turn, some places of each at a time; a document that is met is looked up in the forward index and scored in full.  As
soon as the sum of the impacts that the lists have come to, which no document further down can exceed, is strictly under the K-th best score,
the rest of the lists can't matter.  The best of a task are its bound in all further shards, so what leaves a task is K rows an item.  The
answer is exact: nothing is capped, and lists that never fall under the bound are read to their ends.

Items are the queries: what goes to all tasks grows with them alone, and they are taken in blocks of BLOCK_TERMS terms, each by itself.
Words are told apart by two independent hashes of 64 bits.

Cases: a null or empty text, or one without terms, is no document and no item; texts of any length are read whole; equal scores go by
doc_id, null last; rows that share a doc_id are ranked each by itself, and so are items that share an item_id; an item with fewer than K documents has
fewer rows, down to none; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import only, small_batches, stored
from .words import TERMS, Chunk, slices

K = 10
BLOCK_TERMS = 500_000
SHARD_POSTINGS = 1 << 20
#: Places of each list that are read in the first turn; each further turn reads twice as many.
FIRST_PLACES = 16
#: The best of tasks are merged in so many parts first.
PARTS = 64


class Items:
    """Some items: ids; of item k the terms term[at[k]:at[k + 1]], each times[...] over; hashes of terms, sorted by the first family."""

    def __init__(self, rows: list[tuple[int | None, dict[bytes, int]]]):
        words = sorted({w for _, terms in rows for w in terms})
        self.ids = [i for i, _ in rows]
        buf = np.frombuffer(b"".join(words), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
        c = Chunk(buf, offsets, table=TERMS)
        first, second = c.hashes(), c.hashes(family=1)
        order = np.argsort(first, kind="stable")
        self.first, self.second = first[order], second[order]
        number = {words[k]: n for n, k in enumerate(order.tolist())}
        self.at = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
        self.term = np.array([number[w] for _, t in rows for w in t], np.int64)
        self.times = np.array([n for _, t in rows for n in t.values()], np.int64)

    def __len__(self) -> int:
        return len(self.first)


def _terms_of(text: str) -> Counter:
    raw = np.frombuffer(text.encode(), np.uint8)
    c = Chunk(raw, np.array([0, len(raw)]), fold=True, table=TERMS)
    return Counter(c.buf[a:b].tobytes() for a, b in zip(c.starts.tolist(), c.ends.tolist(), strict=True))


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_TERMS) -> Iterator[Items]:
    """The items that have terms, in blocks of about `most` terms (one item at least)."""
    held, n = [], 0
    for row in items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).toLocalIterator():
        terms = _terms_of(row.text or "")
        if terms:
            held.append((row.id, terms))
            n += len(terms)
        if n >= most:
            yield Items(held)
            held, n = [], 0
    if held:
        yield Items(held)


FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def forward_index(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n, and the numbers and counts of the items' terms that it holds, of each document that has any term."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        own = shared.value
        for batch, buf, offsets in slices(batches):
            c = Chunk(buf, offsets, fold=True, table=TERMS)
            n = c.n_words
            hashes = c.hashes()
            at = np.minimum(np.searchsorted(own.first, hashes), len(own) - 1)
            hit = np.flatnonzero(own.first[at] == hashes)
            hit = hit[own.second[at[hit]] == c.hashes(family=1, words=hit)]
            keys, tfs = np.unique(c.doc_of_word()[hit] * len(own) + at[hit], return_counts=True)
            has = np.flatnonzero(n > 0)
            edges = np.searchsorted(keys, np.append(has, len(n)) * len(own)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (keys % len(own), tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), pa.array(n[has].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, FORWARD)


def document_counts(forward: DataFrame, size: int) -> np.ndarray:
    """df of each of the items' terms, summed within tasks first."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    out = np.zeros(size, np.int64)
    # a row for each term of the items
    for r in forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


class Shard:
    """Some documents: a forward index (values of the terms of each) and each term's documents, highest value first."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int):
        self.ids, self.missing, self.starts, self.terms, self.values = ids, missing, starts, terms, values
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.lexsort((doc, -values, terms))
        self.docs, self.impacts = doc[order], values[order]
        self.list_at = np.searchsorted(terms[order], np.arange(size + 1))

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of documents, looked up in the forward index; times: how often the item has each term."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        edges = np.cumsum(lengths)
        at = np.arange(edges[-1]) - np.repeat(edges - lengths - self.starts[docs], lengths)
        return np.add.reduceat(self.values[at] * times[self.terms[at]], edges - lengths)

    def best(self, terms: np.ndarray, times: np.ndarray, bound: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores among which are all that are of the k best and score `bound` or more.  times: by term, of all items' terms."""
        starts, ends = self.list_at[terms], self.list_at[terms + 1]
        seen = np.zeros(len(self.ids), bool)
        found, scored, depth, step = [], [], 0, FIRST_PLACES
        while True:
            begin, end = np.minimum(starts + depth, ends), np.minimum(starts + depth + step, ends)
            met = np.concatenate([self.docs[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            met = np.unique(met[~seen[met]])
            if len(met):
                seen[met] = True
                found.append(met)
                scored.append(self.scores(met, times))
                every = np.concatenate(scored)
                if len(every) >= k:
                    bound = max(bound, int(np.partition(every, -k)[-k]))
            # a document that no list has come to yet has at most the last value read in each
            more = end < ends
            if not more.any():
                break
            if int((self.impacts[end[more] - 1] * times[terms[more]]).sum()) < bound:
                break
            depth, step = depth + step, 2 * step
        docs, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, scored))
        good = (scores >= bound) & (scores > 0)
        return docs[good], scores[good]


OUT = "place long, item_id long, doc_id long, score long"


def _found(forward: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's k best of each item: place (of the item in its block), item_id, doc_id, score."""
    shared = forward.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        own, w = shared.value
        size = len(own)
        # of each item: ids, whether there is one, and scores, the best first
        top = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(own.ids)
        times = np.zeros(size, np.int64)

        def search(held):
            ids, missing, n = (np.concatenate([h[j] for h in held]) for j in (0, 1, 2))
            lengths, terms, tf = (np.concatenate([h[j] for h in held]) for j in (3, 4, 5))
            m = 25 + (75 * n * n_docs) // n_terms
            values = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, lengths)))
            shard = Shard(ids, missing, np.concatenate([[0], np.cumsum(lengths)]), terms, values, size)
            for q in range(len(own.ids)):
                at = slice(own.at[q], own.at[q + 1])
                times[own.term[at]] = own.times[at]
                best_ids, best_missing, best_scores = top[q]
                bound = int(best_scores[k - 1]) if len(best_scores) >= k else 1
                docs, scores = shard.best(own.term[at], times, bound, k)
                if len(docs):
                    best_ids, best_missing, best_scores = np.append(best_ids, ids[docs]), np.append(best_missing, missing[docs]), np.append(best_scores, scores)
                    order = np.lexsort((best_ids, best_missing, -best_scores))[:k]
                    top[q] = best_ids[order], best_missing[order], best_scores[order]
                times[own.term[at]] = 0

        held, n = [], 0
        for batch in batches:
            ids = batch.column(0)
            lists = [batch.column(j) for j in (2, 3)]
            lengths = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            has = lengths > 0
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False)[has], ids.is_null().to_numpy(zero_copy_only=False)[has], batch.column(1).to_numpy(zero_copy_only=False)[has], lengths[has], terms, tf))
            n += len(terms)
            if n >= SHARD_POSTINGS:
                search(held)
                held, n = [], 0
        if n:
            search(held)
        counts = [len(x[0]) for x in top]
        if sum(counts):
            ids, missing, scores = (np.concatenate([x[j] for x in top]) for j in (0, 1, 2))
            items_of = pa.array([i for i, c in zip(own.ids, counts, strict=True) for _ in range(c)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(counts)), counts)), items_of, pa.array(ids, mask=missing), pa.array(scores)], ["place", "item_id", "doc_id", "score"])

    return forward.mapInArrow(run, OUT)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents.  docs: doc_id, text; items: item_id, text."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for number, block in enumerate(blocks(items)):
        forward = stored(forward_index(docs, block))
        n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_counts(forward, len(block))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        own = _found(forward, block, weights, n_docs, max(1, n_terms), k)
        own = own.withColumns({"block": F.lit(number), "part": F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))})
        best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for by in (["block", "place", "part"], ["block", "place"]):
            own = own.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
        own = own.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(only(docs, "doc_id", "text"), only(items, "item_id", "text"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
), total AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), asked AS (
  SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY ALL
), held AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total
), scored AS (
  SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term), total GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= {K}
"""
