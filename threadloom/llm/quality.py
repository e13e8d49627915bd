"""Quality rules: base counts, and the divergence of a document's histograms from those of its language.

Base counts are exact.  The method: each language's reference is the histogram of character classes and of common words
over all its documents (the common words are the COMMON most frequent words of any length, told by 64-bit hashes, A-Z
folded; all others share one bin).  A document of at least MIN_WORDS words is kept if the Jensen-Shannon distances (square root of the
divergence in bits, 0 to 1) of both its histograms from its language's references stay under the limits.  Shorter ones
are judged by the base rules alone.  Every language of at least REFERENCE_WORDS words has a reference of its own (CLASSES + COMMON + 1
numbers, which is what a language adds to the broadcast); the documents of others, and of none, are compared to the reference of all
documents together.

Cases: null and empty texts have zero counts and fail the base rule; a text of any length is counted whole; repeated rows, ties and shared
or null doc_ids change nothing, rows being judged one by one (repeats count in the references); among words that are equally frequent the
smaller hash is the more common one; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import small_batches, stored
from .words import IS_WORD, Chunk, mix, slices, windows

COMMON = 48
#: A language with fewer words is too small to be a reference.
REFERENCE_WORDS = 1000
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.30
#: For the words the limit is MAX_WORD_DISTANCE + WORD_SLACK / sqrt(n_words): a short text strays further by chance.
MAX_WORD_DISTANCE, WORD_SLACK = 0.45, 1.2
REPEAT_WINDOW = 8
#: A task keeps so many counts of words, before they are summed and, if still many, sent on.
HELD = 1 << 20

#: Classes of characters, told by a character's first byte; bytes that continue a character have none.
CLASSES = 12
_CLASS = np.full(256, 255, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:'\"?!-()", b"#*$%&|<>")):
    _CLASS[list(_bytes)] = _k
_CLASS[:128][_CLASS[:128] == 255] = 7
_CLASS[0xC2:0xC4], _CLASS[0xC4:0xD0], _CLASS[0xD0:0xE0], _CLASS[0xE0:0x100] = 8, 9, 10, 11
_SYMBOL = _CLASS == 6
_LEADS = (np.arange(256) & 0xC0) != 0x80


def _per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each document a mask holds."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(offsets[:-1] < offsets[1:])
    if len(full):
        out[full] = np.add.reduceat(mask.view(np.int8), offsets[full], dtype=np.int64)
    return out


def _classes(c: Chunk, raw: np.ndarray) -> np.ndarray:
    """Documents by classes."""
    kinds = _CLASS[raw]
    return np.stack([_per_document(kinds == k, c.offsets) for k in range(CLASSES)], 1)


def _summed(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(every), np.int64)
    np.add.at(out, inverse, np.concatenate(ns))
    return every, out


def references(docs: DataFrame) -> dict:
    """lang (None: all documents) -> (class shares, common words, their shares and that of the rest)."""

    def run(batches):
        sums: dict = defaultdict(int)
        counted: dict = {}  # of a language: hashes of words, and how often each was found

        def word_rows():
            for lang, (keys, ns) in counted.items():
                every, n = _summed(keys, ns)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(every), pa.string()), pa.array(np.ones(len(every), np.int32)), pa.array(every.view(np.int64)), pa.array(n)], ["lang", "kind", "key", "n"])
            counted.clear()

        def rows():
            keys, ns = list(sums), list(sums.values())
            sums.clear()
            lang = [k[0] for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array(ns, pa.int64())], ["lang", "kind", "key", "n"])

        for batch, buf, offsets in slices(batches):
            c = Chunk(buf, offsets, fold=True)
            langs = batch.column(1).to_pylist()
            codes = {l: k for k, l in enumerate(dict.fromkeys(langs))}
            of_doc = np.array([codes[l] for l in langs])
            classes, words, of_word = _classes(c, buf), c.hashes(), np.repeat(of_doc, c.n_words)
            for lang, k in codes.items():
                own = of_doc == k
                for key, n in enumerate(classes[own].sum(0)):
                    sums[lang, 0, key] += int(n)
                keys, ns = np.unique(words[of_word == k], return_counts=True)
                if len(keys):
                    held = counted.setdefault(lang, ([], []))
                    held[0].append(keys)
                    held[1].append(ns)
            if sum(len(x) for keys, _ in counted.values() for x in keys) > HELD:
                for lang, (keys, ns) in counted.items():
                    every, n = _summed(keys, ns)
                    counted[lang] = [every], [n]
                if sum(len(keys[0]) for keys, _ in counted.values()) > HELD // 2:
                    yield from word_rows()
            if len(sums) > 400_000:
                yield rows()
        yield from word_rows()
        if sums:
            yield rows()

    thin = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = stored(thin.mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    large = counts.where("kind = 1 and lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= REFERENCE_WORDS).select("lang")
    known = sorted(r.lang for r in large.collect())
    named = counts.join(F.broadcast(large), "lang", "left_semi")
    everything = counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "key", "n")
    out = {}
    found: dict = defaultdict(list)
    for part in (named, everything):
        total = part.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(3).alias("kind"), F.lit(0).cast("long").alias("key"), "n")
        best = part.where("kind = 1").withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("_r") <= COMMON).drop("_r")
        for r in part.where("kind = 0").unionByName(best).unionByName(total).collect():
            found[r.lang, r.kind].append((r.key, r.n))
    for lang in [*known, None]:
        classes = np.zeros(CLASSES)
        for key, n in found[lang, 0]:
            classes[key] = n
        common = sorted((k % 2**64, n) for k, n in found[lang, 1])  # Spark has the hashes as signed numbers
        words = np.array([k for k, _ in common], np.uint64)
        n_words = sum(n for _, n in found[lang, 3])
        ns = np.array([n for _, n in common] + [n_words - sum(n for _, n in common)], float)
        out[lang] = (classes / max(1, classes.sum()), words, ns / max(1, ns.sum()))
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeated_words(c: Chunk, hashes: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Of each document: words in windows that are found twice or more in it."""
    n = len(hashes)
    if n < width:
        return np.zeros(c.n_docs, np.int64)
    doc = c.doc_of_word()
    whole = doc[: n - width + 1] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    keys = mix(windows(hashes, width)[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice = at[order[same[1:] | same[:-1]]]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return covered[c.word_at[1:]] - covered[c.word_at[:-1]]


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if x and not x.isspace()]
    return len(lines) - len(set(lines))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """Counts, distances and verdicts of every document; distances are null where no verdict is drawn from them."""
    small_batches(docs.sparkSession)
    refs = references(docs) if refs is None else refs

    def run(batches):
        for batch, buf, offsets in slices(batches):
            c, raw = Chunk(buf, offsets, fold=True), buf
            words = c.n_words
            data = raw.tobytes()
            lines = [duplicate_lines(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            repeats = repeated_words(c, Chunk(raw, offsets).hashes())
            failed = (words < 20) | (100 * repeats > 30 * words)
            classes, hashes = _classes(c, raw).astype(float), c.hashes()
            chars, terms = np.full(c.n_docs, np.nan), np.full(c.n_docs, np.nan)
            langs = [l if l in refs else None for l in batch.column(2).to_pylist()]
            doc_of_word = c.doc_of_word()
            for lang in set(langs):
                own = np.array([l == lang for l in langs])
                share, common, q = refs[lang]
                chars[own] = distance(classes[own] / np.maximum(1, classes[own].sum(1, keepdims=True)), share)
                mine = own[doc_of_word]
                at = np.searchsorted(common, hashes[mine])
                if len(common):
                    at[common[np.minimum(at, len(common) - 1)] != hashes[mine]] = len(common)
                counts = np.bincount(doc_of_word[mine] * (len(common) + 1) + at, minlength=c.n_docs * (len(common) + 1)).reshape(c.n_docs, -1)[own].astype(float)
                terms[own] = distance(counts / np.maximum(1, counts.sum(1, keepdims=True)), q)
            long = words >= MIN_WORDS
            bad = long & ((chars > MAX_CHAR_DISTANCE) | (terms > MAX_WORD_DISTANCE + WORD_SLACK / np.sqrt(np.maximum(words, 1))))
            cols = [batch.column(0), words, _per_document(IS_WORD[raw] & _LEADS[raw], offsets), _per_document(_SYMBOL[raw], offsets), np.array(lines, np.int64), repeats, failed, ~(failed | bad), pa.array(chars, mask=~long), pa.array(terms, mask=~long)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], [x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
