"""The factorization machine of quality: its score by definition, pairs that it learns, held-out rows, and hard tables."""

import math
import random

import numpy as np
import pyarrow as pa
from helpers import DOCS, documents
from pyspark.sql import functions as F

from threadloom.llm import quality_classifier as Q
from threadloom.llm.words import text_bytes

LABELS = "doc_id long, quality int, toxic int"


def found(texts, meta=()):
    return Q.features(*text_bytes(pa.array(texts, pa.string())), [pa.array(m) for m in meta])


def test_score_is_the_double_sum():
    rng = np.random.default_rng(1)
    texts = ["one two two three", "", None, "A | b | c\nA | b | c\n", "wörter " * 30]
    place, value, starts = found(texts, [[1, 2, None, 4, 5000]])
    size = Q.BUCKETS + (len(Q.STATISTICS) + 1) * Q.INTERVALS
    m = Q.Machine(0.3, rng.normal(0, 1, size), rng.normal(0, 1, (size, Q.FACTORS)))
    for k, p in enumerate(m.scores(place, value, starts)):
        own = range(starts[k], starts[k + 1])
        z = m.bias + sum(m.w[place[i]] * value[i] for i in own) + sum(m.v[place[i]] @ m.v[place[j]] * value[i] * value[j] for i in own for j in own if i < j)
        assert abs(1 / (1 + math.exp(-z)) - p) < 1e-6


def test_statistics_by_hand():
    text = "Wow!! The the | 12 #\n\nshort line\nshort line\n"
    words = text.split()
    buf, offsets = text_bytes(pa.array([text, None, " \n "]))
    got = Q.statistics(buf, offsets, Q.Chunk(buf, offsets, fold=True))
    letters = [c for c in text if c.isalpha()]
    share = lambda x: np.searchsorted(Q._SHARES, x, "right")
    size = len(text)
    lines = [x for x in text.split("\n") if x]
    expected = [np.searchsorted(Q._POWERS, x, "right") for x in (len(words), size / len(words), len(words) / len(lines))]
    lower = [w.lower() for w in words]
    expected += [share(x) for x in (sum(c.isupper() for c in letters) / len(letters), 2 / size, 1 / size, 2 / len(words), 1 / len(words), 0, 0, len(set(lower)) / len(words), 1 / len(words), 1 / 3, 2 / 3)]
    # sentence ends: none but the marks after Wow
    expected[8] = share(2 / len(words))
    assert got[0].tolist() == [int(x) for x in expected]
    assert got[1].tolist() == [0] * len(Q.STATISTICS)
    assert got[2, 0] == 0


def test_pairs_are_learned():
    """Good only where just one of two words is there: no sum of weights tells that."""
    rng = random.Random(4)
    fill = [f"w{k}" for k in range(200)]
    texts, labels = [], []
    for _ in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(fill) for _ in range(6)] + ["alpha"] * (3 * a) + ["omega"] * (3 * b)
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(a != b))
    size = Q.BUCKETS + len(Q.STATISTICS) * Q.INTERVALS
    m = Q.train(*found(texts[:1200]), np.array(labels[:1200]), size)
    p = m.scores(*found(texts[1200:]))
    assert ((p >= 0.5) == np.array(labels[1200:])).mean() >= 0.9


def tables(spark, n=600):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        good = k % 3 > 0
        text = " ".join(words) + "." if good else (" ".join(w + rng.choice(["$$$", "###"]) for w in words), "\n".join(" | ".join(words[s : s + 4]) for s in range(0, len(words), 4)))[k % 2]
        docs.append((k, text, "en", "s", len(text)))
        if k % 5:
            labels.append((k, int(good), 0))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_rows_and_bounds(spark):
    docs, labels = tables(spark)
    got = Q.score(docs, Q.fit(docs, labels, ~Q.held_out(), ("n_chars",)), ("n_chars",), Q.held_out()).collect()
    assert len(got) == 600
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    # fewer features than the sample has: a smaller sample, by the same draw
    small = Q.fit(docs, labels, ~Q.held_out(), (), most=9000)
    got = Q.score(docs, small).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got) >= 0.9 * len(got)


def test_hard_tables(spark, tmp_path):
    docs, labels = tables(spark, 120)
    hard = spark.createDataFrame(documents(), DOCS).withColumn("doc_id", F.col("doc_id") + 1000)
    both = docs.unionByName(hard).withColumn("Score", F.lit("x")).withColumn("good", F.lit(0))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    noted = [(1001, 1, 0), (1001, 0, 0), (None, 1, 0), (1002, None, 0), (99_999, 1, 1)]
    labels.unionByName(spark.createDataFrame(noted, LABELS)).withColumn("text", F.lit("clash")).write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.query(spark, str(tmp_path))
    rows = got.collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, Q.query(spark, str(tmp_path)).collect()))
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(r.score)
    # texts that are alike score alike: 1061, 1063 and 1062 have no words
    assert texts[1060] == texts[1063]


def test_no_labels_and_one_kind(spark):
    docs, labels = tables(spark, 30)
    none = Q.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    ones = Q.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert all(r.score > 0.999 for r in Q.score(docs, ones).collect())
    assert Q.score(docs.limit(0), none).count() == 0
    assert Q.fit(docs.limit(0), labels, F.lit(True)).bias == 0
