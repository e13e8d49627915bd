"""Ranked search against scores by definition, with lists cut into many shards, ties, repeats and hard tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, documents, vocabulary
from pyspark.sql import functions as F

from threadloom.llm import lexical

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t, *_ in docs) if t]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(x for _, c, _ in held for x in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x, times in asked.items() if x in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(n=400, seed=2):
    rng, words = random.Random(seed), vocabulary(seed, 120)
    # some words are in nearly all texts, many texts are alike
    text = lambda: " ".join(words[min(119, int(rng.expovariate(0.08)))] for _ in range(rng.randint(1, 60)))
    docs = [(k, text(), None, None, 0) for k in range(n)]
    docs += [(n + k, docs[7][1], None, None, 0) for k in range(40)] + [docs[3], docs[3], (None, docs[7][1], None, None, 0)]
    items = [(k, text()) for k in range(25)] + [(3, docs[7][1]), (None, docs[7][1].upper()), (50, None), (51, " -- "), (52, "nowhere-found"), (53, words[0] + " " + words[0])]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 500_000), (500, 60)])
def test_ranks_by_definition(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(lexical.blocks, "__defaults__", ("item_id", "text", block))
    docs, items = corpus()
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS))
    assert rows(got) == ranked(docs, items)


def test_hard_texts_and_clashing_columns(spark, tmp_path):
    docs = documents()
    items = [(k, t) for k, (_, t, *_) in enumerate(docs[::9])] + [(900, "日本 ONE two"), (901, "x" * 3000)]
    extra = {"rank": F.lit(1), "Score": F.lit("s"), "item_id": F.lit(5)}
    spark.createDataFrame(docs, DOCS).withColumns(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(3)).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert rows(lexical.query(spark, str(tmp_path))) == ranked(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(20)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert lexical.search(d.limit(0), i).count() == 0
    assert lexical.search(d, i.limit(0)).count() == 0
    assert lexical.search(d.withColumn("text", F.lit(None).cast("string")), i).count() == 0


def test_lists_are_left_early():
    """Of a rare word's few documents and a common word's many, the common list is not read to its end."""
    rng = np.random.default_rng(0)
    n = 5000
    lengths = np.full(n, 2)
    terms_ = np.tile([0, 1], n)
    values = np.column_stack([rng.integers(1, 50, n), np.where(np.arange(n) < 12, 10_000, 0) + rng.integers(1, 3, n)]).ravel()
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), np.concatenate([[0], np.cumsum(lengths)]), terms_, values, 2)
    looked = []
    scores = shard.scores
    shard.scores = lambda docs, times: looked.append(len(docs)) or scores(docs, times)
    docs, found = shard.best(np.array([0, 1]), np.array([1, 1]), 1, 10)
    every = values.reshape(n, 2).sum(1)
    assert sorted(found.tolist())[-10:] == sorted(every.tolist())[-10:]
    assert sum(looked) < 200
