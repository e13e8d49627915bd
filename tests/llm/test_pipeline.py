"""The pipeline's stages against plain versions of them, each on its own input, and all in a row."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

from helpers import WORD, shingle_set
from threadloom.llm import toxicity
from threadloom.llm.frames import SPACES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    before, after = seen["toxicity"]
    every = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(every, spark.read.parquet(f"{DIR}/labels.parquet"), ~toxicity.held_out())
    rejected = {r.doc_id for r in toxicity.score(every, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - rejected

    before, after = seen["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(SPACES, " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())

    before, after = seen["near_dedup"]
    ids = [r.doc_id for r in before]
    sets = {r.doc_id: shingle_set(r.text, 5) for r in before}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    assert sorted(r.doc_id for r in after) == sorted(i for i in ids if find(i) == i)

    before, after = seen["mixing"]
    copies = collections.Counter(r.doc_id for r in after)
    assert set(copies) <= {r.doc_id for r in before} and max(copies.values()) <= 2
    sizes, given = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
        given[r.source] += copies[r.doc_id] * len(WORD.findall(r.text))
    longest = max(len(WORD.findall(r.text)) for r in before)
    order = sorted(sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * weights[s]) for s in order) < 1.5 * sum(sizes.values()) else (lo, mid)
    assert all(abs(given[s] - min(2 * sizes[s], lo * weights[s])) <= longest for s in order)

    before, after = seen["bpe"]
    from tokenizers import Tokenizer

    from threadloom.llm.bpe import default_path

    t = Tokenizer.from_file(default_path())
    want = collections.Counter((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in after) == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_run(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "lang", "source", "n_chars"]
    assert out.count() > 0 and out.where(F.length("token_ids") != F.col("n_tokens") * 4).isEmpty()


def test_shingle_sets_agree():
    assert shingle_set("A b\tC a b") == {("a", "b"), ("b", "c"), ("c", "a")}
