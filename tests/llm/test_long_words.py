"""op9's common words may be of any length."""

import random

import numpy as np

from helpers import DOCS
from threadloom.llm import quality


def _words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(5, 11))) for _ in range(n)]


def test_a_language_of_long_words_only(spark):
    rng, words, strange = random.Random(9), _words(9, 30), _words(10, 150)
    rows = [(k, " ".join(rng.choice(words) for _ in range(120)), "ru", None, 0) for k in range(120)]
    rows += [(500, " ".join(strange), "ru", None, 0)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[k].kept for k in range(120))
    assert not out[500].kept and out[500].char_distance < quality.MAX_CHAR_DISTANCE < 0.8 < out[500].word_distance


def test_counts_do_not_depend_on_when_they_are_sent(spark, monkeypatch):
    rows = [(k, " ".join(_words(k, 90)), ("ru", "uk")[k % 2], None, 0) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    whole = quality.references(df)
    monkeypatch.setattr(quality, "HELD", 4)
    parts = quality.references(df)
    for lang in ("ru", "uk", None):
        assert all(np.array_equal(a, b) for a, b in zip(whole[lang], parts[lang], strict=True)) and len(whole[lang][1]) == quality.COMMON


def test_reference_without_words(spark):
    rows = [(1, " ".join(_words(1, 60)), "ru", None, 0)]
    refs = {None: (np.full(quality.CLASSES, 1 / quality.CLASSES), np.zeros(0, np.uint64), np.array([1.0]))}
    assert quality.quality(spark.createDataFrame(rows, DOCS), refs).first().word_distance == 0
