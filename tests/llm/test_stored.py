"""Results that are still lazy stay readable whatever else runs, and no table is left when work ends."""

import os

import pytest

from threadloom import tables
from threadloom.llm import exact_dedup, mixing

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_interleaved_results_and_a_pipeline(spark):
    import corpus_pipeline

    shared = tables.shared_dir(spark)
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    with tables.scope(spark):
        one, two = exact_dedup.query(spark, DIR), mixing.query(spark, DIR)
        n = one.count(), two.count()
        encoded = corpus_pipeline.run(spark, DIR)
        again = exact_dedup.query(spark, DIR)
        assert encoded.count() > 0
        assert (one.count(), two.count(), again.count()) == (*n, n[0])
        # of the pipeline's own, only what its result reads is left
        assert [p for p in os.listdir(shared) if p.startswith("pipeline-") and p not in before] == [p for p in os.listdir(shared) if p.startswith("pipeline-mixing") and p not in before]
    assert set(os.listdir(shared)) - before == set()
