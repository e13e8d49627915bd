"""Queries of kernels take every row of their table, whatever its id."""

import pytest
from pyspark.sql import functions as F

from threadloom import catalog
from threadloom.plans import queries


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Customers with ids in the hundreds, thousands and millions."""
    at = str(tmp_path_factory.mktemp("far"))
    keys = [1, 200, 201, 600, 601, 1500, 15_000, 3_000_001]
    rows = spark.createDataFrame([(k, ("BUILDING", "MACHINERY")[i % 2]) for i, k in enumerate(keys)], "c_custkey long, c_mktsegment string")
    rows.write.parquet(f"{at}/customer.parquet")
    return at, keys


def test_every_region_is_digitized(spark, far):
    at, keys = far
    out = queries.QUERIES["digitize_designs"](spark, at).collect()
    want, got = {}, {}
    for k in keys:
        want[k % 50] = want.get(k % 50, 0) + 1
    for r in out:
        got[r.design_id] = got.get(r.design_id, 0) + r.objects
    assert got == want
    assert all(r.trims_in_objects == 0 and r.within_limits for r in out)


def test_every_sketch_is_compiled(spark, far):
    at, keys = far
    out = queries.QUERIES["sketch_compile"](spark, at)
    assert sorted(r.doc for r in out.collect()) == keys
    assert out.where((F.col("blocks") != 2) | (F.col("elements") != 2)).isEmpty()


def test_a_label_is_cut_by_its_operator_alone(spark, tmp_path):
    text = "é" * 50 + " x" * 50
    spark.createDataFrame([(1, text, "some source")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.QUERIES["ascii_label"](spark, str(tmp_path))
    assert out.first().label == "_" * 16
    assert "substring(text" not in out._jdf.queryExecution().optimizedPlan().toString()
