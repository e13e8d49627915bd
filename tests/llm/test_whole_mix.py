"""The registered result of op8 is the curriculum itself."""

import os

import pytest

from threadloom.llm import mixing

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sources of 300 equal documents, and rows without a word, which are never taken."""
    at = str(tmp_path_factory.mktemp("mix"))
    rows = [(k, "w " * 10, f"s{k % 3}") for k in range(900)] + [(1000, None, "s0"), (1001, "", "s1"), (None, " ", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def test_documents_come_in_the_order_of_their_positions(spark, folder):
    out = mixing.query(spark, folder).collect()
    at = [r.first_position for r in out if r.first_position is not None]
    assert at == sorted(at) and all(0 <= t <= 1 for t in at) and all(r.first_position is None and r.taken == 0 for r in out[len(at) :])
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [*range(900), 1000, 1001] and len(out) == 903
    assert all(r.n_copies == 1 or r.first_position < r.last_position for r in out if r.taken)


def test_copies_come_in_the_order_of_their_positions(spark, folder):
    mixed = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"))
    out = mixing.scheduled(mixed).collect()
    at = [r.position for r in out if r.position is not None]
    assert at == sorted(at) and all(r.position is None and r.words == 0 for r in out[len(at) :])
    words, taken = {}, {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
        taken[r.doc_id] = r.taken
    assert words == taken and set(taken) == {*range(900), 1000, 1001, None}


def test_a_slope_shows_in_the_registered_rows(spark, folder, monkeypatch):
    rows = lambda: {r.doc_id: r.first_position for r in mixing.query(spark, folder).collect()}
    before = rows()
    real = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs: real(docs, slopes=(0.5, 0.0, -0.5)))
    after = rows()
    assert sum(before[k] != after[k] for k in before) > 500


def test_schedules_show_in_the_result(spark, folder):
    out = mixing.scheduled(mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"))).collect()
    for k, a in enumerate(mixing.SLOPES):
        mine = [(r.position, r.words, r.target) for r in out if r.words and r.doc_id % 3 == k]
        for t in (0.25, 0.5, 0.75):
            assert abs(sum(w for at, w, _ in mine if at <= t) - mine[0][2] * (t + a * (t * t - t))) <= 20


def _agree(spark, folder):
    import duckdb

    con = duckdb.connect()
    at = folder + "/documents.parquet"
    con.execute(f"create view documents as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    assert sorted(map(tuple, mixing.query(spark, folder).collect()), key=repr) == sorted(con.execute(mixing.SQL).fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_documents_agree_with_duckdb(spark):
    _agree(spark, DIR)


def test_repeated_rows_and_rows_without_id_agree_with_duckdb(spark, tmp_path):
    rows = [(None, "a b c d", "s1")] * 300 + [(7, "x y z", "s2")] * 50 + [(k % 30, "w " * (k % 9), f"s{k % 3}") for k in range(400)] + [(None, None, None)] * 5
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    _agree(spark, str(tmp_path))


def test_repeated_rows_take_turns(spark, monkeypatch):
    """Rows alike in doc_id and text, but not in all columns, deal the copies of all of them, the same on every run; no column is lost."""
    monkeypatch.setattr(mixing, "RUN", 7)
    names = ["_key", "_p", "_c", "_rows", "_turn", "row", "id", "key", "copies", "turn"]
    rows = [(k % 5 if k % 5 else None, f"some words {k % 5}", "s1", *(f"{n} {k // 2}" for n in names)) for k in range(120)] + [(99, None, "s0", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mix_documents(df.repartition(4))
    assert out.columns == df.columns
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted((tuple(r) for r in mixing.mix_documents(df.repartition(7)).collect()), key=repr)
    assert set(got) <= set(rows)
    want = {}
    for r in mixing.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + sum(2 * p["words"] >= r.size for p in r.positions)
    count = {}
    for r in got:
        count[r[0]] = count.get(r[0], 0) + 1
    assert count == {k: n for k, n in want.items() if n}
