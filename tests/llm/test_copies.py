"""Exact, near and substring duplicates against brute force, on documents that are hard on them."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import DOCS, documents, near, rows_of, sha, substring
from threadloom.llm import exact_dedup, near_dedup, quality, substring_dedup
from threadloom.llm.frames import SPACES


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column with a name that the operators use themselves
    return spark.createDataFrame(documents(), DOCS).withColumns({"kept": F.lit("own"), "row_key": F.lit(1)}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring(docs):
    out = substring_dedup.substring_dedup(docs).withColumn("h", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "h") == substring(documents())
    for r in out.collect():
        assert r.n_removed == sum(s["end"] - s["start"] for s in r.spans)


@pytest.mark.parametrize("message", [1, 64, 100_000])
def test_substring_in_many_chunks(docs, monkeypatch, message):
    monkeypatch.setattr(substring_dedup, "CHUNK", 2000)
    monkeypatch.setattr(substring_dedup, "MESSAGE", message)
    out = substring_dedup.substring_dedup(docs).withColumn("h", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "h") == substring(documents())


@pytest.mark.parametrize("width", [1, 2, 5])
def test_near(docs, width):
    out = near_dedup.near_duplicates(docs, width)
    assert rows_of(out, "doc_id", "n_shingles", "component_id", "kept") == near(documents(), width)


def test_near_in_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCKS", (2, 4))
    monkeypatch.setattr(near_dedup, "BLOCK_GROWTH", 1)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "HUB_PAIRS", 3)
    assert rows_of(near_dedup.near_duplicates(docs, 2), "doc_id", "n_shingles", "component_id", "kept") == near(documents())


def test_near_chain(spark):
    """Each text is near the next one only, so links lead through many texts to the smallest id."""
    words = [f"w{k}" for k in range(400)]
    rows = [(100 - k, " ".join(words[8 * k : 8 * k + 160]), None, None, 0) for k in range(30)]
    assert rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 2), "doc_id", "n_shingles", "component_id", "kept") == near(rows)


def test_one_of_each_near_group_stays(docs):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = near(documents(), near_dedup.SHINGLE)
    want = collections.Counter(i for i, n, c, k in groups if k and n) + collections.Counter(i for i, n, c, k in groups if not n)
    want[70] = min(want[70], 1)
    got = collections.Counter(r.doc_id for r in kept.collect())
    assert got == want


def test_least_matches_prunes_little_at_the_threshold():
    least = near_dedup.least_matches(0.8, 1e-7)
    assert least == sorted(least) and least[-1] < 0.8 * near_dedup.HASHES


def thue_morse(a, b, n):
    """A row of n signs that sums of powers cannot tell from the row with a and b exchanged."""
    return [(a, b)[bin(k).count("1") % 2] for k in range(n)]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_that_sums_of_powers_confuse(spark, n):
    """Texts that differ in such words share no window and no shingle that holds them."""
    one, other = "".join(thue_morse("a", "b", n)), "".join(thue_morse("b", "a", n))
    rest = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join([*rest[:30], one, *rest[30:]]), None, None, 0), (2, " ".join([*rest[:30], other, *rest[30:]]), None, None, 0), (3, one, None, None, 0), (4, other, None, None, 0)]
    rows += [(5, " ".join([one, *rest[:7], "between", other, *rest[:7]]), None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = substring_dedup.substring_dedup(df).withColumn("h", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "h") == substring(rows)
    assert rows_of(near_dedup.near_duplicates(df, 2), "doc_id", "n_shingles", "component_id", "kept") == near(rows)
    assert all(r.n_repeat_words == 0 for r in quality.quality(df).collect())


def test_rows_of_words_that_sums_of_powers_confuse(spark):
    rows = [(k, " ".join(thue_morse(*pair, 4096)[k : k + 2000]), None, None, 0) for k, pair in ((1, ("x", "y")), (33, ("y", "x")))]
    df = spark.createDataFrame(rows, DOCS)
    out = substring_dedup.substring_dedup(df).withColumn("h", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "h") == substring(rows)


def test_templated_texts_meet_in_bounded_groups(spark):
    """Texts of one template that all share buckets and of which none is near enough: every group stays small, none is linked."""
    rng = random.Random(12)
    template = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(template + [f"d{rng.randrange(10**9)}" for _ in range(22)]), None, None, 0) for k in range(1500)]
    rows += [(5000 + k, " ".join(rows[k][1].split()[:-1] + ["end"]), None, None, 0) for k in range(0, 1500, 50)]
    df = spark.createDataFrame(rows, DOCS).repartition(8)
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 2).collect()}
    assert out == {i: i - 5000 if i >= 5000 else i for i, *_ in rows}


def test_groups_of_a_neighbourhood_are_bounded_and_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCKS", (4, 8))
    near_rows = [(0, c, 0 if c % 3 == 0 else c) for c in range(90)] + [(7, c, 7) for c in range(40)]
    groups = collections.defaultdict(list)
    for r in near_dedup.dealt(spark.createDataFrame(near_rows, "hub_comp long, cid long, comp long")).collect():
        groups[r.hub_comp, r.i, r.j].append(r)
    assert max(len(g) for g in groups.values()) <= 40
    met = collections.Counter()
    for (hub, i, j), g in groups.items():
        for a in g:
            for b in g:
                if a.cid < b.cid and (i == j or a.left != b.left):
                    met[hub, a.cid, b.cid] += 1
    comp = {(h, c): k for h, c, k in near_rows}
    want = {(0, a, b) for a in range(90) for b in range(a + 1, 90) if comp[0, a] != comp[0, b]}
    assert want <= set(met) and set(met.values()) == {1}


def exact(rows):
    """keep_id, group_size and digest of each row, and how many rows of each doc_id and digest stay."""
    text = lambda t: re.sub(SPACES, " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[text(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[text(t)], len(groups[text(t)]), sha(text(t))) for i, t, *_ in rows), key=repr), collections.Counter((keep[t], sha(t)) for t in groups)


@pytest.mark.parametrize("bits, heavy", [(exact_dedup.ARRAY_BITS, exact_dedup.HEAVY), (64, exact_dedup.HEAVY), (64, 10), (exact_dedup.ARRAY_BITS, 10**9)])
def test_exact(docs, bits, heavy, monkeypatch):
    """All columns, with a filter of the usual size, one so full that it lets most rows through, and groups that are joined either way."""
    monkeypatch.setattr(exact_dedup, "ARRAY_BITS", bits)
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    rows, stay = exact(documents())
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == [*(c for c in docs.columns if c != "kept"), *exact_dedup.ADDED]
    assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == rows
    assert collections.Counter((r.doc_id, r.text_sha256) for r in out.collect() if r.kept) == stay


def test_copies_go_and_all_columns_stay(spark):
    names = ["kept", "keep_id", "group_size", "text_sha256", "_maybe", "_kept", "_page0", "_ties", "sha", "id"]
    rows = [(k, f"text {k % 4}", *(f"{n} {k}" for n in names)) for k in range(12)] + [(3, "text 3", *("again" for _ in names)), (None, None, *names), (None, "", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and sorted((r[0] for r in got), key=repr) == [0, 1, 2, 3, None]


def test_empty(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
