"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian pruning, exact verification.

A document is its set of distinct shingles of `width` words (SHINGLE unless told otherwise), A-Z folded; a shorter text is one shingle; a text
without words has an empty set and is linked with nothing.  Documents are linked when 100 * intersection >= SIMILARITY * union, on full sets.

1. Documents with equal sets form a class, which goes on as one: two digests of the set have to agree, made of two hashes of each word
   that share nothing but the word, 128 bits in all.
2. Each class has HASHES minimum hashes; BANDS bands of ROWS of them are keys of buckets.  In a bucket every class is paired with
   one hub, that of the smallest doc_id (copies come after their originals), so a bucket of n makes n - 1 pairs.
3. Pairs whose sizes alone forbid the similarity go.  For the rest signatures (a byte of each minimum hash) are compared BATCH by
   BATCH: a pair goes once the posterior probability that it is similar, under a uniform prior, falls below MISS.
4. What is left is verified on the full sets, from the texts.  Links are joined to components.
5. Buckets that still hold several components are gone through once more, all buckets whose hubs are in one component together, as a
   neighbourhood.  Its classes are dealt to blocks, those of the hub's component apart from the others, and each pair of blocks that can
   hold a link is a group of its own, of a bounded number of ids and sketches (SKETCH bins of one permutation).  A group compares its
   pairs across components in growing parts of the sketches, pruned as before, and says only which classes have a partner left.
   Their texts alone are fetched, to the groups in which they have one, and compared there on the full sets, the most similar first,
   until two components are linked or no pair is left.  No pair is ever sent anywhere.

A pair at the threshold shares no bucket with probability (1 - 0.8**4)**32, about 5e-8.

Cases: null text counts as empty; a text of any length is one set, and a batch by itself where it is longer than a slice; rows that
share a doc_id, and rows without one, are told apart by their sets; a null doc_id sorts after all others; repeated rows and ties are
in one class; an empty table gives an empty result; extra columns are ignored, and `drop_near_duplicates` hands them on, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forget, free_name, partitions, small_batches, stored
from .words import Chunk, mix, slices

SHINGLE = 5
SIMILARITY = 80
HASHES, BANDS, ROWS = 128, 32, 4
BATCH = 16
MISS = 1e-5
#: Blocks of a neighbourhood of n classes hold about BLOCK_GROWTH * sqrt(n) of them, and from BLOCKS[0] to BLOCKS[1].
BLOCKS, BLOCK_GROWTH = (256, 8192), 8
#: Bins of a sketch, and after how many of them pairs are compared.
SKETCH, LOOKS = 512, (64, 128, 256, 512)
#: Pairs with one hub that are verified in one go, about.
HUB_PAIRS = 500
LINKS = "a long, b long"
#: A list of classes up to this length is broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _hashed(c: Chunk, width: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats too, and the documents they are in; a document of fewer words is one shingle, the last."""
    h, doc, n = c.hashes(family=family), c.doc_of_word(), c.n_words
    combined = h.copy()
    for k in range(1, width):
        rest = np.zeros_like(h)
        rest[: len(h) - k] = h[k:]
        combined = mix(combined * np.uint64(0x9E3779B97F4A7C15) + rest)
    place = np.arange(len(h)) - c.word_at[doc]
    whole = place + width <= n[doc]
    short = np.flatnonzero((n > 0) & (n < width))
    one = h[c.word_at[:-1][short]].copy()
    for k in range(1, width - 1):
        more = n[short] > k
        one[more] = mix(one[more] * np.uint64(0xD6E8FEB86659FD93) + h[c.word_at[:-1][short][more] + k])
    return np.concatenate([combined[whole], mix(one + np.uint64(1))]), np.concatenate([doc[whole], short])


def _distinct(c: Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order within their documents, where each document's begin (one more), and their places in _hashed."""
    s, d = _hashed(c, width, 0)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(c.n_docs + 1)), order[new]


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, in order within it: their hashes, and where each document's begin (one more)."""
    return _distinct(Chunk(buf, offsets, fold=True), width)[:2]


def signatures(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum hashes of documents with a shingle: a row for each hash."""
    full = at[:-1][at[:-1] < at[1:]]
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(full)), np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(x * _A[k] + _B[k], full)
    return out


FEATURES = "doc_id long, row_key binary, n long, d1 long, d2 long, bands array<long>, sig binary"


def features(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    def run(batches):
        for batch, buf, offsets in slices(batches):
            c = Chunk(buf, offsets, fold=True)
            s, at, places = _distinct(c, width)
            n = np.diff(at)
            full = np.flatnonzero(n)
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands, sigs = [None] * len(n), [None] * len(n)
            if len(full):
                d1[full] = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
                d2[full] = np.add.reduceat(mix(_hashed(c, width, 1)[0][places] ^ np.uint64(0x14057B7EF767814F)), at[:-1][full])
                m = signatures(s, at)
                keys = np.empty((BANDS, len(full)), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[b * ROWS + r])
                    keys[b] = key
                keys, small = keys.T.astype(np.int64), np.ascontiguousarray((m >> np.uint32(13)).astype(np.uint8).T)
                for k, doc in enumerate(full):
                    bands[doc], sigs[doc] = keys[k], small[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(d1.astype(np.int64)), pa.array(d2.astype(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], [x.split()[0] for x in FEATURES.split(", ")])

    return _keyed(docs).mapInArrow(run, FEATURES)


def _row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Sixteen bytes; rows with the same are alike."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text).cast("string"), F.lit("")))))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row_key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key().alias("row_key"))


def least_matches(similarity: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matches with which P(similar | matches) >= miss, for bytes that agree by chance 1 in 256."""
    x = (np.arange(200_000) + 0.5) / 200_000
    lo = similarity + (1 - similarity) / 256
    out = []
    for k in range(batch, hashes + 1, batch):
        least = 0
        for m in range(k + 1):
            log = m * np.log(x) + (k - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= lo].sum() / p.sum() >= miss:
                least = m
                break
        out.append(least)
    return out


def _close(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature matrices that no batch rules out, and their matches."""
    alive, total = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        total = total + (a[alive, part] == b[alive, part]).sum(1)
        keep = total >= m
        alive, total = alive[keep], total[keep]
    return alive, total


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), HASHES)


def prune(pairs: DataFrame, classes: DataFrame, miss: float) -> DataFrame:
    """Of pairs (a, b), those that sizes and signatures let through."""
    thin = classes.select("cid", "n", "sig")
    side = lambda k: thin.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    least = least_matches(SIMILARITY / 100, miss)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                alive, _ = _close(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Of pairs (a, b), those of which the full sets are similar enough.  Pairs of one b are dealt to groups of about HUB_PAIRS; a group has
    b's text once, then those of its partners, and streams through its task in that order."""
    need = stored(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(classes.select("cid", "row_key"), "cid"))
    few = need.count() <= BROADCAST_ROWS
    found = _keyed(docs).select("row_key", "text").join(F.broadcast(need) if few else need, "row_key")

    def shrink(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], ["cid", "size", "body"])

    # rows that are alike come once
    texts = stored(found.select("cid", "text").mapInArrow(shrink, "cid long, size long, body binary").groupBy("cid").agg(F.max(F.struct("size", "body")).alias("_t")).select("cid", "_t.*"))
    forget(need)
    # hubs of many pairs, in a table of known size, so that pairs need not meet by hub to learn how theirs are dealt
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    large = stored(counts.where(F.col("n") > HUB_PAIRS).select("b", F.ceil(F.col("n") / HUB_PAIRS).cast("int").alias("deals")))
    deals = F.coalesce("deals", F.lit(1))
    one = pairs.join(large, "b", "left").select("b", F.pmod(F.xxhash64("a"), deals).cast("int").alias("deal"), F.lit(1).alias("kind"), F.col("a").alias("cid"))
    hub = counts.join(large, "b", "left").select("b", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.lit(0).alias("kind"), F.col("b").alias("cid"))
    rows = one.unionByName(hub).join(texts, "cid").select("b", "deal", "kind", "cid", "size", "body")
    rows = rows.repartition(partitions(docs.sparkSession), "b", "deal").sortWithinPartitions("b", "deal", "kind")

    def run(batches):
        codec, of, theirs = pa.Codec("zstd"), None, None
        for batch in batches:
            hubs, kinds, cids, sizes = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            out = []
            for k in range(batch.num_rows):
                data = codec.decompress(batch.column(5)[k].as_py(), sizes[k], asbytes=True) if sizes[k] else b""
                own, _ = shingles(np.frombuffer(data, np.uint8), np.array([0, len(data)]), width)
                if kinds[k] == 0:
                    of, theirs = hubs[k], own
                    continue
                if of != hubs[k]:
                    raise ValueError("a hub's text has to come before its partners")
                common = len(np.intersect1d(own, theirs, assume_unique=True))
                if 100 * common >= SIMILARITY * (len(own) + len(theirs) - common):
                    out.append(k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([cids[k] for k in out], pa.int64()), pa.array([hubs[k] for k in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, LINKS)


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every class with a link; comp is the smallest cid reachable.  Labels are lowered along links, then each
    label is replaced by its own label, until nothing changes."""
    ends = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(ends.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        before = labels
        near = ends.join(labels, ends.b == labels.cid).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.cid == near.a, "left").select("cid", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        jump = labels.select(F.col("cid").alias("new"), F.col("comp").alias("jumped"))
        moved = stored(lower.join(jump, "new", "left").select("cid", F.least("new", F.coalesce("jumped", "new")).alias("comp"), (F.least("new", F.coalesce("jumped", "new")) < F.col("comp")).alias("moved")))
        done = moved.where("moved").isEmpty()
        forget(before)
        labels = moved.drop("moved")
        labels.stored_at = moved.stored_at
        if done:
            forget(ends)
            return labels


#: The order of classes: by their smallest doc_id, none last.
RANK = "struct(rep is null, rep, cid)"


def sketch(s: np.ndarray) -> np.ndarray:
    """Of distinct shingles in order: in each bin, a byte of the first that falls into it, 0 for none."""
    out = np.zeros(SKETCH, np.uint8)
    bins = (mix(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH)).astype(np.int64)
    used, first = np.unique(bins, return_index=True)
    out[used] = (mix(s[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def least_of_bins(similarity: float, miss: float) -> np.ndarray:
    """Of each number of bins that either of two sketches fills: the fewest agreements with P(similar | agreements) >= miss."""
    x = (np.arange(20_000) + 0.5) / 20_000
    a, b, high = np.log(x), np.log1p(-x), x >= similarity
    out, m = np.zeros(SKETCH + 1, np.int64), 0
    for k in range(1, SKETCH + 1):
        while True:
            log = m * a + (k - m) * b
            p = np.exp(log - log.max())
            if m >= k or p[high].sum() >= miss * p.sum():
                break
            m += 1
        out[k] = m
    return out


def sketches(need: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cid, sketch, size, body) of classes (cid, row_key): body is the text of one of their rows, compressed."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            made = [sketch(shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]), width)[0]).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], ["cid", "sketch", "size", "body"])

    few = need.count() <= BROADCAST_ROWS
    found = _keyed(docs).select("row_key", "text").join(F.broadcast(need) if few else need, "row_key")
    made = found.select("cid", "text").mapInArrow(run, "cid long, sketch binary, size long, body binary")
    return made.groupBy("cid").agg(F.max(F.struct("sketch", "size", "body")).alias("_t")).select("cid", "_t.*")


def neighbourhoods(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(hub_comp, cid, comp): classes of the buckets that hold several components, by the component of the hub."""
    placed = members.withColumn("rank", F.expr(RANK)).join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    buckets = placed.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", "rank").alias("hub_comp"))
    # with two members the hub has met the other one
    mixed = buckets.where("k > 2 and lo <> hi").select("band", "hub_comp")
    return placed.select("band", "cid", "comp").join(mixed, "band").select("hub_comp", "cid", "comp").distinct()


def dealt(near: DataFrame) -> DataFrame:
    """(hub_comp, i, j, left, cid, comp): a row for each group that a class is in.  Others than the hub's component lie in blocks
    0, 1, ... and meet each other, i <= j, and all blocks -1, -2, ... of the hub's component, which never meet each other."""
    minor = F.col("comp") != F.col("hub_comp")
    sizes = near.groupBy("hub_comp").agg(F.count(F.lit(1)).alias("_n"), F.count_if(minor).alias("_m"))
    block = F.greatest(F.lit(BLOCKS[0]), F.least(F.lit(BLOCKS[1]), F.lit(BLOCK_GROWTH) * F.sqrt("_n")))
    # at least one block of each side, so that a sequence has an end
    sizes = sizes.select("hub_comp", F.greatest(F.lit(1), F.ceil(F.col("_m") / block)).cast("int").alias("_minor"), F.greatest(F.lit(1), F.ceil((F.col("_n") - F.col("_m")) / block)).cast("int").alias("_major"))
    rows = near.join(sizes, "hub_comp").withColumn("_own", F.pmod(F.xxhash64("cid", F.lit("block")), F.when(minor, F.col("_minor")).otherwise(F.col("_major"))).cast("int"))
    pair = lambda i, j, left: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), left.alias("left"))
    # in a group of two blocks, the left one is the smaller; a block with itself is left and right at once
    others = F.transform(F.sequence(F.lit(0), F.col("_minor") - 1), lambda k: pair(F.col("_own"), k, F.col("_own") <= k))
    majors = F.transform(F.sequence(F.lit(1), F.col("_major")), lambda k: pair(-k, F.col("_own"), F.lit(False)))
    mine = F.transform(F.sequence(F.lit(0), F.col("_minor") - 1), lambda k: pair(-1 - F.col("_own"), k, F.lit(True)))
    return rows.select("hub_comp", "cid", "comp", F.explode(F.when(minor, F.concat(others, majors)).otherwise(mine)).alias("_g")).select("hub_comp", "_g.*", "cid", "comp")


GROUP = ["hub_comp", "i", "j"]
FOUND = "hub_comp long, i int, j int, cid long"


class _Group:
    """A pair of blocks: ids, components, sizes and sketches of its classes, and which pairs of them may be linked."""

    def __init__(self, table: pa.Table, least: np.ndarray):
        order = np.argsort(table["cid"].to_numpy())
        self.rows, self.least = order, least
        self.cid, self.comp, self.n = (table[k].to_numpy()[order] for k in ("cid", "comp", "n"))
        self.left = table["left"].to_numpy().astype(bool)[order]
        self.same = len(order) > 0 and table["i"][0].as_py() == table["j"][0].as_py()
        self.bins = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(order), SKETCH)[order]

    def partners(self):
        """Of each class on one side: it, those on the other that no look rules out, the most similar first."""
        lefts = np.flatnonzero(self.left)
        by_size = lefts[np.argsort(self.n[lefts], kind="stable")]
        sizes = self.n[by_size]
        for j in range(len(self.cid)) if self.same else np.flatnonzero(~self.left):
            lo = np.searchsorted(sizes, -(-SIMILARITY * self.n[j] // 100))
            hi = np.searchsorted(sizes, 100 * self.n[j] // SIMILARITY, "right")
            i = by_size[lo:hi]
            i = i[(self.comp[i] != self.comp[j]) & ((i < j) | (not self.same))]
            agree, filled, at = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), 0
            for look in LOOKS:
                if not len(i):
                    break
                x, y = self.bins[i, at:look], self.bins[j, at:look]
                agree = agree + ((x == y) & (x > 0)).sum(1)
                filled = filled + ((x > 0) | (y > 0)).sum(1)
                at = look
                keep = agree >= self.least[filled]
                i, agree, filled = i[keep], agree[keep], filled[keep]
            if len(i):
                yield j, i[np.argsort(-agree / np.maximum(filled, 1), kind="stable")]


def across(members: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, width: int, miss: float) -> DataFrame:
    """Links (a, b) between components, verified, that join what buckets still hold apart."""
    near = stored(neighbourhoods(members, comps))
    need = stored(near.select("cid").distinct().join(classes.select("cid", "row_key"), "cid"))
    made = stored(sketches(need, docs, width).join(classes.select("cid", "n"), "cid"))
    least = least_of_bins(SIMILARITY / 100, miss)
    rows = dealt(near).join(made.select("cid", "n", "sketch"), "cid").select(*GROUP, "left", "cid", "comp", "n", "sketch")

    def look(table: pa.Table) -> pa.Table:
        group, has = _Group(table, least), np.zeros(table.num_rows, bool)
        for j, i in group.partners():
            has[i] = has[j] = True
        at = np.flatnonzero(has)
        key = [pa.array([table[k][0].as_py()] * len(at), table[k].type) for k in GROUP]
        return pa.Table.from_arrays([*key, pa.array(group.cid[at])], [*GROUP, "cid"])

    def confirm(table: pa.Table) -> pa.Table:
        group = _Group(table, least)
        bodies, size = table["body"].take(pa.array(group.rows)), table["size"].to_numpy()[group.rows]
        codec, sets, parent, out = pa.Codec("zstd"), {}, {}, []

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        def set_of(k):
            if k not in sets:
                if len(sets) >= 1000:
                    sets.clear()
                data = codec.decompress(bodies[int(k)].as_py(), int(size[k]), asbytes=True) if size[k] else b""
                sets[k] = shingles(np.frombuffer(data, np.uint8), np.array([0, len(data)]), width)[0]
            return sets[k]

        cid, comp, n = group.cid, group.comp, group.n
        for j, i in group.partners():
            for x in i:
                p, q = root(int(comp[x])), root(int(comp[j]))
                if p == q:
                    continue
                common = len(np.intersect1d(set_of(x), set_of(j), assume_unique=True))
                if 100 * common >= SIMILARITY * (n[x] + n[j] - common):
                    parent[max(p, q)] = min(p, q)
                    out.append((int(max(cid[x], cid[j])), int(min(cid[x], cid[j]))))
        return pa.Table.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    open_ = stored(rows.groupBy(*GROUP).applyInArrow(look, FOUND))
    again = dealt(near).join(open_, [*GROUP, "cid"]).join(made, "cid").select(*GROUP, "left", "cid", "comp", "n", "sketch", "size", "body")
    links = stored(again.groupBy(*GROUP).applyInArrow(confirm, LINKS))
    forget(near, need, made, open_)
    return links


def near_duplicates(docs: DataFrame, width: int = SHINGLE, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row_key, a row for each document."""
    small_batches(docs.sparkSession)
    found = stored(features(docs, width))
    by_set = found.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stored(by_set.withColumn("cid", F.monotonically_increasing_id()))
    members = classes.select("cid", "rep", F.explode("bands").alias("band"))
    # b is always the hub, the earlier one by RANK, so a pair comes in one direction only
    hubs = members.groupBy("band").agg(F.min_by("cid", F.expr(RANK)).alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    pairs = members.select("cid", "band").withColumnRenamed("cid", "a").join(hubs, "band").where("a <> b").select("a", "b").distinct()
    likely = stored(prune(pairs, classes, miss))
    links = stored(verify(likely, classes, docs, width))
    comps = components(links)
    more = across(members, classes, comps, docs, width, miss)
    if not more.isEmpty():
        comps = components(links.union(more))
    labelled = classes.join(comps, "cid", "left").select("d1", "d2", "rep", F.coalesce("comp", "cid").alias("comp"))
    # a table of its own, so that the join may be planned by its size and split where a component is large
    least = stored(labelled.groupBy("comp").agg(F.min("rep").alias("component_id")))
    labelled = stored(labelled.join(least, "comp").select("d1", "d2", "component_id"))
    forget(likely, links, more, comps, classes, least)
    out = found.where("n > 0").join(labelled, ["d1", "d2"]).select("doc_id", "n", "component_id", "row_key")
    out = out.unionByName(found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "row_key"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key")


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows, without those of which another row of the same component stays; of rows that share the id that stays one does. Rows
    without doc_id go if a row with one is in their component, and else stay."""
    flagged = stored(near_duplicates(docs, width))
    # one row of each component, told by its key; rows with an empty set, and components without any id, stay as they are
    best = flagged.where("kept and n_shingles > 0 and component_id is not null").groupBy("component_id").agg(F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("_n"))
    names, key, number = [F.col(f"`{n}`") for n in docs.columns], free_name(docs, "key"), free_name(docs, "number")
    stay = best.select("row_key").union(flagged.where("n_shingles = 0 or component_id is null").select("row_key")).distinct().withColumnRenamed("row_key", key)
    rows = docs.withColumn(key, _row_key()).join(stay, key, "left_semi")
    repeated = best.where("_n > 1").select(F.col("row_key").alias(key))
    if repeated.isEmpty():
        return rows.select(*names)
    alike = stored(rows.join(repeated, key, "left_semi").withColumn(number, F.monotonically_increasing_id()))
    first = alike.groupBy(key).agg(F.min(number).alias(number))
    return rows.join(repeated, key, "left_anti").select(*names).unionByName(alike.join(first, [key, number], "left_semi").select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2).drop("row_key")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 1, least(len(w), 1)))) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON c.a = p.doc_id JOIN n q ON c.b = q.doc_id WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.y, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.x
"""
