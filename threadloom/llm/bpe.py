"""BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a word under byte-level BPE is fixed by one number for each of its prefixes: the last token of that
prefix's own encoding.  A token t that is a suffix of a prefix p is its last token exactly when the pair (last token of
p without t, t) is one that merging would leave apart.  So the distinct words of a batch are put into a trie and the last
tokens are handed down depth first: a prefix that words share is worked out once, and each word's tokens are read off
by stepping back from its end.  Words in byte order are the depth-first order of their trie, and the stack of the
current path is all of the trie that has to be kept.

Whole texts are encoded as the tokenizers library does with add_special_tokens=False and no truncation or padding: the
strings of special tokens in a text become those tokens.

Cases: null counts as empty, and empty texts have no tokens; a text of any length is encoded as one (its distinct words are put into the
trie together, and what is remembered of words is bounded); repeated rows, ties and shared or null doc_ids change nothing, as each row
is encoded by itself; an empty table gives an empty result; extra columns pass through `encode` and `decode`, which replace only a column
of the name that they add, and are handed on by `encoded_and_checked` where `keep` names them.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches

#: The pre-tokenizer's fixed pattern: contractions, letters, digits, other signs, and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words that a worker remembers, at most: those of late, and those before them.
REMEMBERED = 300_000
#: Pairs of tokens of which it remembers whether they stay apart.
PAIRS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of the vocabulary file stands for: printable Latin-1 signs stand for themselves, the others
    are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        signs, vocab = byte_of_sign(), data["model"]["vocab"]
        to_bytes = lambda s: bytes(signs[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        #: of each token, its bytes; the last one is for no token
        self.sizes = [*map(len, self.bytes_of), 0]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: of each token: the rank of the merge that makes it (-1: a byte) and its halves
        self.made: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(self.bytes_of)
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = (self.ids[to_bytes(x)] for x in (m if isinstance(m, list) else m.split(" ")))
            t = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merges[a, b] = (rank, t)
            self.made[t] = (rank, a, b)
        self.longest = max(map(len, self.ids))
        self.apart: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """A word's tokens by merging the pair of the lowest rank again and again."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(out) > 1:
            rank, at = min((self.merges.get((out[i], out[i + 1]), (1 << 60, 0))[0], i) for i in range(len(out) - 1))
            if rank == 1 << 60:
                break
            out[at : at + 2] = [self.merges[out[at], out[at + 1]][1]]
        return out

    def stays_apart(self, a: int, b: int) -> bool:
        """Merging the bytes of tokens a and b gives a and b: only what touches the seam can differ, so the tokens along
        the seam are followed back through the order of their merges."""
        key = a << 32 | b
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self._seam(a, b)
            if len(self.apart) > PAIRS:
                self.apart.clear()
                self.apart[key] = known
        return known

    def _seam(self, a: int, b: int) -> bool:
        # left and right: tokens at the seam, from the whole token down to its byte; each exists from the rank of its merge
        # on, until the rank of the merge that takes it in
        left, right = [], []
        until = 1 << 60
        while True:
            rank, _, r = self.made[a]
            left.append((rank, until, a))
            if rank < 0:
                break
            a, until = r, rank
        until = 1 << 60
        while True:
            rank, l, _ = self.made[b]
            right.append((rank, until, b))
            if rank < 0:
                break
            b, until = l, rank
        for f0, t0, x in left:
            for f1, t1, y in right:
                m = self.merges.get((x, y))
                if m is None:
                    continue
                # both are there when it is this merge's turn; with the same rank as the merge that takes the left one in,
                # the left pair goes first; with that of the right one's, the seam goes first
                if max(f0, f1) < m[0] and m[0] < t0 and m[0] <= t1:
                    return False
        return True

    def trie(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Distinct words with their tokens, in byte order."""
        get, bytes_of, longest, apart, known, sizes = self.ids.get, self.bytes_of, self.longest, self.stays_apart, self.apart.get, self.sizes
        last: list[int] = [-1]  # of each prefix on the current path, the last token
        before = b""
        for word in sorted(words):
            n, k = len(word), 0
            m = min(n, len(before))
            if word[:m] == before[:m]:
                k = m
            else:
                while word[k] == before[k]:
                    k += 1
            del last[k + 1 :]
            for end in range(k + 1, n + 1):
                # exactly one token fits; mostly it begins where the last one did, or after that
                likely = end - 1 - sizes[last[end - 1]]
                for start in range(likely, end):
                    t = get(word[start:end])
                    if t is not None:
                        if not start:
                            break
                        fits = known(last[start] << 32 | t)
                        if apart(last[start], t) if fits is None else fits:
                            break
                else:
                    for start in range(likely - 1, max(-1, end - longest - 1), -1):
                        t = get(word[start:end])
                        if t is not None:
                            if not start:
                                break
                            fits = known(last[start] << 32 | t)
                            if apart(last[start], t) if fits is None else fits:
                                break
                last.append(t)
            before, at, out = word, n, []
            while at:
                out.append(last[at])
                at -= len(bytes_of[last[at]])
            yield word, out[::-1]

    def learn(self, words: set[str]) -> None:
        """Afterwards self.words has them all; words that come often are handed on, others are forgotten."""
        if len(self.words) + len(words) > REMEMBERED // 2:
            self.words, self.older = {}, self.words
        new = {}
        for w in words.difference(self.words):
            known = self.older.get(w)
            if known is None:
                new[w.encode("utf-8", "surrogatepass")] = w
            else:
                self.words[w] = known
        for b, ids in self.trie(new):
            self.words[new[b]] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        parts = [self.split(t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        found = [[[p] if k % 2 else self.find(p) for k, p in enumerate(ps)] for ps in parts]
        self.learn({w for ps in found for k, p in enumerate(ps) if not k % 2 for w in p})
        known = self.words.__getitem__
        for ps in found:
            out.append(b"".join(struct.pack("<I", self.special[p[0]]) if k % 2 else b"".join(map(known, p)) for k, p in enumerate(ps)))
        return out

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _some(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        at, total, texts = 0, 0, []
        for k, t in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
            texts.append(t or "")
            total += len(texts[-1])
            if total >= size:
                yield batch.slice(at, k + 1 - at), texts
                at, total, texts = k + 1, 0, []
        if texts:
            yield batch.slice(at), texts


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The rows with token_ids, binary: ids as little-endian unsigned 32-bit integers (a column of that name is replaced)."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    docs = docs.drop("token_ids")
    names = docs.columns
    schema = docs.withColumn("token_ids", F.lit(b"")).schema

    def run(batches):
        c = codec(path)
        for rows, texts in _some(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(c.encode_batch(texts), pa.binary())], [*names, "token_ids"])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """The rows with the text that token ids stand for (null ids: null); bytes that are no UTF-8 become U+FFFD."""
    path = path or default_path()
    df = df.drop(into)
    names = df.columns
    schema = df.withColumn(into, F.lit("")).schema

    def run(batches):
        c = codec(path)
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                out = [None if b is None else c.decode(b) for b in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*names, into])

    return df.mapInArrow(run, schema)


def encoded_and_checked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, token_ids (if ids), n_tokens, ids_sha256, decoded_sha256: encodes, and decodes what came out.  keep: columns to hand on,
    but for those that bear the name of one of these."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    names = ["doc_id", *["token_ids"] * ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    keep = tuple(c for c in keep if c.lower() not in names)
    # by place, so that a column may be called anything
    thin = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(keep)))
    made = [F.lit(b"").alias("token_ids")] * ids + [F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")]
    schema = thin.select("doc_id", *made, *(f"kept{k}" for k in range(len(keep)))).schema

    def run(batches):
        c = codec(path)
        for rows, texts in _some(batches, "text"):
            out = c.encode_batch(texts)
            back = [hexed(c.decode(b).encode("utf-8", "surrogatepass")) for b in out]
            own = [pa.array(out, pa.binary())] if ids else []
            yield pa.RecordBatch.from_arrays([rows.column(0), *own, pa.array([len(b) // 4 for b in out], pa.int64()), pa.array(list(map(hexed, out)), pa.string()), pa.array(back, pa.string()), *rows.columns[2:]], [*names, *(f"kept{k}" for k in range(len(keep)))])

    return thin.mapInArrow(run, schema).select(*names, *(F.col(f"kept{k}").alias(c) for k, c in enumerate(keep)))


def query(spark, sf_dir: str) -> DataFrame:
    return encoded_and_checked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ids=False)
