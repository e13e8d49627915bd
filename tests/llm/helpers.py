"""Plain versions of what the operators compute, and documents that are hard on them."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def vocabulary(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeioumnrstlé") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def documents():
    """Nulls, empty and long texts, ties, repeated rows, copies near and exact, shared passages."""
    rng, words = random.Random(5), vocabulary(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(260)
    rows = []
    for k in range(40):
        parts = [text(rng.randint(1, 120))]
        if k % 4 == 0:
            parts.append(passage if k % 8 else "  ".join(passage.split()[:60]))
        rows.append((k, "\n".join(parts + [text(rng.randint(1, 40))])))
    for k in range(40, 60):
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    long = " ".join(text(50) for _ in range(120))
    rows += [(60, None), (61, ""), (62, " \t\n\x0b\x0c\r "), (63, None), (64, long), (65, long + " end"), (66, "one"), (67, "One"), (68, "one two"), (69, "ONE  TWO")]
    rows += [(70, base), (70, base), (71, base.replace(" ", "\t")), (None, base), (None, "lonely words of a row without number"), (72, "a b c d"), (73, "x" * 3000), (74, "日本 \U0001f600 " * 60)]
    return [(i, t, ("en", "de", None)[k % 3], ("s1", "s2", None)[k % 3], len(t or "")) for k, (i, t) in enumerate(rows)]


def substring(rows):
    first = {}
    number = lambda i: float("inf") if i is None else i
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            first[k] = min(first.get(k, float("inf")), number(i))
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < number(i):
                gone[s : s + 50] = [True] * 50
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def shingle_set(text, k=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[s : s + k]) for s in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows, k=2):
    sets = [shingle_set(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_rest) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i, i == (least.get(find(k)) if sets[k] else i)) for k, (i, *_rest) in enumerate(rows)), key=repr)


def quality_counts(text):
    w = WORD.findall(text or "")
    seen, lines = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            lines += x in seen
            seen.add(x)
    n = collections.Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
    m = [False] * len(w)
    for s in range(len(w) - 7):
        if n[tuple(w[s : s + 8])] > 1:
            m[s : s + 8] = [True] * 8
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, sum(m))


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
