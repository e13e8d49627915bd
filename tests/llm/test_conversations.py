"""Conversation repair against an exhaustive search over edits, on conversations that are hard on it."""

import itertools
import random
import re
import zlib

import pytest
from helpers import sha, rows_of

from threadloom.llm import conversations

TURNS = "conv_id long, turn long, role string, text string, note string"


def faults(turns):
    """(initial, must go, truncated) of turns (role, text) in order."""
    seen, out = set(), []
    for role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        out.append((role[:1], blank, not blank and again, cut))
    return out


def cheapest(marks):
    """(cost, audit), least first, of all edits there are: each is tried, as far as it costs no more than the best so far."""
    best = [(3 * len(marks), "D" * len(marks))]

    def step(k, state, cost, audit):
        if cost > best[0][0]:
            return
        if k == len(marks) and state in ("e", "a"):
            best[0] = min(best[0], (cost, audit))
        step(k, "a" if state == "u" else "u", cost + 2, audit + "I")
        if k == len(marks):
            return
        initial, blank, again, cut = marks[k]
        step(k + 1, state, cost + 3, audit + "D")
        if blank or again:
            return
        step(k + 1, "a" if state == "u" else "u", cost + 2 + cut, audit + "R")
        if (initial, state) in (("s", "e"), ("u", "e"), ("u", "s"), ("u", "a"), ("a", "u")):
            step(k + 1, initial, cost + cut, audit + "K")

    step(0, "e", 0, "")
    return best[0]


def mended(turns, audit):
    out, k, state = [], 0, "e"
    for letter in audit:
        if letter == "I":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant", ""))
            continue
        role, text = turns[k]
        k += 1
        if letter == "K":
            state = role[0]
            out.append((role, text))
        elif letter == "R":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant", text))
    return out


def ordered(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}


def hard():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "u", "user", "assistant"])
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), role, rng.choice(["Well.", "and so", "", " \n", None, "Why?", "Ünd“", f"{turn}!"]), "x"))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    rows += [(None, 0, "user", "No number.", None), (None, 0, "assistant", "None. ", None), (-1, 5, "user", "a. " * 20_000, None), (-1, 9, "assistant", "b", None)]
    return rows


@pytest.mark.parametrize("stretch", [2, 256])
def test_cheapest_edits(spark, monkeypatch, stretch):
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    rows = hard()
    df = spark.createDataFrame(rows, TURNS)
    turns = conversations.judged(df)
    found = conversations.verdicts(turns)
    got = {r.conv_id: r for r in found.collect()}
    out = {}
    for r in sorted(conversations.repaired(turns, found).collect(), key=lambda r: (repr(r.conv_id), r.place)):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    convs = ordered(rows)
    assert got.keys() == convs.keys()
    for conv, x in convs.items():
        marks, r = faults(x), got[conv]
        assert (r.cost, r.audit) == cheapest(marks), (conv, x)
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(m[k] for m in marks) for k in (1, 2, 3))
        assert r.illegal == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        numbers = {t for c, t, *_ in rows if c == conv and t is not None}
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert out.get(conv, []) == mended(x, r.audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in out.get(conv, [])))


def test_long_conversation_in_stretches(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "", f"{k}."]), "") for k in range(700)]
    turns = conversations.judged(spark.createDataFrame(rows, TURNS))
    (r,) = conversations.verdicts(turns).collect()
    states = {"e": (0, ""), "s": (1 << 40, ""), "u": (2, "I"), "a": (4, "II")}
    for initial, blank, again, cut in faults(ordered(rows)[1]):
        add = lambda p, c, letter: (states[p][0] + c, states[p][1] + letter)
        late = cut if not blank and not again else 1 << 40
        new = {p: add(p, 3, "D") for p in states}
        new["s"] = min(new["s"], add("e", late if initial == "s" else 1 << 40, "K"))
        new["u"] = min([new["u"], *(add(p, late if initial == "u" else 1 << 40, "K") for p in "esa"), *(add(p, late + 2, "R") for p in "esa")])
        new["a"] = min(new["a"], add("u", late if initial == "a" else 1 << 40, "K"), add("u", late + 2, "R"))
        states = new
        states["u"] = min(states["u"], *(add(p, 2, "I") for p in "esa"))
        states["a"] = min(states["a"], add("u", 2, "I"))
    assert (r.cost, r.audit) == min(states["e"], states["a"])


def test_whole_query_on_damage(spark, tmp_path):
    rows = hard() + [(500 + k, t, ("user", "assistant")[t % 2], f"Turn {t}. Said!", "") for k in range(40) for t in range(4)]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(conversations.query(spark, str(tmp_path)), "conv_id", "cost", "audit", "repaired_sha256")
    one = lambda x: " " if x is None else str(x)
    after = []
    for conv, turn, role, text, _ in rows:
        h = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if h:
            row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", one(text)) if h == 2 else text)
            after += [row] * (2 if h == 3 else 1)
    convs = ordered(after)
    expected = []
    for conv in {r[0] for r in rows}:
        x = convs.get(conv, [])
        cost, audit = cheapest(faults(x))
        expected.append((conv, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in mended(x, audit)))))
    assert got == sorted(expected, key=repr)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], TURNS)
    assert conversations.verdicts(conversations.judged(df)).count() == 0
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert conversations.query(spark, str(tmp_path)).count() == 0
