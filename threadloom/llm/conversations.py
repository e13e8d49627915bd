"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

A turn is blank (it has nothing but separators), a duplicate (role and text were seen earlier in its conversation) or truncated (its last
character, separators aside, is none of `.!?`); the first of these that holds is its fault.  Turns may be kept (K, cost 0), be given the
role user or assistant (R, 2), or be deleted (D, 3; blank and duplicate ones must be), and empty turns of a user or an assistant may be
inserted anywhere (I, 2); a truncated turn that is not deleted costs 1 more.  Of equally cheap repairs the one whose initials are ASCII-least
counts.

Method: windows over a conversation's turns give flags; thin structs of them are collected, sorted, and folded by aggregate(), which carries
four (cost, audit) structs, one for each place in the pattern (nothing yet, after s, after u, after a), through native least expressions.  A
cheapest repair of equal cost never is the beginning of another one, as every insertion costs, so the least of each place is all that the
next turn has to know.  A conversation is folded in stretches of STRETCH turns, each from all four places, which are then joined: a long one
costs no more a turn than a short one, and no array holds more than a stretch or the stretches' own results.  Texts are not collected: edits and
turns of a conversation meet in order and stream through their task.

Cases: a null conv_id is a conversation of its own; turns go by turn, null first, then by role and text, so ties and repeated rows have one
order, and repeated rows are duplicates; a null role or text counts as one space (which is a blank text, and a role without use); an empty
text is blank; a text of any length is judged whole; a conversation without rows has no row in `verdicts`, and zeros in the query; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import only, partitions, small_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STRETCH = 256
#: More than any repair costs.
NEVER = 1 << 50
#: Places in the pattern: nothing yet, after s, after u, after a.
PLACES = ("e", "s", "u", "a")


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, at (0, 1, ... in the conversation), role, text, initial, blank, duplicate, truncated, illegal (with the turn before), fresh
    (the first row of its turn), turn."""
    one_space = F.lit(" ")
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), one_space).alias("role"), F.coalesce(F.col("text").cast("string"), one_space).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    w, same = Window.partitionBy("conv_id").orderBy(*order), Window.partitionBy("conv_id", "role", "text").orderBy("at")
    r = r.withColumn("initial", F.substring("role", 1, 1))
    r = r.withColumns({"at": (F.row_number().over(w) - 1).cast("long"), "before": F.lag("initial").over(w), "last_turn": F.lag("turn").over(w)})
    # all windows lie within conversations, so turns are moved once
    r = r.withColumn("again", F.row_number().over(same) > 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return r.select(
        "conv_id", "at", "role", "text", "initial", blank.alias("blank"), (~blank & F.col("again")).alias("duplicate"), (~blank & ~F.col("again") & ~ended).alias("truncated"),
        F.coalesce(~F.concat("before", "initial").isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("fresh"), "turn",
    )


def _state(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost") if isinstance(cost, int) else cost.alias("cost"), F.lit(audit).alias("audit") if isinstance(audit, str) else audit.alias("audit"))


def _moved(state: Column, cost, letter: str) -> Column:
    return _state(F.least(state["cost"] + F.lit(cost) if isinstance(cost, int) else state["cost"] + cost, F.lit(NEVER)), F.concat(state["audit"], F.lit(letter)))


def _all(states: dict) -> Column:
    return F.struct(*(states[p].alias(p) for p in PLACES))


def _inserted(e: Column, s: Column, u: Column, a: Column) -> Column:
    """With as many turns inserted as lead to the places after u and after a most cheaply."""
    u2 = F.least(u, _moved(e, INSERT, "I"), _moved(s, INSERT, "I"), _moved(a, INSERT, "I"))
    return _all({"e": e, "s": s, "u": u2, "a": F.least(a, _moved(u2, INSERT, "I"))})


def _after(x: Column, t: Column) -> Column:
    """The four states after one more turn."""
    stays = ~t["must"]
    own = lambda role: F.when(stays & (t["initial"] == role), t["late"] + F.lit(KEEP)).otherwise(F.lit(NEVER))
    rerole = F.when(stays, t["late"] + F.lit(REROLE)).otherwise(F.lit(NEVER))
    gone = {p: _moved(x[p], DELETE, "D") for p in PLACES}
    before_u = [x["e"], x["s"], x["a"]]
    s = F.least(gone["s"], _moved(x["e"], own("s"), "K"))
    u = F.least(gone["u"], *(_moved(y, own("u"), "K") for y in before_u), *(_moved(y, rerole, "R") for y in before_u))
    a = F.least(gone["a"], _moved(x["u"], own("a"), "K"), _moved(x["u"], rerole, "R"))
    return _inserted(gone["e"], s, u, a)


def _start(place: str) -> Column:
    """Nothing but one place is reached yet."""
    return F.struct(*(_state(0 if p == place else NEVER, "").alias(p) for p in PLACES))


def _beginning() -> Column:
    return F.struct(_state(0, "").alias("e"), _state(NEVER, "").alias("s"), _state(INSERT, "I").alias("u"), _state(2 * INSERT, "II").alias("a"))


def verdicts(turns: DataFrame) -> DataFrame:
    """From judged(): a row for each conversation with gaps, blank, duplicate, truncated, illegal, cost, audit."""
    code = F.struct("at", "initial", (F.col("blank") | F.col("duplicate")).alias("must"), F.when(F.col("truncated"), TRUNCATED).otherwise(0).cast("long").alias("late"))
    stretch = F.floor(F.col("at") / STRETCH).alias("stretch")
    count = lambda c: F.count_if(c).alias(c)
    g = turns.groupBy("conv_id", stretch).agg(
        F.array_sort(F.collect_list(code)).alias("codes"), *(count(c) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")
    )
    fold = lambda start: F.aggregate("codes", start, _after)
    # a conversation begins with nothing, each further stretch wherever the one before it may end
    later = F.when(F.col("stretch") > 0, F.struct(*(fold(_start(p)).alias(p) for p in PLACES)))
    g = g.select("*", F.when(F.col("stretch") == 0, fold(_beginning())).alias("opening"), later.alias("later")).drop("codes")
    c = g.groupBy("conv_id").agg(
        F.max("opening").alias("opening"), F.array_sort(F.collect_list(F.when(F.col("stretch") > 0, F.struct("stretch", "later")))).alias("rest"),
        *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal", "fresh")), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"),
    )
    through = lambda x, to, m: F.least(*(_state(F.least(x[p]["cost"] + m["later"][p][to]["cost"], F.lit(NEVER)), F.concat(x[p]["audit"], m["later"][p][to]["audit"])) for p in PLACES))
    end = F.aggregate("rest", F.col("opening"), lambda x, m: _all({to: through(x, to, m) for to in PLACES}))
    best = F.least(F.col("end.e"), F.col("end.a"))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("fresh"), F.lit(0)).cast("long")
    return c.withColumn("end", end).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def edits(found: DataFrame) -> DataFrame:
    """conv_id, place (of the edit), at (the turn that it is done to, or that it is inserted before), letter, nth (of the turns that come out)."""
    e = found.where(F.length("audit") > 0).select("conv_id", "audit", F.explode(F.sequence(F.lit(1), F.length("audit"))).alias("place"))
    e = e.select("conv_id", "place", F.expr("substring(audit, place, 1)").alias("letter"))
    w = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("conv_id", "place", "letter", F.coalesce(F.count_if(F.col("letter") != "I").over(w), F.lit(0)).alias("at"), F.coalesce(F.count_if(F.col("letter") != "D").over(w), F.lit(0)).alias("nth"))


REPAIRED = "conv_id {}, place long, role string, text string"


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, place, role, text; conversations lie whole and in order within partitions.  From judged() and
    verdicts().  Turns that come out alternate between user and assistant, but for a system's that is kept at the head."""
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    none = F.lit(None).cast("string")
    asked = edits(found).select("conv_id", "at", F.col("place").cast("long").alias("place"), "letter", "nth", none.alias("role"), none.alias("text"))
    given = turns.select("conv_id", "at", F.lit(None).cast("long").alias("place"), none.alias("letter"), F.lit(0).cast("long").alias("nth"), "role", "text")
    # a turn's own edit is the last one at its place, and the turn follows
    both = asked.unionByName(given).repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at", F.col("place").asc_nulls_last())

    def run(batches):
        last, begun, headed, wanted, place = None, False, 0, None, 0
        for batch in batches:
            out = []
            for conv, letter, nth, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)), strict=True):
                if not begun or conv != last:
                    last, begun, headed, wanted, place = conv, True, 0, None, 0
                if letter is None:
                    if wanted and wanted[0] != "D":
                        kept = wanted[0] == "K"
                        if kept and wanted[1] == 0 and role.startswith("s"):
                            headed = 1
                        out.append((conv, place, role if kept else ("user", "assistant")[(wanted[1] - headed) % 2], text))
                        place += 1
                    wanted = None
                elif letter == "I":
                    out.append((conv, place, ("user", "assistant")[(nth - headed) % 2], ""))
                    place += 1
                else:
                    wanted = (letter, nth)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(0).type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())], ["conv_id", "place", "role", "text"])

    return both.mapInArrow(run, REPAIRED.format(kind))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 from repaired(): a digest's state is kept, not the conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        last, state, schema = None, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], schema), pa.array([y for _, y in done], pa.string())], ["conv_id", "repaired_sha256"])
        for batch in batches:
            done, schema = [], batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield row()
        if state is not None:
            done = [(last, state.hexdigest())]
            yield row()

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The test's damage: by crc32 of `conv_id:turn`, 1 of 20 rows each is dropped, emptied, left without ends of sentences, repeated, or given
    to the user."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))), F.lit(20))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(one_space("text"), "[.!?]", "")).otherwise(one_space("text"))
    r = rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(one_space("role")).alias("role"), text.alias("text"), h.alias("_h")).where("_h <> 0")
    return r.withColumn("_copy", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def query(spark, sf_dir: str) -> DataFrame:
    rows = only(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    turns = stored(judged(damaged(rows)))
    found = stored(verdicts(turns))
    hashed = digests(repaired(turns, found)).withColumnRenamed("conv_id", "_d")
    every = rows.select(F.col("conv_id").alias("_c")).distinct()
    out = every.join(found, F.col("_c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(hashed, F.col("_c").eqNullSafe(F.col("_d")), "left")
    return out.select(F.col("_c").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_SQL_MOVE = "{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}}"
_m = lambda x, cost, letter: _SQL_MOVE.format(x=x, cost=cost, letter=letter)

SQL = rf"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS h FROM keyed, poly
), damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(0, 2) r(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended, substring(role, 1, 1) AS initial FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed
), judged AS (
  SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND NOT ended AS truncated, coalesce((lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
), codes AS (
  SELECT conv_id, pos, truncated::BIGINT AS late, CASE WHEN blank OR duplicate THEN {NEVER} ELSE 2 + truncated::BIGINT END AS rerole,
         CASE WHEN NOT (blank OR duplicate) AND initial = 's' THEN truncated::BIGINT ELSE {NEVER} END AS ks, CASE WHEN NOT (blank OR duplicate) AND initial = 'u' THEN truncated::BIGINT ELSE {NEVER} END AS ku,
         CASE WHEN NOT (blank OR duplicate) AND initial = 'a' THEN truncated::BIGINT ELSE {NEVER} END AS ka FROM judged
), steps AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS e, {{'c': {NEVER}::BIGINT, 'a': ''}} AS s, {{'c': 2::BIGINT, 'a': 'I'}} AS u, {{'c': 4::BIGINT, 'a': 'II'}} AS a FROM totals
  UNION ALL
  SELECT conv_id, pos, e, s, u, least(a, {_m("u", 2, "I")}) AS a FROM (
    SELECT conv_id, pos, e, s, least(u, {_m("e", 2, "I")}, {_m("s", 2, "I")}, {_m("a", 2, "I")}) AS u, a FROM (
      SELECT p.conv_id, p.pos + 1 AS pos, {_m("p.e", 3, "D")} AS e, least({_m("p.s", 3, "D")}, {_m("p.e", "ks", "K")}) AS s,
             least({_m("p.u", 3, "D")}, {", ".join(_m(f"p.{x}", "ku", "K") for x in "esa")}, {", ".join(_m(f"p.{x}", "rerole", "R") for x in "esa")}) AS u,
             least({_m("p.a", 3, "D")}, {_m("p.u", "ka", "K")}, {_m("p.u", "rerole", "R")}) AS a
      FROM steps p JOIN codes k ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.pos = k.pos
    )
  )
), best AS (
  SELECT s.conv_id, t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, least(e, a).c AS cost, least(e, a).a AS audit FROM steps s JOIN totals t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.pos = t.n
), letters AS (
  SELECT conv_id, place, substring(audit, place, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS place FROM best)
), counted AS (
  SELECT *, coalesce(count(*) FILTER (letter <> 'I') OVER w, 0) AS pos, coalesce(count(*) FILTER (letter <> 'D') OVER w, 0) AS nth FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), met AS (
  SELECT c.conv_id, c.place, c.letter, c.nth, j.role, CASE c.letter WHEN 'I' THEN '' ELSE j.text END AS text, max(CASE WHEN c.letter = 'K' AND c.nth = 0 AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS headed
  FROM counted c LEFT JOIN judged j ON c.letter <> 'I' AND c.conv_id IS NOT DISTINCT FROM j.conv_id AND c.pos = j.pos WHERE c.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (nth - headed) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY place) AS body FROM met GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
