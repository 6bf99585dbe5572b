"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows, in order, become one whose role initials are nothing, or an optional `s` and then `ua` once or more.  Edits: Keep
costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant row, anywhere) 2; a row that stays though its text is
truncated costs 1 more.  Blank rows and repetitions of a role and text are always deleted.  Among the cheapest edits those whose
initials, in order, are ASCII-least are taken: the audit.

A prefix of the rows can end in four states: nothing yet, after system, after user, after assistant.  From a cost vector over these the next row's
vector follows, and likewise backwards.  The two meet in the middle; the crossing with the least sum is chosen, and among
equal ones that whose audit so far is least; both halves follow in the same way.  Only vectors are kept, so the space is linear.  No audit so far need be written out to be
compared: those of different states differ, and none is the beginning of another, since each ends with the letter of the same row.  So
a vector carries the four states' ranks, which follow from those before.

What one row does to vectors, a stretch of rows does too: four costs and ranks from each of four states.  So a conversation of any length is cut
into segments of SEGMENT rows and nodes of as many segments or nodes; these are summed up on the way to the root and, on the way back, each
node is told its first and last state and finds its children's crossings.  No task holds more than SEGMENT rows or children.
Inserts belong to the row that they stand before; since D sorts before I, none stands before a deleted row, and rows that must go don't take part.

Order: by turn, nulls first, then role, then text (UTF-8 bytes).  Equal rows are one row with a count from the start.

Defined results: null roles and texts count as one space.  A null conv_id is a conversation of its own.  A conversation without rows (all
with 0 copies) has zeros, an empty audit and the empty string's hash.  The gaps of turns that lie too far apart for a long are null.
The digest of a repaired conversation is sequential by definition: its rows stream through one task, which holds one batch of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normwerk.llm.common import row_key, stored

#: Rows of a segment, and children of a node: 2 ** SHIFT.
SHIFT = 12
# costs
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# What counts as white space
WHITE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the state after an inserted or re-roled row
_NAME = {USER: "user", ASSISTANT: "assistant"}
_TAIL = (0, 2, 1, 0)  # rows to insert at the end
_OTHER, _LATE, _GONE = 3, 4, 8  # a row's code: class of its initial (0 to 3: s, u, a, other), truncated, must be deleted
_NEVER = 1 << 60

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs and ranks of the four states
Step = tuple[Vector, ...]  # from each state


# --- vectors --------------------------------------------------------------------------------------


def _row_edits(code: int) -> list[dict[int, tuple[int, str]]]:
    """For each state before a row: the states after it, with cost and letters."""
    kind, late = code & 3, TRUNCATED * bool(code & _LATE)
    out = []
    for before in range(4):
        found = {before: [(DELETE, "D")]}
        state = before
        for inserted in range(4):
            told, letters = INSERT * inserted + late, "I" * inserted
            kept = {0: SYSTEM if state == START else None, 1: USER if state != USER else None, 2: ASSISTANT if state == USER else None}.get(kind)
            if kept is not None:
                found.setdefault(kept, []).append((told, letters + "K"))
            found.setdefault(_NEXT[state], []).append((told + REROLE, letters + "R"))
            state = _NEXT[state]
        out.append({after: min(ways) for after, ways in found.items()})
    return out


_EDITS = [_row_edits(code) for code in range(8)]


def _vector(ways: dict[int, tuple]) -> Vector:
    """ways: by state, a cost and what orders the audits."""
    order = {s: i for i, s in enumerate(sorted(ways, key=lambda s: ways[s][1:]))}
    return tuple(ways[s][0] if s in ways else _NEVER for s in range(4)), tuple(order.get(s, 4) for s in range(4))


_ROWS: list[Step] = [tuple(_vector(ways) for ways in edits) for edits in _EDITS]
_AT: list[Vector] = [_vector({s: (0, "")}) for s in range(4)]


def forward(vector: Vector, step: Step) -> Vector:
    ways: dict[int, tuple[int, int, int]] = {}
    for before in range(4):
        if vector[0][before] < _NEVER:
            costs, ranks = step[before]
            for after in range(4):
                if costs[after] < _NEVER:
                    way = (vector[0][before] + costs[after], vector[1][before], ranks[after])
                    if after not in ways or way < ways[after]:
                        ways[after] = way
    return _vector(ways)


def backward(costs: Sequence[int], step: Step) -> list[int]:
    return [min(_NEVER, *(a + b for a, b in zip(step[before][0], costs, strict=True))) for before in range(4)]


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The state after each step on the way from `start` to `end`."""
    n = len(steps)
    if n < 2:
        return [end] * n
    middle = n // 2
    ahead = _AT[start]
    for s in steps[:middle]:
        ahead = forward(ahead, s)
    behind = [0 if s == end else _NEVER for s in range(4)]
    for s in reversed(steps[middle:]):
        behind = backward(behind, s)
    at = min(range(4), key=lambda s: (min(ahead[0][s] + behind[s], _NEVER), ahead[1][s]))
    return crossings(steps[:middle], start, at) + crossings(steps[middle:], at, end)


def summed(steps: Sequence[Step]) -> Step:
    out = []
    for start in _AT:
        for s in steps:
            start = forward(start, s)  # noqa: PLW2901
        out.append(start)
    return tuple(out)


@lru_cache(maxsize=20_000)
def _summed_rows(codes: bytes) -> Step:
    return summed([_ROWS[c] for c in codes])


@lru_cache(maxsize=20_000)
def _letters(codes: bytes, start: int, end: int) -> tuple[str, ...]:
    """Each row's letters."""
    states = [start, *crossings([_ROWS[c] for c in codes], start, end)]
    return tuple(_EDITS[c][a][b][1] for c, a, b in zip(codes, states, states[1:], strict=False))


def last_state(vector: Vector) -> tuple[int, int]:
    """(cost, state) of the best end of a whole conversation."""
    at = min(range(4), key=lambda s: (vector[0][s] + INSERT * _TAIL[s], vector[1][s]))
    return vector[0][at] + INSERT * _TAIL[at], at


# --- rows -----------------------------------------------------------------------------------------


def ordered(df: DataFrame, copies: str | None = None) -> DataFrame:
    """_k1, _k2 (the conversation), conv_id, turn, role, text, n, _d1, _d2 (conversation, role and text), at (ascending in a conversation's order), stored.

    `copies` names a column of how often a row stands there; a row with 0 only names its conversation.  Sorted by ranges, so a conversation of any length is spread.
    """
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    rows = df.select("conv_id", *[F.when(n > 0, c).alias(name) for name, c in (("turn", F.col("turn")), ("role", F.coalesce("role", F.lit(" "))), ("text", F.coalesce("text", F.lit(" "))))], n.alias("n"))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    doubles = [c.alias(name) for c, name in zip(row_key("conv_id", "role", "text"), ("_d1", "_d2"), strict=True)]
    keyed = once.select(*row_key("conv_id"), "*", *doubles)
    at = keyed.repartitionByRange("_k1", "_k2", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("_k1", "_k2", "turn", "role", "text")
    return stored(at.withColumn("at", F.monotonically_increasing_id()), "conversation-rows")


def judged(rows: DataFrame) -> DataFrame:
    """The rows without texts: their first fault, and the code that the edits depend on."""
    later = stored(rows.filter("n > 0").groupBy("_d1", "_d2").agg(F.min("at").alias("_first"), F.count("*").alias("_c")).filter("_c > 1").drop("_c"), "conversation-repeated")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    late = ~F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(_OTHER)
    small = rows.select("_k1", "_k2", "conv_id", "turn", "n", "_d1", "_d2", "at", blank.alias("blank"), late.alias("late"), kind.alias("kind"))
    out = small.join(later, ["_d1", "_d2"], "left").withColumn("repeated", ~F.col("blank") & (F.coalesce("_first", "at") < F.col("at")))
    gone = F.col("blank") | F.col("repeated")
    code = F.col("kind") + F.when(gone, _GONE).when(F.col("late"), _LATE).otherwise(0)
    return stored(out.select("_k1", "_k2", "conv_id", "turn", "n", "at", "blank", "repeated", (F.col("late") & ~gone).alias("late"), code.alias("code")), "conversation-codes")


_STEP = "costs array<long>, ranks array<int>, first int, last int, illegal long"


def _flat(step: Step, first: int, last: int, illegal: int) -> dict:
    return {"costs": [c for v in step for c in v[0]], "ranks": [r for v in step for r in v[1]], "first": first, "last": last, "illegal": illegal}


def _step(child: dict) -> Step:
    c, r = child["costs"], child["ranks"]
    return tuple((tuple(c[i : i + 4]), tuple(r[i : i + 4])) for i in (0, 4, 8, 12))


def _illegal(before: int, after: int) -> bool:
    return (before, after) not in ((0, 1), (1, 2), (2, 1))


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for rows in b.column("rows").to_pylist():
            illegal, before = 0, None
            for r in rows:
                kind = r["code"] & 3
                illegal += r["n"] - 1 + (before is not None and _illegal(before, kind))
                before = kind
            out.append(_flat(_summed_rows(bytes(r["code"] for r in rows if r["code"] < _GONE)), rows[0]["code"] & 3, before, illegal))
        yield _with(b, out)


def _nodes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for children in b.column("children").to_pylist():
            illegal = sum(c["illegal"] for c in children) + sum(_illegal(x["last"], y["first"]) for x, y in zip(children, children[1:], strict=False))
            out.append(_flat(summed([_step(c) for c in children]), children[0]["first"], children[-1]["last"], illegal))
        yield _with(b, out)


def _with(b: pa.RecordBatch, out: list[dict]) -> pa.RecordBatch:
    types = (("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("first", pa.int32()), ("last", pa.int32()), ("illegal", pa.int64()))
    return pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[k] for x in out], t) for k, t in types]], [*b.schema.names, *[k for k, _ in types]])


def _told(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From nodes with their first and last state to their children's."""
    for b in it:
        out = []
        for k1, k2, children, start, end, tail in zip(*(b.column(c).to_pylist() for c in ("_k1", "_k2", "children", "start", "end", "tail")), strict=True):
            states = [start, *crossings([_step(c) for c in children], start, end)]
            out += [(k1, k2, c["node"], x, y, 0) for c, x, y in zip(children, states, states[1:], strict=False)]
            out[-1] = (*out[-1][:5], tail)
        yield _batch(out, (("_k1", pa.int64()), ("_k2", pa.int64()), ("node", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.int32())))


def _batch(rows: list[tuple], columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns)], [n for n, _ in columns])


def _rooted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ends = [last_state(_step({"costs": c, "ranks": r})[START]) for c, r in zip(b.column("costs").to_pylist(), b.column("ranks").to_pylist(), strict=True)]
        more = (("cost", [c for c, _ in ends], pa.int64()), ("start", [START] * len(ends), pa.int32()), ("end", [e for _, e in ends], pa.int32()), ("tail", [_TAIL[e] for _, e in ends], pa.int32()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_k1", "_k2", "children", "illegal")), *[pa.array(v, t) for _, v, t in more]], ["_k1", "_k2", "children", "illegal", *[n for n, _, _ in more]])


def _written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their first and last state: their audits."""
    for b in it:
        out = []
        for rows, start, end, tail in zip(*(b.column(c).to_pylist() for c in ("rows", "start", "end", "tail")), strict=True):
            letters = iter(_letters(bytes(r["code"] for r in rows if r["code"] < _GONE), start, end))
            out.append("".join("D" * r["n"] if r["code"] >= _GONE else next(letters) + "D" * (r["n"] - 1) for r in rows) + "I" * tail)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_k1", "_k2", "node", "start")), pa.array(out, pa.string())], ["_k1", "_k2", "node", "start", "audit"])


def audits(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (_k1, _k2, cost, illegal) and segments (_k1, _k2, node, start, audit); `codes` as from `judged`.  Costs leave out rows that must go and equal copies."""
    node = F.shiftright("at", SHIFT).alias("node")
    groups = codes.filter("n > 0").groupBy("_k1", "_k2", node).agg(F.sort_array(F.collect_list(F.struct("at", "code", "n"))).alias("rows"))
    segments = stored(groups.mapInArrow(_segments, f"_k1 long, _k2 long, node long, rows array<struct<at: long, code: int, n: long>>, {_STEP}"), "conversation-segments")
    levels, level = [], segments.drop("rows")
    while not levels or (levels[-1][1] != -1):
        most = level.groupBy("_k1", "_k2").count().agg(F.max("count")).first()[0] or 0
        parent = -1 if most <= 1 << SHIFT else SHIFT
        up = (F.lit(-1).cast("long") if parent == -1 else F.shiftright("node", SHIFT)).alias("_up")
        children = F.sort_array(F.collect_list(F.struct("node", "costs", "ranks", "first", "last", "illegal"))).alias("children")
        kind = "array<struct<node: long, costs: array<long>, ranks: array<int>, first: int, last: int, illegal: long>>"
        made = level.groupBy("_k1", "_k2", up).agg(children).withColumnRenamed("_up", "node").mapInArrow(_nodes, f"_k1 long, _k2 long, node long, children {kind}, {_STEP}")
        levels.append((stored(made, "conversation-nodes"), parent))
        level = levels[-1][0].drop("children")
    told = "_k1 long, _k2 long, node long, start int, end int, tail int"
    roots = stored(levels[-1][0].mapInArrow(_rooted, f"_k1 long, _k2 long, children {kind}, illegal long, cost long, start int, end int, tail int"), "conversation-roots")
    places = roots.mapInArrow(_told, told)
    for nodes, _ in reversed(levels[:-1]):
        places = nodes.select("_k1", "_k2", "node", "children").join(stored(places, "conversation-places"), ["_k1", "_k2", "node"]).mapInArrow(_told, told)
    placed = segments.select("_k1", "_k2", "node", "rows").join(stored(places, "conversation-places"), ["_k1", "_k2", "node"])
    return roots.select("_k1", "_k2", "cost", "illegal"), stored(placed.mapInArrow(_written, "_k1 long, _k2 long, node long, start int, audit string"), "conversation-audits")


# --- repaired rows --------------------------------------------------------------------------------


def _planned(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Each segment's audit, and then its rows."""
    plans = segments.select("_k1", "_k2", "node", F.shiftleft("node", SHIFT).alias("at"), F.lit(0).alias("_o"), F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit("").alias("role"), F.col("audit").alias("text"), F.col("start").cast("long").alias("n"))
    texts = rows.filter("n > 0").select("_k1", "_k2", F.shiftright("at", SHIFT).alias("node"), "at", F.lit(1).alias("_o"), "conv_id", "role", "text", "n")
    return plans.unionByName(texts)


def _edited(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(_k1, _k2, conv_id, at, part, role, text, edit) of the rows that are left; a row's inserts come before it, those at the end after it."""
    kinds = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    audit, place, state, held = "", 0, START, None

    def inserts(of: tuple, part: int) -> Iterator[tuple]:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            state, place = _NEXT[state], place + 1
            yield (*of, part, _NAME[state], "", "I")
            part += 1

    for b in it:
        for k1, k2, at, o, conv_id, role, text, n in zip(*(b.column(c).to_pylist() for c in ("_k1", "_k2", "at", "_o", "conv_id", "role", "text", "n")), strict=True):
            if not o:
                if held:
                    yield from inserts(held, 1)
                audit, place, state, held = text, 0, n, None
                continue
            held = (k1, k2, conv_id, at)
            yield from inserts(held, -9)
            edit, place = audit[place], place + n
            if edit != "D":
                state = _NEXT[state] if edit == "R" else kinds[role[0]]
                yield (*held, 0, _NAME[state] if edit == "R" else role, text, edit)
    if held:
        yield from inserts(held, 1)


def repaired_rows(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """conv_id, at, part (together the order), role, text, edit (K, R or I) of every row of the repaired conversations."""
    kind = rows.select("conv_id").schema["conv_id"].dataType.simpleString()
    names = (("conv_id", pa.int64() if kind == "bigint" else pa.string()), ("at", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for r in _edited(it):
            some.append(r[2:])
            size += len(r[6])
            if size > 1 << 22 or len(some) >= 4096:
                yield _batch(some, names)
                some, size = [], 0
        if some:
            yield _batch(some, names)

    planned = _planned(rows if kind == "bigint" else rows.withColumn("conv_id", F.col("conv_id").cast("string")), segments)
    return planned.repartition("_k1", "_k2", "node").sortWithinPartitions("_k1", "_k2", "at", "_o").mapInArrow(batches, f"conv_id {'long' if kind == 'bigint' else 'string'}, at long, part int, role string, text string, edit string")


def digests(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """_k1, _k2, sha256 of the repaired rows as role:text, joined by line ends; conversations of which nothing is left are missing."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, digest = None, None
        for k1, k2, _, _, _, role, text, _ in _edited(it):
            if key == (k1, k2):
                digest.update(b"\n")
            else:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256()
            digest.update(role.encode())
            digest.update(b":")
            digest.update(text.encode())
        if key:
            done.append((*key, digest.hexdigest()))
        for i in range(0, len(done), 4096):
            yield _batch(done[i : i + 4096], (("_k1", pa.int64()), ("_k2", pa.int64()), ("sha256", pa.string())))

    return _planned(rows, segments).repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", "at", "_o").mapInArrow(batches, "_k1 long, _k2 long, sha256 string")


def faults(codes: DataFrame) -> DataFrame:
    """_k1, _k2, conv_id, gaps, blank, duplicate, truncated and _fixed (what rows that must go and equal copies cost) of every conversation."""
    n, gone = F.col("n"), F.col("code") >= _GONE
    real, once = n > 0, F.when(n > 0, n - 1).otherwise(0)
    span = F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1).cast("long")), F.count_distinct("turn"))
    return codes.groupBy("_k1", "_k2").agg(
        F.min("conv_id").alias("conv_id"), F.when(F.count("turn") > 0, span).otherwise(0).cast("long").alias("gaps"),
        F.sum(F.when(real & F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(real & F.col("repeated"), n).when(real & ~F.col("blank"), once).otherwise(0)).alias("duplicate"),
        F.sum(F.when(real & F.col("late"), 1).otherwise(0)).cast("long").alias("truncated"),
        (F.sum(F.when(real & gone, n).otherwise(once)) * DELETE).alias("_fixed"),
    )


def repair(df: DataFrame, copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv_id, turn, role, text): a report, and the repaired rows.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, a row for each conversation.
    """
    rows = ordered(df, copies)
    codes = judged(rows)
    whole, segments = audits(codes)
    letters = segments.groupBy("_k1", "_k2").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    zero = F.lit(0).cast("long")
    joined = faults(codes).join(whole, ["_k1", "_k2"], "left").join(letters, ["_k1", "_k2"], "left").join(digests(rows, segments), ["_k1", "_k2"], "left")
    report = joined.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", zero).alias("illegal"), F.coalesce(F.col("cost") + F.col("_fixed"), zero).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
    return report, repaired_rows(rows, segments)


#: Of the query op11: damage (with a checksum made in SQL), faults and the least edits, row by row.
ORACLE = r"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT CAST(n AS BIGINT), 0, CAST(n AS BIGINT) FROM range(256) t(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations
), kinds AS (
  SELECT raw.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(place, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind FROM raw, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), found AS (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    coalesce(substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), FALSE) AND i > 1 AS illegal FROM numbered
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM found
), follow(s, t, name) AS (
  VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), inserts AS (
  SELECT s, s AS t, '' AS letters, CAST([] AS VARCHAR[]) AS lines FROM follow
  UNION ALL SELECT s, t, 'I', [name || ':'] FROM follow
  UNION ALL SELECT x.s, y.t, 'II', [x.name || ':', y.name || ':'] FROM follow x JOIN follow y ON y.s = x.t
), steps AS (
  SELECT s, s AS t, 'D' AS letters, 3 AS cost, CAST([] AS VARCHAR[]) AS lines, 'D' AS op, '' AS name FROM follow
  UNION ALL SELECT i.s, k.t, i.letters || 'K', 2 * length(i.letters), i.lines, 'K', k.t FROM inserts i JOIN (SELECT s, t FROM follow UNION ALL SELECT '', 's') k ON k.s = i.t
  UNION ALL SELECT i.s, f.t, i.letters || 'R', 2 * length(i.letters) + 2, i.lines, 'R', f.name FROM inserts i JOIN follow f ON f.s = i.t
), ways(conv_id, i, s, cost, audit, lines) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', 0, '', CAST([] AS VARCHAR[]) FROM judged
  UNION ALL
  SELECT conv_id, i, t, cost, audit, lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) AS o FROM (
    SELECT w.conv_id, w.i + 1 AS i, p.t, w.cost + p.cost + CASE WHEN p.op <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END AS cost, w.audit || p.letters AS audit,
      list_concat(w.lines, p.lines, CASE p.op WHEN 'K' THEN [j.role || ':' || j.text] WHEN 'R' THEN [p.name || ':' || j.text] ELSE [] END) AS lines
    FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN steps p ON p.s = w.s AND (p.op = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (p.op <> 'K' OR p.name = substr(j.role, 1, 1))
  )) WHERE o = 1
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM judged GROUP BY conv_id
), ends AS (
  SELECT w.conv_id, w.cost + 2 * length(e.letters) AS cost, w.audit || e.letters AS audit, list_concat(w.lines, e.lines) AS lines
  FROM ways w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN inserts e ON e.s = w.s AND e.t IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * length(e.letters), w.audit || e.letters) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
