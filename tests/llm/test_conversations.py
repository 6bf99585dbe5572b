"""Conversation repair against plain searches over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from normwerk.llm import conversations, queries

GOOD = re.compile(r"(s?(ua)+)?$")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, faults):
    """(cost, audit, repaired) of the best of all edit sequences with at most two inserts at a place."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    own = [[(3, "D", [])] + ([] if f in ("blank", "duplicate") else [((f == "truncated") + c, e, [(r, t)]) for c, e, r in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant"))]) for (role, t), f in zip(rows, faults)]
    best = None
    for edits in itertools.product(*own):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 2 * sum(map(len, ins))
            if best and cost > best[0]:
                continue
            out = [(r, "") for r in ins[0]]
            for e, i in zip(edits, ins[1:]):
                out += e[2] + [(r, "") for r in i]
            if GOOD.match("".join(r[:1] for r, _ in out)) and all(r for r, _ in out):
                audit = "I" * len(ins[0]) + "".join(e[1] + "I" * len(i) for e, i in zip(edits, ins[1:]))
                best = min(best or (cost, audit, out), (cost, audit, out), key=lambda x: x[:2])
    return best


def forward_search(rows, faults):
    """The same for longer ones: the best strings of each state, row by row."""
    follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", [])}

    def filled(best):
        for _ in range(3):
            for s, (c, a, out) in list(best.items()):
                new = (c + 2, a + "I", [*out, (follow[s], "")])
                if (t := follow[s][0]) not in best or new[:2] < best[t][:2]:
                    best[t] = new
        return best

    for (role, text), fault in zip(rows, faults):
        new = {}

        def put(s, way, new=new):
            if s not in new or way[:2] < new[s][:2]:
                new[s] = way

        for s, (c, a, out) in filled(dict(best)).items():
            put(s, (c + 3, a + "D", out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] in ({"", "s", "u", "a"} - {""}) and (role[:1] == follow[s][0] or role[:1] == "s" and s == ""):
                    put(role[0], (c + late, a + "K", [*out, (role, text)]))
                put(follow[s][0], (c + 2 + late, a + "R", [*out, (follow[s], text)]))
        best = new
    return min((w for s, w in filled(best).items() if s in ("", "a")), key=lambda x: x[:2])


def plain_report(conv, search=forward_search):
    """conv: rows (turn, role, text) after damage."""
    rows = [(r, t) for _, r, t in sorted(((turn is not None, turn or 0), " " if r is None else r, " " if t is None else t) for turn, r, t in conv)]
    faults = plain_faults(rows)
    turns = [t for t, _, _ in conv if t is not None]
    cost, audit, out = search(rows, faults)
    pairs = [(a[0][:1] + b[0][:1]) for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def rows_of(rng, n):
    return [(rng.choice([None, *range(9)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "sys", None]), rng.choice(["One.", "Two", "Three?", "Four! ", "Five,\n", "", " \t", None, "Six. \v", "é"])) for _ in range(n)]


def test_both_plain_searches_agree():
    rng = random.Random(2)
    for n in [0, 1, 1, 2, 2, 2, *[3] * 25]:
        rows = [(r or " ", t or " ") for _, r, t in rows_of(rng, n)]
        f = plain_faults(rows)
        assert forward_search(rows, f)[:3] == all_edits(rows, f)


def report(spark, convs):
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA)
    found, rows = conversations.repair(df.withColumn("audit", F.lit(1)).withColumn("at", F.lit("x")).withColumn("_k1", F.lit(2)))
    got = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return got, rows


@pytest.mark.parametrize("shift", [12, 1, 2])
def test_repair_equals_the_plain_search(spark, monkeypatch, shift):
    """Also with segments and nodes of two and four, so that conversations have several levels."""
    monkeypatch.setattr(conversations, "SHIFT", shift)
    rng = random.Random(shift)
    convs = {i: rows_of(rng, rng.choice([1, 2, 3, 5, 9, 30])) for i in range(60)} | {None: rows_of(rng, 7), 99: [(1, "user", "Same.")] * 40 + [(2, "assistant", "Same.")] * 3}
    got, rows = report(spark, convs)
    assert set(got) == set(convs)
    for c, conv in convs.items():
        assert got[c] == plain_report(conv), c
    lines = {}
    for r in rows.orderBy("at", "part").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c in convs:
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == got[c][-1]


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SHIFT", 5)
    rng = random.Random(4)
    conv = [(i, rng.choice(["user", "assistant", "user", "system"]), f"Text {i}" + rng.choice([".", "", "."])) for i in range(3000)]
    assert report(spark, {1: conv, 2: [(1, "user", "x" * 2_000_000 + ".")]})[0] == {1: plain_report(conv), 2: plain_report([(1, "user", "x" * 2_000_000 + ".")])}


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, *r[1:]) for c in [*range(150), None] for t, r in enumerate(rows_of(rng, rng.randint(1, 9)))] + [(3, None, "user", "No turn."), (3, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        of = convs.setdefault(c, [])
        if k == 4:
            role = "user"
        of += [(t, role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * {0: 0, 3: 2}.get(k, 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: plain_report(conv) for c, conv in convs.items()} and any(not conv for conv in convs.values())


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(conversations.ORACLE)
    got = queries.op11_conversation_repair(spark, "/root/testdata/sf0.01")
    assert got.columns == list(want.columns) and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
