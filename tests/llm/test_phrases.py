"""Collocations against a plain count, parsing against its rules, and the query against its SQL."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from normwerk.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, score double, phrase string, n int, chunk string"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_pieces(text):
    return [w for p in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)) if (w := re.findall("[^ \t]+", p))]


def plain(rows, support=10, covered=50, top=2000):
    f, out = {}, []
    for text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for w in plain_pieces(text):
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        found = []
        for p, a in cand.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= covered * a for q, b in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["É", "Ab", "漢字", "x\x00y", "ﬁ"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ". ", "\n", ", ", "; "]) for _ in range(n))
    out = [(prose(rng.choice([1, 2, 30, 200])), rng.choice(["en", "de", "en", None])) for _ in range(150)]
    copy = prose(120)
    out += [(prose(20) + copy + prose(20), "en") for _ in range(40)] + [(copy, "de")] * 15
    out += [(None, "en"), ("", "en"), (" \n. ", "fr"), ("same " * 500, "fr"), ("a b " * 90, "fr"), ("One two. " * 40, "fr"), ("lone", "it")]
    return out


@pytest.fixture(params=[1 << 20, 300])
def stretch(request, monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", request.param)
    monkeypatch.setattr(phrases, "TOGETHER", request.param)


@pytest.mark.parametrize("modulus", [1, 3, 16, 10**9])
def test_collocations_equal_a_plain_count(spark, rows, stretch, monkeypatch, modulus):
    monkeypatch.setattr(phrases, "MODULUS", modulus)
    df = spark.createDataFrame([(i, *r, 1.0, "p", 2, "c") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.collocations(df, top=2000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and sorted(map(tuple, got.collect())) == plain(rows)


def test_ties_limits_and_full_bitmaps(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "BITMAP_BITS", 64)  # all bits set: nothing is held back, and the counts decide
    df = spark.createDataFrame([(i, *r, 1.0, "p", 2, "c") for i, r in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, phrases.collocations(df, support=3, top=7).collect())) == plain(rows, 3, 50, 7)
    assert sorted(map(tuple, phrases.collocations(df, support=5, covered=101).collect())) == plain(rows, 5, 101, 10**9)


def test_parsing(spark, rows):
    """Chunks begin and end at triggers, overlap in two words, and written one after another give the texts."""
    text = next(t for t, _ in rows if t and len(t) > 600)
    w = phrases.words_of([text.encode()])
    a, e, last = phrases._chunks(w, 16)
    assert a[0] == 0 and e[-1] == len(w.starts) and last.tolist() == [False] * (len(a) - 1) + [True] and len(a) > 3
    assert (e[:-1] == a[1:] + 2).all() and all(w.next_[i] for i in a[1:])
    pair = {(bytes(w.data[w.starts[i] : w.ends[i]]), bytes(w.data[w.starts[i + 1] : w.ends[i + 1]])) for i in a[1:].tolist()}
    inside = [(bytes(w.data[w.starts[i] : w.ends[i]]), bytes(w.data[w.starts[i + 1] : w.ends[i + 1]])) for i in range(1, len(w.starts) - 1) if w.next_[i] and i not in set(a.tolist())]
    assert pair.isdisjoint(inside)
    d = phrases.dictionary(spark.createDataFrame(rows, "text string, lang string")).collect()
    assert len({(r["lang"], r["last"], r["chunk"]) for r in d}) == len(d)
    assert sum(r["c"] * len(re.split("[ \n]", r["chunk"])) for r in d) - sum(2 * r["c"] for r in d if not r["last"]) == sum(len(p) for t, _ in rows for p in plain_pieces(t))
    assert any(r["c"] >= 40 for r in d)


def test_keys_that_share_a_half_stay_apart():
    first, number = phrases._distinct(np.array([5, 5, 7, 5], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.uint64))
    assert len(first) == 3 and number[0] == number[3] != number[1]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(phrases.ORACLE)
    got = queries.op13_phrases(spark, "/root/testdata/sf0.001")
    assert got.columns == list(want.columns) and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
