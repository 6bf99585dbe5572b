"""Operators, sources, sinks and streams."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from normwerk.operators import archetypes, consensus, hygiene, ingest, search, tables, traffic, vectors
from normwerk.sources import readers, sinks
from normwerk.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


CLAUSES = """преамбула до первого номера
1 Общие положения документа, достаточно длинный текст
1.1 Первый пункт
с переносом на вторую строку документа
5.13.1. Пункт с точкой после номера, достаточно длинный текст
2 РАЗРАБОТАН институтом проектирования зданий и сооружений
2020 год введения документа в действие на территории страны
3.1 коротко
4 Введение и общие положения документа ........ 7
1.1 Повторный пункт, который не должен заменить первый пункт
--- стр. 2 (claude-pdf) ---
6.1 Последний пункт документа с достаточно длинным текстом"""


def test_clauses(spark):
    got = {r["clause_no"]: r for r in ingest.clauses(spark.createDataFrame([(1, CLAUSES), (2, ""), (3, None)], "doc_id long, text string")).collect()}
    assert set(got) == {"1", "1.1", "5.13.1", "6.1"}
    assert got["1.1"]["body"] == "Первый пункт с переносом на вторую строку документа" and got["1.1"]["section_path"] == "1 > 1"
    assert (got["5.13.1"]["section_path"], got["5.13.1"]["section_top"]) == ("5 > 13 > 1", "5")


def test_pages(spark):
    df = spark.createDataFrame([(1, "--- стр. 1 (a) ---\none\n--- стр. 3 (b) ---\nthree\n--- стр. 1 (c) ---\nagain", 3), (2, "no marks", 2)], "doc_id long, text string, total int")
    got = {(r["doc_id"], r["page_no"]): (r["text"].strip(), r["confidence"], r["reason"]) for r in ingest.pages(df).collect()}
    assert got == {(1, 1): ("again", 1.0, None), (1, 2): ("", 0.0, "page_missing"), (1, 3): ("three", 1.0, None), (2, 1): ("no marks", 0.7, "no_page_markers")}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id int, s string, n int")
    assert rows(tables.upsert(old, new, "id")) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert rows(tables.upsert(old, new, "id", ["s"])) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    assert rows(tables.upsert_coalescing(old, new, "id")) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    once = tables.upsert(old, new, "id")
    assert rows(tables.upsert(once, new, "id")) == rows(once)
    assert tuple(tables.upsert_counts(old, new, "id").first()) == (1, 1)


def test_snapshot(spark, tmp_path):
    path = f"{tmp_path}/snap"
    one = spark.createDataFrame([(i, "x") for i in range(50)], "id int, s string")
    sinks.merge_snapshot(one, path, "id", 8)
    two = spark.createDataFrame([(3, "y"), (99, "z")], "id int, s string")
    for _ in range(2):  # twice is once
        sinks.merge_snapshot(two, path, "id", 8)
    got = dict(rows(spark.read.parquet(path).select("id", "s")))
    assert len(got) == 51 and got[3] == "y" and got[99] == "z" and got[4] == "x"


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 16)], "id long, embedding array<double>").repartition(5)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = search.vector_search(df, m[3].tolist(), 7, threshold=0.2).collect()
    want = [(i, s) for i, s in sorted(enumerate(n @ n[3]), key=lambda x: (-x[1], x[0])) if s > 0.2][:7]
    assert [r["id"] for r in got] == [i for i, _ in want] and np.allclose([r["sim"] for r in got], [s for _, s in want], atol=1e-6)
    q = df.filter("id < 30").withColumnRenamed("id", "query_id")
    batch = {(r["query_id"], r["rank"]): r["id"] for r in vectors.batch_vector_search(df.filter("id < 500"), q, 3).collect()}
    assert batch == {(i, k + 1): j for i in range(30) for k, j in enumerate(sorted(range(500), key=lambda j: (-(n[i] @ n[j]), j))[:3])}
    sql = df.filter("id < 20").select("id", search.cosine(F.col("embedding"), F.array(*map(F.lit, m[3].tolist()))).alias("s"))
    assert all(abs(r["s"] - n[r["id"]] @ n[3]) < 1e-6 for r in sql.collect())


def test_fusion_and_embedding(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert {r["id"]: round(r["rrf"], 9) for r in search.fuse(a, b).collect()} == {1: round(1 / 61, 9), 2: round(1 / 62 + 1 / 61, 9), 3: round(1 / 62, 9)}
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in search.embed(docs, search.hashing_embedder(8)).collect()}
    assert got[2] is None and got[1] == got[3] and len(got[1]) == 8
    with pytest.raises(Exception, match="vectors for"):
        search.embed(docs, lambda t: []).collect()


def test_renaming(spark):
    df = spark.createDataFrame([("1", "A b.md"), ("2", "a-b.md"), ("3", "A-b.md"), ("4", "Ж.md")], "path string, name string")
    got = dict(rows(hygiene.renamed(df).select("path", "new_name")))
    assert len({x.lower() for x in got.values()}) == 4 and got["4"] == "Zh.md" and got["2"] != "A-b.md"


def plain_renaming(names):
    """Names in order of (already safe, name, path): the first of each keeps it, others take the least free number."""
    taken = {n.lower() for n in names}
    out, seen = {}, set()
    for i in sorted(range(len(names)), key=lambda i: (names[i], i)):
        n = names[i]
        if n.lower() in seen:
            stem, ext = (n[: n.rindex(".")], n[n.rindex(".") :]) if "." in n[1:] else (n, "")
            k = 2
            while f"{stem}-{k}{ext}".lower() in taken:
                k += 1
            n = f"{stem}-{k}{ext}"
            taken.add(n.lower())
        seen.add(n.lower())
        out[f"{i:04d}"] = n
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_renaming_to_free_numbers(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a.md", "A.md", "a-2.md", "a-2-2.md"] if not seed else [f"{x}{s}{e}" for x, s, e in zip(rng.choice(["a", "A", "b"], 400), rng.choice(["", "", "", "-2", "-3", "-5", "-02", "-2-2", "-7"], 400), rng.choice([".md", ".md", ""], 400))]
    df = spark.createDataFrame([(f"{i:04d}", n) for i, n in enumerate(names)], "path string, name string").repartition(5)
    got = dict(rows(hygiene.renamed(df).select("path", "new_name")))
    assert len({n.lower() for n in got.values()}) == len(names) and got == plain_renaming(names)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0, 1, 2)])
def test_ordered_sync_whatever_the_order_of_batches(spark, tmp_path, order):
    """Older updates that come later, repeated batches, equal times, marks of deletion, values that stay where the update has none."""
    t = lambda d: dt.datetime(2026, 1, d)
    batches = [[(1, "a", "x", False, t(1)), (2, "b", "y", False, t(5)), (3, "c", "z", False, t(2)), (None, "n", None, False, None)], [(1, "d", None, False, t(4)), (2, "e", "w", False, t(3)), (3, "f", None, True, t(9)), (1, "g", "q", False, t(2))], [(2, "h", None, False, t(5)), (3, "i", "r", False, t(4)), (4, "j", "s", True, t(1)), (None, "m", "o", False, t(1))]]
    for b in order:
        sinks.merge_ordered(spark.createDataFrame(batches[b], "id int, s string, keep string, gone boolean, updated timestamp"), f"{tmp_path}/x", "id", "updated", b, ("keep",), "gone", buckets=3)
    got = sinks.read_ordered(spark, f"{tmp_path}/x", "gone")
    assert got.columns == ["id", "s", "keep", "updated"]
    assert sorted(rows(got.select("id", "s", "keep")), key=repr) == sorted([(1, "d", "q"), (2, "h", "y"), (None, "m", "o")], key=repr)


def test_significance(spark):
    rng = np.random.default_rng(3)
    z = [*rng.normal(size=60).round(2).tolist(), 4.0, -4.0, 3.5, 3.5, None]
    got = {r["archetype_id"]: r for r in archetypes.significant(spark.createDataFrame(list(enumerate(z)), "archetype_id int, z double").repartition(3), 0.05).collect()}
    p = {i: round(math.erfc(abs(x) / math.sqrt(2)), 9) for i, x in enumerate(z) if x is not None}
    for i, r in got.items():
        if z[i] is None:
            assert r["p"] is None and r["q"] is None and r["significant"] is False
            continue
        q = min(y * len(p) / sum(v <= y for v in p.values()) for y in p.values() if y >= p[i])
        assert r["p"] == pytest.approx(p[i], abs=2e-7) and r["q"] == pytest.approx(q, abs=2e-5) and r["significant"] == (q <= 0.05)
    assert sum(r["significant"] for r in got.values()) >= 4


def test_null_keys_are_one_key(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (None, "n", "y")], "id int, s string, t string")
    new = spark.createDataFrame([(None, "m", None), (2, "b", None)], "id int, s string, t string")
    assert sorted(rows(tables.upsert(old, new, "id", ["t"])), key=repr) == sorted([(1, "a", "x"), (None, "m", "y"), (2, "b", None)], key=repr)
    assert sorted(rows(tables.upsert_coalescing(old, new, "id")), key=repr) == sorted([(1, "a", "x"), (None, "m", "y"), (2, "b", None)], key=repr)
    assert rows(tables.upsert_counts(old, new, "id")) == [(1, 1)]
    for _ in range(3):  # replays add nothing
        sinks.merge_snapshot(new, f"{tmp_path}/snap", "id")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 2


def test_consensus(spark):
    v = spark.createDataFrame([(1, m, "T", 10.0 + 4 * i, 99.0) for i, m in enumerate("abc")] + [(1, "a", "T", 60.0, 60.0)], "request_id int, model string, type string, x double, y double").withColumn("element", F.monotonically_increasing_id())
    assert consensus.position_consensus(v).count() == 3
    d = spark.createDataFrame([(1, True), (1, False), (1, True), (2, False)], "request_id int, ok boolean")
    assert rows(consensus.degraded(d)) == [(1, 2, True, False), (2, 0, True, True)]


def test_clusters(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(21), 40, 50, 60]], "id long")
    assert dict(rows(archetypes.clusters(links, nodes))) == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 60}


def test_quotes(spark):
    r = spark.createDataFrame([(1, "1. стена мокрая\n2. пол"), (2, "")], "report_id int, raw_text string")
    c = spark.createDataFrame([(1, "стена мокрая"), (1, "потолок"), (9, "x")], "report_id int, raw_text string")
    assert rows(archetypes.quotes_checked(c, r).select("raw_text", "found")) == [("x", False), ("потолок", False), ("стена мокрая", True)]
    assert rows(archetypes.counts_checked(c, r)) == [(1, 2, 2, True), (2, 0, 0, True)]


def test_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.md").write_bytes("текст\n".encode() + b"\xff")
    (tmp_path / "c/b.txt").write_bytes(b"no")
    got = readers.read_corpus(spark, f"{tmp_path}/c").collect()
    assert [(r["name"], r["text"]) for r in got] == [("a.md", "текст\n�")]
    (tmp_path / "dump.txt").write_text('noise {"memory": [{"id": "1", "content": "c"}], "projects": [], "agent_logs": [{"agent_id": "a", "duration_ms": 5}]} end')
    d = readers.read_dump(spark, f"{tmp_path}/dump.txt")
    assert d["memory"].first()["content"] == "c" and d["projects"].count() == 0 and d["agent_logs"].first()["duration_ms"] == 5
    idea = "---\ndate: 2026-05-27\nsource: voice\nstatus: new\nfeasibility: ~\nimpact: 7\ntags: [a, b]\n---\n\nтело"
    r = readers.read_ideas(spark.createDataFrame([("p", idea)], "path string, text string")).first()
    assert (r["date"], r["feasibility"], r["impact"], r["tags"], r["body"]) == ("2026-05-27", None, 7, ["a", "b"], "тело")
    p = '{"title": {"title": [{"plain_text": "a"}, {"plain_text": "b"}]}, "url": {"url": "u"}, "status": {"status": {"name": "s"}}}'
    assert tuple(readers.flatten_properties(spark.createDataFrame([(p,)], "properties string")).first()) == ("ab", "u", "s")
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "a string, b string").coalesce(1), f"{tmp_path}/j")
    assert next((tmp_path / "j").glob("part*")).read_text() == '{"a":"é","b":null}\n'


def test_streams(spark, tmp_path):
    line = '10.0.0.{} - - [{}/Apr/2026:10:00:00 +0000] "GET /a HTTP/1.1" 200 5 "-" "{}"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.log").write_text("\n".join(line.format(i % 5, 20 + i % 3, "Googlebot" if i % 4 == 0 else "Mozilla") for i in range(60)) + "\ngarbage\n")
    (tmp_path / "in/2.log").write_text(line.format(1, 28, "Mozilla") + "\n")
    s = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in").withColumnRenamed("value", "line")
    streams.to_table(streams.daily_traffic(s), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["day"], r["class"]): (r["ips"], r["requests"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sum(n for _, n in got.values()) == 60 and got[dt.date(2026, 4, 20), "bot"] == (5, 5)

    snap = spark.createDataFrame([(1, "a", dt.datetime(2026, 1, 1)), (1, "b", dt.datetime(2026, 1, 2)), (2, "c", dt.datetime(2026, 1, 1))], "id int, s string, updated timestamp")
    snap.write.parquet(f"{tmp_path}/snap")
    streams.sync(spark.readStream.schema(snap.schema).parquet(f"{tmp_path}/snap"), f"{tmp_path}/target", "id", "updated", f"{tmp_path}/cp2").awaitTermination()
    assert dict(rows(sinks.read_ordered(spark, f"{tmp_path}/target").select("id", "s"))) == {1: "b", 2: "c"}

    raw = spark.createDataFrame([("hello", '{"type": "NOTE", "priority": "high"}', dt.datetime(2026, 1, 1)), ("bad", "not json", dt.datetime(2026, 1, 1)), ("odd", '{"type": "nonsense"}', dt.datetime(2026, 1, 1))], "message string, classification string, ts timestamp")
    raw.write.parquet(f"{tmp_path}/raw")
    streams.intake(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/raw"), f"{tmp_path}/mem", f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/cp3").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/mem").select("content", "priority")) == [("bad", "medium"), ("hello", "high")]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3 and spark.read.parquet(f"{tmp_path}/bad").first()["content"] == "odd"

    f = spark.createDataFrame([("h1", dt.datetime(2026, 1, 1)), ("h1", dt.datetime(2026, 1, 1, 1)), ("h2", dt.datetime(2026, 1, 1))], "sha256 string, arrived timestamp")
    f.write.parquet(f"{tmp_path}/files")
    streams.to_table(streams.once(spark.readStream.schema(f.schema).parquet(f"{tmp_path}/files")), f"{tmp_path}/once", f"{tmp_path}/cp4").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2

    logs = spark.createDataFrame([("a", "success", dt.datetime(2026, 1, 1)), ("a", "error", dt.datetime(2026, 1, 1)), ("a", "success", dt.datetime(2026, 1, 9))], "agent_id string, status string, created_at timestamp")
    logs.write.parquet(f"{tmp_path}/logs")
    streams.to_table(streams.daily_activity(spark.readStream.schema(logs.schema).parquet(f"{tmp_path}/logs")), f"{tmp_path}/act", f"{tmp_path}/cp5").awaitTermination()
    assert (dt.date(2026, 1, 1), "a", 2, 1, 1) in rows(spark.read.parquet(f"{tmp_path}/act"))


def test_parts_of_sheets_and_sections(spark):
    """Small parts: headers carried over several of them, sections numbered across them; null and negative row numbers of sections too."""
    rng = np.random.default_rng(3)
    sheet = [(s, int(n), f"H{s}{n}" if rng.random() < 0.05 else None) for s in "ab" for n in rng.permutation(300) - 100]
    got = {(r["sheet"], r["row_no"]): r["complex"] for r in ingest.filled_headers(spark.createDataFrame(sheet, "sheet string, row_no long, h string"), "h", "none", rows_per_part=7).collect()}
    last = {}
    for s, n, h in sorted(sheet):
        last[s] = h or last.get(s, "none")
        assert got[s, n] == last[s]
    records = [(int(i), rng.choice(["KR", "OVIK", "odd"]).item() if i % 9 else None) for i in rng.permutation(200) - 50]
    numbered = hygiene.numbered_in_sections(spark.createDataFrame(records, "id long, section string"), rows_per_part=11).collect()
    for section in ("KR", "OVIK", "odd", None):
        mine = sorted((r["id"], r["number"]) for r in numbered if r["section"] == section)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1)) and len(mine) == sum(s == section for _, s in records)


def test_similarity_links_make_all_components(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HELD_ROWS", 12)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8))
    m = np.repeat(centres, 5, axis=0) + rng.normal(scale=0.15, size=(150, 8))
    m[7] = m[8] = m[100]  # equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(500, None), (501, [0.0] * 8)], "id long, embedding array<double>").repartition(4)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    label = list(range(150))
    near = (n @ n.T) >= 0.95
    while (new := [min(label[j] for j in np.flatnonzero(near[i])) for i in range(150)]) != label:
        label = new
    got = dict(rows(archetypes.clusters(vectors.similarity_links(df, 0.95), df.select("id"))))
    assert got == dict(enumerate(label)) | {500: 500, 501: 501} and 10 < len(set(label)) < 140


def test_batch_searches_in_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HELD_ROWS", 16)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(200, 6))
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), "xyz"[i % 3]) for i, v in enumerate(m)], "id long, embedding array<double>, section string").repartition(3)
    q = df.filter("id < 60").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.batch_vector_search(df, q, 4, group="section").collect()}
    assert got == {(i, k + 1): j for i in range(60) for k, j in enumerate(sorted((j for j in range(200) if j % 3 == i % 3), key=lambda j: (-(n[i] @ n[j]), j))[:4])}
    assert vectors.batch_vector_search(df, q.limit(0), 4).count() == 0


def test_batch_text_search(spark):
    """Against all documents and queries; common words, repeated words, unknown words, null texts."""
    rng = np.random.default_rng(6)
    words = ["the"] * 20 + [f"w{i}" for i in range(30)]
    docs = [(i, None if i == 9 else " ".join(["the", *rng.choice(words, 25)])) for i in range(80)]
    queries = [(i, " ".join(rng.choice(words, 3))) for i in range(15)] + [(20, "the"), (21, "the unknown"), (22, ""), (23, "w1 W1, w1")]
    got = {}
    for r in search.batch_text_search(spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(queries, "query_id long, query string"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    texts = {i: t.split() for i, t in docs if t}
    mean = sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for w in words}
    for i, q in queries:
        want = set(q.lower().replace(",", "").split())
        score = lambda t: sum(np.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in want)  # noqa: E731, B023
        best = sorted(((-round(score(t), 6), k) for k, t in texts.items() if want and want <= set(t)))[:5]
        assert [(k, round(s, 6)) for _, k, s in sorted(got.get(i, []))] == [(k, round(-s, 6)) for s, k in best]
        for one, query in ((got.get(i, []), q),) if want else ():
            single = search.text_search(spark.createDataFrame(docs, "id long, content string"), query, 5).collect() if i in (0, 20, 21) else None
            assert single is None or [r["id"] for r in single] == [k for _, k, _ in sorted(one)]


def test_intermediate_tables(spark):
    from normwerk.sources import shared

    t = shared.stored(spark.range(5).toDF("id"), "five")
    assert t.count() == 5
    shared.clean_up(spark)
    with pytest.raises(Exception, match="FILE|PATH|exist"):
        spark.read.schema("id long").parquet(t.inputFiles()[0]).count()


def test_replayed_batches_and_repeated_keys(spark, tmp_path):
    raw = spark.createDataFrame([("m", '{"type": "NOTE", "priority": "high"}', dt.datetime(2026, 1, 1))], "message string, classification string, ts timestamp")
    raw.write.parquet(f"{tmp_path}/raw")
    for run in range(2):  # a new checkpoint: the same batch again
        streams.intake(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/raw"), f"{tmp_path}/mem", f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/cp{run}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/mem").count() == 1 and spark.read.parquet(f"{tmp_path}/log").count() == 1
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        sinks.merge_snapshot(new, f"{tmp_path}/snap", "k", buckets=4)
    assert [k for k, _ in rows(spark.read.parquet(f"{tmp_path}/snap").select("k", "v"))] == [1, 2]


def test_sketches_of_days_make_any_range(spark):
    rng = np.random.default_rng(8)
    rows_ = [(dt.datetime(2026, 1, int(d), 5), f"10.0.{i // 250}.{i % 250}", f"agent {a}", bool(a % 5 == 0)) for d, i, a in zip(rng.integers(1, 11, 20_000), rng.zipf(1.3, 20_000) % 6000, rng.zipf(1.5, 20_000) % 40)]
    df = spark.createDataFrame(rows_, "ts timestamp, ip string, ua string, is_bot boolean").repartition(3)
    days = traffic.daily_sketches(df)
    parts = days.filter("day < '2026-01-05'").unionByName(days.filter("day >= '2026-01-05'"))  # as appended day by day
    for first, last in ((1, 10), (3, 3), (4, 7)):
        got = {r["class"]: r for r in traffic.sketched(parts, f"2026-01-{first:02d}", f"2026-01-{last:02d}", 3).collect()}
        for name, bot in (("bot", True), ("human", False)):
            some = [r for r in rows_ if r[3] == bot and first <= r[0].day <= last]
            exact = len({r[1] for r in some})
            agents = Counter(r[2] for r in some)
            assert got[name]["requests"] == len(some) and abs(got[name]["ips"] - exact) <= max(2, 0.04 * exact)
            assert [a["n"] for a in got[name]["agents"]] == [n for _, n in agents.most_common(3)] and all(agents[a["value"]] == a["n"] for a in got[name]["agents"])


def _visits():
    """Lines of 60 days, each with its own number of addresses, and the exact numbers."""
    exact = {dt.date(2026, 1, 1) + dt.timedelta(d): 100 + 23 * d for d in range(60)}
    line = '10.{}.{}.{} - - [{:%d/%b/%Y}:10:00:00 +0000] "GET /a HTTP/1.1" 200 5 "-" "Mozilla"'
    return [(line.format(d.day, i // 250, i % 250, d),) for d, n in exact.items() for i in range(n)], exact


def test_approximate_addresses_of_every_day_are_close(spark):
    lines, exact = _visits()
    got = {r["day"]: r["ips"] for r in traffic.approximate_by_class(traffic.parsed(spark.createDataFrame(lines, "line string"))[0]).collect()}
    assert got.keys() == exact.keys() and all(abs(got[d] - n) <= max(2, 0.05 * n) for d, n in exact.items())


def test_streamed_addresses_of_every_day_are_close(spark, tmp_path):
    lines, exact = _visits()
    spark.createDataFrame(lines, "line string").write.parquet(f"{tmp_path}/in")
    streams.to_table(streams.daily_traffic(spark.readStream.schema("line string").parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["day"]: r["ips"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) >= len(exact) - 2 and all(abs(n - exact[d]) <= max(2, 0.05 * exact[d]) for d, n in got.items())


def test_linked_folders_of_long_numbers(spark):
    projects = spark.createDataFrame([("02-10/100004",), ("02-10/1000041",), ("02-10/1000042",), ("02-10/123",)], "project string")
    folders = spark.createDataFrame([(f"02-10_{n} school", 1, f"/a/{n}", n != "1000042") for n in ("100004", "1000041", "1000042")], "folder string, root int, path string, has_comments boolean")
    want = [("02-10/100004", "02-10_100004", "/a/100004", "linked"), ("02-10/1000041", "02-10_1000041", "/a/1000041", "linked"), ("02-10/1000042", "02-10_1000042", "/a/1000042", "no_comments_file"), ("02-10/123", None, None, "no_prefix")]
    assert rows(hygiene.linked_folders(projects, folders)) == sorted(want, key=repr)


def test_audit_summary_counts_files(spark):
    found = {"a": [["TABS", "CRLF"], ["TABS"], []], "b": [["SPACES_IN_FILENAME"]] * 3, "c": [[]], "d": [["TABS"]], None: [["TABS"], []]}
    df = spark.createDataFrame([(p, [(i, 1) for i in x]) for p, every in found.items() for x in every], "path string, issues array<struct<issue: string, n: int>>")
    assert rows(hygiene.audit_summary(df)) == [("CLEAN", 4), ("CRLF", 1), ("SPACES_IN_FILENAME", 1), ("TABS", 2)]
