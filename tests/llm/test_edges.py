"""Empty tables, nulls, ties, repeated rows, very long texts and columns of the outputs' names, operator by operator."""

import random

import numpy as np
import pytest
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from normwerk.llm import compressors, langid, licenses, line_templates, near_copies, ogg, packing, pieces, quality, queries, simhash, token_files, tokens

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = SCHEMA + ", score double, lang_pred string, rejected boolean, media string, payload string, ogg string, host string, rule string, n_words int, labels string, h long, at int, slots string, node long, root long, key long, keys string, fp string, n int"
MORE = (9.0, "x", True, "m", "p", "o", "h", "r", 3, "l", 1, 2, "s", 4, 5, 6, "k", "f", 7)


OF_OTHER_TABLES = ("op8_url_rules", "op11_conversation_repair", "op12_vector_graph", "op13_phrases")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *MORE) for i, t, lang in rows], CLASH)


def save(spark, at, rows, labels=(), benchmark=(), pages=(), conversations=(), embeddings=()):
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame(list(embeddings), "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    table(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, save(spark, tmp_path, [])).count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids, texts and languages, empty texts, repeated rows, ties, and one text of two million characters."""
    rng = random.Random(31)
    long = "\n".join(prose(rng, 40) for _ in range(9000))
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (3, long, "en"), (4, long + " x", "en"), (None, "alpha beta", None), (None, None, None), (5, " \n ", "fr"), (6, "alpha", "en"), (6, "alpha", "en"), (7, "123 456", "en")]
    rows += [(i, prose(rng, 50) if i % 2 else prose(rng, 50)[::-1], "en" if i % 2 else "de") for i in range(10, 40)]
    at = save(spark, tmp_path_factory.mktemp("odd"), rows, [(i, i % 2, 0) for i in range(1, 40)] + [(3, None, None), (10, 0, 0)], [(1, prose(rng, 12)), (2, None)], [(1, None, None), (2, "http://a.com/de/", "")])
    return at, rows


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in OF_OTHER_TABLES and n not in ("op7_best_fit_packing", "pipeline")])
def test_odd_rows_come_out_as_often_as_they_came_in(spark, odd, name):
    at, rows = odd
    got = [r["doc_id"] for r in queries.QUERIES[name](spark, at).collect()]
    assert sorted(map(repr, got)) == sorted(repr(i) for i, _, _ in rows)


def test_odd_rows_have_the_stated_values(spark, odd):
    """Not only as many rows: what null, empty, repeated and very long texts get."""
    at, rows = odd
    take = lambda q: {k: [r for r in out if r["doc_id"] == k] for out in [queries.QUERIES[q](spark, at).collect()] for k in (1, 2, 3, 5, 6, None)}
    language = take("op3_langid_zstd")
    assert {r["lang_pred"] for k in (1, 2, 5) for r in language[k]} == {"und"} and {r["lang_pred"] for r in language[3]} == {"en"} and len({tuple(r) for r in language[3]}) == 1
    quality_ = take("op2_quality_zstd")
    assert quality_[1][0]["score"] == quality_[2][0]["score"] and len({tuple(r) for r in quality_[3]}) == len({tuple(r) for r in quality_[6]}) == 1
    lines = take("op5_line_templates")
    assert all(r["n_dropped"] == 0 for k in (1, 2, 5) for r in lines[k]) and lines[2][0]["n_chars"] == 0
    leaks = take("op6_benchmark_templates")
    assert all(not r["contaminated"] and r["n_items"] == 0 and list(r["item_ids"]) == [] for k in (1, 2, 5) for r in leaks[k])
    scans = take("op9_license_templates")
    assert all(r["n_words"] == 0 and r["first_word"] is None and r["labels"] == "" for k in (1, 2, 5) for r in scans[k])


def test_odd_rows_are_packed_and_piped(spark, odd):
    at, rows = odd
    got = queries.op7_best_fit_packing(spark, at).collect()
    whole = sum(len(x) // 4 + 1 for x in tokens.encoder(special=True).batch([t for _, t, _ in rows]))
    assert sum(r["length"] for r in got) == whole and all(r["length"] <= packing.CAPACITY for r in got)
    out = queries.pipeline(spark, at).collect()
    assert {3} <= {r["doc_id"] for r in out} and not {1, 2, 5, 7} & {r["doc_id"] for r in out}


def test_columns_of_the_outputs_names(spark, odd):
    """The operators' own interfaces over tables that have such columns: outputs replace them, others stay."""
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    model = {"constant": 0.25}
    assert {r["score"] for r in quality.score(docs, model).select("score").collect()} == {0.25}
    found = langid.predict(docs, [("en", b"alpha beta gamma delta" * 9), ("de", b"rho sigma tau upsilon" * 9)])
    assert found.columns == [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")] + ["lang_pred", "score", "rejected"]
    assert found.filter("lang_pred not in ('en', 'de', 'und')").count() == 0
    scanned = licenses.scan(docs)
    assert scanned.count() == docs.count() and scanned.columns.count("score") == 1 and scanned.columns.count("labels") == 1
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert line_templates.drop_lines(docs).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd[0]).columns == docs.columns, name
    media = ogg.write_ogg(docs.limit(3).selectExpr("doc_id", "length(text) as n_bytes", "cast(coalesce(text, '') as binary) as payload", "media"))
    assert media.count() == 3 and media.columns.count("media") == 1


def test_short_texts_with_narrow_margins_are_rejected(spark):
    rng = random.Random(3)
    english, german = ([" ".join(rng.choice(w) for _ in range(80)) for _ in range(60)] for w in (["the", "and", "house", "water", "people", "with"], ["der", "und", "haus", "wasser", "leute", "mit"]))
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([*((t, "en") for t in english), *((t, "de") for t in german)])], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    texts = ["a", "xq", "123 z", "Qwrt 7", "zzzz zzzz", "the people with the water and the house", "die leute mit dem wasser und der leute haus", None, "12"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("i").collect()
    assert [r["rejected"] for r in got] == [True] * 5 + [False] * 2 + [True] * 2
    assert [r["lang_pred"] for r in got[5:]] == ["en", "de", "und", "und"]


def test_samples_are_the_smallest_hashes_and_whole(spark):
    """Of labels with many and with few ids, repeated ids and texts of any length."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1), "a" if i % 50 else "b") for i in range(4000)] + [(5, "another text of five", "a"), (None, "none", "a"), (9000, "x", None)], "doc_id long, text string, lang string")
    got = compressors.sample_per_label(docs, docs.select("doc_id", "lang"), "lang", 100)
    h = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").distinct().collect()}
    for label, n in (("a", 100), ("b", 80)):
        ids = sorted((i for i in range(4000) if bool(i % 50) == (label == "a")), key=h.get)[:n]
        assert got[label] == [min([f"text {i} " * (i % 7 + 1)] + (["another text of five"] if i == 5 else [])) for i in ids]


def test_raw_dictionaries_hold_stretches_of_whole_texts():
    texts = [f"{i:03d}" * 400 for i in range(50)] + ["short one"]
    raw = compressors.raw_dictionary(texts, 30_000)
    assert len(raw) <= 30_000 and b"short one" in raw and all(f"{i:03d}".encode() * 3 in raw for i in range(50))
    assert compressors.raw_dictionary(["abc", "de"], 100) == b"abc\nde" and compressors.raw_dictionary([], 10) == b""
    ends = compressors.raw_dictionary(["".join(chr(97 + i // 1000) for i in range(20_000))], 5_000)
    assert {chr(b) for b in ends} >= set("aejot")  # from the first to the last


def test_quality_sees_differences_only():
    """Texts of other lengths and compressibility whose sizes differ alike have one score."""
    assert (quality.features(np.array([[1000, 400, 300, 350]])) == quality.features(np.array([[500, 800, 600, 700]]))).all()
    assert (quality.features(np.zeros((0, 4))) == 0).all()


def test_tables_of_pieces_keep_all_keys():
    rng = np.random.default_rng(1)
    h, g = (rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(2))
    h[:2000] &= np.uint64(7)  # the same places
    t = pieces.Table(bits=4)
    for a in range(0, 5000, 500):
        t.add(h[a : a + 500], g[a : a + 500])
    assert (t.find(h, g) == np.arange(5000)).all() and (t.find(h, g + np.uint64(1)) == -1).all()


def test_large_keys_of_several_components_are_compared_in_full(spark):
    """A pair that shares a key with many others, and never stands near its partner in it."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(30)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]
    near = base[0].copy()
    near[60] = "other"
    texts.append((30, " ".join(near)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    prints = near_copies.nodes_of(docs).withColumn("_of", F.struct("doc_id"))
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("_of").alias("_of"))
    banded = nodes.selectExpr("1L as key", "node", "n").unionByName(nodes.selectExpr("node as key", "node", "n"))
    of = spark.createDataFrame([], "node long, root long")
    links = near_copies._further_links(docs, ["doc_id"], nodes, banded, of).collect()
    pair = {r["node"] for r in prints.filter("doc_id in (0, 30)").collect()}
    assert [{r["a"], r["b"]} for r in links] == [pair]


def test_layout_of_token_files(spark, tmp_path, monkeypatch):
    """Encodings, row groups and page indexes as the files have them; more files than are broadcast give the same positions."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(6000)], "doc_id long, text string")
    monkeypatch.setitem(token_files.LAYOUT, "parquet.block.size", str(256 * 1024))
    monkeypatch.setitem(token_files.LAYOUT, "parquet.page.row.count.limit", "200")
    monkeypatch.setitem(token_files.LAYOUT, "parquet.page.size", str(8 * 1024))
    token_files.write_token_files(docs, f"{tmp_path}/t")
    groups = 0
    for file in (tmp_path / "t").glob("part-*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {(c := meta.row_group(g).column(i)).path_in_schema.split(".")[0]: c for i in range(meta.num_columns)}
            assert all(c.has_offset_index and c.has_column_index and c.compression == "ZSTD" for c in columns.values())
            assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"} & set(columns["ids"].encodings) and "DELTA_BINARY_PACKED" in columns["start_in_part"].encodings + columns["doc_id"].encodings
            assert columns["doc_id"].statistics.min <= columns["doc_id"].statistics.max
    assert groups > len(list((tmp_path / "t").glob("part-*.parquet")))
    want = sorted(map(tuple, token_files.read_metadata(spark, f"{tmp_path}/t").collect()))
    monkeypatch.setattr(token_files, "BROADCAST_FILES", 0)
    assert sorted(map(tuple, token_files.read_metadata(spark, f"{tmp_path}/t").collect())) == want
    n = [r[2] for r in want]
    assert [r[1] for r in want] == np.concatenate([[0], np.cumsum(n)[:-1]]).tolist()
    some = token_files.read_tokens(spark, f"{tmp_path}/t", 100, 103)
    assert sorted((r["doc_id"], len(r["ids"])) for r in some.collect()) == [(i, n[i]) for i in range(100, 104)]
