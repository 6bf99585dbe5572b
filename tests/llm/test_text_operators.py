"""Tokens, packing, near duplicates, line templates, decontamination, classifiers and the pipeline against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from normwerk.llm import decontaminate, langid, line_templates, near_copies, packing, quality, queries, simhash, token_files, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", score double, _k1 long, fp string, key string, rank int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", str(rng.randint(0, 99))]) for _ in range(n))


def write(spark, at, rows, **more):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, 2, "f", "k", 3) for i, t in rows], EXTRA).write.parquet(f"{at}/documents.parquet")
    for name, (data, schema) in more.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice([1, 3, 30, 300]))) for i in range(60)]
    out += [(60, None), (61, ""), (62, "  \n\t "), (63, prose(rng, 9000)), (64, out[5][1]), (65, out[5][1]), (None, out[5][1]), (66, out[7][1]), (66, out[7][1]), (67, "don't  stop\n\n\nnow \x00 漢字 \ue000 x")]
    near = prose(rng, 400).split()
    for i in range(70, 90):
        w = list(near)
        w[rng.randrange(len(w))] = "changed"
        out.append((i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def plain_ids():
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    return lambda t: [*tool.encode(t or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library(plain_ids):
    rng, e = random.Random(3), tokens.encoder()
    bits = ["a", "é", "Z", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'", "'s", "'ll", " '", "1", "23", "²", "̈", "漢", "😀", "|", "***", "\r\n", "_", "ß", "×", "-", "!!", "<|endoftext|>", "\x00", "\x1c", "\x85", "\ufeff", "\ue000", "x" * 80]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(4000)] + [None, ""]
    for t, got in zip(texts, e.batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain_ids(t)[:-1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op4(spark, tmp_path, rows, plain_ids):
    got = queries.op4_token_parquet(spark, write(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain_ids(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_selective_reads(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert {r["doc_id"] for r in token_files.read_tokens(spark, path, 10, 12).collect()} == {10, 11, 12}
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().toString()
    assert token_files.read_metadata(spark, path).count() == len(rows) and "ids:array" not in plan.split("Physical Plan")[1]
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{path}0")
    assert token_files.digests(spark, f"{path}0").count() == 0


def test_op7(spark, tmp_path, rows, plain_ids):
    got = queries.op7_best_fit_packing(spark, write(spark, tmp_path, rows)).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = plain_ids(t)
        mine = [r for r in by[i] if r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])]
        assert {r["start"] for r in mine} >= {0} and sum({r["piece"]: r["length"] for r in mine}.values()) == len(ids)
        assert all(r["length"] == 2048 for r in mine if r["piece"])
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0, *[r["length"] for r in s]])[:-1]) and sum(r["length"] for r in s) <= 2048 and sum(r["length"] * 3 > 2048 for r in s) <= 2
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_places_every_piece_once():
    for seed in range(60):
        r = random.Random(seed)
        c = r.choice([1, 7, 100, 2048])
        counts = defaultdict(int)
        for _ in range(r.randint(0, 200)):
            counts[r.randint(1, c) if r.random() < 0.5 else max(1, int(c * r.random() ** 3))] += r.choice([1, 1, 2, 50])
        room, seen = defaultdict(list), defaultdict(set)
        for x, rank, n, first, offset in packing.plan(dict(counts), c):
            for k in range(n):
                room[first + k].append((offset, x))
                assert rank + k not in seen[x]
                seen[x].add(rank + k)
        assert {x: len(v) for x, v in seen.items()} == dict(counts)
        for s in room.values():
            s.sort()
            assert [o for o, _ in s] == list(np.cumsum([0, *[x for _, x in s]])[:-1]) and sum(x for _, x in s) <= c


def plain_print(t):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_anchors_miss_no_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    sets = []
    for x in (a, b):
        s = [set() for _ in x]
        for r, k in zip(*simhash.anchor_keys(x), strict=True):
            s[r].add(k)
        sets.append(s)
    assert all(p & q for p, q in zip(*sets, strict=True)) and max(map(len, sets[0])) <= 33


def components_of(prints):
    ids = sorted(prints, key=repr)
    parent = {f: f for f in set(prints.values())}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for i, x in enumerate(fs):
        for y in fs[:i]:
            if (x ^ y).bit_count() <= 4:
                parent[find(x)] = find(y)
    least = {}
    for i in ids:
        if i[0] is not None:
            r = find(prints[i])
            least[r] = min(least.get(r, i[0]), i[0])
    return {i: least.get(find(f)) for i, f in prints.items()}


@pytest.mark.parametrize("hot", [2048, 3])
def test_op10(spark, tmp_path, rows, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)  # 3: the cells of hot keys do the work
    got = queries.op10_simhash_anchors(spark, write(spark, tmp_path, rows)).collect()
    prints = {(i, n): plain_print(t) for n, (i, t) in enumerate(rows)}
    roots = components_of(prints)
    assert sorted((repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)) == sorted(repr((k[0], f"{f:016x}", roots[k])) for k, f in prints.items())


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_templates(rows, spare_copies=False):
    """The same rule by plain loops: words -> masked -> leaves -> constant words -> two templates a form -> documents of each."""
    lt = line_templates
    held = defaultdict(set)  # form: its documents
    forms = {}
    for row in set(rows):
        for at, line in enumerate((row[1] or "").split("\n")):
            w = tuple("<*>" if any(c.isascii() and c.isdigit() for c in x) else x for x in line.split())
            if len(w) >= lt.MIN_WORDS:
                held[w].add(row)
                forms[row, at] = w
    leaf = lambda w: (len(w), w[: lt.DEPTH])
    support, every = defaultdict(int), defaultdict(int)
    for w, docs in held.items():
        every[leaf(w)] += len(docs)
        for p, x in enumerate(w):
            support[leaf(w), p, x] += len(docs)

    def template(w, share):
        t = tuple(x if x != "<*>" and support[leaf(w), p, x] >= max(lt.MIN_DOCS, share * every[leaf(w)]) else "<*>" for p, x in enumerate(w))
        return (leaf(w), t) if sum(x != "<*>" for x in t) >= lt.MIN_CONSTANT * len(t) else None

    both = {w: [template(w, lt.CONSTANT_SHARE), template(w, 0)] for w in held}
    docs = defaultdict(set)
    for w, ts in both.items():
        for t in ts:
            docs[t] |= held[w]
    again = {w: next((t for t in ts if t and len(docs[t]) >= lt.MIN_DOCS), None) for w, ts in both.items()}
    gone = {row: {at: again[w] for (r, at), w in forms.items() if r == row and again[w]} for row in set(rows)}
    if spare_copies:
        lines = lambda row: (row[1] or "").split("\n")
        much = [r for r in gone if r[1] and gone[r] and (len(r[1]) - sum(len(lines(r)[at]) + 1 for at in gone[r])) < len(r[1]) * (1 - lt.MAX_SHARE)]
        rest = {r: (tuple(sorted(gone[r].items())), tuple((at, x) for at, x in enumerate(lines(r)) if at not in gone[r])) for r in much}
        single = {r: sum(x == rest[r] for x in rest.values()) < 2 for r in much}
        order = lambda r: hashlib.md5(r[1].encode()).hexdigest()[:15]
        first = {}
        for r in much:
            for t in gone[r].values():
                first[t] = min(first.get(t, (True, "g")), (single[r], order(r)))
        for r in much:
            gone[r] = {at: t for at, t in gone[r].items() if first[t][1] != order(r)} if single[r] else {}
    return [(i, t if not gone[i, t] else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone[i, t])) for i, t in rows]


def test_op5(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "\n".join([prose(rng, 40), f"Posted by user{i} on day {i} of the year", *(["Read more about this story here"] if i % 2 else []), f"call us now for a {rng.choice(WORDS)} offer today", prose(rng, 30)])) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "one line"), (None, rows[0][1]), (23, rows[1][1]), (24, rows[1][1]), (24, rows[1][1]), (25, "\n\n")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _drop int")
    got = line_templates.drop_lines(df)
    assert got.columns == df.columns
    want = plain_templates(rows)
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(repr, want))
    assert "Posted by" not in dict(want)[3] and "Read more" not in dict(want)[3] and "call us" not in dict(want)[3]
    spared = line_templates.drop_lines(df, spare_copies=True)
    assert sorted(repr((r["doc_id"], r["text"])) for r in spared.collect()) == sorted(map(repr, plain_templates(rows, spare_copies=True)))
    assert line_templates.drop_lines(df.limit(0)).count() == line_templates.drop_lines(df.limit(0), spare_copies=True).count() == 0


@pytest.mark.parametrize("own", [60, 6, 0])
def test_op5_drops_a_shared_passage_whatever_its_share(spark, own):
    """Pages with much, little and nothing of their own; only with spare_copies does one page keep the passage, or all copies stay."""
    rng = random.Random(own)
    passage = "this passage of two lines stands in all of the pages\nand its second line closes what the first began to say"
    rows = [(i, passage + ("\n" + " ".join(f"{rng.choice(WORDS)}{chr(97 + rng.randrange(26))}" for _ in range(own)) if own else "")) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for spare, kept in ((False, 0), (True, {60: 0, 6: 1, 0: 6}[own])):
        got = line_templates.drop_lines(df, dropped="n", spare_copies=spare).collect()
        assert sum("passage" in r["text"] for r in got) == kept and {r["n"] for r in got} <= {0, 2}
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(plain_templates(rows, spare))


ITEMS = [
    (1, "Tom has 5 red apples and gives 2 of them to Anna. How many apples does Tom keep in the end?"),
    (2, "The train leaves the old station at 9 h and travels 120 km before the driver stops to rest."),
    (3, "short item"),
    (4, None),
    (5, ""),
    (6, "exactly five words stand here"),
]


def test_op6(spark, tmp_path):
    rng = random.Random(4)
    filler = lambda: prose(rng, 60)
    rows = [
        (1, filler() + " " + ITEMS[0][1] + " " + filler()),
        (2, filler() + ". " + ITEMS[0][1].replace("Tom", "Ben").replace("Anna", "Zoe").replace("5", "17")),  # other values, the same everywhere
        (3, filler() + ". " + ITEMS[1][1].replace("9 h", "11 h").replace("120 km", "80 mi")),
        (4, filler()),
        (5, None),
        (6, ""),
        (7, "Here Tom has 5 red apples and nothing else happens to them at all"),
        (8, ITEMS[5][1]),
        (None, ITEMS[1][1]),
        (9, "short item"),
        (1, "repeated id " + filler()),
    ]
    at = write(spark, tmp_path, rows, benchmark=(ITEMS + ITEMS[:1], "item_id long, text string"))
    got = sorted((repr((r["doc_id"], list(r["item_ids"]))) for r in queries.op6_benchmark_templates(spark, at).collect()))
    assert got == sorted(map(repr, [(1, [1]), (2, [1]), (3, [2]), (4, []), (5, []), (6, []), (7, []), (8, [6]), (None, [2]), (9, [3]), (1, [])]))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = decontaminate.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [4, 5, 6, 7, 1]))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == len(rows) and decontaminate.clean(docs.limit(0), none).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    item = "today Anna pays 7 coins to Omar and Anna takes 7 pears from Omar before the big market closes"
    same = item.replace("Anna", "Lena").replace("7", "9")
    mixed = "today Lena pays 9 coins to Omar and Rita takes 4 pears from Omar before the big market closes"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    got = decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [1]


def test_quality(spark, tmp_path):
    rng = random.Random(6)
    good = lambda: prose(rng, 150)
    bad = lambda: " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(150))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(300, None), (301, ""), (None, good())]
    labels = [(i, int(i % 3 > 0), 0) for i in range(240)] + [(5, 1, 0), (6, None, 0)]
    got = queries.op2_quality_zstd(spark, write(spark, tmp_path, rows, labels=(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    none = quality.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), none).first()["score"] == 0.5


def test_language(spark, tmp_path):
    rng = random.Random(7)
    vocab = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)] for k, letters in (("aa", "abcdeimn"), ("bb", "opqrstuv"), ("cc", "éèçàôfgh"))}
    text = lambda k, n: " ".join(rng.choice(vocab[k]) for _ in range(n))
    rows = [(i, text(k, rng.choice([20, 100, 400])), k) for i in range(150) for k in [("aa", "bb", "cc")[i % 3]]] + [(200, None, "aa"), (201, "", None), (202, "123 !? 4", "aa"), (203, text("bb", 50), None)]
    spark.createDataFrame([(*r, "src", 1) for r in rows], "doc_id long, text string, lang string, source string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_langid_zstd(spark, str(tmp_path)).collect()}
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] for i, t, k in rows[:150] if len(t) > 200)
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in rows[:150]]) > 0.97
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und", "und", "und", "bb"]
    assert langid.predict(spark.createDataFrame([(1, "x")], "doc_id long, text string"), []).first()["lang_pred"] == "und"


def test_pipeline(spark, tmp_path, rows):
    """Each stage against its plain rule; rows and columns of documents until the last."""
    item = (1, ITEMS[1][1])
    more = [*rows, (500, prose(random.Random(1), 80) + ". " + item[1])]
    at = write(spark, tmp_path, more, benchmark=([item], "item_id long, text string"))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        a, b = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in (before, docs))
        if name == "language":
            assert sorted(map(repr, b)) == sorted(repr(x) for x in a if x[1] and any(c.isalpha() for c in x[1]))
        if name == "lines":
            assert sorted(map(repr, b)) == sorted(map(repr, plain_templates(a, spare_copies=True)))
        if name == "near_duplicates":
            roots = components_of({(i, n): plain_print(t) for n, (i, t) in enumerate(a)})
            assert sorted(i for i, _ in b) == sorted({r for r in roots.values() if r is not None})
        if name == "benchmark":
            assert {i for i, _ in a} - {i for i, _ in b} == {500}
    packed = corpus_pipeline.run(spark, at)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_near_copies_by_five_word_shingles(spark):
    """Pairs around 0.8, most of them over 4 bits apart, and a group, against all pairs."""
    rng = random.Random(12)
    texts = []
    for n in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(w))
        for k in rng.sample(range(200), 1 + n % 6):
            w[k] = "changed"
        texts.append(" ".join(w))
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    linked = {2 * n for n in range(60) if len(sets[2 * n] & sets[2 * n + 1]) >= 0.8 * len(sets[2 * n] | sets[2 * n + 1])}
    assert 30 < len(linked) < 60
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == set(range(120)) - {i + 1 for i in linked}


def test_near_copies_are_found_by_anchors(spark, monkeypatch):
    """Without minhash: texts of equal words but one, whose fingerprints of 5-word shingles are within 4 bits, come together; others don't."""

    def nothing(it):
        for b in it:
            yield pa.RecordBatch.from_pylist([], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    rng = random.Random(16)
    base = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(30)]
    texts = [" ".join(w) for w in base] + [" ".join(["changed", *w[1:]]) for w in base]

    def plain(t):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in {" ".join(t.split()[i : i + 5]) for i in range(396)}]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    linked = [i for i in range(30) if (plain(texts[i]) ^ plain(texts[30 + i])).bit_count() <= 4]
    assert len(linked) > 25
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_copies.nodes_of(docs)
    at = {r["doc_id"]: (r["node"], r["fp"]) for r in nodes.collect()}
    assert all(f % 2**64 == plain(texts[i]) for i, (_, f) in at.items())
    pairs = {frozenset((r["a"], r["b"])) for r in near_copies._anchor_pairs(nodes).collect()}
    assert {frozenset((at[i][0], at[30 + i][0])) for i in linked} <= pairs
    prints = dict(at.values())
    assert all(((prints[a] ^ prints[b]) % 2**64).bit_count() <= near_copies.RADIUS for a, b in pairs)
    monkeypatch.setattr(near_copies, "_near_rows", nothing)
    monkeypatch.setattr(near_copies, "_further_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    root = {r["doc_id"]: r["root"] for r in near_copies.roots(docs, ["doc_id"]).collect()}
    assert all(root[i] == root[30 + i] for i in linked) and len(set(root.values())) >= 30


def test_near_duplicates_keeps_a_row_of_every_group(spark):
    rng = random.Random(13)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (1, a), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(repr((r["doc_id"], r["text"])) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(map(repr, [(1, a), (None, b), (1, c), (1, d), (3, "")]))


def test_added_tokens_in_texts_are_tokens(spark, tmp_path):
    """The library with nothing but add_special_tokens=False."""
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = lambda t: tool.encode(t, add_special_tokens=False).ids
    rng, bits = random.Random(8), ["a", " ", "\n", ".", "1", "é", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["a b <|endoftext|> c", "no token", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(500))]
    for t, got in zip(texts, tokens.encoder(special=True).batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(t)
    at = write(spark, tmp_path, list(enumerate(texts[:2])))
    want = [[*plain(t), 0] for t in texts[:2]]
    assert 50256 in want[0]
    got = {r["doc_id"]: r for r in queries.op4_token_parquet(spark, at).collect()}
    assert [(got[i]["n_tokens"], got[i]["ids_crc32"]) for i in (0, 1)] == [(len(w), crc(w)) for w in want]
    got = {r["doc_id"]: r for r in queries.op7_best_fit_packing(spark, at).collect()}
    assert [(got[i]["length"], got[i]["ids_crc32"]) for i in (0, 1)] == [(len(w), crc(w)) for w in want]


@pytest.mark.parametrize("n", [60, 1500])
def test_templates_do_not_depend_on_size(spark, n):
    """Two fields of 15 values each: all lines go, be there few of each value or a hundred."""
    rng = random.Random(n)
    own = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{x}{y}" for x in "abcdefghij" for y in "abcdef") for i in range(n)]
    rows = [(i, f"{own[i]}\nthis was sent by {rng.choice(WORDS[:15])} and {rng.choice(WORDS[5:])} from our office") for i in range(n)]
    # a line with fields of 300 values in every third document, which repeats three times in it, and few of which are alike
    rows = [(i, t + f"\nplease write to {''.join(rng.choice('abcdefg') for _ in range(3))} or {''.join(rng.choice('abcdefg') for _ in range(3))} about your order" * (3 if i % 3 == 0 else 0)) for i, t in rows]
    got = line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), dropped="n").collect()
    assert {(r["doc_id"], r["text"]) for r in got} == set(enumerate(own)) and all(r["n"] == (4 if r["doc_id"] % 3 == 0 else 1) for r in got)


def test_mostly_shared_documents_lose_the_passage(spark):
    """With copies spared: pages of a long shared passage and a short text of their own; of the second passage, no page is a copy."""
    rng = random.Random(15)
    p, q = ("\n".join(prose(rng, 30) for _ in range(4)) for _ in range(2))
    own = [prose(rng, 12) for _ in range(16)]
    rows = [(i, f"{p if i < 8 else q}\n{t}") for i, t in enumerate(own)] + [(16, f"{p}\n{own[0]}")] + [(17, f"{prose(rng, 400)}\n{p}")]
    got = {r["doc_id"]: (r["text"], r["n"]) for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), dropped="n", spare_copies=True).collect()}
    whole = [i for i in range(17) if got[i] == (rows[i][1], 0)]
    assert [i for i in whole if not 8 <= i < 16] == [0, 16] and len(whole) == 3
    assert all(got[i] == (own[i], 4) for i in range(16) if i not in whole) and got[17] == (rows[17][1].split("\n")[0], 4)


def test_word_for_word_copies_are_found(spark):
    """Items dense in numbers, of few words, with a first word after a colon, and with one altered repeated value."""
    item = "today Anna pays 7 coins to Omar at the old market hall while all of his other friends sit by the river and sing until Anna goes home"
    items = [(1, "Compute 12 + 15 * 3 - 7"), (2, "Who wrote the long poem"), (3, item), (4, "Name 3 rivers"), (5, "Where do 4 tall people from the north live")]
    docs = [(1, "first. Compute 12 + 15 * 3 - 7 then rest"), (2, "Question: Who wrote the long poem about it"), (3, item.replace("until Anna", "until Rita")), (4, "please, Name 3 rivers of it"), (5, "Question: Where do 9 tall people from the north live now"), (6, "Compute 12 + 15 * 4 - 7")]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(1, 6)]


def plain_contaminated(docs, items):
    """Every window of every document against every window of every item, by words."""
    token = re.compile(r"[.!?\n]+|[^\W_]+(?:['’.,][^\W_]+)*")

    def words(t):
        out, before = [], "."
        for x in token.findall(t or ""):
            if x[0] not in ".!?\n":
                low, name = x.lower(), x[0].isupper() and x[1:] == x[1:].lower()
                kind = "<number>" if x[0].isdigit() else "<name>" if name and before[0] not in ".!?\n" else "<unit>" if low in decontaminate.UNITS and not name and before[0].isdigit() else low
                out.append((low, kind, name))
            before = x
        return out

    found = set()
    for item_id, text in set(items):
        w = words(text)
        size = min(decontaminate.WINDOW, len(w))
        if size < decontaminate.MIN_COPY:
            continue
        places = range(len(w) - size + 1)
        for doc_id, t in docs:
            v = words(t)
            at = range(len(v) - size + 1)
            literal = {b for b in places for a in at if [x[0] for x in w[b : b + size]] == [x[0] for x in v[a : a + size]]}
            if len(literal) >= decontaminate.MIN_SHARE * len(places) - 1e-9:
                found.add((doc_id, item_id))
            if size < decontaminate.MIN_ITEM:
                continue
            enough = lambda x: sum(k == low for low, k, _ in x) >= decontaminate.MIN_LITERAL
            by_shift = defaultdict(lambda: (set(), set()))
            n = sum(enough(w[b : b + size]) for b in places)
            for b in places:
                part = w[b : b + size]
                forms = [part] + ([[(part[0][0], "<name>", True), *part[1:]]] if b == 0 and part[0][2] and part[0][1] == part[0][0] else [])
                for form in forms:
                    for a in at if enough(form) else ():
                        if [x[1] for x in form] == [x[1] for x in v[a : a + size]]:
                            covered, values = by_shift[a - b]
                            covered.add(b)
                            values |= {(x[0], y[0]) for x, y in zip(form, v[a : a + size], strict=True) if x[1] != x[0]}
            covered = {b for c, values in by_shift.values() if len(values) == len({x for x, _ in values}) for b in c}
            if n and len(covered) >= decontaminate.MIN_SHARE * n - 1e-9:
                found.add((doc_id, item_id))
    return found


def test_matches_equal_all_windows_against_all(spark):
    """Random texts with passages of items, some of which share long instructions, others values, others all words; nulls, empty texts, repeated rows."""
    rng = random.Random(21)
    bits = [*WORDS[:12], "Anna", "Tom", "Zoe", "5", "17", "3.5", "km", "h", "Alpha"]
    some = lambda n: " ".join(rng.choice(bits) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    told = "read this text with care and then give the one right answer to it please now"
    items = [(i, f"{told if i % 3 else ''} {some(rng.choice([2, 3, 4, 5, 8, 12, 30]))}") for i in range(25)] + [(30, None), (31, ""), (0, "a b c d e f g")]
    docs = [(i, some(rng.randrange(60))) for i in range(20)]
    for i in range(20, 60):
        w = rng.choice(items)[1] or ""
        if rng.random() < 0.5:
            w = w.replace("Anna", "Mary").replace("5", "8")
        w = w.split()
        a = rng.randrange(max(1, len(w) // 2))
        docs.append((i, f"{some(5)} {' '.join(w[a:])} {some(5)}"))
    docs += [(60, None), (61, ""), (62, told), (63, told), (20, docs[20][1])]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 30


def test_items_of_one_and_two_words_without_ids_and_with_one_id(spark):
    """Found at word borders; an id's texts and null ids are told apart."""
    rng = random.Random(21)
    long = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(3)]
    items = [(1, "zyzzyva"), (2, "Quark soup"), (None, long[0]), (3, long[1]), (3, long[2]), (4, None), (4, ""), (None, "sole")]
    docs = [(1, "a Zyzzyva, here"), (2, "zyzzyvas"), (3, "quark  soup."), (4, "quark and soup"), (5, "x " + long[0]), (6, long[1] + " y"), (7, long[2]), (8, long[2] + " " + long[1]), (9, "soup quark"), (10, "the sole thing " + long[0])]
    df, b = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], list(r["item_ids"])) for r in decontaminate.contaminated(df, b).collect()}
    assert got == {1: (True, 1, [1]), 2: (False, 0, []), 3: (True, 1, [2]), 4: (False, 0, []), 5: (True, 1, []), 6: (True, 1, [3]), 7: (True, 1, [3]), 8: (True, 1, [3]), 9: (False, 0, []), 10: (True, 1, [])}
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, b).collect()) == [2, 4, 9]


def plain_sizes(text, dictionaries, level):
    """Bytes of each piece of 1,024 under each dictionary, by the library alone."""
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    raw = text.encode("utf-8", "replace")
    out = []
    for a in range(0, len(raw), 1024):
        row = [len(raw[a : a + 1024])]
        for d in dictionaries:
            more = {"dict_data": zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(d) >= 8 else {}
            row.append(len(zstandard.ZstdCompressor(level=level, **plain, **more).compress(raw[a : a + 1024])))
        out.append(row)
    return out


def test_quality_equals_a_plain_loop(spark):
    """Sizes, differences and the calibrated score of every text; the calibration is the least of its loss."""
    rng = random.Random(14)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 80, 900]))) if i % 3 else "".join(rng.choice("XYZ!$ ") for _ in range(rng.choice([20, 3000]))) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 17 else int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    extra = [(200, ""), (201, None), (202, "é" * 5000), (203, texts[0]), (204, texts[0])]
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.unionByName(spark.createDataFrame(extra, docs.schema)), model).collect()}
    x = {}
    for i, t in [*enumerate(texts), *extra]:
        rows = plain_sizes(t or "", model["dictionaries"], 6)
        total = [sum(r[j] for r in rows) for j in range(4)]
        each = [(r[3] - r[2]) / r[1] for r in rows]
        x[i] = [(total[3] - total[2]) / total[1], min(each), max(each)] if rows else [0.0] * 3
    c = model["calibration"]

    def chance(v):
        z = [max(-4.0, min(4.0, (a - m) / s)) for a, m, s in zip(v, c.mean, c.scale)]
        terms = [1.0, *z, *(z[i] * z[j] for i in range(3) for j in range(i, 3))]
        return 1 / (1 + np.exp(-sum(w * t for w, t in zip(c.w, terms))))

    for i, v in x.items():
        p = chance(v)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(np.log(p / (1 - p)) + model["shift"]))), abs=1e-9)
    assert got[203] == got[204] == got[0]
    y = np.array([i % 3 > 0 for i in range(160)], dtype=float)
    m = np.array([x[i] for i in range(160)])
    best = quality.Calibration(m, y)
    loss = lambda w: -np.sum(y * np.log(p := np.clip(1 / (1 + np.exp(-np.clip(best._matrix(m) @ w, -30, 30))), 1e-15, 1 - 1e-15)) + (1 - y) * np.log(1 - p)) + 0.5 * np.sum(w[1:] ** 2)
    steps = np.random.default_rng(0).normal(scale=0.05, size=(200, len(best.w)))
    assert all(loss(best.w) <= loss(best.w + d) + 1e-9 for d in steps)


def test_language_equals_a_plain_loop(spark):
    rng = random.Random(15)
    vocabulary = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40)] for k, letters in (("aa", "abcdefgh"), ("bb", "ghijklmn"), ("cc", "mnopqrst"))}
    docs = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(rng.choice([4, 60, 700]))), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df)
    texts = [*(t for _, t, _ in docs), *(f"{docs[i][1]} {docs[i + 1][1]}" for i in range(20)), None, "", "12 34", "Q", docs[0][1].upper()]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("i").collect()
    kinds = set()
    for t, r in zip(texts, got, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        rows = plain_sizes(f" {t.lower()} ", [d for _, d in model], langid.LEVEL)
        sizes = [sum(x[j] for x in rows) for j in range(1, 4)]
        best = min(range(3), key=sizes.__getitem__)
        margin = sorted(sizes)[1] - sizes[best]
        assert r["lang_pred"] == model[best][0] and r["score"] == pytest.approx(1 - 0.5 ** min(margin, 60)) and r["rejected"] == (margin < max(1, 0.002 * sizes[best]))
        kinds.add(r["rejected"])
    assert kinds == {True, False}
