"""Ogg, URL rules and licenses: round trips and plain versions."""

import fnmatch
import hashlib
import random
import re
import zlib

import pytest

from normwerk.llm import licenses, ogg, queries, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, media string, _k1 long"


def documents(spark, tmp_path, rows):
    at = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x", 5) for i, t in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    return at


TEXTS = [(1, "short"), (2, ""), (3, None), (4, "x" * 64), (5, "long é " * 90_000), (6, "short"), (None, "no id"), (6, "short"), (7, "bin\0ary\n")]


def test_crc_of_pages_is_oggs():
    def slow(data):
        r = 0
        for b in data:
            r ^= b << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
        return r

    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.page_crc(data) == slow(data)


def test_ogg_round_trip_and_damage():
    rng = random.Random(1)
    for n in (0, 1, 254, 255, 256, 4032, 4033, 70_000, 300_000):
        payload = rng.randbytes(n)
        media = ogg.encode(payload, n)
        got = ogg.decode(media)
        assert got["payload"] == payload and got["bad_pages"] == got["lost_pages"] == 0 and got["n_bytes"] == n and got["streams"] == 2
        assert got["duration_us"] == max((len(b"".join(payload[i : i + ogg.BLOCK] for i in range(s * ogg.BLOCK, n, 2 * ogg.BLOCK))) * 125 for s in (0, 1)))
    media = ogg.encode(rng.randbytes(300_000), 5)
    broken = bytearray(media)
    broken[len(media) // 2] ^= 1
    got = ogg.decode(bytes(broken))
    assert got["bad_pages"] == 1 and got["lost_pages"] >= 1 and 0 < len(got["payload"]) < 300_000
    assert ogg.decode(b"junk" + media)["bad_pages"] == 0 and ogg.decode(b"OggS")["pages"] == 0 and ogg.decode(media[:-7])["bad_pages"] <= 1


def test_op1(spark, tmp_path):
    got = {(r["doc_id"], r["n_bytes"]): r for r in queries.op1_media_ogg(spark, documents(spark, tmp_path, TEXTS)).collect()}
    for i, t in TEXTS:
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert "bad=0" in r["feature"]
    assert got[1, 5]["media_sha256"] == got[6, 5]["media_sha256"]


def test_packets_have_times(spark):
    df = spark.createDataFrame([(1, bytearray(b"a" * 10_000), 10_000)], "id long, payload binary, n_bytes long")
    rows = ogg.ogg_packets(ogg.write_ogg(df)).orderBy("serial", "start_us").collect()
    assert [(r["serial"], r["start_us"], r["end_us"]) for r in rows] == [(1, 0, 504_000), (1, 504_000, 746_000), (2, 0, 504_000)]


URLS = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/en/1?x#y", "https://example.org/es/a", "https://badexample.org/es/", "http://org/", "http://org", "http://a.com/fr/", "http://com/de/x.exe", "http://a.b/track/z", "http://ads.x/y", "http://a.b/c/tag/t/page/2", "ftp://u@h:1/p/../login", "http://é.org/é", "http://x.org.evil/es/", "http://a/" + "b*" * 5000 + ".exe", "a://b://c/track/"]


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest[len(host) : len(host) + 1] == "/" else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in url_rules.HOST_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    globs = sum(fnmatch.fnmatchcase(host, h) and fnmatch.fnmatchcase(path, p) for h, p in url_rules.BLOCK_GLOBS)
    best = max(fits, default=(0, None, "block" if globs else "allow"))
    return host, path, best[1], best[2], globs


def test_op8(spark, tmp_path):
    rng = random.Random(2)
    parts = ["org", "com", "example.", "ads.", "/", "/en/1", "/es/", "/fr/", "/de/", "/track/", "/login", ".exe", "/tag/", "/page/", "?", "#", "x", "."]
    urls = URLS + ["http://" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["n_globs"]) for r in queries.op8_url_rules(spark, str(tmp_path)).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(urls)}


def test_many_rules_span_words():
    rules = [url_rules.block_glob(f"h{i}.*", f"*/p{i}/*.x") for i in range(40)]
    tool = url_rules.Globs(rules)
    assert tool.words > 5
    import numpy as np

    url = lambda h, p: np.array([url_rules.START, *b".", *h.encode(), url_rules.SLASH, *p.encode(), url_rules.END])
    found = tool.match([url(f"h{i}.org", f"/a/p{i}/q.x") for i in range(40)] + [url("h1.org", "/a/p2/q.x")])
    assert (found[:40] == np.eye(40, dtype=bool)).all() and not found[40].any()


def plain_licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_op9(spark, tmp_path):
    rng = random.Random(3)
    bits = ["Under the MIT License", "apache", "license,", "Version 2.", "CC-BY-NC", "cc by", "nc", "é", "x1", "all rights reserved", "licensed under the", "\n", "GNU General Public License, version 3", "copyright 2020 Me."]
    texts = [None, "", "  ", "Under the MIT License"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    got = {r["doc_id"]: r for r in queries.op9_license_templates(spark, documents(spark, tmp_path, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("text", "label", "yes"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-notice", True),
        ("Licensed under Apache License 2.0", "apache-notice", True),
        ("Licensed under the old Apache License 2.0", "apache-notice", False),
        ("Copyright (c) 2020 Some One. All rights reserved.", "copyright-reserved", True),
        ("copyright all rights reserved", "copyright-reserved", False),
        ("licensed under the GNU General Public License, version 3.", "gpl-notice", True),
        ("Licensed under a Creative Commons CC BY-NC-SA 4.0", "cc-notice", True),
    ],
)
def test_templates(text, label, yes):
    assert (label in licenses.scan_text(text)[5].split(",")) == yes


def filled(markup, optional, words):
    """A licence's wording with its optional parts or without, and so many words in each region."""
    text = re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if optional else "", markup, flags=re.DOTALL)
    return re.sub(r"\{\{(\d+),(\d+)\}\}", lambda m: " ".join(["Someone"] * words(int(m[1]), int(m[2]))), text)


@pytest.mark.parametrize(("label", "markup"), licenses.LICENSES, ids=[x for x, _ in licenses.LICENSES])
def test_whole_licenses(label, markup):
    """Accepted with and without what is optional, in any region's bounds; not with a mandatory word changed, left out or added, or a region over its bound."""
    found = lambda t: label in licenses.scan_text(f"Title 2020\n{t}\nthe end")[5].split(",")
    least, most = (lambda a, b: a), (lambda a, b: b)
    assert all(found(filled(markup, o, n)) for o in (False, True) for n in (least, most))
    assert found(filled(markup, True, least).upper().replace(" ", "\n  "))
    parts = re.split(r"(\[\[.*?\]\]|\{\{\d+,\d+\}\})", markup, flags=re.DOTALL)
    plain = [i for i, x in enumerate(parts) if x[:2] not in ("[[", "{{") and len(licenses.words_of(x)) > 2]
    for i in plain:
        w = parts[i].split()
        for k in {1, len(w) // 2}:
            for new in ([*w[:k], "changed", *w[k + 1 :]], [*w[:k], *w[k + 1 :]], [*w[:k], "added", *w[k:]]):
                other = "".join([*parts[:i], " " + " ".join(new) + " ", *parts[i + 1 :]])
                if licenses.words_of(" ".join(new)) != licenses.words_of(parts[i]):
                    assert not found(filled(other, False, most)), (i, k, new)
    if "{{" in markup:
        assert not found(filled(markup, False, lambda a, b: b + 1))


def test_templates_equal_regular_expressions():
    """A plain matcher: the same markup as a pattern over words."""
    rng = random.Random(6)
    for _ in range(200):
        parts, pattern = ["a b"], r"a b"
        for _ in range(rng.randint(1, 4)):
            kind, w = rng.randrange(3), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 2)))
            n = rng.randint(0, 1), rng.randint(1, 3)
            parts.append((w, f"[[{w}]]", "{{%d,%d}}" % n)[kind])
            pattern += (f" {w}", f"(?: {w})?", r"(?: \w+){%d,%d}" % n)[kind]
        tool = licenses.Template("x", " ".join(parts))
        for _ in range(20):
            words = ["a", "b", *[rng.choice("abc") for _ in range(rng.randint(0, 9))]]
            assert tool.at([w.encode() for w in words], 0) == bool(re.match(pattern + r"(?!\w)", " ".join(words)))


def test_urls_of_very_different_lengths(spark, tmp_path):
    """One very long URL, an empty one and null between short ones; repeated rows and columns of the outputs' names."""
    long = "https://Ads.example.org/" + "a/" * 50_000 + "login"
    urls = ["https://x.com/fr/a", long, None, "", "no scheme", "https://x.com/fr/a", "https://y.net/tag/1/page/2"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).orderBy("page_id").collect()
    assert [(r["host"], r["rule"], r["verdict"], r["n_globs"]) for r in got] == [
        ("x.com", "com/fr/", "allow", 0), ("ads.example.org", "org/", "allow", 2), ("", None, "allow", 0), ("", None, "allow", 0), ("", None, "allow", 0), ("x.com", "com/fr/", "allow", 0), ("y.net", None, "block", 1),
    ]
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
