"""Scalar functions on hand-written inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from normwerk.functions import crossval, dates, rules, text


def one(spark, value, *columns, schema="x string"):
    df = spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema)
    r = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return r[0] if len(columns) == 1 else tuple(r)


X = "x"


@pytest.mark.parametrize(("name", "sig"), [("СП РК 2.02-101-2022", "2.02-101-2022"), ("СН 387-78", "387-78"), ("МСН 10-01-2012", "10-01-2012"), ("Закон", None), ("12", None), ("a 1.2 b 3–4—5.", "3-4-5")])
def test_signature(spark, name, sig):
    assert one(spark, name, text.signature(X)) == sig


def test_codes(spark):
    assert one(spark, "СНРК 5.04 - 23 - 2002.", text.normalize_doc_code(X)) == "СН РК 5.04-23-2002"
    assert one(spark, "НАЦИОНАЛЬНЫЙ ГОСТ Р СТАНДАРТ 21.703—2020", text.detect_doc_code(X)) == "ГОСТ Р 21.703—2020"
    assert one(spark, "Об утверждении\nСП РК 2.02-101-2022 и прочее", text.detect_doc_code(X)) == "СП РК 2.02-101-2022"
    assert one(spark, "без кода", text.detect_doc_code(X)) is None
    assert one(spark, "введён в 1998 году", text.detect_doc_year(X)) == 1998
    t = "шапка\nСП РК 2.02-101-2022\nПожарная безопасность зданий и сооружений\nещё"
    assert one(spark, t, text.detect_doc_title(X, F.lit("СП РК 2.02-101-2022"))) == "Пожарная безопасность зданий и сооружений"
    assert one(spark, "01-03/00289", text.project_prefix(X)) == "01-03_00289" and one(spark, "x", text.project_prefix(X)) is None


def test_names(spark):
    assert one(spark, "Щука №1 «тест».md", text.safe_filename(X)) == "Schuka-N1-test.md"
    assert one(spark, "№«».txt", text.safe_filename(X)) == "N.txt" and one(spark, "««.txt", text.safe_filename(X)) == "file.txt"
    assert one(spark, 'a<b>:"/\\|?*  c', text.sanitize_folder(X)) == "a b c"
    assert one(spark, "Ёлка хороша и ещё пять слов тут", text.slug(X)) == "yolka-khorosha-i-eschyo-pyat"
    assert one(spark, "a b*~/é", text.percent_encode(X)) == "a%20b%2A~%2F%C3%A9"
    assert one(spark, "7 > 5 > 6", text.section_key(X)) == [7, 5, 6]
    assert one(spark, "5.13.1", text.section_path(X)) == "5 > 13 > 1"


@pytest.mark.parametrize(
    ("t", "key"),
    [
        ("Архитектурно-планировочное задание выдано ГУ Архитектуры от 12 мая 2026 года № 123", "апз"),
        ("Задание на проектирование утверждено директором от 01 июня 2026 года", "задание_на_проектирование"),
        ("Совершенно нечитаемый текст без единого ключевого слова", "письмо"),
        ("Технические условия № ТУ-45 от 10.03.2026 на водоснабжение объекта", "тех_условия"),
        ("", "письмо"),
        (None, "письмо"),
    ],
)
def test_document_types(spark, t, key):
    got = one(spark, (t,), text.classify_doc(X))
    assert got["key"] == key and 0 < got["confidence"] <= 1
    assert got["confidence"] == 0.1 or key != "письмо"


def test_weight_breaks_ties(spark):
    table = (("low", "", "", ("альфа", "бета", "гамма"), (), 1), ("high", "", "", ("дельта",), (), 3))
    assert one(spark, "альфа бета гамма дельта", text.classify_doc(X, table))["key"] == "high"


def test_fields(spark):
    f = one(spark, "Технические условия № ТУ-45 от 5 марта 2026 года\nТОО «Ромашка» площадь 1 250,5 га, кадастр 01:234:567:890", text.extract_fields(X))
    assert (f["date"], f["number"], f["org_name"], f["area"], f["year"], f["cadastral"]) == ("05 марта 2026", "ТУ-45", "ТОО «Ромашка»", "1250,5", "2026", "01:234:567:890")
    f = one(spark, "Управление архитектуры города от 10.03.2026", text.extract_fields(X))
    assert f["date"] == "10.03.2026" and f["org_name"] == "Управление архитектуры города" and f["number"] == text.MISS
    r = one(spark, "Технические условия № ТУ-45 от 10.03.2026", text.format_record(text.classify_doc(X)["key"], text.extract_fields(X)))
    assert "ТУ-45" in r and text.MISS in r


@pytest.mark.parametrize(("code", "title", "section"), [("СП РК 2.02-101-2022", "", "MOPB"), ("сп рк 4.01-1", None, "OVIK"), ("ВСН 1", "Отопление и вентиляция", "OVIK"), ("X", "Фундаменты зданий", "KR"), ("X", None, "General"), ("СН РК EN 1993-1-2", "", "MOPB")])
def test_sections(spark, code, title, section):
    assert one(spark, (code, title), text.classify_section("x", "y"), schema="x string, y string") == section


def test_audit(spark):
    body = "x" * 600
    names = lambda t, n="a.md": {r["issue"] for r in one(spark, (t, n), text.audit("x", "y"), schema="x string, y string")}
    assert names("") == {"EMPTY_FILE"} and names("short") == {"VERY_SMALL"} and names(body) == set()
    cases = {
        "URL_ENCODED_JUNK": "(%22a%22)", "EMPTY_LINKS": "](  )", "WORD_BOOKMARKS": "](a%5Cl%20%22b)", "MULTI_BLANK": "\n\n\n\n", "CRLF": "\r\n", "MIXED_LINE_ENDINGS": "\r\n\n", "REPLACEMENT_CHAR": "�",
        "NULL_BYTES": "\0", "HTML_ENTITIES": "&#12;", "WORD_ANCHORS": "<A name=", "NBSP": " " * 11, "TABS": "\t", "VERY_LONG_LINE": "y" * 3001, "BROKEN_TOC": "[1.2 a](%22", "BROKEN_TABLES": "\n|a|\n|b|\n|c|\n|d|\n",
        "STRAY_YAML_DELIMS": "\n---\n\n---\n\n---\n", "BASE64_IMAGES": "data:image/png;base64,",
    }
    for issue, bit in cases.items():
        assert issue in names(body + bit), issue
    assert names(body, "имя файла.md") == {"CYRILLIC_FILENAME", "SPACES_IN_FILENAME"}


def test_normalise(spark):
    new, n = text.normalize_content(X)
    t = 'a\r\nb c\td[t](%22x%22)[u]()<a name="sub1"></a>&amp;lt;&nbsp;e  \n\n\n\n\n\nf\n\n'
    got = one(spark, t, new, *n.values())
    assert got[0] == "a\nb c    dtu< e\n\n\nf\n"
    assert dict(zip(n, got[1:], strict=True)) == {"crlf": 1, "nbsp": 1, "tabs": 1, "url_junk": 1, "empty_links": 1, "word_anchors": 1, "html_entities": 3, "trailing_ws_lines": 1, "collapsed_blank_blocks": 1}
    assert one(spark, got[0], new) == got[0]
    assert one(spark, "&amp;amp;lt;", new) == "&amp;lt;\n"  # twice isn't once here


def test_page_tier(spark):
    tier = lambda *v: tuple(one(spark, v, text.page_tier(F.col("a"), F.col("b"), F.col("c")), schema="a int, b int, c double"))
    assert tier(50, 0, None) == ("L1", None) and tier(3, 50, 0.6) == ("L2", None)
    assert tier(3, 50, 0.5) == ("L3", "l2_low_confidence") and tier(3, 4, 0.9) == ("L3", "l2_too_short") and tier(3, None, None) == ("L3", "l2_failed")


@pytest.mark.parametrize(("line", "bot"), [('10.0.0.1 - - [22/Apr/2026:10:00:00 +0000] "GET /a HTTP/1.1" 200 512 "-" "Mozilla/5.0"', False), ('10.0.0.2 - - [22/Apr/2026:10:00:01 +0000] "GET /robots.txt HTTP/1.1" 404 0 "-" "Googlebot/2.1"', True), ('10.0.0.3 - - [22/Apr/2026:10:00:02 +0000] "GET /b HTTP/1.1" 200 9 "-" ""', True), ('10.0.0.4 - - [22/Apr/2026:10:00:03 +0000] "GET /b HTTP/1.1" 200 9 "-" "-"', False), ("garbage line", None)])
def test_access_lines(spark, line, bot):
    r = one(spark, line, text.parse_access_line(X))
    assert (r is None) == (bot is None)
    if r:
        assert one(spark, r["ua"], text.is_bot(X)) == bot and r["ts"] == dt.datetime(2026, 4, 22, 10, 0, r["ts"].second)


def test_privacy_and_sections(spark):
    new, n = text.anonymise(X)
    got = one(spark, "Иванов И.И. ivan@mail.kz +7 701 123-45-67 ИИН 880101300123 ул. Абая, д. 5", new, *n.values())
    assert "<name>" in got[0] and "<email>" in got[0] and "<phone>" in got[0] and "<id>" in got[0] and "<address>" in got[0] and list(got[1:]) == [1] * 5
    assert one(spark, "# Введение\nа\n# Замечания\n1. б\n2. в\n# Выводы\nг", text.cut_section(X, "Замечания")).strip() == "1. б\n2. в"
    assert one(spark, ("", " "), text.embed_input("x", "y"), schema="x string, y string") is None


def test_business_days(spark):
    def plain(a, b, off):
        return sum((a + dt.timedelta(i)).weekday() < 5 and a + dt.timedelta(i) not in off for i in range((b - a).days + 1))

    off = [dt.date(2026, 3, 9), dt.date(2026, 3, 21), dt.date(2026, 5, 1)]
    rows = [(dt.date(2026, 2, 20) + dt.timedelta(i), dt.date(2026, 2, 20) + dt.timedelta(i + j)) for i in range(20) for j in (0, 1, 5, 6, 7, 30, 75)]
    df = spark.createDataFrame(rows + [(rows[0][0], None)], "a date, b date")
    for r in df.withColumn("n", dates.business_days(F.col("a"), F.col("b"), off)).collect():
        assert r["n"] == (None if r["b"] is None else plain(r["a"], r["b"], off))
    assert plain(dt.date(2026, 3, 6), dt.date(2026, 3, 10), off) == 2


def test_confidence(spark):
    level = lambda t: one(spark, t, crossval.extract_confidence(F.col(X)))
    assert level("... confidence: High") == "high" and level("confidence – высокая") == "high" and level("confidence: unsure") is None and level("none") is None
    mark = lambda t: one(spark, t, crossval.ensure_confidence_marker(F.col(X), F.lit("low")))
    assert mark("a\nconfidence: high\n\n") == "a\nconfidence: high\n\n" and mark("confidence: high then b") == " then b\nconfidence: low" and mark("  ") == "  "
    win = lambda *v: one(spark, v, crossval.winning_answer(*[F.col(c) for c in "abcd"]), schema="a string, b string, c string, d string")
    assert win("claude_was_right", "ans", None, "high") == "ans\nconfidence: high"
    assert win("claude_was_right", "ans", " note ", None) == "ans\n\n[уточнение эксперта]\nnote\nconfidence: medium"
    assert win("gpt_was_right", "ans", "n", "x") == "n\nconfidence: medium" and win("both_wrong", "ans", " ", None) is None and win(None, "a", "b", None) is None


def test_reviews_and_json(spark):
    r = one(spark, '{"verdict": "Rejected", "missed_norms": ["a", "", "b"], "rationale": "x"}', crossval.normalize_review(F.col(X)))
    assert (r["verdict"], r["missed_norms"], r["disagreement"], r["critique"]) == ("rejected", ["a", "b"], True, "x")
    r = one(spark, '{"verdict": "??", "missed_norms": "one"}', crossval.normalize_review(F.col(X)))
    assert (r["verdict"], r["missed_norms"]) == ("error", ["one"])
    for bad in ("not json", "", "[]"):
        assert one(spark, bad, crossval.normalize_review(F.col(X)))["verdict"] == "error"
        assert one(spark, bad, crossval.safe_parse(F.col(X), "a int")) is None
    assert one(spark, '```json\n{"a": 3}\n```', crossval.safe_parse(F.col(X), "a int"))["a"] == 3
    c = one(spark, ("bad", "m" * 150), crossval.parse_classification(F.col("x"), F.col("y")), schema="x string, y string")
    assert (c["type"], len(c["summary"]), c["priority"], c["tags"], c["impact"]) == ("NOTE", 100, "medium", ["unclassified"], None)
    assert one(spark, "# heading\nbody", crossval.claim(F.col(X))) == "body"


@pytest.mark.parametrize(("notes", "ok"), [("см. п.5.3.2", True), ("Таблица 7.1", True), ("по ГОСТ 123", True), ("просто", False), (None, False), ("СТ РК 1", True), ("без СНа", False)])
def test_citations(spark, notes, ok):
    assert one(spark, (notes,), crossval.has_citation(F.col(X))) == ok


def test_prompt(spark):
    df = spark.createDataFrame([("q", [("a\nb" * 500, {"doc_code": "СП 1", "clause": "3"}), (None, {})])], "q string, c array<struct<content string, metadata map<string,string>>>")
    p = df.select(crossval.format_prompt(F.col("q"), F.col("c"))).first()[0]
    assert p.startswith("ВОПРОС:\nq\n\n") and "[1] СП 1 п.3\na ba" in p and p.endswith("[2] НТД п.\n") and max(map(len, p.split("\n"))) == 800


def test_rule_tables():
    assert len(rules.DOC_TYPES) == 19 and len(rules.SECTION_CODES) == 22 and len(rules.CITATIONS) == 12


@pytest.mark.parametrize(
    ("x", "line"),
    [
        ("Решение Акимата о предоставлении постоянного землепользования земельного участка 2,5 га № 7/1 от 01.02.2020", "о предоставлении права постоянного землепользования для [цели], площадью 2,5 га, от 01.02.2020 года — 7/1"),
        ("Государственная лицензия № Л-12 от 03.04.2021 категории II", "категории II — Л-12 от 03.04.2021 года"),
        ("Санитарно-эпидемиологическое заключение № С-5 от 06.07.2022, согласование", "санитарно-эпидемиологическое заключение [???] — С-5 от 06.07.2022 г."),
        ("Отчёт: инженерно-геологические изыскания, лицензия № 55-А, 2019", "выполненный [???] в 2019 году (лицензия № 55-А)"),
    ],
)
def test_records_of_single_types(spark, x, line):
    assert line in one(spark, x, text.format_record(text.classify_doc(X)["key"], text.extract_fields(X), more=text.record_fields(X)))


def test_report_fields(spark):
    r = one(spark, "Заключение № 01-0123/24 от 05.06.2024\nОбъект: Школа на 300 мест\nтекст", text.report_fields(X))
    assert tuple(r) == ("01-0123/24", "05.06.2024", "Школа на 300 мест") and tuple(one(spark, "пусто", text.report_fields(X))) == (None, None, None)
