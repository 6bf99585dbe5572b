"""Text functions, Column to Column, all in built-in expressions.

Patterns follow Python's reading: `(?U)` makes \\w, \\s and \\b Unicode, `(?u)` folds all letters, `(?d)` lets only \\n end a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from normwerk.functions import rules

MISS = "[???]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """Null where nothing matches."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


# --- names and codes ------------------------------------------------------------------------------


def signature(name: Column | str) -> Column:
    """The longest run of digits, points and dashes (the first of equals) that begins with a digit, without points and dashes at its ends; null if it has neither within or fewer than 4 characters."""
    runs = F.regexp_extract_all(F.regexp_replace(_col(name), "[–—]", "-"), F.lit(r"\d[\d.\-]*"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    s = F.btrim(longest, F.lit(".-"))
    return F.when((F.length(s) >= 4) & s.rlike(r"[.\-]"), s)


def normalize_doc_code(c: Column | str) -> Column:
    s = F.regexp_replace(F.trim(_col(c)), r"\.+$", "")
    s = F.regexp_replace(F.translate(s, *rules.LOOKALIKES), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?U)\b(СН|СП|СНиП|НТП)РК\b", "$1 РК")
    return F.regexp_replace(s, rf"(?U)\s*([{rules.DASHES}])\s*", "$1")


_PREFIX = rf"(?iuU)\b(?:{'|'.join(rules.CODE_PREFIXES)})(?:\s*РК?)?"


def detect_doc_code(text: Column | str) -> Column:
    head = F.regexp_replace(F.substring(_col(text), 1, 3000), r"(?U)\s+", " ")
    whole = first_match(head, rf"{_PREFIX}\s*\d[\d.{rules.DASHES}]*\d")
    prefix = first_match(head, rf"{_PREFIX}\b")
    window = F.regexp_extract(head, rf"{_PREFIX}\b(.{{0,80}})", 1)
    version = first_match(window, rf"(?U)\d{{1,4}}(?:\s*[.{rules.DASHES}]\s*\d{{1,4}}){{1,5}}")
    return normalize_doc_code(F.coalesce(whole, F.when(version.isNotNull(), F.concat(prefix, F.lit(" "), version))))


def detect_doc_year(text: Column | str) -> Column:
    return first_match(F.substring(_col(text), 1, 3000), r"(?U)\b(19\d{2}|20\d{2})\b").cast("int")


def detect_doc_title(text: Column | str, code: Column | str) -> Column:
    """The first line of 20 to 200 characters after the code's first word that isn't itself a code."""
    head = F.substring(_col(text), 1, 3000)
    at = F.coalesce(F.instr(head, F.element_at(F.split(_col(code), " "), 1)), F.lit(0))
    after = F.when(at > 0, F.substr(head, at)).otherwise(head)
    whole_code = rf"{_PREFIX}\s*\d[\d.{rules.DASHES}]*\d$".replace(r"(?iuU)\b", r"(?iuU)^")
    lines = F.transform(F.split(after, r"\r\n|\n|\r"), lambda x: strip(x))
    return F.get(F.filter(lines, lambda x: F.length(x).between(20, 200) & ~x.rlike(whole_code)), F.lit(0))


def doc_type_from_code(code: Column | str) -> Column:
    return F.element_at(F.split(_col(code), " "), 1)


def _mapped(c: Column, table: dict[str, str]) -> Column:
    single = {k: v for k, v in table.items() if len(v) == 1}
    many = {k: v for k, v in table.items() if len(v) > 1}
    gone = "".join(k for k, v in table.items() if not v)
    out = F.translate(c, "".join(single) + gone, "".join(single.values()))
    return reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), many.items(), out)


def transliterate(c: Column | str) -> Column:
    table = rules.TRANSLITERATION | {k.upper(): v.capitalize() for k, v in rules.TRANSLITERATION.items()} | rules.SYMBOLS
    return _mapped(_col(c), table)


def _dashed(c: Column, keep: str) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, rf"[^{keep}]+", "-"), "-+", "-"), F.lit("-._"))


def safe_filename(name: Column | str) -> Column:
    """Latin letters, digits, `-`, `_` and `.`; the extension stays as it is."""
    n = _col(name)
    ext = F.regexp_extract(n, r"(?s)^.*[^.](\.[^.]+)$", 1)
    stem = _dashed(transliterate(F.substring(n, F.lit(1), F.length(n) - F.length(ext))), r"A-Za-z0-9_.\-")
    return F.concat(F.when(stem == "", "file").otherwise(stem), ext)


def export_filename(name: Column | str) -> Column:
    """As safe_filename but with letters of all alphabets, `_` in place of others, at most 120 characters."""
    s = F.btrim(F.regexp_replace(_col(name), r"(?U)[^\w.\-]+", "_"), F.lit("_. "))
    return F.substring(F.when(s == "", "file").otherwise(s), 1, 120)


def sanitize_folder(name: Column | str) -> Column:
    return F.substring(collapse(F.regexp_replace(_col(name), r'[<>:"/\\|?*]', " ")), 1, 120)


def slug(text: Column | str) -> Column:
    """The first five words, in Latin letters and digits, joined by dashes."""
    s = _mapped(F.lower(_col(text)), rules.SLUG_TRANSLITERATION)
    words = F.filter(F.split(F.regexp_replace(s, r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 5), "-")


def project_prefix(c: Column | str) -> Column:
    """Two numbers of two digits and one of four digits or more, which is taken whole: cut to six it would be another project's."""
    return first_match(F.translate(_col(c), "/\\", "__"), r"^\d{2}-\d{2}_\d{4,}")


def is_comments_file(name: Column | str) -> Column:
    return _col(name).rlike(r"(?iu)замечан.*\.(docx?|xlsx?|pdf|odt|rtf)$")


def percent_encode(c: Column | str) -> Column:
    s = F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(s, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


# --- clauses and pages ----------------------------------------------------------------------------

_NO, _BODY = "\u0001", "\u0002"


def clause_parts(text: Column | str) -> Column:
    """Array of 'number \\u0002 body' for every marker, in order; what stands before the first is dropped."""
    t = F.translate(_col(text), _NO + _BODY, "")
    t = F.regexp_replace(t, r"(?md)^--- стр\. \d+ \([^)]+\) ---$", "")
    t = F.regexp_replace(t, r"(?mdU)^\s*(\d+(?:\.\d+){0,4})\s*\.?(?:\s+|$)", f"{_NO}$1{_BODY}")
    parts = F.split(t, _NO)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def clause_number(part: Column | str) -> Column:
    return F.element_at(F.split(_col(part), _BODY), 1)


def clause_body(part: Column | str) -> Column:
    return collapse(F.element_at(F.split(_col(part), _BODY), 2))


def is_clause(number: Column, body: Column, least: int = 30) -> Column:
    """Long enough, no year or page number, no preamble line, no line of a table of contents."""
    bare = number.rlike(r"^\d+$")
    return ~((F.length(body) < least) | bare & (F.coalesce(number.try_cast("bigint"), F.lit(10**9)) > 200) | bare & body.rlike(rf"(?iuU)^({rules.PREAMBLE})\b") | body.rlike(r"[._…]{5,}"))


def section_path(number: Column | str) -> Column:
    return F.array_join(F.split(_col(number), r"\."), " > ")


def section_key(path: Column | str) -> Column:
    """The first integer of each level, for natural order."""
    return F.transform(F.split(_col(path), ">"), lambda x: F.coalesce(F.regexp_extract(x, r"\d+", 0).try_cast("int"), F.lit(0)))


def split_pages(text: Column | str) -> Column:
    """Array of 'page \\u0002 text' for the markers `--- стр. N (tier) ---`."""
    t = F.regexp_replace(F.translate(_col(text), _NO + _BODY, ""), r"(?md)^--- стр\. (\d+) \([^)]+\) ---$", f"{_NO}$1{_BODY}")
    parts = F.split(t, _NO)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def page_tier(text_len: Column, l2_len: Column, l2_confidence: Column, least: int = 50, confidence: float = 0.6) -> Column:
    """struct(tier, reason): the text layer if long enough, else the first recognition if sure and long enough, else the next."""
    reason = F.when(l2_confidence.isNull(), "l2_failed").when(l2_confidence < confidence, "l2_low_confidence").otherwise("l2_too_short")
    tier = F.when(text_len >= least, "L1").when((l2_confidence >= confidence) & (l2_len >= least), "L2").otherwise("L3")
    return F.struct(tier.alias("tier"), F.when(tier == "L3", reason).alias("reason"))


# --- audit and normalisation ----------------------------------------------------------------------


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("int")


def count_literal(c: Column, what: str) -> Column:
    """How often a string occurs, by the length that goes with it."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Issue, pattern (None: a literal), a string that every match holds, number that is still fine
COUNTED = (
    ("URL_ENCODED_JUNK", r"\(%22[^)]*%22[^)]*\)", "(%22", 0),
    ("EMPTY_LINKS", r"\]\(\s*\)", "](", 0),
    ("WORD_BOOKMARKS", r"\]\([^)]*%5Cl%20%22[^)]*\)", "%5Cl%20%22", 0),
    ("MULTI_BLANK", r"\n\n\n\n+", "\n\n\n\n", 0),
    ("REPLACEMENT_CHAR", None, "\ufffd", 0),
    ("HTML_ENTITIES", r"&(?:nbsp|amp|lt|gt|quot|#\d+);", "&", 0),
    ("WORD_ANCHORS", r"(?i)<a\s+name=", "<", 0),
    ("NBSP", None, "\u00a0", 10),
    ("TABS", None, "\t", 0),
    ("VERY_LONG_LINE", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "", 3000),
    ("BROKEN_TOC", r"\[\s*[\d.]+\s+[^\]]+\]\(%22", "](%22", 0),
    ("BASE64_IMAGES", r"data:image/[^;]+;base64,", ";base64,", 0),
)
LONG_LINE = r"(?:\A|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]{3001}"  # tried once a line
FENCE, TABLE_ROW, TABLE_RULE = r"\n---(?=\n)", r"(?md)^\|.*\|$", r"(?mdU)^\|[\s\-:|]+\|$"
CYRILLIC = "[а-яА-ЯёЁ]"


def audit(text: Column | str, name: Column | str) -> Column:
    """Array of struct(issue, n); n is null for issues that aren't counted.  An empty text has EMPTY_FILE alone.

    Each pattern is looked for once, and only in texts that hold the string which all of its matches have.
    """
    t, f = _col(text), _col(name)

    def n_of(issue: str, pattern: str | None, holds: str, least: int) -> Column:
        if pattern is None:
            return count_literal(t, holds)
        if issue == "VERY_LONG_LINE":
            long = F.length(t) > least
            return F.when(long & t.rlike(LONG_LINE), F.array_max(F.transform(F.split(t, pattern), F.length))).otherwise(0)
        return F.when(F.contains(t, F.lit(holds)), count_of(t, pattern)).otherwise(0)

    bare = F.contains(F.replace(t, F.lit("\r\n"), F.lit("")), F.lit("\n"))
    crlf = F.contains(t, F.lit("\r\n"))
    fences = F.when(F.contains(t, F.lit("\n---")), count_of(t, FENCE)).otherwise(0) + F.when(F.startswith(t, F.lit("---\n")), 1).otherwise(0)
    tables = F.contains(t, F.lit("|")) & (count_of(t, TABLE_ROW) > 3)
    issue = lambda k, n, keep, counted=True: F.struct(F.lit(k).alias("issue"), n.cast("int").alias("n"), F.lit(keep).alias("least"), F.lit(counted).alias("counted"))
    yes = lambda c: c.cast("int")
    found = [issue("VERY_SMALL", F.when(F.length(t) < 500, F.length(t)), 0)]
    found += [issue(k, n_of(k, p, h, least), least) for k, p, h, least in COUNTED]
    found += [
        issue("MIXED_LINE_ENDINGS", yes(crlf & bare), 0, False),
        issue("CRLF", yes(crlf & ~bare), 0, False),
        issue("NULL_BYTES", yes(F.contains(t, F.lit("\0"))), 0, False),
        issue("CYRILLIC_FILENAME", yes(f.rlike(CYRILLIC)), 0, False),
        issue("SPACES_IN_FILENAME", yes(F.contains(f, F.lit(" "))), 0, False),
        issue("BROKEN_TABLES", F.when(tables, yes(count_of(t, TABLE_RULE) == 0)), 0, False),
        issue("STRAY_YAML_DELIMS", F.when(~F.startswith(t, F.lit("---\n")), fences), 2),
    ]
    some = F.transform(F.filter(F.array(*found), lambda x: x["n"] > x["least"]), lambda x: F.struct(x["issue"].alias("issue"), F.when(x["counted"], x["n"]).alias("n")))
    return F.when(F.length(t) == 0, F.array(F.struct(F.lit("EMPTY_FILE").alias("issue"), F.lit(None).cast("int").alias("n")))).otherwise(some)


STEPS = ("crlf", "nbsp", "tabs", "url_junk", "empty_links", "word_anchors", "html_entities", "trailing_ws_lines", "collapsed_blank_blocks")
# Step, pattern (None: a literal), a string that every match holds, what comes in its place
_STEPS = (
    ("crlf", None, "\r\n", "\n"),
    ("nbsp", None, "\u00a0", " "),
    ("tabs", None, "\t", "    "),
    ("url_junk", r"\[([^\]]+)\]\(%22[^)]*\)", "](%22", "$1"),
    ("empty_links", r"\[([^\]]+)\]\(\s*\)", "](", "$1"),
    ("word_anchors", r'(?i)<a\s+name="[^"]*"\s*>\s*</a>', "<", ""),
    *(("html_entities", None, name, char) for name, char in rules.ENTITIES),
    ("trailing_ws_lines", r"(?mdU)[\s&&[^\n]]+$", "", ""),
    ("collapsed_blank_blocks", r"\n{4,}", "\n\n\n\n", "\n\n\n"),
)


def normalization(text: Column | str) -> Column:
    """struct(text, and the count of each of STEPS); entities are replaced one after another, so that &amp;lt; ends as <.

    Each step sees the text of the one before, which is worked out once.
    """
    state = F.struct(_col(text).alias("text"), *[F.lit(0).alias(k) for k in STEPS])
    for step, pattern, holds, new in _STEPS:

        def applied(s: Column) -> Column:
            t = s["text"]  # the function is used at once, before the loop goes on
            if pattern is None:
                there, n, after = F.contains(t, F.lit(holds)), count_literal(t, holds), F.replace(t, F.lit(holds), F.lit(new))
            else:
                white = F.contains(t, F.lit(" \n")) | F.endswith(t, F.lit(" ")) | t.rlike(r"(?U)[\s&&[^\n ]]")  # without these no line ends in white space
                there, n, after = F.contains(t, F.lit(holds)) if holds else white, count_of(t, pattern), F.regexp_replace(t, pattern, new)
            return F.when(there, F.struct(after.alias("text"), *[(s[k] + n if k == step else s[k]).alias(k) for k in STEPS])).otherwise(s)

        state = bound(state, applied)
    return bound(state, lambda s: F.struct(F.concat(F.btrim(s["text"], F.lit("\n")), F.lit("\n")).alias("text"), *[s[k].alias(k) for k in STEPS]))


def normalize_content(text: Column | str) -> tuple[Column, dict[str, Column]]:
    """The normalised text, and how often each of STEPS applied, as columns of their own."""
    state = normalization(text)
    return state["text"], {k: state[k] for k in STEPS}


# --- classification -------------------------------------------------------------------------------


def classify_section(code: Column | str, title: Column | str) -> Column:
    c = _col(code)
    both = F.lower(F.concat_ws(" ", c, F.coalesce(_col(title), F.lit(""))))
    by_code = [F.when(c.rlike(f"(?iuU){p}"), s) for p, s in rules.SECTION_CODES]
    by_word = [F.when(both.rlike("|".join(words)), s) for s, words in rules.SECTION_WORDS]
    return F.coalesce(*by_code, *by_word, F.lit(rules.SECTIONS[-1]))


def classify_doc(text: Column | str, types: tuple = rules.DOC_TYPES, fallback: tuple[str, float] = rules.FALLBACK_TYPE) -> Column:
    """struct(key, confidence): keywords found, less half the words against, times weight; equal scores by weight, then order."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    hits = lambda words: reduce(lambda a, w: a + F.contains(low, F.lit(w.lower())).cast("int"), words, F.lit(0))
    scored = F.array(*[F.struct(((hits(kw) - hits(anti) * 0.5) * w).cast("double").alias("score"), F.lit(w).alias("weight"), F.lit(-i).alias("ord"), F.lit(k).alias("key")) for i, (k, _, _, kw, anti, w) in enumerate(types)])
    best = F.array_max(scored)
    total = F.aggregate(scored, F.lit(0.0), lambda s, x: s + F.greatest(x["score"], F.lit(0.0)))
    ok = best["score"] > 0
    return F.struct(
        F.when(ok, best["key"]).otherwise(fallback[0]).alias("key"), F.when(ok, F.bround(F.least(best["score"] / F.when(total > 0, total), F.lit(1.0)), 2)).otherwise(fallback[1]).alias("confidence")
    )


_STOPS = r"(?!от\b|для\b|по\b|об?\b|в\b|с\b|и\b|на\b|\d)"


def extract_fields(text: Column | str) -> Column:
    """struct(date, number, org_name, area, year, cadastral, subject); [???] for what isn't found."""
    t = F.coalesce(_col(text), F.lit(""))
    miss = lambda c: F.coalesce(c, F.lit(MISS))
    words = rf"(?iuU)(?:от\s+)?(\d{{1,2}})\s+((?:{rules.MONTHS})\w*)\s+(\d{{4}})"
    day = F.lpad(F.regexp_extract(t, words, 1).try_cast("int").cast("string"), 2, "0")
    spelled = F.when(t.rlike(words), F.concat_ws(" ", day, F.regexp_extract(t, words, 2), F.regexp_extract(t, words, 3)))
    digits = r"(?U)\b(\d{2})[.\-](\d{2})[.\-](\d{4})\b"
    numeric = F.when(t.rlike(digits), F.concat_ws(".", *[F.regexp_extract(t, digits, i) for i in (1, 2, 3)]))
    quoted = first_match(t, r"(?iuU)(?:ТОО|АО|ГКП|РГП|КГП|ЗАО|ГП|ОАО|МКП|КП)\s*«[^»]{2,80}»")
    office = first_match(t, rf"(?iuU)(?:Управлени[ея]|Отдел|Департамент|Комитет|Министерств|Аким(?:ат)?)\w*(?:\s+{_STOPS}\w+){{0,5}}")
    line = F.get(F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), lambda x: strip(x)), lambda x: F.length(x) > 10), F.lit(0))
    return F.struct(
        miss(F.coalesce(spelled, numeric)).alias("date"), miss(first_match(t, r"(?iuU)[№#]\s*([А-ЯЁA-Z0-9][А-ЯЁA-Z0-9\-/.]{1,30})", 1)).alias("number"), miss(F.trim(F.coalesce(quoted, office))).alias("org_name"),
        miss(F.regexp_replace(first_match(t, r"(?iuU)(\d[\d\s]*[,.]?\d*)\s*(?:га|гектар)", 1), r"(?U)\s+", "")).alias("area"), miss(first_match(t, r"(?U)\b(20\d{2}|19\d{2})\b")).alias("year"),
        miss(first_match(t, r"(\d{2}[:\-]\d{3}[:\-]\d{3}[:\-]\d{3,4})", 1)).alias("cadastral"), miss(F.substring(line, 1, 120)).alias("subject"),
    )


def record_fields(text: Column | str) -> Column:
    """The fields of single types, and whether the text is a sanitary conclusion."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.struct(*[F.coalesce(strip(first_match(t, p, g)), F.lit(none)).alias(k) for k, p, g, none in rules.RECORD_FIELDS], t.rlike(rules.SANITARY[0]).alias("sanitary"))


def format_record(key: Column, fields: Column, types: tuple = rules.RECORDS, more: Column | None = None) -> Column:
    """One line per document, by the template of its type; `fields` come from extract_fields and `more` from record_fields (without it, single types' fields stay open)."""
    template = F.coalesce(*[F.when(key == k, t) for k, t in types], F.lit(types[-1][1]))
    if more is not None:
        template = F.when((key == "согласование") & more["sanitary"], rules.SANITARY[1]).otherwise(template)
    org = fields["org_name"]
    values = {"org": org, "date": fields["date"], "number": fields["number"], "area": fields["area"], "year": fields["year"], "cad": fields["cadastral"], "subject": F.substring(fields["subject"], 1, 80)}
    values["org_fmt"] = F.when(F.contains(org, F.lit("«")) | F.contains(org, F.lit('"')), org).otherwise(F.concat(F.lit("«"), org, F.lit("»")))
    values |= {k: more[k] if more is not None else F.lit(none) for k, _, _, none in rules.RECORD_FIELDS}
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


# --- logs, searching, privacy ---------------------------------------------------------------------

_LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'


def parse_access_line(line: Column | str) -> Column:
    """struct(ip, ts, method, path, status, bytes, referer, ua); null for lines of another form.

    The pattern is matched once: what matches becomes its seven groups, each after a mark that the line itself can't hold.
    """
    whole = F.translate(_col(line), _NO, "")
    groups = F.split(F.regexp_replace(whole, rf"(?s){_LINE}.*", "".join(f"{_NO}${i}" for i in range(1, 8))), _NO)

    def fields(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        request = lambda i: F.get(F.split(at(3), " "), F.lit(i))
        return F.when(
            F.size(g) == 8,
            F.struct(
                at(1).alias("ip"), F.try_to_timestamp(at(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"), request(0).alias("method"), request(1).alias("path"),
                at(4).cast("int").alias("status"), at(5).try_cast("bigint").alias("bytes"), at(6).alias("referer"), at(7).alias("ua"),
            ),
        )

    return bound(groups, fields)


def is_bot(ua: Column | str) -> Column:
    """A listed agent or an empty one; `-` counts as human (see is_unknown_agent)."""
    return F.lower(_col(ua)).rlike(rules.BOTS) | (_col(ua) == "")


def is_unknown_agent(ua: Column | str) -> Column:
    return _col(ua) == "-"


def tokenize(text: Column | str, stop: tuple[str, ...] = ()) -> Column:
    tokens = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens


def embed_input(summary: Column | str, content: Column | str) -> Column:
    full = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    s = F.substring(F.trim(F.concat_ws("\n", full(_col(summary)), full(_col(content)))), 1, 8000)
    return F.when(s != "", s)


ANONYMISED = (
    ("email", r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("phone", r"(?<!\d)\+?\d[\d\-() ]{8,14}\d(?!\d)"),
    ("id", r"(?<!\d)\d{12}(?!\d)"),
    ("address", r"(?iuU)\b(?:ул|пр|мкр|г)\.\s*[\p{L}\d\-]+(?:,?\s*(?:д|кв)\.?\s*\d+)*"),
    ("name", r"(?U)\b\p{Lu}\p{Ll}+\s+\p{Lu}\.\s?\p{Lu}\."),
)


def anonymise(text: Column | str) -> tuple[Column, dict[str, Column]]:
    """The text with <kind> in place of personal data, and the counts; ids go before phones, of which they would pass as one."""
    t, n = _col(text), {}
    for kind, p in sorted(ANONYMISED, key=lambda x: x[0] == "phone"):
        n[kind] = count_of(t, p)
        t = F.regexp_replace(t, p, f"<{kind}>")
    return t, n


# A report's number, date and object
REPORT = (("number", r"(?iuU)заключени\w*\s*(?:экспертизы\s*)?№\s*([\w\-/.]+)"), ("date", r"(?U)\b(\d{2}\.\d{2}\.\d{4})\b"), ("object", r"(?imuU)^\s*(?:наименование\s+)?объект\w*\s*[:—–-]\s*([^\n]+)"))


def report_fields(text: Column | str) -> Column:
    """struct(number, date, object) of a report; null for what isn't found."""
    return F.struct(*[F.trim(first_match(_col(text), p, 1)).alias(k) for k, p in REPORT])


def cut_section(text: Column | str, heading: str) -> Column:
    """What stands between a heading line and the next one (# or capitals alone)."""
    return first_match(_col(text), rf"(?msdu)^#*\s*{heading}[^\n]*\n(.*?)(?=^#|^\p{{Lu}}[\p{{Lu}} ]{{5,}}$|\z)", 1)
