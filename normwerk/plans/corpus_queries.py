"""Ingestion and corpus hygiene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from normwerk.functions import text
from normwerk.operators import hygiene, ingest, tables
from normwerk.plans import bridge
from normwerk.plans.bridge import CATALOGUE_SQL, CLAUSES_SQL, FILES_SQL, PAGES_SQL, RUNS_SQL, with_views

NO_HEADER = "КОМПЛЕКС 0.00 Без категории"


def clauses(spark, sf_dir):
    c = ingest.clauses(bridge.clause_texts(spark, sf_dir))
    return c.select("doc_id", "clause_no", "section_path", "section_top", "body")


def clause_hashes(spark, sf_dir):
    c = ingest.with_content(ingest.clauses(bridge.clause_texts(spark, sf_dir)).withColumn("doc_code", F.lit("SP 1")))
    return c.select("id", "content_hash")


def rendered_documents(spark, sf_dir):
    return ingest.rendered(ingest.clauses(bridge.clause_texts(spark, sf_dir))).select("doc_id", F.md5("text").alias("text_md5"))


def rendered_in_parts(spark, sf_dir):
    """Documents in parts of about 500 characters, put together again."""
    parts = ingest.rendered_parts(ingest.clauses(bridge.clause_texts(spark, sf_dir)), 500)
    whole = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), "")
    follows = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.col("p")[i]["start"] == F.col("p")[i - 1]["start"] + F.length(F.col("p")[i - 1]["text"]))
    gapless = F.when(F.size("p") == 1, True).otherwise(follows)
    return whole.filter(gapless).select("doc_id", F.md5(joined).alias("text_md5"))


def documents_with_clauses(spark, sf_dir):
    """How many orders are rendered and how many have no clause."""
    c = bridge.table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    o = bridge.table(spark, sf_dir, "orders").select("o_orderkey").join(c.withColumn("_has", F.lit(True)), "o_orderkey", "left")
    return o.agg(F.count_if(F.col("_has")).alias("rendered"), F.count_if(F.col("_has").isNull()).alias("skipped"))


def unfinished_inputs(spark, sf_dir):
    inputs = bridge.table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("sha256"))
    return ingest.unfinished(inputs, bridge.runs(spark, sf_dir)).select("c_custkey")


def latest_runs(spark, sf_dir):
    return ingest.latest_ok(bridge.runs(spark, sf_dir))


def recent_runs(spark, sf_dir):
    return bridge.runs(spark, sf_dir).select("run_id", "status", "started_at").orderBy(F.desc("started_at"), "run_id").limit(20)


def changed_clauses(spark, sf_dir):
    """Clauses whose (id, hash) the store doesn't have yet."""
    l = bridge.table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    new = l.select(key.alias("id"), F.md5(F.col("l_partkey").cast("string")).alias("h"))
    old = l.filter("l_orderkey % 3 <> 0").select(key.alias("id"), F.md5((F.col("l_partkey") + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).cast("string")).alias("h"))
    return tables.unchanged_skipped(new, old, ["id", "h"]).select("id")


def _orders_sides(spark, sf_dir):
    o = bridge.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    old = o.filter("o_orderkey % 3 <> 0")
    new = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.lit("N")).alias("o_orderstatus"), (F.col("price") + 1).alias("price"))
    return old, new


def upsert_orders(spark, sf_dir):
    return tables.upsert(*_orders_sides(spark, sf_dir), "o_orderkey")


def upsert_keeping(spark, sf_dir):
    """As upsert_orders, but a null status doesn't replace one that is there."""
    return tables.upsert(*_orders_sides(spark, sf_dir), "o_orderkey", keep_if_null=["o_orderstatus"])


def upsert_counts(spark, sf_dir):
    return tables.upsert_counts(*_orders_sides(spark, sf_dir), "o_orderkey")


def upsert_parts(spark, sf_dir):
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = p.filter("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.lit("renamed")).alias("p_name"), F.when(F.col("p_partkey") % 6 == 0, F.lit(0)).alias("p_size"))
    return tables.upsert_coalescing(p.filter("p_partkey % 3 <> 0"), new, "p_partkey")


def page_tiers(spark, sf_dir):
    return ingest.tier_accounting(bridge.page_texts(spark, sf_dir))


def page_fallbacks(spark, sf_dir):
    return ingest.fallback_reasons(bridge.page_texts(spark, sf_dir))


def run_counters(spark, sf_dir):
    runs = bridge.runs(spark, sf_dir).select("run_id")
    pages = bridge.page_texts(spark, sf_dir)
    return ingest.run_counters(runs, pages.filter("text_len >= 50").select("run_id"), pages.filter("text_len < 10").select("run_id"))


def _catalogue(spark, sf_dir):
    c = ingest.filled_headers(bridge.catalogue(spark, sf_dir), "CASE WHEN col_a LIKE 'КОМПЛЕКС%' THEN concat(col_a, ' ', col_b) END", NO_HEADER)
    return c.filter(~F.col("col_a").startswith("КОМПЛЕКС")).select("complex", "row_no", F.col("col_b").alias("title"), text.signature("col_a").alias("sig"))


def _files(spark, sf_dir):
    return bridge.files(spark, sf_dir).withColumn("sig", text.signature("name"))


def catalogue_headers(spark, sf_dir):
    return _catalogue(spark, sf_dir).select("row_no", "complex", "sig")


def catalogue_matches(spark, sf_dir):
    return hygiene.match_catalogue(_files(spark, sf_dir), _catalogue(spark, sf_dir)).select("path", "sig", "complex", "row_no")


def catalogue_missing(spark, sf_dir):
    return hygiene.missing_files(_files(spark, sf_dir), _catalogue(spark, sf_dir)).select("row_no", "sig", "complex")


def files_unlisted(spark, sf_dir):
    return hygiene.unlisted_files(_files(spark, sf_dir), _catalogue(spark, sf_dir)).select("path")


def files_per_complex(spark, sf_dir):
    return hygiene.match_catalogue(_files(spark, sf_dir), _catalogue(spark, sf_dir)).groupBy("complex").agg(F.count("*").alias("n"))


def top_missing(spark, sf_dir):
    return hygiene.top_missing(hygiene.missing_files(_files(spark, sf_dir), _catalogue(spark, sf_dir)))


def linked_folders(spark, sf_dir):
    p = bridge.table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    code = lambda c, sep: F.format_string(f"%02d-%02d{sep}%05d", c % 40 + 1, c % 12 + 1, c)
    projects = p.select(F.when(k % 11 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(code(k, "/")).alias("project"))
    folders = p.filter("p_partkey % 4 <> 0").select(code(k, "_").alias("folder"), F.explode(F.array(F.lit(2), F.lit(1))).alias("root"), (k % 3 == 0).alias("has_comments")).withColumn("path", F.concat_ws("/", F.col("root").cast("string"), "folder"))
    return hygiene.linked_folders(projects, folders)


def changed_links(spark, sf_dir):
    p = bridge.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("old"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("new"))
    return tables.changed(p, "old", "new", skip_existing=True).select("p_partkey", "new")


def union_of_roots(spark, sf_dir):
    f = bridge.files(spark, sf_dir).select("name", "path", "root")
    return hygiene.union_of_roots(f.filter("root = 1").drop("root"), f.filter("root = 0").drop("root")).select("name", "path")


def safe_names(spark, sf_dir):
    """New names of files, numbered where they collide."""
    return hygiene.renamed(bridge.files(spark, sf_dir).select("path", "name")).select("path", "new_name")


def colliding_names(spark, sf_dir):
    """New names of files whose safe names are other files' numbered ones."""
    k, group = F.col("p_partkey"), (F.col("p_partkey") % 7).cast("string")
    name = F.concat(bridge.pick(("n", "N", "n", "n", "n", "N"), k % 6), group, bridge.pick(("", "", "-2", "-3", "-2-2", "-5"), k % 6), F.lit(".md"))
    files = bridge.table(spark, sf_dir, "part").select(F.lpad(k.cast("string"), 12, "0").alias("path"), name.alias("name"))
    return hygiene.renamed(files).select("path", "new_name")


def _dirty(spark, sf_dir):
    """Documents with defects put in by their number, so that every rule has something to find."""
    i, x = F.col("doc_id"), F.col("text")
    extra = [(3, "\r\nline"), (4, "\u00a0" * 12), (5, "\tcell"), (6, "[a](%22b%22)"), (7, "[a]()"), (8, '<a name="s1"></a>'), (9, "&amp;lt;&nbsp;"), (10, "tail   \n"), (11, "\n\n\n\n\n"), (12, "data:image/png;base64,AA")]
    body = F.concat(x, *[F.when(i % n == 0, s).otherwise("") for n, s in extra])
    return bridge.table(spark, sf_dir, "documents").select(F.concat(F.lit("d "), i.cast("string")).alias("path"), F.when(i % 2 == 0, F.concat(F.lit("doc "), i.cast("string"), F.lit(".md"))).otherwise("doc.md").alias("name"), body.alias("text"))


def audit_summary(spark, sf_dir):
    return hygiene.audit_summary(hygiene.audited(_dirty(spark, sf_dir)))


def worst_files(spark, sf_dir):
    return hygiene.worst_files(hygiene.audited(_dirty(spark, sf_dir)))


def normalization_totals(spark, sf_dir):
    return hygiene.normalization_totals(hygiene.normalized(_dirty(spark, sf_dir)))


def normalized_pages(spark, sf_dir):
    p = bridge.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return hygiene.normalized(p).select(F.col("path").cast("bigint").alias("page_id"), F.md5("text").alias("text_md5"), F.col("html_entities").cast("bigint").alias("html_entities"))


def documents_per_section(spark, sf_dir):
    c = _catalogue(spark, sf_dir).select("row_no", F.concat(F.lit("СП РК "), F.col("sig")).alias("code"), "title")
    return c.select(text.classify_section("code", "title").alias("section")).groupBy("section").agg(F.count("*").alias("n"))


def numbered_records(spark, sf_dir):
    c = _catalogue(spark, sf_dir).select(F.col("row_no").alias("id"), text.classify_section(F.concat(F.lit("СП РК "), F.col("sig")), F.col("title")).alias("section"))
    return hygiene.numbered_in_sections(c)


def document_types(spark, sf_dir):
    """Types by a rule table over the words of the test texts: rules are a parameter."""
    table = (("en", "", "main", ("the ", " and ", " of "), (" que ",), 2), ("de", "", "main", (" der ", " und ", " die "), (), 2), ("fr", "", "main", (" les ", " des ", " une "), (), 1), ("other", "", "main", ("***",), (), 3))
    return bridge.table(spark, sf_dir, "documents").select("doc_id", text.classify_doc("text", table, ("other", 0.1)).alias("t")).select("doc_id", "t.key", "t.confidence")


def anonymised(spark, sf_dir):
    new, n = text.anonymise("text")
    return bridge.table(spark, sf_dir, "documents").select("doc_id", n["email"].cast("bigint").alias("emails"), F.regexp_count(new, F.lit("<email>")).cast("bigint").alias("marks"))


QUERIES = {f.__name__: f for f in (clauses, clause_hashes, rendered_documents, rendered_in_parts, documents_with_clauses, unfinished_inputs, latest_runs, recent_runs, changed_clauses, upsert_orders, upsert_keeping, upsert_counts, upsert_parts, page_tiers, page_fallbacks, run_counters, catalogue_headers, catalogue_matches, catalogue_missing, files_unlisted, files_per_complex, top_missing, linked_folders, changed_links, union_of_roots, safe_names, colliding_names, audit_summary, worst_files, normalization_totals, normalized_pages, documents_per_section, numbered_records, document_types, anonymised)}

_SIDES = """o AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS price FROM orders), old AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'N' END AS o_orderstatus, price + 1 AS price FROM o WHERE o_orderkey % 2 = 0)"""
_CAT = "cat AS (SELECT row_no, sig, title, coalesce(last_value(complex IGNORE NULLS) OVER (ORDER BY row_no), '" + NO_HEADER + "') AS complex, is_header FROM catalogue), c AS (SELECT * FROM cat WHERE NOT is_header), f AS (SELECT 'r' || CAST(root AS VARCHAR) || '/' || CAST(k AS VARCHAR) || '/' || name AS path, * FROM files)"
_MISSING = "missing AS (SELECT * FROM c WHERE sig NOT IN (SELECT sig FROM f WHERE sig IS NOT NULL))"
_SECTION = "CASE WHEN sig LIKE '2.02-%' THEN 'MOPB' WHEN sig LIKE '2.04-%' OR sig LIKE '4.01-%' THEN 'OVIK' WHEN sig LIKE '3.02-%' OR sig LIKE '3.03-%' THEN 'KR' ELSE 'General' END"
_DIRTY = r"""dirty AS (SELECT doc_id, 'd ' || CAST(doc_id AS VARCHAR) AS path, doc_id % 2 = 0 AS spaced, text || CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) || 'line' ELSE '' END
 || CASE WHEN doc_id % 4 = 0 THEN repeat(chr(160), 12) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(9) || 'cell' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN '[a](%22b%22)' ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN '[a]()' ELSE '' END || CASE WHEN doc_id % 8 = 0 THEN '<a name="s1"></a>' ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN '&amp;lt;&nbsp;' ELSE '' END
 || CASE WHEN doc_id % 10 = 0 THEN 'tail   ' || chr(10) ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN repeat(chr(10), 5) ELSE '' END || CASE WHEN doc_id % 12 = 0 THEN 'data:image/png;base64,AA' ELSE '' END AS t FROM documents),
n AS (SELECT *, len(regexp_extract_all(t, '\n\n\n\n+')) AS multi, len(regexp_extract_all(t, '&(?:nbsp|amp|lt|gt|quot|#[0-9]+);')) AS ents, length(t) - length(replace(t, chr(160), '')) AS nbsp,
 length(t) - length(replace(t, chr(9), '')) AS tabs, list_max(list_transform(string_split(replace(t, chr(13), chr(10)), chr(10)), lambda x: length(x))) AS longest, contains(t, chr(13)) AS crlf, contains(replace(t, chr(13) || chr(10), ''), chr(10)) AS lf FROM dirty),
i AS (SELECT path, unnest(list_filter([CASE WHEN length(t) < 500 THEN 'VERY_SMALL' END, CASE WHEN contains(t, '(%22b%22)') THEN 'URL_ENCODED_JUNK' END, CASE WHEN contains(t, ']()') THEN 'EMPTY_LINKS' END, CASE WHEN multi > 0 THEN 'MULTI_BLANK' END,
 CASE WHEN ents > 0 THEN 'HTML_ENTITIES' END, CASE WHEN contains(t, '<a name=') THEN 'WORD_ANCHORS' END, CASE WHEN nbsp > 10 THEN 'NBSP' END, CASE WHEN tabs > 0 THEN 'TABS' END, CASE WHEN longest > 3000 THEN 'VERY_LONG_LINE' END,
 CASE WHEN contains(t, 'data:image/') THEN 'BASE64_IMAGES' END, CASE WHEN crlf AND lf THEN 'MIXED_LINE_ENDINGS' END, CASE WHEN crlf AND NOT lf THEN 'CRLF' END, CASE WHEN spaced THEN 'SPACES_IN_FILENAME' END], lambda x: x IS NOT NULL)) AS issue FROM n)"""
_NORMAL = """s AS (SELECT doc_id, t, replace(replace(replace(replace(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(160), ' '), chr(9), '    '), '[a](%22b%22)', 'a'), '[a]()', 'a'), '<a name="s1"></a>', ''), '', '') AS u FROM dirty),
e AS (SELECT *, replace(replace(replace(replace(replace(u, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS v, len(regexp_extract_all(u, '&(?:nbsp|amp|gt|lt|quot);')) + len(regexp_extract_all(u, '&amp;(?:lt|gt|quot);')) AS ents FROM s),
w AS (SELECT *, array_to_string(list_transform(string_split(v, chr(10)), lambda x: rtrim(x, ' ')), chr(10)) AS x, len(list_filter(string_split(v, chr(10)), lambda x: x <> rtrim(x, ' '))) AS trail FROM e),
z AS (SELECT *, len(regexp_extract_all(x, '\\n{4,}')) AS blanks, trim(regexp_replace(x, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), chr(10)) || chr(10) AS fin FROM w)"""
_ENTITIES = ("&nbsp;", "&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&laquo;", "&raquo;")
_CHARACTERS = (" ", "&", "<", ">", '"', "''", "«", "»")
_WHITE = r"[ \t\r\f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PAGES_NORMAL = r"""e0 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(160), ' '), chr(9), '    '), '\[([^\]]+)\]\(%22[^)]*\)', '\1', 'g'),
 '\[([^\]]+)\]\(\s*\)', '\1', 'g'), '(?i)<a\s+name="[^"]*"\s*>\s*</a>', '', 'g') AS t, 0 AS n FROM pages)""" + "".join(
    f",\ne{i + 1} AS (SELECT page_id, replace(t, '{e.replace(chr(39), chr(39) * 2)}', '{c}') AS t, n + (length(t) - length(replace(t, '{e}', ''))) // {len(e)} AS n FROM e{i})" for i, (e, c) in enumerate(zip(_ENTITIES, _CHARACTERS, strict=True))
)
ORACLE_SQL = {
    "normalized_pages": f"WITH {_PAGES_NORMAL} SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '(?m){_WHITE}+$', '', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10)) || chr(10)) AS text_md5, CAST(n AS BIGINT) AS html_entities FROM e8",
    "clauses": with_views(CLAUSES_SQL, then="SELECT doc_id, no AS clause_no, no AS section_path, no AS section_top, ltrim(body, '~') AS body FROM clauses"),
    "clause_hashes": with_views(CLAUSES_SQL, then="SELECT CAST(doc_id AS VARCHAR) || '-' || no AS id, md5('SP 1' || chr(10) || 'п.' || no || chr(10) || no || chr(10) || ltrim(body, '~')) AS content_hash FROM clauses"),
    "rendered_documents": with_views(CLAUSES_SQL, then="SELECT doc_id, md5(string_agg('## п.' || no || chr(10) || chr(10) || ltrim(body, '~'), chr(10) || chr(10) ORDER BY n)) AS text_md5 FROM clauses GROUP BY doc_id"),
    "documents_with_clauses": "SELECT count(*) FILTER (WHERE k IS NOT NULL) AS rendered, count(*) FILTER (WHERE k IS NULL) AS skipped FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) ON k = o_orderkey",
    "unfinished_inputs": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "latest_runs": with_views(RUNS_SQL, then="SELECT sha256, run_id FROM runs WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY started_at DESC, run_id DESC) = 1"),
    "recent_runs": with_views(RUNS_SQL, then="SELECT run_id, status, started_at FROM runs ORDER BY started_at DESC, run_id LIMIT 20"),
    "changed_clauses": """WITH n AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, l_orderkey, l_linenumber, l_partkey AS p FROM lineitem)
SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.id = n.id AND o.l_orderkey % 3 <> 0 AND o.p + CASE WHEN o.l_linenumber = 2 THEN 1 ELSE 0 END = n.p)""",
    "upsert_orders": f"WITH {_SIDES} SELECT o_orderkey, o_orderstatus, price FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)",
    "upsert_keeping": f"WITH {_SIDES} SELECT o_orderkey, coalesce(new.o_orderstatus, old.o_orderstatus) AS o_orderstatus, new.price FROM new LEFT JOIN old USING (o_orderkey) UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)",
    "upsert_counts": f"WITH {_SIDES} SELECT count(*) FILTER (WHERE old.o_orderkey IS NULL) AS inserted, count(*) FILTER (WHERE old.o_orderkey IS NOT NULL) AS updated FROM new LEFT JOIN old ON old.o_orderkey = new.o_orderkey",
    "upsert_parts": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'renamed' WHEN p_partkey % 3 <> 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 6 = 0 THEN 0 WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0",
    "page_tiers": with_views(PAGES_SQL, then="SELECT run_id, CASE WHEN text_len >= 50 THEN 'L1' WHEN l2_confidence >= 0.6 AND l2_text_len >= 50 THEN 'L2' ELSE 'L3' END AS tier, count(*) AS pages, round(avg(l2_confidence), 6) AS confidence FROM page_texts GROUP BY 1, 2"),
    "page_fallbacks": with_views(PAGES_SQL, then="SELECT CASE WHEN l2_confidence < 0.6 THEN 'l2_low_confidence' ELSE 'l2_too_short' END AS reason, count(*) AS pages FROM page_texts WHERE text_len < 50 AND NOT (l2_confidence >= 0.6 AND l2_text_len >= 50) GROUP BY 1"),
    "run_counters": with_views(PAGES_SQL, then="SELECT o_orderkey AS run_id, CAST(1 AS BIGINT) AS documents, count(*) FILTER (WHERE text_len >= 50) AS clauses, count(*) FILTER (WHERE text_len < 10) AS errors FROM orders LEFT JOIN page_texts ON run_id = o_orderkey GROUP BY 1"),
    "catalogue_headers": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, then="SELECT row_no, complex, sig FROM c"),
    "catalogue_matches": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, then="SELECT path, f.sig, m.complex, m.row_no FROM f JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sig ORDER BY row_no) = 1) m ON m.sig = f.sig"),
    "catalogue_missing": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, _MISSING, then="SELECT row_no, sig, complex FROM missing"),
    "files_unlisted": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, then="SELECT path FROM f WHERE sig IS NULL OR sig NOT IN (SELECT sig FROM c)"),
    "files_per_complex": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, then="SELECT m.complex, count(*) AS n FROM f JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sig ORDER BY row_no) = 1) m ON m.sig = f.sig GROUP BY 1"),
    "top_missing": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, _MISSING, "worst AS (SELECT complex, count(*) AS n_missing FROM missing GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)", then="SELECT complex, n_missing, CAST(row_number() OVER (PARTITION BY complex ORDER BY row_no) AS INTEGER) AS rank, row_no FROM missing JOIN worst USING (complex) QUALIFY rank <= 10"),
    "linked_folders": """WITH p AS (SELECT p_partkey AS k, printf('%02d-%02d', p_partkey % 40 + 1, p_partkey % 12 + 1) AS a, printf('%05d', p_partkey) AS b FROM part)
SELECT CASE WHEN k % 11 = 0 THEN 'x' || CAST(k AS VARCHAR) ELSE a || '/' || b END AS project, CASE WHEN k % 11 <> 0 THEN a || '_' || b END AS prefix,
 CASE WHEN k % 11 <> 0 AND k % 4 <> 0 THEN '1/' || a || '_' || b END AS path, CASE WHEN k % 11 = 0 THEN 'no_prefix' WHEN k % 4 = 0 THEN 'no_folder' WHEN k % 3 <> 0 THEN 'no_comments_file' ELSE 'linked' END AS bucket FROM p""",
    "changed_links": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS new FROM part WHERE p_partkey % 3 = 0",
    "union_of_roots": with_views(FILES_SQL, then="SELECT name, 'r' || CAST(root AS VARCHAR) || '/' || CAST(k AS VARCHAR) || '/' || name AS path FROM files QUALIFY row_number() OVER (PARTITION BY name ORDER BY root DESC, path) = 1"),
    "safe_names": with_views(FILES_SQL, "n AS (SELECT name, 'r' || CAST(root AS VARCHAR) || '/' || CAST(k AS VARCHAR) || '/' || name AS path, CASE WHEN sig IS NULL THEN 'Zakon-' || CAST(k AS VARCHAR) ELSE 'SP-RK-' || sig END AS stem FROM files)", "r AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY name, path) AS r FROM n)", then="SELECT path, stem || CASE WHEN r > 1 THEN '-' || CAST(r AS VARCHAR) ELSE '' END || '.md' AS new_name FROM r"),
    "colliding_names": """WITH f AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS path, CASE p_partkey % 6 WHEN 1 THEN 'N' WHEN 5 THEN 'N' ELSE 'n' END || CAST(p_partkey % 7 AS VARCHAR) || CASE p_partkey % 6 WHEN 2 THEN '-2' WHEN 3 THEN '-3' WHEN 4 THEN '-2-2' WHEN 5 THEN '-5' ELSE '' END AS stem FROM part),
g AS (SELECT *, lower(stem) AS key, row_number() OVER (PARTITION BY lower(stem) ORDER BY stem, path) AS r FROM f), t AS (SELECT DISTINCT key FROM g),
c AS (SELECT key, unnest(range(2, n + 20)) AS number FROM (SELECT key, count(*) AS n FROM g GROUP BY key)),
free AS (SELECT key, number, row_number() OVER (PARTITION BY key ORDER BY number) AS i FROM c WHERE key || '-' || CAST(number AS VARCHAR) NOT IN (SELECT key FROM t))
SELECT path, stem || CASE WHEN r = 1 THEN '' ELSE '-' || CAST(number AS VARCHAR) END || '.md' AS new_name FROM g LEFT JOIN free ON free.key = g.key AND free.i = g.r - 1""",
    "audit_summary": f"WITH {_DIRTY} SELECT issue, count(DISTINCT path) AS files FROM i GROUP BY 1 UNION ALL SELECT 'CLEAN', count(*) FROM dirty WHERE path NOT IN (SELECT path FROM i WHERE issue <> 'SPACES_IN_FILENAME')",
    "worst_files": f"WITH {_DIRTY} SELECT path, CAST(count(*) AS INTEGER) AS n FROM i WHERE issue <> 'SPACES_IN_FILENAME' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "normalization_totals": f"""WITH {_DIRTY}, {_NORMAL}, k AS (SELECT z.*, multi, n.nbsp, n.tabs, n.crlf FROM z JOIN n USING (doc_id) WHERE fin <> z.t)
SELECT unnest(['crlf','nbsp','tabs','url_junk','empty_links','word_anchors','html_entities','trailing_ws_lines','collapsed_blank_blocks','changed_files']) AS step,
 unnest([sum(CAST(crlf AS BIGINT)), sum(nbsp), sum(tabs), sum(CAST(contains(t, '(%22') AS BIGINT)), sum(CAST(contains(t, ']()') AS BIGINT)), sum(CAST(contains(t, '<a name') AS BIGINT)), sum(ents), sum(trail), sum(blanks), count(*)])::BIGINT AS n FROM k""",
    "documents_per_section": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, then=f"SELECT {_SECTION} AS section, count(*) AS n FROM c GROUP BY 1"),
    "numbered_records": with_views(CATALOGUE_SQL, FILES_SQL, _CAT, f"x AS (SELECT row_no AS id, {_SECTION} AS section FROM c)", then="SELECT id, section, CAST(CASE section WHEN 'OVIK' THEN 0 WHEN 'KR' THEN 1 WHEN 'MOPB' THEN 2 ELSE 3 END AS INTEGER) AS section_no, CAST(row_number() OVER (PARTITION BY section ORDER BY id) AS INTEGER) AS number FROM x"),
    "document_types": """WITH s AS (SELECT doc_id, greatest(-100, (CAST(contains(l, 'the ') AS INTEGER) + CAST(contains(l, ' and ') AS INTEGER) + CAST(contains(l, ' of ') AS INTEGER) - 0.5 * CAST(contains(l, ' que ') AS INTEGER)) * 2)::DOUBLE AS en,
 ((CAST(contains(l, ' der ') AS INTEGER) + CAST(contains(l, ' und ') AS INTEGER) + CAST(contains(l, ' die ') AS INTEGER)) * 2)::DOUBLE AS de, (CAST(contains(l, ' les ') AS INTEGER) + CAST(contains(l, ' des ') AS INTEGER) + CAST(contains(l, ' une ') AS INTEGER))::DOUBLE AS fr,
 (CAST(contains(l, '***') AS INTEGER) * 3)::DOUBLE AS other FROM (SELECT doc_id, lower(text) AS l FROM documents)), b AS (SELECT *, greatest(en, de, fr, other) AS top, greatest(en, 0) + de + fr + other AS total FROM s)
SELECT doc_id, CASE WHEN top <= 0 THEN 'other' WHEN other = top THEN 'other' WHEN en = top THEN 'en' WHEN de = top THEN 'de' ELSE 'fr' END AS key, CASE WHEN top <= 0 THEN 0.1::DOUBLE ELSE round_even(least(top / total, 1), 2) END AS confidence FROM b""",
    "anonymised": r"SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9_\-]+(?:\.[a-zA-Z0-9_\-]+)+')) AS emails, len(regexp_extract_all(text, '[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9_\-]+(?:\.[a-zA-Z0-9_\-]+)+')) AS marks FROM documents",
}
ORACLE_SQL["rendered_in_parts"] = ORACLE_SQL["rendered_documents"]
