"""Readers, sinks and streams over files that are first written from the given tables, and functions over texts built from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from normwerk.functions import crossval, text
from normwerk.operators import consensus, export, ingest, traffic
from normwerk.plans import bridge
from normwerk.plans.bridge import ACCESS_SQL, AGENT_LOGS_SQL, CATALOGUE_SQL, RUNS_SQL, with_views
from normwerk.plans.corpus_queries import NO_HEADER, _orders_sides
from normwerk.plans.corpus_queries import ORACLE_SQL as CORPUS_SQL
from normwerk.plans.review_queries import ORACLE_SQL as REVIEW_SQL
from normwerk.sources import readers, sinks
from normwerk.sources.shared import new_path, stored
from normwerk.streaming import streams


def _s(c):
    return c.cast("string")


# --- readers and sinks ----------------------------------------------------------------------------


def _sections(spark, sf_dir) -> str:
    path = new_path(spark, "sections")
    d = bridge.table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("section"), F.concat(F.lit("doc "), _s(F.col("doc_id")), F.lit(".md")).alias("name"), "text")
    sinks.write_sections(d, path)
    return path


def sections_written(spark, sf_dir):
    """Documents written by section, read back with their index."""
    path = _sections(spark, sf_dir)
    back = spark.read.schema("name string, text string, section string").json(f"{path}/documents")
    index = spark.read.schema("section string, name string, n_chars int").json(f"{path}/index")
    return back.join(index, ["section", "name"]).select("section", "name", F.md5("text").alias("text_md5"), "n_chars")


def corpus_files(spark, sf_dir):
    """The same files as whole texts: lines (a document each) by section."""
    files = readers.read_corpus(spark, f"{_sections(spark, sf_dir)}/documents", "*.json")
    lines = files.select(F.regexp_extract("path", "section=([^/]+)", 1).alias("section"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> ''").groupBy("section").agg(F.count("*").alias("n"))


def tables_read(spark, sf_dir):
    return readers.read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def dump_read(spark, sf_dir):
    """Dumps of documents, orders and events, an object for 5,000 ids of each, read back by ranges of bytes."""
    path = new_path(spark, "dump")
    d, o, e = (bridge.table(spark, sf_dir, t) for t in ("documents", "orders", "events"))
    arrays = [
        ("memory", d, "doc_id", F.struct(_s(F.col("doc_id")).alias("id"), F.col("text").alias("content"), F.col("lang").alias("content_type"), F.array(F.lit("a}"), F.lit('b"')).alias("tags"))),
        ("projects", o, "o_orderkey", F.struct(_s(F.col("o_orderkey")).alias("id"), F.concat(F.lit('{"'), "o_orderpriority", F.lit('\\"}],')).alias("name"), F.col("o_orderstatus").alias("status"))),
        ("agent_logs", e, "event_id", F.struct(_s(F.col("event_id")).alias("agent_id"), F.col("event_type").alias("action"), F.col("user_id").cast("int").alias("duration_ms"), F.col("props").alias("status"))),
    ]
    lines = None
    for i, (name, df, key, row) in enumerate(arrays):
        k = F.floor(F.col(key) / 5000)
        rows = df.select(k.alias("k"), F.lit(2 * i + 1).alias("kind"), F.col(key).cast("long").alias("id"), F.to_json(row).alias("value"))
        rows = rows if lines is None else lines.unionByName(rows)
        lines = rows.unionByName(df.select(k.alias("k")).distinct().select("k", F.lit(2 * i).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(f'"{name}": [').alias("value")))
    ends = lines.select("k").distinct()
    for kind, mark in ((-1, '{"version": [1, 2], "note": "]}",'), (6, '"rest": {"memory": {"id": "no"}, "n": 1}}')):
        lines = lines.unionByName(ends.select("k", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(mark).alias("value")))
    after = F.lead("kind").over(Window.partitionBy("k").orderBy("kind", "id"))  # rows of one object, a bounded number
    element = F.col("kind") % 2 == 1
    mark = F.when((F.col("kind") > 0) & element, F.when(after == F.col("kind"), ",").otherwise("],")).otherwise("")
    out = lines.select("k", "kind", "id", F.concat("value", mark).alias("value")).sortWithinPartitions("k", "kind", "id")  # the window has brought each object together
    out.select("k", "value").write.partitionBy("k").text(path)
    t = readers.read_dump(spark, path)
    memory = t["memory"].select(F.lit("memory").alias("array"), "id", F.md5("content").alias("text_md5"), F.col("content_type").alias("kind"), F.size("tags").alias("n"))
    projects = t["projects"].select(F.lit("projects").alias("array"), "id", F.md5("name").alias("text_md5"), F.col("status").alias("kind"), F.lit(0).alias("n"))
    logs = t["agent_logs"].select(F.lit("agent_logs").alias("array"), F.col("agent_id").alias("id"), F.md5("status").alias("text_md5"), F.col("action").alias("kind"), F.col("duration_ms").alias("n"))
    return memory.unionByName(projects).unionByName(logs)


def access_files(spark, sf_dir):
    """Compressed logs, every hundredth line of which is another's: requests by status, and the unreadable ones."""
    path = new_path(spark, "access")
    noise = bridge.table(spark, sf_dir, "events").filter("event_id % 100 = 0").select(F.concat(F.lit("no request "), _s(F.col("event_id"))).alias("line"))
    bridge.access_lines(spark, sf_dir).unionByName(noise).write.text(path, compression="gzip")
    good, bad = traffic.parsed(readers.read_access_log(spark, f"{path}/*.gz", partitions=16))
    return good.groupBy("status").agg(F.count("*").alias("n")).unionByName(bad.agg(F.lit(0).alias("status"), F.count("*").alias("n")))


def catalogue_files(spark, sf_dir):
    path = new_path(spark, "catalogue")
    bridge.catalogue(spark, sf_dir).write.csv(path, header=True)
    c = ingest.filled_headers(readers.read_catalogue(spark, path), "CASE WHEN col_a LIKE 'КОМПЛЕКС%' THEN concat(col_a, ' ', col_b) END", NO_HEADER, rows_per_part=97)
    return c.filter(~F.col("col_a").startswith("КОМПЛЕКС")).select("row_no", "complex")


def jsonl_written(spark, sf_dir):
    path = new_path(spark, "jsonl")
    sinks.write_jsonl(export.training_set(bridge.cross_validation(spark, sf_dir)), path)
    return spark.read.schema("stream string, metadata string").json(path).groupBy("stream").agg(F.count("*").alias("n"))


def summary_written(spark, sf_dir):
    path = new_path(spark, "summary")
    sinks.write_summary(export.summary(bridge.cross_validation(spark, sf_dir)), path)
    return spark.read.schema("total long, labelled long, sft long, dpo long, dpo_critic long").json(path)


def ideas_read(spark, sf_dir):
    i = F.col("doc_id")
    head = F.concat(
        F.lit("---\ndate: 2024-01-"), F.lpad(_s(i % 28 + 1), 2, "0"), F.lit("\nsource: "), F.coalesce("source", F.lit("~")), F.lit("\nstatus: "), F.when(i % 3 == 0, "~").otherwise("new"),
        F.lit("\nfeasibility: "), F.when(i % 4 == 0, "~").otherwise(_s(i % 10)), F.lit("\nimpact: high\ntags: [a, "), F.coalesce("lang", F.lit("")), F.lit("]\n---\n\nbody "), _s(i),
    )
    r = readers.read_ideas(bridge.table(spark, sf_dir, "documents").select("doc_id", head.alias("text")))
    return r.select("doc_id", "date", "source", "status", "feasibility", F.col("impact").isNull().alias("no_impact"), F.array_join("tags", ",").alias("tags"), "body")


def properties_flat(spark, sf_dir):
    k = _s(F.col("p_partkey"))
    p = F.concat(F.lit('{"title": {"title": [{"plain_text": "'), F.col("p_brand"), F.lit('"}, {"plain_text": " '), k, F.lit('"}]}, "url": {"url": "https://x/'), k, F.lit('"}, "status": {"status": {"name": "'), F.col("p_type"), F.lit('"}}}'))
    return readers.flatten_properties(bridge.table(spark, sf_dir, "part").select("p_partkey", p.alias("properties")))


def snapshot_merged(spark, sf_dir):
    """A snapshot after an upsert that is run twice."""
    path = new_path(spark, "snapshot")
    old, new = _orders_sides(spark, sf_dir)
    for rows in (old, new, new):
        sinks.merge_snapshot(rows, path, "o_orderkey", buckets=16)
    return spark.read.parquet(path).drop("bucket")


def errors_appended(spark, sf_dir):
    path = new_path(spark, "errors")
    k = F.col("o_orderkey")
    e = bridge.table(spark, sf_dir, "orders").select(k.alias("run_id"), F.repeat(F.lit("e"), (k * 37 % 4000).cast("int")).alias("message"))
    for rest in (0, 1):
        sinks.append_rows(e.filter(F.col("run_id") % 2 == rest), path, error="message")
    return spark.read.parquet(path).select("run_id", F.length("message").alias("n_chars"))


def one_run(spark, sf_dir):
    return ingest.run_by_id(bridge.runs(spark, sf_dir), 7).select("run_id", "status", "sha256")


def run_figures(spark, sf_dir):
    """All counters of a run."""
    runs = bridge.runs(spark, sf_dir)
    pages = bridge.page_texts(spark, sf_dir)
    timed = runs.select("run_id", "started_at", F.timestamp_seconds(F.unix_timestamp("started_at") + F.col("run_id") % 90).alias("finished_at"))
    new = pages.select("run_id", (F.col("page_no") % 2 == 1).alias("is_new"))
    some = pages.select("run_id", "text_len")
    return ingest.run_counters(runs.select("run_id"), some.filter("text_len >= 50"), some.filter("text_len < 10"), pages=some, stored_rows=new, runs=timed)


# --- functions ------------------------------------------------------------------------------------

PREFIXES = ("СП РК", "СНиП РК", "ГОСТ")


def doc_codes(spark, sf_dir):
    """Codes, years, titles and types found in texts, and codes brought into one form."""
    k = F.col("p_partkey")
    number = F.format_string("%d.%02d-%03d-%d", k % 5 + 1, k % 30 + 1, k % 400 + 100, k % 25 + 1999)
    code = F.concat(bridge.pick(PREFIXES, k % 3), F.lit(" "), number)
    body = F.concat(F.lit("НАЦИОНАЛЬНЫЙ ДОКУМЕНТ\n"), code, F.lit("\nТитул нормативного документа, часть "), _s(k), F.lit("\nтекст"))
    loose = F.concat(F.lit("CП РК "), F.replace(number, F.lit("-"), F.lit(" - ")), F.lit("."))  # the first letter is Latin
    t = bridge.table(spark, sf_dir, "part").select("p_partkey", body.alias("t"), loose.alias("loose")).withColumn("code", text.detect_doc_code("t"))
    return t.select("p_partkey", "code", text.detect_doc_year("t").alias("year"), text.detect_doc_title("t", "code").alias("title"), text.doc_type_from_code("code").alias("type"), text.normalize_doc_code("loose").alias("normal"))


def pages_split(spark, sf_dir):
    """Documents with page markers, of which every third page's is missing, to a row a page."""
    l = bridge.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.concat(F.lit(" part "), _s(F.max("l_partkey")), F.lit(" \n")).alias("b"))
    mark = F.when(F.col("n") % 3 != 0, F.concat(F.lit("--- стр. "), _s(F.col("n")), F.lit(" (L1) ---\n"), F.col("b"))).otherwise("")
    d = l.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", mark.alias("m")))), lambda x: x["m"]), "").alias("text"), (F.max("n") + 1).cast("int").alias("total"))
    return ingest.pages(d)


def record_lines(spark, sf_dir):
    """Types, fields and the line of each of four kinds of documents."""
    k = _s(F.col("p_partkey"))
    kind = F.col("p_partkey") % 4
    t = (
        F.when(kind == 0, F.concat(F.lit("Технические условия № ТУ-"), k, F.lit(" от 10.03.2026 на водоснабжение объекта")))
        .when(kind == 1, F.concat(F.lit("Справка № 5/"), k, F.lit(" от 11.04.2026 выдана ТОО «Альфа»")))
        .when(kind == 2, F.lit("Эскизный проект разработан АО «Бета» в 2025 году"))
        .otherwise(F.concat(F.lit("Протокол измерений шума, № П-"), k, F.lit(" от 01.02.2026, АО «Гамма»")))
    )
    d = bridge.table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    d = d.select("p_partkey", text.classify_doc("t")["key"].alias("key"), text.extract_fields("t").alias("f"), text.record_fields("t").alias("m"))
    return d.select("p_partkey", "key", text.format_record(F.col("key"), F.col("f"), more=F.col("m")).alias("line"))


def embed_inputs(spark, sf_dir):
    i = F.col("doc_id")
    d = bridge.table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 == 1, F.concat(F.lit(" about "), _s(i))).when(i % 3 == 2, "  ").alias("summary"), "text")
    return d.select("doc_id", F.md5(text.embed_input("summary", "text")).alias("input_md5"))


def classifications(spark, sf_dir):
    """Models' answers, plain, fenced or no JSON, to the fields of a message."""
    i = F.col("doc_id")
    good = F.concat(F.lit('{"type": "TASK", "priority": "high", "tags": ["a", "b"], "feasibility_score": '), _s(i % 10), F.lit("}"))
    raw = F.when(i % 5 == 0, "no JSON").when(i % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    c = crossval.parse_classification(raw, F.concat(F.lit("message "), _s(i)))
    return bridge.table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.type", "c.summary", "c.priority", F.array_join("c.tags", ",").alias("tags"), "c.feasibility", "c.impact")


def report_texts(spark, sf_dir):
    """A report's number, date, object and one section, from texts built from parts."""
    k = _s(F.col("p_partkey"))
    named = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("Наименование объекта: Дом "), k, F.lit("\n"))).otherwise("")
    section = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("# Выводы\nТекст "), k, F.lit("\n"))).otherwise("")
    t = F.concat(F.lit("ЗАКЛЮЧЕНИЕ № 12/п-"), k, F.lit(" от 01.02.2026\n"), named, F.lit("# Введение\nО нём.\n"), section, F.lit("# Приложения\nНет."))
    r = bridge.table(spark, sf_dir, "part").select("p_partkey", text.report_fields(t).alias("f"), text.cut_section(t, "Выводы").alias("conclusions"))
    return r.select("p_partkey", "f.number", "f.date", "f.object", "conclusions")


def degraded_requests(spark, sf_dir):
    """Requests of which not all three models' answers can be read."""
    k = F.col("p_partkey")
    raw = F.when(k % 7 == 0, "broken {").otherwise(F.concat(F.lit('{"a": '), _s(k), F.lit("}")))
    return consensus.degraded(bridge.table(spark, sf_dir, "part").select(F.floor(k / 3).alias("request_id"), crossval.safe_parse(raw, "a int").isNotNull().alias("ok")))


def approximate_agents(spark, sf_dir):
    """The commonest agents of people by sketch; with fewer agents than it tracks, its counts are exact."""
    return traffic.approximate_top(traffic.parsed(bridge.access_lines(spark, sf_dir))[0], "ua", 3, bots=False)


def _close(found, access, days=None):
    """`found` with its approximate addresses replaced by whether they are within a twentieth, or two, of the exact number."""
    kind = F.when(F.col("is_bot"), "bot").otherwise("human").alias("class")
    a = access if days is None else access.filter(F.to_date("ts").between(*[F.lit(d).cast("date") for d in days]))
    key = [k for k in ("day", "class") if k in found.columns]
    exact = a.select(F.to_date("ts").alias("day"), kind, "ip").distinct().groupBy(*key).agg(F.count_distinct("ip").alias("_exact"))
    near = F.abs(F.col("ips") - F.col("_exact")) <= F.greatest(F.col("_exact") * 0.05, F.lit(2))
    return found.join(exact, key).withColumn("ips_close", near).drop("ips", "_exact")


def approximate_traffic(spark, sf_dir):
    access = traffic.parsed(bridge.access_lines(spark, sf_dir))[0]
    return _close(traffic.approximate_by_class(access), access)


SKETCHED = ("2024-01-05", "2024-01-20")


def sketched_traffic(spark, sf_dir):
    """A range of days from stored daily sketches: requests, addresses, the commonest agent."""
    access = traffic.parsed(bridge.access_lines(spark, sf_dir))[0]
    days = stored(traffic.daily_sketches(access), "sketches")
    found = traffic.sketched(days, *SKETCHED, n=20)
    best = F.array_sort("agents", lambda x, y: F.when(x["n"] != y["n"], F.when(x["n"] > y["n"], -1).otherwise(1)).when(x["value"] < y["value"], -1).otherwise(1))[0]
    return _close(found.withColumns({"agent": best["value"], "agent_n": best["n"]}).drop("agents"), access, SKETCHED)


# --- streams, run to the end of what is there -----------------------------------------------------


def _stream(spark, df, name):
    """`df` as files that a stream reads."""
    rows = stored(df, name)
    return spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])


def _result(spark, stream, name):
    out = new_path(spark, name)
    streams.to_table(stream, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out)


def traffic_stream(spark, sf_dir):
    """Requests by day and class of the days that are complete."""
    lines = _stream(spark, bridge.access_lines(spark, sf_dir), "stream-lines")
    return _close(_result(spark, streams.daily_traffic(lines), "stream-traffic"), traffic.parsed(bridge.access_lines(spark, sf_dir))[0])


def activity_stream(spark, sf_dir):
    return _result(spark, streams.daily_activity(_stream(spark, bridge.agent_logs(spark, sf_dir), "stream-logs")), "stream-activity")


def sync_stream(spark, sf_dir):
    """Orders as updates of 97 rows each, in four batches whose times overlap, the last of them twice: the update with the latest time stays, unless it says that the row is gone."""
    k = F.col("o_orderkey")
    value = F.when(k % 4 != 0, k)
    updates = bridge.table(spark, sf_dir, "orders").select((k % 97).alias("id"), k.alias("version"), value.alias("note"), (k % 5 == 0).alias("gone"), F.timestamp_seconds(k).alias("updated"))
    out, files = new_path(spark, "stream-target"), new_path(spark, "stream-updates")
    updates.repartition(4, F.pmod(F.xxhash64("version"), F.lit(4))).write.parquet(files)
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(files)
    streams.sync(stream, out, "id", "updated", f"{out}-checkpoint", keep_if_null=("note",), deleted="gone").awaitTermination()
    sinks.merge_ordered(updates.filter(F.pmod(F.xxhash64("version"), F.lit(4)) == 3), out, "id", "updated", 0, ("note",), "gone")  # old updates once more
    return sinks.read_ordered(spark, out, "gone").select("id", "version", "note")


def intake_stream(spark, sf_dir):
    """Messages: what is stored, by type, and what breaks a constraint."""
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "nonsense").when(i % 2 == 0, "TASK").otherwise("NOTE")
    answer = F.when(i % 7 == 0, "no JSON").otherwise(F.concat(F.lit('{"type": "'), kind, F.lit('", "priority": "high"}')))
    raw = bridge.table(spark, sf_dir, "documents").select(F.concat(F.lit("message "), _s(i)).alias("message"), answer.alias("classification"), F.timestamp_seconds(i).alias("ts"))
    out = new_path(spark, "stream-intake")
    streams.intake(_stream(spark, raw, "stream-raw"), f"{out}/memory", f"{out}/log", f"{out}/bad", f"{out}/checkpoint").awaitTermination()
    n = lambda name, c: spark.read.parquet(f"{out}/{name}").groupBy(c.alias("content_type")).agg(F.count("*").alias("n")).select(F.lit(name).alias("kept_in"), "content_type", "n")
    return n("memory", F.col("content_type")).unionByName(n("bad", F.col("content_type"))).unionByName(n("log", F.col("action")))


def once_stream(spark, sf_dir):
    files = bridge.table(spark, sf_dir, "customer").select(F.md5(_s(F.col("c_custkey") % 53)).alias("sha256"), F.timestamp_seconds(F.col("c_custkey") % 1000).alias("arrived"))
    return _result(spark, streams.once(_stream(spark, files, "stream-files")), "stream-once").select("sha256")


QUERIES = {f.__name__: f for f in (sections_written, corpus_files, tables_read, dump_read, access_files, catalogue_files, jsonl_written, summary_written, ideas_read, properties_flat, snapshot_merged, errors_appended, one_run, run_figures, doc_codes, pages_split, record_lines, embed_inputs, classifications, report_texts, degraded_requests, approximate_agents, approximate_traffic, sketched_traffic, traffic_stream, activity_stream, sync_stream, intake_stream, once_stream)}

_NUMBER = "printf('%d.%02d-%03d-%d', p_partkey % 5 + 1, p_partkey % 30 + 1, p_partkey % 400 + 100, p_partkey % 25 + 1999)"
_PREFIX = bridge.sql_pick(PREFIXES, "p_partkey % 3")
_K = "CAST(p_partkey AS VARCHAR)"
_CLOSED = "day + INTERVAL 1 DAY <= (SELECT max({ts}) - INTERVAL 1 DAY FROM {table})"
ORACLE_SQL = {
    "sections_written": "SELECT coalesce(lang, 'none') AS section, 'doc_' || CAST(doc_id AS VARCHAR) || '.md' AS name, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
    "corpus_files": "SELECT coalesce(lang, 'none') AS section, count(*) AS n FROM documents GROUP BY 1",
    "tables_read": "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "dump_read": """SELECT 'memory' AS "array", CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, lang AS kind, 2::INTEGER AS n FROM documents
UNION ALL SELECT 'projects', CAST(o_orderkey AS VARCHAR), md5('{"' || o_orderpriority || '\\"}],'), o_orderstatus, 0 FROM orders UNION ALL SELECT 'agent_logs', CAST(event_id AS VARCHAR), md5(props), event_type, CAST(user_id AS INTEGER) FROM events""",
    "access_files": with_views(ACCESS_SQL, then="SELECT status, count(*) AS n FROM access GROUP BY 1 UNION ALL SELECT 0, count(*) FROM events WHERE event_id % 100 = 0"),
    "catalogue_files": with_views(CATALOGUE_SQL, f"c AS (SELECT row_no, coalesce(last_value(complex IGNORE NULLS) OVER (ORDER BY row_no), '{NO_HEADER}') AS complex, is_header FROM catalogue)", then="SELECT row_no, complex FROM c WHERE NOT is_header"),
    "jsonl_written": REVIEW_SQL["training_set"],
    "summary_written": REVIEW_SQL["export_summary"],
    "ideas_read": """SELECT doc_id, '2024-01-' || printf('%02d', doc_id % 28 + 1) AS date, source, CASE WHEN doc_id % 3 <> 0 THEN 'new' END AS status, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 10 AS INTEGER) END AS feasibility,
 TRUE AS no_impact, CASE WHEN coalesce(lang, '') = '' THEN 'a' ELSE 'a,' || lang END AS tags, 'body ' || CAST(doc_id AS VARCHAR) AS body FROM documents""",
    "properties_flat": f"SELECT p_partkey, p_brand || ' ' || {_K} AS title, 'https://x/' || {_K} AS url, p_type AS status FROM part",
    "snapshot_merged": CORPUS_SQL["upsert_orders"],
    "errors_appended": "SELECT o_orderkey AS run_id, CAST(least(o_orderkey * 37 % 4000, 2000) AS INTEGER) AS n_chars FROM orders",
    "one_run": with_views(RUNS_SQL, then="SELECT run_id, status, sha256 FROM runs WHERE run_id = 7"),
    "run_figures": with_views(bridge.PAGES_SQL, then="SELECT o_orderkey AS run_id, CAST(1 AS BIGINT) AS documents, count(*) FILTER (WHERE text_len >= 50) AS clauses, count(*) FILTER (WHERE text_len < 10) AS errors, count(page_no) AS pages, count(*) FILTER (WHERE page_no % 2 = 1) AS inserted, count(*) FILTER (WHERE page_no % 2 = 0) AS updated, CAST(o_orderkey % 90 * 1000 AS BIGINT) AS duration_ms FROM orders LEFT JOIN page_texts ON run_id = o_orderkey GROUP BY o_orderkey"),
    "doc_codes": f"SELECT p_partkey, {_PREFIX} || ' ' || {_NUMBER} AS code, CAST(p_partkey % 25 + 1999 AS INTEGER) AS year, 'Титул нормативного документа, часть ' || {_K} AS title, string_split({_PREFIX}, ' ')[1] AS type, 'СП РК ' || {_NUMBER} AS normal FROM part",
    "pages_split": """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, 'part ' || CAST(max(l_partkey) AS VARCHAR) AS b FROM lineitem GROUP BY 1, 2), t AS (SELECT doc_id, unnest(generate_series(1, max(n) + 1)) AS page_no FROM l GROUP BY doc_id)
SELECT t.doc_id, CAST(page_no AS INTEGER) AS page_no, coalesce(b, '') AS text, CASE WHEN marked IS NULL THEN 0.7::DOUBLE WHEN b IS NULL THEN 0.0 ELSE 1.0 END AS confidence, CASE WHEN marked IS NULL THEN 'no_page_markers' WHEN b IS NULL THEN 'page_missing' END AS reason FROM t LEFT JOIN (SELECT * FROM l WHERE n % 3 <> 0) l ON l.doc_id = t.doc_id AND l.n = t.page_no LEFT JOIN (SELECT DISTINCT doc_id AS marked FROM l WHERE n % 3 <> 0) ON marked = t.doc_id WHERE marked IS NOT NULL OR page_no = 1""",
    "record_lines": f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'тех_условия' WHEN 1 THEN 'справка' WHEN 2 THEN 'эскизный_проект' ELSE 'протокол' END AS key,
 CASE p_partkey % 4 WHEN 0 THEN '«[???]» — ТУ-' || {_K} || ' от 10.03.2026, на водоснабжение объекта' WHEN 1 THEN 'справка ТОО «Альфа» от 11.04.2026 года — 5/' || {_K} || ', касательно Справка № 5/' || {_K} || ' от 11.04.2026 выдана ТОО «Альфа»'
 WHEN 2 THEN 'эскизный проект, разработанный АО «Бета» в 2025 году' ELSE 'протокол измерений шума — П-' || {_K} || ' от 01.02.2026 года, выполненный АО «Гамма»' END AS line FROM part""",
    "embed_inputs": "WITH d AS (SELECT doc_id, trim(concat_ws(chr(10), CASE WHEN doc_id % 3 = 1 THEN ' about ' || CAST(doc_id AS VARCHAR) END, CASE WHEN length(trim(text)) > 0 THEN text END)) AS t FROM documents) SELECT doc_id, md5(nullif(substr(t, 1, 8000), '')) AS input_md5 FROM d",
    "classifications": "SELECT doc_id, CASE WHEN bad THEN 'NOTE' ELSE 'TASK' END AS type, 'message ' || CAST(doc_id AS VARCHAR) AS summary, CASE WHEN bad THEN 'medium' ELSE 'high' END AS priority, CASE WHEN bad THEN 'unclassified' ELSE 'a,b' END AS tags, CASE WHEN NOT bad AND doc_id % 10 <> 0 THEN CAST(doc_id % 10 AS INTEGER) END AS feasibility, CAST(NULL AS INTEGER) AS impact FROM (SELECT doc_id, doc_id % 5 = 0 AS bad FROM documents)",
    "degraded_requests": "SELECT p_partkey // 3 AS request_id, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS ok_count, count(*) FILTER (WHERE p_partkey % 7 <> 0) < 3 AS degraded, count(*) FILTER (WHERE p_partkey % 7 <> 0) = 0 AS failed FROM part GROUP BY 1",
    "approximate_agents": with_views(ACCESS_SQL, then="SELECT ua AS value, count(*) AS n FROM access WHERE NOT is_bot GROUP BY 1 ORDER BY n DESC, value LIMIT 3"),
    "approximate_traffic": with_views(ACCESS_SQL, then="SELECT CAST(ts AS DATE) AS day, CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS class, count(*) AS requests, TRUE AS ips_close FROM access GROUP BY 1, 2"),
    "sketched_traffic": with_views(ACCESS_SQL, "s AS (SELECT CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS class, ua FROM access WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')", "u AS (SELECT class, ua, count(*) AS n, sum(count(*)) OVER (PARTITION BY class) AS requests FROM s GROUP BY 1, 2)",
        then="SELECT class, CAST(requests AS BIGINT) AS requests, ua AS agent, n AS agent_n, TRUE AS ips_close FROM u QUALIFY row_number() OVER (PARTITION BY class ORDER BY n DESC, ua) = 1"),
    "traffic_stream": with_views(ACCESS_SQL, "d AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN is_bot THEN 'bot' ELSE 'human' END AS class, count(*) AS requests, TRUE AS ips_close FROM access GROUP BY 1, 2)", then=f"SELECT * FROM d WHERE {_CLOSED.format(ts='ts', table='access')}"),
    "activity_stream": with_views(AGENT_LOGS_SQL, "d AS (SELECT CAST(created_at AS DATE) AS day, agent_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'error') AS error, CAST(floor(avg(duration_ms) + 0.5) AS INTEGER) AS mean_ms FROM agent_logs GROUP BY 1, 2)", then=f"SELECT * FROM d WHERE {_CLOSED.format(ts='created_at', table='agent_logs')}"),
    "sync_stream": "SELECT o_orderkey % 97 AS id, max(o_orderkey) AS version, max(o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) AS note FROM orders GROUP BY 1 HAVING max(o_orderkey) % 5 <> 0",
    "report_texts": f"SELECT p_partkey, '12/п-' || {_K} AS number, '01.02.2026' AS date, CASE WHEN p_partkey % 3 <> 0 THEN 'Дом ' || {_K} END AS object, CASE WHEN p_partkey % 4 <> 0 THEN 'Текст ' || {_K} || chr(10) END AS conclusions FROM part",
    "intake_stream": """WITH m AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'note' WHEN doc_id % 5 = 0 THEN 'nonsense' WHEN doc_id % 2 = 0 THEN 'task' ELSE 'note' END AS content_type FROM documents)
SELECT CASE WHEN content_type = 'nonsense' THEN 'bad' ELSE 'memory' END AS kept_in, content_type, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT 'log', content_type, count(*) FROM m GROUP BY 2""",
    "once_stream": "SELECT DISTINCT md5(CAST(c_custkey % 53 AS VARCHAR)) AS sha256 FROM customer",
}
