"""Views that give the operators inputs of the expected shape from the given tables, in Spark and as SQL.

Each `*_SQL` text is a common table expression body for DuckDB; `with_views` joins the ones that a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT_TYPES = ("idea", "task", "note", "query", "status", "stream", "decision", "unknown_kind")
PRIORITIES = ("low", "medium", "high", "critical")
AGENTS = ("Mozilla/5.0 (X11)", "Mozilla/5.0 (Win)", "Googlebot/2.1", "curl/8.5", "", "-", "Safari/605", "AhrefsBot/7")
ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def after(base: str, minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(base).cast("timestamp")) + minutes * 60)


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    i = F.col("id")
    impact = F.when(i % 7 != 0, i % 11)
    return d.join(e, "id", "left").select(
        "id", F.col("text").alias("content"), pick(CONTENT_TYPES, i % 8).alias("content_type"),
        F.when(i % 10 == 0, "archived").when(i % 10 == 1, "completed").otherwise("active").alias("status"),
        pick(PRIORITIES, i % 4).alias("priority"), F.col("source").alias("related_project"), F.array("lang", "source").alias("tags"), "embedding",
        F.concat(F.lit('{"impact_score": '), F.coalesce(impact.cast("string"), F.lit("null")), F.lit(', "lang": "'), F.col("lang"), F.lit('"}')).alias("metadata"),
        after(ORIGIN, i).alias("created_at"),
    )


MEMORY_SQL = f"""memory AS (SELECT d.doc_id AS id, d.text AS content, {sql_pick(CONTENT_TYPES, "d.doc_id % 8")} AS content_type,
  CASE d.doc_id % 10 WHEN 0 THEN 'archived' WHEN 1 THEN 'completed' ELSE 'active' END AS status, {sql_pick(PRIORITIES, "d.doc_id % 4")} AS priority,
  d.source AS related_project, d.lang, d.source, e.embedding, CASE WHEN d.doc_id % 7 <> 0 THEN CAST(d.doc_id % 11 AS INTEGER) END AS impact,
  TIMESTAMP '{ORIGIN}' + to_minutes(d.doc_id) AS created_at
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def agent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    return e.select(
        F.concat(F.lit("agent_"), (F.col("user_id") % 12).cast("string")).alias("agent_id"), kind.alias("action"),
        F.when(kind == "error", "error").when(kind == "view", "pending").when(kind == "signup", "timeout").otherwise("success").alias("status"),
        F.when(F.col("event_id") % 17 != 0, F.floor(F.col("value") * 100).cast("int")).alias("duration_ms"), F.col("ts").cast("timestamp").alias("created_at"),
    )


AGENT_LOGS_SQL = """agent_logs AS (SELECT 'agent_' || CAST(user_id % 12 AS VARCHAR) AS agent_id, event_type AS action,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'timeout' ELSE 'success' END AS status,
  CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 100) AS INTEGER) END AS duration_ms, ts AS created_at FROM events)"""


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`line` in the combined log format."""
    u, i, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    ip = F.concat_ws(".", F.lit("10"), (u % 3).cast("string"), (u % 7).cast("string"), (u % 250).cast("string"))
    status = F.when(kind == "error", "500").when(kind == "signup", "302").when(i % 23 == 0, "404").otherwise("200")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        F.concat(ip, F.lit(" - - ["), stamp, F.lit(' +0000] "GET /p/'), (i % 40).cast("string"), F.lit(' HTTP/1.1" '), status, F.lit(" "), (i % 5000).cast("string"), F.lit(' "-" "'), pick(AGENTS, u % 8), F.lit('"')).alias("line")
    )


ACCESS_SQL = f"""access AS (SELECT '10.' || CAST(user_id % 3 AS VARCHAR) || '.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS ip,
  date_trunc('second', ts) AS ts, '/p/' || CAST(event_id % 40 AS VARCHAR) AS path,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 302 WHEN event_id % 23 = 0 THEN 404 ELSE 200 END AS status,
  event_id % 5000 AS bytes, {sql_pick(AGENTS, "user_id % 8")} AS ua, user_id % 8 IN (2, 3, 4, 7) AS is_bot FROM events)"""

DECISIONS = ("claude_was_right", "gpt_was_right", "both_wrong", "split")
VERDICTS = ("confirmed", "rejected", "uncertain", "error")


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    l = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    g = c.groupBy(F.col("conv_id").alias("id")).agg(first("user").alias("question"), first("assistant").alias("analyst_answer"), F.count("*").alias("k_used"))
    i = F.col("id")
    decision = F.when(F.col("q").isNotNull(), pick(DECISIONS, (1 - F.col("q")) * 2 + F.col("t")))
    level = pick(("high", "medium", "low", "certain"), i % 4)
    marker = F.when(i % 5 < 3, F.concat(F.lit("\nconfidence: "), level)).otherwise(F.lit(""))
    verdict = pick(VERDICTS, i % 4)
    notes = F.when(decision.isNull() | (decision == "claude_was_right") & (i % 3 == 0), F.lit(None)).when(i % 2 == 0, "see GOST 12345 for details").otherwise("no citation here")
    clause = lambda n: F.struct(F.lit(f"clause text {n}").alias("content"), F.create_map(F.lit("doc_code"), F.lit(f"SP {n}"), F.lit("clause_no"), F.lit(f"{n}.1")).alias("metadata"))
    return g.join(l, "id", "left").select(
        "id", "question", F.array(clause(1), clause(2)).alias("context_clauses"), F.col("k_used").cast("int").alias("k_used"), F.lit("a").alias("analyst_model"),
        F.concat("analyst_answer", marker).alias("analyst_answer"), F.when(i % 5 < 3, level).alias("analyst_confidence"), F.lit("r").alias("reviewer_model"), verdict.alias("reviewer_verdict"),
        F.concat(F.lit('{"verdict": "'), verdict, F.lit('", "missed_norms": ["N1"]}')).alias("reviewer_raw"), (verdict != "confirmed").alias("disagreement"),
        decision.alias("final_decision"), F.when(decision.isNotNull(), pick(("approved", "rejected", "need_more_evidence"), i % 3)).alias("expert_verdict"), notes.alias("expert_notes"),
    )


CV_SQL = f"""cv0 AS (SELECT conv_id AS id, min_by(text, turn) FILTER (WHERE role = 'user') AS question, min_by(text, turn) FILTER (WHERE role = 'assistant') AS base_answer,
  CAST(count(*) AS INTEGER) AS k_used FROM conversations GROUP BY conv_id),
lab AS (SELECT doc_id AS id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
cv AS (SELECT cv0.id, question, base_answer, k_used, {sql_pick(("high", "medium", "low", "certain"), "cv0.id % 4")} AS level, cv0.id % 5 < 3 AS marked,
  base_answer || CASE WHEN cv0.id % 5 < 3 THEN chr(10) || 'confidence: ' || {sql_pick(("high", "medium", "low", "certain"), "cv0.id % 4")} ELSE '' END AS analyst_answer,
  {sql_pick(VERDICTS, "cv0.id % 4")} AS reviewer_verdict, cv0.id % 4 <> 0 AS disagreement,
  CASE WHEN q IS NOT NULL THEN {sql_pick(DECISIONS, "(1 - q) * 2 + t")} END AS final_decision,
  CASE WHEN q IS NOT NULL THEN {sql_pick(("approved", "rejected", "need_more_evidence"), "cv0.id % 3")} END AS expert_verdict,
  CASE WHEN q IS NULL OR (q = 1 AND t = 0 AND cv0.id % 3 = 0) THEN NULL WHEN cv0.id % 2 = 0 THEN 'see GOST 12345 for details' ELSE 'no citation here' END AS expert_notes
  FROM cv0 LEFT JOIN lab USING (id))"""


def clause_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: numbered clauses, one per line item, with a preamble, a short and a repeated clause."""
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("string")
    body = F.concat(n, F.lit(". clause of part "), F.col("l_partkey").cast("string"), F.lit(" supplied by "), F.col("l_suppkey").cast("string"), F.lit(" quantity "), F.col("l_quantity").cast("int").cast("string"))
    g = l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", body.alias("b")))).alias("x"))
    extra = F.concat(F.when(F.col("doc_id") % 13 == 0, "\n1. repeated clause that must not replace the first one").otherwise(""), F.when(F.col("doc_id") % 17 == 0, "\n9.9 short").otherwise(""))
    return g.select("doc_id", F.concat(F.lit("Preamble without number\n"), F.array_join("x.b", "\n"), extra).alias("text"))


CLAUSES_SQL = """clauses AS (SELECT * FROM (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS no, CAST(l_linenumber AS BIGINT) AS n,
  'clause of part ' || CAST(l_partkey AS VARCHAR) || ' supplied by ' || CAST(l_suppkey AS VARCHAR) || ' quantity ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS body FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, '1', 1, '~repeated clause that must not replace the first one' FROM lineitem WHERE l_orderkey % 13 = 0)
  QUALIFY row_number() OVER (PARTITION BY doc_id, no ORDER BY body) = 1)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, row_no, col_a, col_b in sheet order; every 50th row is a header."""
    k = F.col("p_partkey")
    code = F.format_string("СП РК %d.%02d-%03d-%d", k % 5 + 1, k % 30 + 1, k % 400 + 100, k % 25 + 1999)
    header = k % 50 == 1
    return table(spark, sf_dir, "part").select(
        F.lit("main").alias("sheet"), k.alias("row_no"), F.when(header, F.concat(F.lit("КОМПЛЕКС "), F.floor(k / 50).cast("string"), F.lit(".0"))).otherwise(code).alias("col_a"), F.when(header, F.col("p_brand")).otherwise(F.col("p_name")).alias("col_b")
    )


CATALOGUE_SQL = """catalogue AS (SELECT p_partkey AS row_no, p_partkey % 50 = 1 AS is_header,
  CASE WHEN p_partkey % 50 = 1 THEN 'КОМПЛЕКС ' || CAST(p_partkey // 50 AS VARCHAR) || '.0 ' || p_brand END AS complex,
  printf('%d.%02d-%03d-%d', p_partkey % 5 + 1, p_partkey % 30 + 1, p_partkey % 400 + 100, p_partkey % 25 + 1999) AS sig, p_name AS title FROM part)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, path, name: files named after two thirds of the catalogue, and some noise."""
    k = F.col("p_partkey")
    code = F.format_string("СП РК %d.%02d-%03d-%d.md", k % 5 + 1, k % 30 + 1, k % 400 + 100, k % 25 + 1999)
    name = F.when(k % 20 == 0, F.concat(F.lit("Закон "), k.cast("string"), F.lit(".md"))).otherwise(code)
    return table(spark, sf_dir, "part").filter(k % 3 != 0).select((k % 2).cast("int").alias("root"), F.concat(F.lit("r"), (k % 2).cast("string"), F.lit("/"), k.cast("string"), F.lit("/"), name).alias("path"), name.alias("name"))


FILES_SQL = """files AS (SELECT p_partkey AS k, CAST(p_partkey % 2 AS INTEGER) AS root,
  CASE WHEN p_partkey % 20 = 0 THEN 'Закон ' || CAST(p_partkey AS VARCHAR) || '.md'
       ELSE 'СП РК ' || printf('%d.%02d-%03d-%d', p_partkey % 5 + 1, p_partkey % 30 + 1, p_partkey % 400 + 100, p_partkey % 25 + 1999) || '.md' END AS name,
  CASE WHEN p_partkey % 20 <> 0 THEN printf('%d.%02d-%03d-%d', p_partkey % 5 + 1, p_partkey % 30 + 1, p_partkey % 400 + 100, p_partkey % 25 + 1999) END AS sig
  FROM part WHERE p_partkey % 3 <> 0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("run_id"), F.md5(F.col("o_custkey").cast("string")).alias("sha256"), F.when(s == "F", "ok").when(s == "O", "running").otherwise("failed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, md5(CAST(o_custkey AS VARCHAR)) AS sha256,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at FROM orders)"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, page_no, text_len, l2_text_len, l2_confidence."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("page_no"), (F.col("l_quantity") * 2).cast("int").alias("text_len"), (F.col("l_partkey") % 120).cast("int").alias("l2_text_len"), (F.lit(1) - F.col("l_discount") * 6).alias("l2_confidence"))


PAGES_SQL = """page_texts AS (SELECT l_orderkey AS run_id, l_linenumber AS page_no, CAST(l_quantity * 2 AS INTEGER) AS text_len, CAST(l_partkey % 120 AS INTEGER) AS l2_text_len,
  1 - l_discount * 6 AS l2_confidence FROM lineitem)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    end = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("e"))
    start = F.to_date("o_orderdate")
    return o.join(end, "o_orderkey", "left").select(F.col("o_orderkey").alias("project_id"), start.alias("start"), F.when(F.col("e") >= start, F.col("e")).alias("end"), F.date_add(start, (F.col("o_orderkey") % 60).cast("int")).alias("answer"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))


PROJECTS_SQL = """projects AS (SELECT o_orderkey AS project_id, CAST(o_orderdate AS DATE) AS start_, CASE WHEN CAST(e AS DATE) >= CAST(o_orderdate AS DATE) THEN CAST(e AS DATE) END AS end_,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS answer, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region"))
    x, q = F.col("l_partkey") % 100, F.col("l_quantity")
    severity = F.when(q < 6, "critical").when(q < 28, "major").when(q < 46, "minor").otherwise("recommendation")
    return l.join(place, "l_suppkey", "left").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("comment_index"), F.floor(x * x / 100).alias("archetype_id"), F.col("l_returnflag").alias("section"), "region", severity.alias("severity"),
        F.col("l_suppkey").alias("clause_id"), F.col("l_linestatus").alias("object_type"), (F.lit(1) - F.col("l_discount") * 4).alias("confidence"), F.to_date("l_shipdate").alias("report_date"),
    )


COMMENTS_SQL = """comments AS (SELECT l_orderkey AS report_id, l_linenumber AS comment_index, CAST(floor((l_partkey % 100) * (l_partkey % 100) / 100.0) AS BIGINT) AS archetype_id, l_returnflag AS section,
  r_name AS region, CASE WHEN l_quantity < 6 THEN 'critical' WHEN l_quantity < 28 THEN 'major' WHEN l_quantity < 46 THEN 'minor' ELSE 'recommendation' END AS severity,
  l_suppkey AS clause_id, l_linestatus AS object_type, 1 - l_discount * 4 AS confidence, CAST(l_shipdate AS DATE) AS report_date
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, model, type, label: three models' findings, each missing some."""
    k = F.col("p_partkey")
    m = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return table(spark, sf_dir, "part").withColumn("m", m).filter((k + 5 * F.col("m")) % 7 != 0).select((k % 500).alias("request_id"), F.concat(F.lit("model_"), F.col("m").cast("string")).alias("model"), F.col("p_type").alias("type"), F.col("p_name").alias("label"))


VOTES_SQL = """votes AS (SELECT p_partkey % 500 AS request_id, 'model_' || CAST(m AS VARCHAR) AS model, p_type AS type, p_name AS label
  FROM part, (VALUES (0), (1), (2)) v(m) WHERE (p_partkey + 5 * m) % 7 <> 0)"""


def with_views(*views: str, then: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + then
