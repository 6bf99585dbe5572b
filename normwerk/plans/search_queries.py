"""Search and record queries over the memory table."""

from __future__ import annotations

from pyspark.sql import functions as F

from normwerk.functions import rules
from normwerk.operators import search, tables, text_index, vectors
from normwerk.plans import bridge
from normwerk.plans.bridge import MEMORY_SQL, with_views

TEXT = "the of and"
QUERY_ID = 7


def _query_vector(spark, sf_dir):
    """One stored vector stands for the embedding of a question."""
    return bridge.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_ID).select("embedding").first()[0]


def hybrid_search(spark, sf_dir):
    m = bridge.memory(spark, sf_dir)
    return search.hybrid_search(m, _query_vector(spark, sf_dir), TEXT).select("id", F.round("rrf", 9).alias("rrf"), "content_type", "status")


def vector_search(spark, sf_dir):
    return search.vector_search(bridge.memory(spark, sf_dir), _query_vector(spark, sf_dir), threshold=0.1).select("id", F.round("sim", 6).alias("sim"))


def vector_search_filtered(spark, sf_dir):
    m = bridge.memory(spark, sf_dir)
    return search.vector_search(m, _query_vector(spark, sf_dir), k=5, threshold=-1.0, where={"status": "active", "content_type": "note"}).select("id", F.round("sim", 6).alias("sim"))


def vector_search_builtin(spark, sf_dir):
    """The same scores by built-in functions alone."""
    m = bridge.memory(spark, sf_dir).filter(F.col("embedding").isNotNull())
    q = bridge.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_ID).select(F.col("embedding").alias("q"))
    scored = m.join(F.broadcast(q)).select("id", search.cosine(F.col("embedding"), F.col("q")).alias("sim"))
    return scored.filter("sim > 0.1").orderBy(F.desc("sim"), "id").limit(10).select("id", F.round("sim", 6).alias("sim"))


def text_search(spark, sf_dir):
    return search.text_search(bridge.memory(spark, sf_dir), TEXT).select("id", F.round("score", 6).alias("score"))


def batch_text_search(spark, sf_dir):
    """Every hundredth text, whole, as a query against a stored index of all texts: it finds itself, its copies and what holds all of its words."""
    m = bridge.memory(spark, sf_dir)
    q = m.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query"))
    return text_index.batch_text_search(text_index.build(m), q, 5).select("query_id", "id", "score", "rank")


def batch_text_search_scan(spark, sf_dir):
    """The same without an index, from the texts themselves."""
    m = bridge.memory(spark, sf_dir)
    q = m.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query"))
    return search.batch_text_search(m, q, 5).select("query_id", "id", "score", "rank")


def _index_of_changed(spark, rows):
    """An index of `rows` that was built from others: of every third text only a part, every fifth missing, and some more."""
    i = F.col("id")
    before = rows.filter(i % 5 != 0).withColumn("content", F.when(i % 3 == 0, F.substring("content", 1, 40)).otherwise(F.col("content")))
    index = text_index.build(before.select("id", "content").unionByName(rows.filter(i % 5 == 1).select((-i - 1).alias("id"), "content")))
    text_index.update(index, rows, removed=rows.select((-i - 1).alias("id")))
    return index


def text_search_updated(spark, sf_dir):
    """From an index that was brought up to date with changed, new and removed texts."""
    return text_index.text_search(_index_of_changed(spark, bridge.memory(spark, sf_dir)), TEXT).select("id", F.round("score", 6).alias("score"))


def text_search_compacted(spark, sf_dir):
    """The same after its generations were written as one."""
    return text_index.text_search(text_index.compacted(_index_of_changed(spark, bridge.memory(spark, sf_dir))), TEXT).select("id", F.round("score", 6).alias("score"))


def hybrid_search_indexed(spark, sf_dir):
    m = bridge.memory(spark, sf_dir)
    index = text_index.build(m.filter(F.col("embedding").isNotNull()))
    return text_index.hybrid_search(index, m, _query_vector(spark, sf_dir), TEXT).select("id", F.round("rrf", 9).alias("rrf"), "content_type", "status")


def batch_vector_search(spark, sf_dir):
    """Every hundredth vector against all."""
    e = bridge.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    return vectors.batch_vector_search(e, q, 5).select("query_id", "id", F.round("sim", 6).alias("sim"), "rank")


def approximate_vectors(spark, sf_dir):
    """Every hundredth vector against a stored index: how many were asked, and whether nine tenths or more of the exact results were found."""
    e = bridge.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    index = vectors.hyperplane_index(e.filter("id % 2 = 0"))
    index.add(e.filter("id % 2 <> 0"))
    exact, found = vectors.batch_vector_search(e, q, 5), vectors.approximate_vector_search(index, q, 5).select("query_id", "id", F.lit(True).alias("_f"))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("_f") >= 0.9 * F.count("*")).alias("recalled"))


def filtered_memory(spark, sf_dir):
    return tables.optional_filters(bridge.memory(spark, sf_dir), content_type=None, status="active", priority="high").select("id", "content_type", "related_project")


def list_documents(spark, sf_dir):
    m = tables.optional_filters(bridge.memory(spark, sf_dir), content_type="note", status="active")
    return m.select("related_project", "id").orderBy("related_project", "id").limit(200)


def get_document(spark, sf_dir):
    return bridge.memory(spark, sf_dir).filter("id = 42").limit(1).select("id", "content_type", "status", "priority")


def idea_bank(spark, sf_dir):
    m = bridge.memory(spark, sf_dir).filter("content_type = 'idea'")
    impact = F.get_json_object("metadata", "$.impact_score").try_cast("int")
    return m.select("id", impact.alias("impact")).orderBy(F.desc_nulls_first("impact"), "id").limit(20)


def by_project(spark, sf_dir):
    return bridge.memory(spark, sf_dir).filter("related_project = 'src3'").select("id", "status")


def by_tag(spark, sf_dir):
    return bridge.memory(spark, sf_dir).filter(F.array_contains("tags", "fr")).select("id", "related_project")


def by_pattern(spark, sf_dir):
    """A pattern in the text or a JSON field, without regard to case."""
    m = bridge.memory(spark, sf_dir)
    return m.filter(F.ilike(F.col("content"), F.lit("%LICENSED UNDER%")) & F.ilike(F.get_json_object("metadata", "$.lang"), F.lit("E%"))).select("id").orderBy("id").limit(50)


def pending_embedding(spark, sf_dir):
    return bridge.memory(spark, sf_dir).filter(F.col("embedding").isNull()).select("id", "created_at").orderBy("created_at", "id").limit(100)


def recent(spark, sf_dir):
    m = tables.optional_filters(bridge.memory(spark, sf_dir), content_type="task")
    return m.select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(10)


def type_summary(spark, sf_dir):
    return bridge.memory(spark, sf_dir).filter("status = 'active'").groupBy("content_type").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))


def embedding_completeness(spark, sf_dir):
    return bridge.memory(spark, sf_dir).agg(F.count_if(F.col("embedding").isNull()).alias("empty"), F.count("*").alias("total"))


def corpus_totals(spark, sf_dir):
    n = lambda t: bridge.table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n"))
    return n("documents").unionByName(n("embeddings")).unionByName(n("events")).groupBy().pivot("table_name", ["documents", "embeddings", "events"]).agg(F.max("n"))


def validate_memory(spark, sf_dir):
    """Broken rules and how many rows break each."""
    allowed = [tables.outside("content_type", rules.CONTENT_TYPES), tables.outside("status", rules.STATUSES), tables.outside("priority", rules.PRIORITIES), tables.missing("content")]
    good, bad = tables.validated(bridge.memory(spark, sf_dir), allowed)
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("valid").alias("reason"), F.count("*").alias("n")))


def memory_with_defaults(spark, sf_dir):
    """Rows to append, with declared defaults where a field is missing."""
    raw = bridge.memory(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("priority")).alias("priority"), F.when(F.col("id") % 5 != 0, F.col("status")).alias("status"))
    return tables.with_defaults(raw, priority="medium", status="active", source="user")


def missing_from_vectors(spark, sf_dir):
    """Languages of the rows without a vector: what is left of a set when the matched ones are taken away."""
    m = bridge.memory(spark, sf_dir)
    ids = m.select("id").exceptAll(m.filter(F.col("embedding").isNotNull()).select("id"))
    return m.join(ids, "id", "left_semi").groupBy(F.element_at("tags", 1).alias("lang")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (hybrid_search, vector_search, vector_search_filtered, vector_search_builtin, text_search, batch_text_search, batch_text_search_scan, text_search_updated, text_search_compacted, hybrid_search_indexed, batch_vector_search, approximate_vectors, filtered_memory, list_documents, get_document, idea_bank, by_project, by_tag, by_pattern, pending_embedding, recent, type_summary, embedding_completeness, corpus_totals, validate_memory, memory_with_defaults, missing_from_vectors)}

_SIM = "list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_QV = f"qv AS (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID})"


def _bm25(rows: str, words: str) -> str:
    """Tables tok, st, p, dfs, sc (id, score) of `rows` for a list of words."""
    return f"""tok AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM {rows}),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM tok),
p AS (SELECT id, len(t) AS length, w, len(list_filter(t, lambda x: x = w)) AS tf FROM tok, (SELECT unnest({words}) AS w) WHERE list_contains(t, w)),
dfs AS (SELECT w, count(*) AS df FROM p GROUP BY w),
sc AS (SELECT id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 9) AS score
  FROM p JOIN dfs USING (w), st GROUP BY id HAVING count(*) = len({words}))"""


_WORDS = "['and', 'of', 'the']"
ORACLE_SQL = {
    "hybrid_search": with_views(MEMORY_SQL, _QV, "emb AS (SELECT * FROM memory WHERE embedding IS NOT NULL)", _bm25("emb", _WORDS),
        f"vec AS (SELECT m.id, row_number() OVER (ORDER BY {_SIM} DESC, m.id) AS rank FROM emb m, qv q QUALIFY rank <= 40)",
        "fts AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 40)",
        "f AS (SELECT coalesce(vec.id, fts.id) AS id, coalesce(1.0::DOUBLE / (60 + vec.rank), 0) + coalesce(1.0::DOUBLE / (60 + fts.rank), 0) AS rrf FROM vec FULL JOIN fts ON vec.id = fts.id)",
        then="SELECT id, round(rrf, 9) AS rrf, content_type, status FROM (SELECT * FROM f ORDER BY rrf DESC, id LIMIT 8) JOIN memory USING (id)"),
    "vector_search": with_views(MEMORY_SQL, _QV, then=f"SELECT m.id, round({_SIM}, 6) AS sim FROM memory m, qv q WHERE m.embedding IS NOT NULL AND {_SIM} > 0.1 ORDER BY {_SIM} DESC, m.id LIMIT 10"),
    "vector_search_filtered": with_views(MEMORY_SQL, _QV, then=f"SELECT m.id, round({_SIM}, 6) AS sim FROM memory m, qv q WHERE m.embedding IS NOT NULL AND status = 'active' AND content_type = 'note' ORDER BY {_SIM} DESC, m.id LIMIT 5"),
    "text_search": with_views(MEMORY_SQL, _bm25("memory", _WORDS), then="SELECT id, round(score, 6) AS score FROM sc ORDER BY score DESC, id LIMIT 10"),
    "batch_text_search": with_views(MEMORY_SQL,
        "q0 AS (SELECT id AS query_id, content AS query FROM memory WHERE id % 100 = 0)",
        "q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS w FROM q0)", "need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1)",
        "tok AS (SELECT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS t FROM memory)", "st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM tok)",
        "x AS (SELECT id, len(t) AS length, unnest(t) AS w FROM tok)", "p AS (SELECT id, length, w, count(*) AS tf FROM x WHERE w IN (SELECT w FROM q) GROUP BY ALL)", "dfs AS (SELECT w, count(*) AS df FROM p GROUP BY w)",
        "sc AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score, count(*) AS c FROM p JOIN dfs USING (w) JOIN q USING (w), st GROUP BY ALL)",
        then="SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc JOIN need USING (query_id) WHERE c = need QUALIFY rank <= 5"),
    "batch_vector_search": "SELECT q.vec_id AS query_id, m.vec_id AS id, round(" + _SIM + ", 6) AS sim, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(" + _SIM + ", 12) DESC, m.vec_id) AS INTEGER) AS rank FROM embeddings m, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5",
    "filtered_memory": with_views(MEMORY_SQL, then="SELECT id, content_type, related_project FROM memory WHERE status = 'active' AND priority = 'high'"),
    "list_documents": with_views(MEMORY_SQL, then="SELECT related_project, id FROM memory WHERE status = 'active' AND content_type = 'note' ORDER BY 1, 2 LIMIT 200"),
    "get_document": with_views(MEMORY_SQL, then="SELECT id, content_type, status, priority FROM memory WHERE id = 42"),
    "idea_bank": with_views(MEMORY_SQL, then="SELECT id, impact FROM memory WHERE content_type = 'idea' ORDER BY impact DESC NULLS FIRST, id LIMIT 20"),
    "by_project": with_views(MEMORY_SQL, then="SELECT id, status FROM memory WHERE related_project = 'src3'"),
    "by_tag": with_views(MEMORY_SQL, then="SELECT id, related_project FROM memory WHERE lang = 'fr' OR source = 'fr'"),
    "by_pattern": with_views(MEMORY_SQL, then="SELECT id FROM memory WHERE content ILIKE '%LICENSED UNDER%' AND lang ILIKE 'E%' ORDER BY id LIMIT 50"),
    "pending_embedding": with_views(MEMORY_SQL, then="SELECT id, created_at FROM memory WHERE embedding IS NULL ORDER BY created_at, id LIMIT 100"),
    "recent": with_views(MEMORY_SQL, then="SELECT id, created_at FROM memory WHERE content_type = 'task' ORDER BY created_at DESC, id LIMIT 10"),
    "type_summary": with_views(MEMORY_SQL, then="SELECT content_type, count(*) AS n, max(created_at) AS latest FROM memory WHERE status = 'active' GROUP BY 1"),
    "embedding_completeness": with_views(MEMORY_SQL, then="SELECT count(*) FILTER (WHERE embedding IS NULL) AS empty, count(*) AS total FROM memory"),
    "corpus_totals": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM events) AS events",
    "validate_memory": with_views(MEMORY_SQL, "v AS (SELECT content_type NOT IN ('idea','task','note','query','decision','context','agent_report','digest') AS a, content IS NULL AS b FROM memory)",
        then="SELECT 'content_type_not_allowed' AS reason, count(*) AS n FROM v WHERE a HAVING n > 0 UNION ALL SELECT 'content_missing', count(*) FROM v WHERE b HAVING count(*) > 0 UNION ALL SELECT 'valid', count(*) FROM v WHERE NOT a AND NOT b"),
    "memory_with_defaults": with_views(MEMORY_SQL, then="SELECT id, CASE WHEN id % 3 <> 0 THEN priority ELSE 'medium' END AS priority, CASE WHEN id % 5 <> 0 THEN status ELSE 'active' END AS status, 'user' AS source FROM memory"),
    "missing_from_vectors": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY lang",
}
ORACLE_SQL["vector_search_builtin"] = ORACLE_SQL["vector_search"]
ORACLE_SQL |= {"batch_text_search_scan": ORACLE_SQL["batch_text_search"], "text_search_updated": ORACLE_SQL["text_search"], "text_search_compacted": ORACLE_SQL["text_search"], "hybrid_search_indexed": ORACLE_SQL["hybrid_search"]}
ORACLE_SQL["approximate_vectors"] = "SELECT count(*) AS queries, TRUE AS recalled FROM embeddings WHERE vec_id % 100 = 0"
