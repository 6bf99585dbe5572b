"""Reviewed answers and training data, comment archetypes, consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from normwerk.functions import crossval, rules
from normwerk.operators import archetypes, consensus, export, tables, vectors
from normwerk.plans import bridge
from normwerk.plans.bridge import COMMENTS_SQL, CV_SQL, VOTES_SQL, with_views


def _cv(spark, sf_dir):
    return bridge.cross_validation(spark, sf_dir)


def labelled_rows(spark, sf_dir):
    return export.labelled(_cv(spark, sf_dir)).select("id", "final_decision", "expert_verdict")


def next_unlabelled(spark, sf_dir):
    return export.next_unlabelled(_cv(spark, sf_dir), only_disagreements=True).select("id", "reviewer_verdict")


def labelling_stats(spark, sf_dir):
    return export.labelling_stats(_cv(spark, sf_dir))


def label_buckets(spark, sf_dir):
    return export.label_buckets(_cv(spark, sf_dir))


def validate_reviews(spark, sf_dir):
    """Rows that break a declared constraint, by reason."""
    bad = tables.validated(_cv(spark, sf_dir), export.CONSTRAINTS)[1]
    return bad.select("id", F.array_join("reasons", ",").alias("reasons"))


def citations(spark, sf_dir):
    """Labels that may be stored: notes that cite a norm, or none where the decision needs none; citations are put into every third note."""
    cv = _cv(spark, sf_dir).filter(F.col("final_decision").isNotNull())
    notes = F.when(F.col("id") % 3 == 0, F.concat(F.lit("см. СП 2.02, "), F.coalesce("expert_notes", F.lit("")))).otherwise(F.col("expert_notes"))
    return cv.select("id", crossval.has_citation(notes).alias("cited"), export.may_store(F.col("final_decision"), notes).alias("storable"))


def sft_rows(spark, sf_dir):
    s = export.sft(export.labelled(_cv(spark, sf_dir)))
    return s.select(F.col("metadata.log_id").alias("id"), F.md5(F.get("messages", F.lit(2))["content"]).alias("target_md5"), F.md5(F.get("messages", F.lit(1))["content"]).alias("prompt_md5"))


def dpo_rows(spark, sf_dir):
    d = export.dpo(export.labelled(_cv(spark, sf_dir)))
    return d.select(F.col("metadata.log_id").alias("id"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


def critic_rows(spark, sf_dir):
    d = export.dpo_critic(export.labelled(_cv(spark, sf_dir)))
    return d.select(F.col("metadata.log_id").alias("id"), F.get_json_object("rejected", "$.verdict").alias("rejected_verdict"), F.get_json_object("chosen", "$.verdict").alias("chosen_verdict"))


def training_set(spark, sf_dir):
    return export.training_set(_cv(spark, sf_dir)).groupBy("stream").agg(F.count("*").alias("n"))


def export_summary(spark, sf_dir):
    return export.summary(_cv(spark, sf_dir))


def review_fields(spark, sf_dir):
    cv = _cv(spark, sf_dir)
    r = crossval.normalize_review(F.col("reviewer_raw"))
    return cv.select("id", crossval.extract_confidence(F.col("analyst_answer")).alias("confidence"), r["verdict"].alias("verdict"), F.size(r["missed_norms"]).alias("n_missed"), r["disagreement"].alias("disagreement"), F.md5(crossval.claim(F.col("analyst_answer"))).alias("claim_md5"))


def _comments(spark, sf_dir):
    return bridge.comments(spark, sf_dir)


def comment_jobs(spark, sf_dir):
    return archetypes.job_summary(_comments(spark, sf_dir))


def archetypes_promoted(spark, sf_dir):
    return archetypes.promoted(_comments(spark, sf_dir))


def archetype_statistics(spark, sf_dir):
    return archetypes.statistics(_comments(spark, sf_dir))


def severity_check(spark, sf_dir):
    s = archetypes.severity_check(_comments(spark, sf_dir))
    return s.select("severity", "n", *[F.round(c, 6).alias(c) for c in ("share", "expected", "difference")])


def only_major_reports(spark, sf_dir):
    return archetypes.only_major(_comments(spark, sf_dir))


AXES = ("section", "object_type", "region")


def axis_frequencies(spark, sf_dir):
    return archetypes.frequencies(_comments(spark, sf_dir), AXES, [["section"], ["object_type", "region"], [*AXES], []])


SIX_AXES = ("section", "object_type", "severity", "region", "clause_id", "branch")


def six_axis_frequencies(spark, sf_dir):
    """By each of the six axes, and by three of them together; the report's number stands for its branch."""
    c = _comments(spark, sf_dir).withColumn("branch", F.col("report_id") % 14)
    return archetypes.frequencies(c, SIX_AXES, [*([a] for a in SIX_AXES), ["section", "region", "branch"]])


def report_shares(spark, sf_dir):
    return archetypes.report_shares(_comments(spark, sf_dir), "archetype_id", "object_type")


def pareto(spark, sf_dir):
    return archetypes.pareto(_comments(spark, sf_dir)).select("archetype_id", "n", F.round("running_share", 6).alias("running_share"), "in_core")


def pareto_summary(spark, sf_dir):
    return archetypes.pareto_summary(archetypes.pareto(_comments(spark, sf_dir)))


def top_archetypes(spark, sf_dir):
    return archetypes.top_per_slice(_comments(spark, sf_dir), "section")


def regional_drift(spark, sf_dir):
    return archetypes.regional_drift(_comments(spark, sf_dir), "ASIA", "EUROPE")


def drift_significance(spark, sf_dir):
    """Which archetypes' shares differ between two regions, at a false-discovery rate of a half (the test rows are all but alike)."""
    return archetypes.significant(regional_drift(spark, sf_dir), 0.5).select("archetype_id", "z", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "significant")


def review_flags(spark, sf_dir):
    c = _comments(spark, sf_dir)
    return c.select(archetypes.needs_review("confidence").alias("needs_review"), (F.col("confidence") < 0.4).alias("unsure")).groupBy("needs_review", "unsure").agg(F.count("*").alias("n"))


def quotes_checked(spark, sf_dir):
    """Line items' quotes against a report text built from their order; every 7th report's quotes are false, and of every 11th the first item wasn't extracted."""
    l = bridge.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" fails;")).alias("q"))
    reports = l.groupBy("report_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.col("n").cast("string"), F.lit(". "), F.col("q"))))).alias("raw_text"))
    said = l.filter((F.col("report_id") % 11 != 0) | (F.col("n") != 1)).select("report_id", "n", F.when(F.col("report_id") % 7 == 0, F.concat(F.lit("no "), F.col("q"))).otherwise(F.col("q")).alias("raw_text"))
    per = archetypes.quotes_checked(said, reports).groupBy("report_id").agg(F.count_if(~F.col("found")).alias("not_found"))
    return archetypes.counts_checked(said, reports).join(per, "report_id", "left").select("report_id", "extracted", "numbered", "complete", F.coalesce("not_found", F.lit(0)).alias("not_found"))


def comment_clusters(spark, sf_dir):
    """Components of all links of 0.45 or more among the vectors (the test vectors have few above)."""
    e = bridge.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return archetypes.clusters(vectors.similarity_links(e, 0.45), e.select("id"))


def density_clusters(spark, sf_dir):
    """Vectors with two others of 0.4 or more lie densely; clusters of such, with what is near them."""
    e = bridge.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.density_clusters(e, 0.4, 3)


def vote_consensus(spark, sf_dir):
    return consensus.label_consensus(bridge.votes(spark, sf_dir))


def vote_levels(spark, sf_dir):
    return consensus.levels(consensus.label_consensus(bridge.votes(spark, sf_dir)))


def majority_type(spark, sf_dir):
    return consensus.majority(bridge.votes(spark, sf_dir), "type")


def unanimous_votes(spark, sf_dir):
    return consensus.unanimous(bridge.votes(spark, sf_dir), ["model_0", "model_1", "model_2"], ["request_id", "type", "label"])


def near_positions(spark, sf_dir):
    """Elements that two models see at nearly the same place of a request."""
    v = bridge.votes(spark, sf_dir).select("request_id", "model", "type", F.col("label").alias("element"))
    k = bridge.table(spark, sf_dir, "part").select(F.col("p_name").alias("element"), (F.col("p_partkey") % 500).alias("request_id"), "p_partkey").groupBy("element", "request_id").agg(F.min("p_partkey").alias("k"))
    m = F.substring("model", 7, 1).cast("int")
    placed = v.distinct().join(k, ["element", "request_id"]).withColumns({"x": ((F.col("k") * 37 + m * 4) % 100).cast("double"), "y": ((F.col("k") * 53 + m * 6) % 100).cast("double")})
    return consensus.position_consensus(placed).groupBy("request_id").agg(F.count("*").alias("pairs"))


QUERIES = {f.__name__: f for f in (labelled_rows, next_unlabelled, labelling_stats, label_buckets, validate_reviews, citations, sft_rows, dpo_rows, critic_rows, training_set, export_summary, review_fields, comment_jobs, archetypes_promoted, archetype_statistics, severity_check, only_major_reports, axis_frequencies, six_axis_frequencies, report_shares, pareto, pareto_summary, top_archetypes, regional_drift, drift_significance, review_flags, quotes_checked, comment_clusters, density_clusters, vote_consensus, vote_levels, majority_type, unanimous_votes, near_positions)}

_LAB = "l AS (SELECT *, CASE WHEN marked AND level <> 'certain' THEN level END AS conf FROM cv WHERE final_decision IS NOT NULL AND expert_verdict IS NOT NULL)"


def _marked(text: str) -> str:
    """SQL of a text that ends in its marker: the bridge's answers hold at most one marker, in their last line."""
    return f"CASE WHEN marked AND level <> 'certain' AND NOT noted THEN {text} ELSE rtrim(regexp_replace({text}, '(?i)confidence\\s*[:=]\\s*(high|medium|low)\\b', '', 'g'), ' ' || chr(10)) || chr(10) || 'confidence: ' || coalesce(conf, 'medium') END"


_SFT = "t AS (SELECT *, final_decision = 'claude_was_right' AND expert_notes IS NULL AS plain, expert_notes IS NOT NULL AS noted, CASE WHEN final_decision = 'claude_was_right' THEN CASE WHEN expert_notes IS NULL THEN trim(analyst_answer, ' ' || chr(10)) WHEN analyst_answer IS NULL THEN expert_notes ELSE trim(analyst_answer, ' ' || chr(10)) || chr(10) || chr(10) || '[уточнение эксперта]' || chr(10) || expert_notes END ELSE expert_notes END AS target FROM l)"
_PROMPT = "'ВОПРОС:' || chr(10) || question || repeat(chr(10), 4) || 'КЛОЗЫ ИЗ БАЗЫ НТД:' || repeat(chr(10), 2) || '[1] SP 1 п.1.1' || chr(10) || 'clause text 1' || repeat(chr(10), 2) || '[2] SP 2 п.2.1' || chr(10) || 'clause text 2'"
_DPO = "final_decision = 'gpt_was_right' AND disagreement AND expert_notes IS NOT NULL AND analyst_answer IS NOT NULL AND analyst_answer <> ''"
_CRITIC = "final_decision = 'claude_was_right' AND disagreement AND analyst_answer IS NOT NULL AND reviewer_verdict IN ('rejected', 'uncertain')"
_SHARE = "CASE severity WHEN 'major' THEN 0.5 WHEN 'minor' THEN 0.35 WHEN 'critical' THEN 0.1 ELSE 0.05 END"
_PARETO = "n AS (SELECT archetype_id, count(*) AS n FROM comments GROUP BY 1), p AS (SELECT archetype_id, n, sum(n) OVER (ORDER BY n DESC, archetype_id ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS total FROM n), q AS (SELECT archetype_id, n, round(run / total, 6) AS running_share, (run - n) / total < 0.8 AS in_core FROM p)"
_CONS = "c AS (SELECT request_id, type, lower(trim(label)) AS label, count(DISTINCT model) AS models FROM votes GROUP BY ALL)"
ORACLE_SQL = {
    "labelled_rows": with_views(CV_SQL, then="SELECT id, final_decision, expert_verdict FROM cv WHERE final_decision IS NOT NULL AND expert_verdict IS NOT NULL"),
    "next_unlabelled": with_views(CV_SQL, then="SELECT id, reviewer_verdict FROM cv WHERE expert_verdict IS NULL AND disagreement ORDER BY id LIMIT 1"),
    "labelling_stats": with_views(CV_SQL, then="SELECT count(*) AS total, count(*) FILTER (WHERE expert_verdict IS NULL) AS unlabeled, count(*) FILTER (WHERE expert_verdict IS NOT NULL) AS labeled, count(*) FILTER (WHERE disagreement) AS disagreements, count(*) FILTER (WHERE disagreement AND expert_verdict IS NULL) AS unlabeled_disagree, count(*) FILTER (WHERE final_decision = 'claude_was_right') AS claude_was_right, count(*) FILTER (WHERE final_decision = 'gpt_was_right') AS gpt_was_right, count(*) FILTER (WHERE final_decision = 'both_wrong') AS both_wrong, count(*) FILTER (WHERE final_decision = 'split') AS split FROM cv"),
    "label_buckets": with_views(CV_SQL, then="SELECT 'final_decision' AS field, coalesce(final_decision, 'null') AS value, count(*) AS n FROM cv GROUP BY 2 UNION ALL SELECT 'expert_verdict', coalesce(expert_verdict, 'null'), count(*) FROM cv GROUP BY 2"),
    "validate_reviews": with_views(CV_SQL, "r AS (SELECT id, CASE WHEN question IS NULL THEN 'question_missing' END AS a, CASE WHEN base_answer IS NULL THEN 'analyst_answer_missing' END AS b, CASE WHEN final_decision <> 'claude_was_right' AND expert_notes IS NULL THEN 'notes_missing' END AS c FROM cv)", then="SELECT id, concat_ws(',', a, b, c) AS reasons FROM r WHERE coalesce(a, b, c) IS NOT NULL"),
    "sft_rows": with_views(CV_SQL, _LAB, _SFT, then=f"SELECT id, md5({_marked('target')}) AS target_md5, md5({_PROMPT}) AS prompt_md5 FROM t WHERE target IS NOT NULL AND target <> ''"),
    "dpo_rows": with_views(CV_SQL, _LAB, then=f"SELECT id, md5(expert_notes || chr(10) || 'confidence: ' || coalesce(conf, 'medium')) AS chosen_md5, md5({_marked('analyst_answer').replace('NOT noted', 'TRUE')}) AS rejected_md5 FROM l WHERE {_DPO}"),
    "critic_rows": with_views(CV_SQL, _LAB, then=f"SELECT id, reviewer_verdict AS rejected_verdict, 'confirmed' AS chosen_verdict FROM l WHERE {_CRITIC}"),
    "training_set": with_views(CV_SQL, _LAB, _SFT, then=f"SELECT stream, count(*) AS n FROM (SELECT 'sft' AS stream FROM t WHERE target IS NOT NULL AND target <> '' UNION ALL SELECT 'dpo' FROM l WHERE {_DPO} UNION ALL SELECT 'dpo_critic' FROM l WHERE {_CRITIC}) GROUP BY 1"),
    "export_summary": with_views(CV_SQL, _LAB, _SFT, then=f"SELECT (SELECT count(*) FROM cv) AS total, (SELECT count(*) FROM l) AS labelled, (SELECT count(*) FROM t WHERE target IS NOT NULL AND target <> '') AS sft, (SELECT count(*) FROM l WHERE {_DPO}) AS dpo, (SELECT count(*) FROM l WHERE {_CRITIC}) AS dpo_critic"),
    "review_fields": with_views(CV_SQL, then="SELECT id, CASE WHEN marked AND level <> 'certain' AND base_answer IS NOT NULL THEN level END AS confidence, reviewer_verdict AS verdict, CAST(1 AS INTEGER) AS n_missed, disagreement, md5(substr(trim(coalesce(analyst_answer, ''), ' ' || chr(10)), 1, 400)) AS claim_md5 FROM cv"),
    "comment_jobs": with_views(COMMENTS_SQL, then="SELECT report_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'major') AS substantial, count(*) FILTER (WHERE severity = 'minor') AS minor FROM comments GROUP BY 1"),
    "archetypes_promoted": with_views(COMMENTS_SQL, then="SELECT archetype_id, count(*) AS n, count(DISTINCT report_id) AS n_reports FROM comments GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT report_id) >= 2"),
    "archetype_statistics": with_views(COMMENTS_SQL, then="SELECT archetype_id, count(*) AS occurrences, count(DISTINCT report_id) AS reports, max(report_date) AS last_seen FROM comments GROUP BY 1"),
    "severity_check": with_views(COMMENTS_SQL, "n AS (SELECT severity, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM comments GROUP BY 1)", then=f"SELECT severity, n, round(share, 6) AS share, CAST({_SHARE} AS DOUBLE) AS expected, round(share - CAST({_SHARE} AS DOUBLE), 6) AS difference FROM n"),
    "only_major_reports": with_views(COMMENTS_SQL, then="SELECT report_id, count(*) AS n FROM comments GROUP BY 1 HAVING bool_and(severity = 'major')"),
    "axis_frequencies": with_views(COMMENTS_SQL, then="SELECT section, object_type, region, count(*) AS n, CAST(grouping_id(section, object_type, region) AS BIGINT) AS axes_used FROM comments GROUP BY GROUPING SETS ((section), (object_type, region), (section, object_type, region), ())"),
    "report_shares": with_views(COMMENTS_SQL, "o AS (SELECT object_type, count(DISTINCT report_id) AS of_ FROM comments GROUP BY 1)", then="SELECT object_type, archetype_id, count(DISTINCT report_id) AS reports, round(count(DISTINCT report_id) / max(of_), 6) AS share FROM comments JOIN o USING (object_type) GROUP BY 1, 2"),
    "pareto": with_views(COMMENTS_SQL, _PARETO, then="SELECT archetype_id, n, running_share, in_core FROM q"),
    "pareto_summary": with_views(COMMENTS_SQL, _PARETO, then="SELECT count(*) FILTER (WHERE in_core) AS core, count(*) AS archetypes, round(count(*) FILTER (WHERE in_core) / count(*), 6) AS share, count(*) FILTER (WHERE in_core) / count(*) <= 0.25 AS reached FROM q"),
    "top_archetypes": with_views(COMMENTS_SQL, then="SELECT section, archetype_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, archetype_id) AS INTEGER) AS rank FROM comments GROUP BY 1, 2 QUALIFY rank <= 20"),
    "regional_drift": with_views(COMMENTS_SQL, "w AS (SELECT archetype_id, count(*) FILTER (WHERE region = 'ASIA') AS n_a, count(*) FILTER (WHERE region = 'EUROPE') AS n_b FROM comments WHERE region IN ('ASIA', 'EUROPE') GROUP BY 1)", "t AS (SELECT *, sum(n_a) OVER ()::DOUBLE AS t_a, sum(n_b) OVER ()::DOUBLE AS t_b, CAST(rank() OVER (ORDER BY n_a DESC) AS INTEGER) AS rank_a, CAST(rank() OVER (ORDER BY n_b DESC) AS INTEGER) AS rank_b FROM w)",
        then="SELECT archetype_id, n_a, n_b, rank_a, rank_b, round(n_a / t_a - n_b / t_b, 6) AS difference, round((n_a / t_a - n_b / t_b) / sqrt((n_a + n_b) / (t_a + t_b) * (1 - (n_a + n_b) / (t_a + t_b)) * (1 / t_a + 1 / t_b)), 6) AS z FROM t"),
    "review_flags": with_views(COMMENTS_SQL, then="SELECT confidence < 0.75 AS needs_review, confidence < 0.4 AS unsure, count(*) AS n FROM comments GROUP BY 1, 2"),
    "quotes_checked": "WITH x AS (SELECT l_orderkey AS report_id, count(*) AS numbered, count(*) FILTER (WHERE l_orderkey % 11 <> 0 OR l_linenumber <> 1) AS extracted FROM lineitem GROUP BY 1) SELECT report_id, extracted, numbered, extracted >= numbered AS complete, CASE WHEN report_id % 7 = 0 THEN extracted ELSE 0 END AS not_found FROM x",
    "six_axis_frequencies": with_views(COMMENTS_SQL, "c AS (SELECT *, report_id % 14 AS branch FROM comments)", then="SELECT section, object_type, severity, region, clause_id, branch, count(*) AS n, CAST(grouping_id(section, object_type, severity, region, clause_id, branch) AS BIGINT) AS axes_used FROM c GROUP BY GROUPING SETS ((section), (object_type), (severity), (region), (clause_id), (branch), (section, region, branch))"),
    "citations": with_views(CV_SQL, then="SELECT id, id % 3 = 0 AS cited, final_decision = 'claude_was_right' OR id % 3 = 0 AS storable FROM cv WHERE final_decision IS NOT NULL"),
    "comment_clusters": """WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45),
r(id, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.x) SELECT id, min(x) AS cluster FROM r GROUP BY id""",
    "near_positions": with_views(VOTES_SQL, "k AS (SELECT p_name AS element, p_partkey % 500 AS request_id, min(p_partkey) AS k FROM part GROUP BY 1, 2)", "v AS (SELECT DISTINCT request_id, model, type, label AS element, CAST(substr(model, 7, 1) AS INTEGER) AS m FROM votes)",
        "p AS (SELECT v.*, (k * 37 + m * 4) % 100 AS x, (k * 53 + m * 6) % 100 AS y FROM v JOIN k USING (element, request_id))",
        then="SELECT a.request_id, count(*) AS pairs FROM p a JOIN p b ON a.request_id = b.request_id AND a.type = b.type AND a.model < b.model AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10 GROUP BY 1"),
    "vote_consensus": with_views(VOTES_SQL, _CONS, then="SELECT * FROM c"),
    "vote_levels": with_views(VOTES_SQL, _CONS, then="SELECT request_id, count(*) AS candidates, count(*) FILTER (WHERE models >= 3) AS high, count(*) FILTER (WHERE models = 2) AS medium, count(*) FILTER (WHERE models = 1) AS low, round(count(*) FILTER (WHERE models < 3) / count(*), 6) AS disagreement FROM c GROUP BY 1"),
    "majority_type": with_views(VOTES_SQL, "m AS (SELECT request_id, type, count(DISTINCT model) AS n FROM votes GROUP BY 1, 2)", then="SELECT request_id, type, n FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC, length(type) DESC, type DESC) = 1"),
    "unanimous_votes": with_views(VOTES_SQL, then="SELECT DISTINCT request_id, type, label FROM votes GROUP BY ALL HAVING count(DISTINCT model) = 3"),
}

_TAIL = " + ".join(f"({c}) * pow(t, {i + 1})" for i, c in enumerate(archetypes.TAIL))
ORACLE_SQL["drift_significance"] = f"""WITH d AS ({ORACLE_SQL["regional_drift"]}), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM d),
p AS (SELECT archetype_id, z, CASE WHEN z IS NOT NULL THEN round(least(1.0, 2 * exp(-z * z / 2) * 0.3989422804014327 * ({_TAIL})), 9) END AS p FROM t), r AS (SELECT *, count(*) OVER (ORDER BY p) AS rank, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
q AS (SELECT *, round(min(p * m / rank) OVER (ORDER BY p DESC), 9) AS q FROM r)
SELECT p.archetype_id, p.z, round(p.p, 6) AS p, round(q, 6) AS q, coalesce(q <= 0.5, FALSE) AS significant FROM p LEFT JOIN q ON q.archetype_id = p.archetype_id"""
ORACLE_SQL["density_clusters"] = """WITH RECURSIVE s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS sim FROM embeddings a, embeddings b),
l AS (SELECT * FROM s WHERE sim >= 0.4), core AS (SELECT a AS id FROM l GROUP BY a HAVING count(*) >= 3),
k AS (SELECT a, b FROM l WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
r(id, x) AS (SELECT id, id FROM core UNION SELECT r.id, k.b FROM r JOIN k ON k.a = r.x), c AS (SELECT id, min(x) AS cluster FROM r GROUP BY id),
e AS (SELECT a AS id, b FROM l WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) = 1)
SELECT vec_id AS id, coalesce(c.cluster, d.cluster) AS cluster, c.id IS NOT NULL AS core FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN e ON e.id = vec_id LEFT JOIN c d ON d.id = e.b"""
