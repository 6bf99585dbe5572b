"""The registered queries of this subpackage and their SQL, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normwerk.llm import conversations, decontaminate, langid, licenses, line_templates, ogg, packing, phrases, quality, simhash, token_files, url_rules, vector_graph
from normwerk.llm.common import crc_of_id, new_path, text_or_empty


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 8-bit samples in Ogg files; digests of what is read back.  The column `media` is the store: its bytes are whole files."""
    raw = text_or_empty().cast("binary")
    padded = F.greatest(F.ceil(F.length(raw) / 64), F.lit(1)) * 64
    payload = F.concat(raw, F.repeat(F.lit("\0"), (padded - F.length(raw)).cast("int")).cast("binary"))
    stored = ogg.write_ogg(documents(spark, sf_dir).select("doc_id", F.length(raw).cast("long").alias("n_bytes"), payload.alias("payload")))
    p, o = F.col("ogg.payload"), F.col("ogg")
    feature = F.format_string("streams=%d pages=%d bad=%d lost=%d packets=%d duration_us=%d", o["streams"], o["pages"], o["bad_pages"], o["lost_pages"], F.size(o["packets"]), o["duration_us"])
    return ogg.read_ogg(stored.drop("n_bytes")).select(
        "doc_id", F.col("ogg.n_bytes").alias("n_bytes"), F.length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"), F.crc32(F.substring(p, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op2_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of three quarters of them."""
    held_out = crc_of_id() % 4 == 2
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.filter(~held_out), labels)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_langid_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    held_out = crc_of_id() % 3 == 1
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in Parquet list columns; positions and digests of what is read back."""
    path = new_path(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), path)
    return token_files.digests(spark, path)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs: lines dropped, and length and digest of what is left."""
    left = line_templates.drop_lines(documents(spark, sf_dir).select("doc_id", "text"), dropped="n_dropped")
    return left.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items, as they are or with other numbers, names and units."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(documents(spark, sf_dir))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op10_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: each row is left, dropped (0 copies), emptied, cut, repeated (2 copies) or given to the user, by a checksum of its place."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations, and the cheapest edits that mend them."""
    return conversations.repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "copies")[0]


def op12_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20, against all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_graph.search(rows, rows.filter("vec_id % 20 = 0"), 20)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return phrases.collocations(documents(spark, sf_dir).select("text", "lang"), top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media_ogg, op2_quality_zstd, op3_langid_zstd, op4_token_parquet, op5_line_templates, op6_benchmark_templates, op7_best_fit_packing, op8_url_rules, op9_license_templates, op10_simhash_anchors, op11_conversation_repair, op12_vector_graph, op13_phrases, pipeline)}

ORACLE_SQL = {"op5_line_templates": line_templates.ORACLE, "op8_url_rules": url_rules.ORACLE, "op11_conversation_repair": conversations.ORACLE, "op13_phrases": phrases.ORACLE}
