"""From raw documents to packed sequences: language, lines, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normwerk.llm import decontaminate, langid, line_templates, near_copies, packing
from normwerk.llm.common import crc_of_id, row_key, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; learned, as in the query, from those with a language whose crc32 mod 3 isn't 1."""
    model = langid.fit(docs.filter(crc_of_id() % 3 != 1).select("doc_id", "text", "lang"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return langid.predict(rows, model, "_text").filter(~F.col("rejected")).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates, copies being left for the next stage; n_chars follows the text."""
    out = line_templates.drop_lines(docs, spare_copies=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8 or more): that with the smallest doc_id, null last, then by hash of the text."""
    keys = ["_k1", "_k2"]
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), "text")
    of = near_copies.roots(keyed, ["doc_id", *keys])
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", *keys)).alias("_m")).select("_m._k1", "_m._k2")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key("doc_id", "text"))
    return rows.join(first, keys, "left_semi").groupBy(*keys).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]
#: zstandard, hashes of shingles and tokenizers are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
