"""Sources: text corpora, tables read in ranges, dumps, logs, catalogues, ideas, nested properties."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normwerk.sources.dump import elements
from normwerk.sources.keyset import KeysetSource

DUMP = {
    "memory": "id string, content string, content_type string, summary string, tags array<string>, source string, priority string, status string, related_project string, created_at string",
    "projects": "id string, name string, description string, status string, agents array<string>",
    "agent_logs": "agent_id string, action string, status string, duration_ms int, created_at string",
}


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """path, name, text: a row per file; bytes that aren't UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"))


def register(spark: SparkSession) -> None:
    """Make the `keyset` format known to the session, and let comparisons be sent along to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeysetSource)


def read_table(spark: SparkSession, url: str, table: str, key: str = "id", partitions: int = 8, bounds: tuple[int, int] | None = None, properties: dict[str, str] | None = None, schema: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A remote table, in ranges of its key that are read side by side where `bounds` (the least and the largest, for integers) are given.

    http(s) URLs are read page by page (see sources.keyset; `schema` has the columns), jdbc URLs by the database's driver; any other is a path of Parquet files.
    """
    if url.startswith(("http://", "https://")):
        register(spark)
        cuts = [bounds[0] + (bounds[1] - bounds[0]) * i // partitions for i in range(1, partitions)] if bounds else []
        return spark.read.format("keyset").schema(schema).options(url=url, table=table, key=key, bounds=json.dumps(sorted(set(cuts))), **(options or {})).load()
    if not url.startswith("jdbc:"):
        return spark.read.parquet(f"{url.rstrip('/')}/{table}.parquet")
    if bounds is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties)


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Three tables from JSON objects with three arrays that other text may wrap, each read by as many tasks as its bytes ask for (see sources.dump)."""
    found = elements(spark, path)  # from a stored table
    return {k: found.filter(F.col("array") == k).select(F.from_json("element", columns).alias("_e")).select("_e.*") for k, columns in DUMP.items()}


def read_access_log(spark: SparkSession, glob: str, partitions: int | None = None) -> DataFrame:
    """line; a .gz file is one task, so its lines are dealt out at once where `partitions` says so."""
    lines = spark.read.text(glob).withColumnRenamed("value", "line")
    return lines.repartition(partitions) if partitions else lines


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """sheet, row_no, col_a, col_b of CSV files that hold their row numbers."""
    return spark.read.csv(path, header=True, schema="sheet string, row_no long, col_a string, col_b string")


def read_ideas(texts: DataFrame) -> DataFrame:
    """date, source, status, feasibility, impact, tags, body from front matter; `~` and what is missing are null."""
    head = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    at = lambda k: F.nullif(F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit("")), F.lit("~"))
    tags = F.filter(F.transform(F.split(F.btrim(F.coalesce(at("tags"), F.lit("")), F.lit("[]")), ","), lambda x: F.trim(x)), lambda x: x != "")
    keep = [c for c in texts.columns if c != "text"]
    return texts.select(*keep, at("date").alias("date"), at("source").alias("source"), at("status").alias("status"), at("feasibility").try_cast("int").alias("feasibility"), at("impact").try_cast("int").alias("impact"), tags.alias("tags"), F.regexp_extract("text", r"(?s)\A---\n.*?\n---\n\n?(.*)", 1).alias("body"))


def flatten_properties(rows: DataFrame, column: str = "properties") -> DataFrame:
    """title, url, status from nested property JSON."""
    title = F.from_json(F.get_json_object(column, "$.title.title"), "array<struct<plain_text string>>")
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.array_join(F.transform(title, lambda x: x["plain_text"]), "").alias("title"), F.get_json_object(column, "$.url.url").alias("url"), F.get_json_object(column, "$.status.status.name").alias("status"))
