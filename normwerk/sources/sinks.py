"""Sinks: JSON lines, documents by section, run summaries, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normwerk.functions.text import export_filename
from normwerk.operators.tables import first_by, upsert
from normwerk.sources.shared import stored


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, characters as they are."""
    df.write.mode("overwrite").option("encoding", "UTF-8").option("ignoreNullFields", "false").json(path)


def write_sections(documents: DataFrame, path: str) -> None:
    """Texts in a folder per section (`section`, `name`, `text`), and an index of names and lengths beside them."""
    d = documents.withColumn("name", export_filename("name"))
    d.write.mode("overwrite").partitionBy("section").json(f"{path}/documents")
    d.select("section", "name", F.length("text").alias("n_chars")).write.mode("overwrite").json(f"{path}/index")


def write_summary(summary: DataFrame, path: str) -> None:
    """One row in one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


ERROR_CHARS = 2000


def append_rows(df: DataFrame, path: str, error: str | None = None) -> None:
    """`error` names a column of error texts, of which the journal keeps the first ERROR_CHARS characters."""
    df = df.withColumn(error, F.substring(error, 1, ERROR_CHARS)) if error else df
    df.write.mode("append").parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def merge_snapshot(new: DataFrame, path: str, key: str, buckets: int = 64, keep_if_null: tuple[str, ...] = ()) -> None:
    """Upsert into a snapshot that is stored by buckets of its key; only buckets with incoming rows are rewritten.

    Doing it twice with the same rows leaves the same table.
    """
    spark = new.sparkSession
    new = first_by(new, [key], [F.xxhash64(*[F.col(c) for c in new.columns])])  # repeated keys: one row, always the same
    incoming = bucketed(new, key, buckets)
    touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # at most `buckets` numbers
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    else:
        old = incoming.limit(0)
    merged = bucketed(upsert(old.drop("bucket"), new, key, keep_if_null), key, buckets)
    # the old files are read before they go; the buckets are replaced when the write commits
    stored(merged, "snapshot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_ordered(new: DataFrame, path: str, key: str, updated: str, batch: int = 0, keep_if_null: tuple[str, ...] = (), deleted: str | None = None, buckets: int = 64) -> None:
    """Bring updates into a snapshot in which the row with the largest (`updated`, batch) of each key stands, whatever the order in which batches come.

    `keep_if_null` names columns for which the latest value that isn't null counts.  Where `deleted` is true the row stays as a mark, so that an older update that comes later doesn't bring
    it back; `read_ordered` leaves it out.  The merge takes the largest of what is there and what comes: it can be repeated and batches can change places.  Of rows of one key, time and batch
    the one with the largest hash counts.  Null keys are one key; null times are the earliest.  A key that many rows have is merged where they are read.
    """
    spark = new.sparkSession
    columns = [c for c in new.columns if c != key]
    order = F.struct(F.col(updated).alias("t"), F.lit(batch).cast("long").alias("b"), F.xxhash64(*[F.col(c) for c in new.columns]).alias("h"))
    late = [c for c in columns if c in keep_if_null]
    rows = new.withColumn("_order", order).select("*", *[F.when(F.col(c).isNotNull(), F.col("_order")).alias(f"_order_{c}") for c in late])
    incoming = bucketed(rows, key, buckets)
    touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.read.schema(incoming.schema).parquet(path).filter(F.col("bucket").isin(touched)) if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else incoming.limit(0)
    last = [(F.max_by(c, f"_order_{c}") if c in late else F.max_by(F.struct(c), "_order")[c]).alias(c) for c in columns]
    orders = [F.max(c).alias(c) for c in ("_order", *[f"_order_{c}" for c in late])]
    merged = old.unionByName(incoming).groupBy(key, "bucket").agg(*last, *orders)
    # the old files are read before they go; the buckets are replaced when the write commits
    stored(merged.select(incoming.columns), "snapshot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_ordered(spark: SparkSession, path: str, deleted: str | None = None) -> DataFrame:
    """The snapshot that `merge_ordered` keeps."""
    rows = spark.read.parquet(path)
    rows = rows.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else rows
    return rows.drop("bucket", *[c for c in rows.columns if c == "_order" or c.startswith("_order_")])
