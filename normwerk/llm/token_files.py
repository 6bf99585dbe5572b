"""Token ids in Parquet files that allow selective reads.

One row per document, in ascending doc_id order over all files: doc_id, part (the file's number), start_in_part, n_tokens and
ids, a list column.  Integers are dictionary encoded while a dictionary pays, else delta encoded (Parquet format 2);
row groups and pages are of stated size, so that the column and page indexes, which hold the smallest and largest doc_id
of each page, let a reader of a few documents skip the rest.  Readers of metadata alone don't touch the ids.

Defined results: null and empty texts have the end id alone.  Null doc_ids come first; rows of one doc_id are ordered by
a hash of their text.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normwerk.llm import pieces
from normwerk.llm.tokens import encoder

BROADCAST_FILES = 200_000  # of 16 bytes each
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding where a dictionary doesn't pay
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def write_token_files(df: DataFrame, path: str) -> None:
    """Encode every whole text of `df` (doc_id, text) and write the files; each text is shuffled once, into its range of doc_ids."""
    rows = df.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("part", T.LongType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, start = encoder(special=True), TaskContext.get().partitionId(), 0
        for b in (x for whole in it for x in pieces.slices(whole, 1)):
            ids, at = tool.arrays(b.column(1).to_pylist(), end=True)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(at) - 1, part)), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], [f.name for f in schema])
            start += int(at[-1])

    rows.mapInArrow(batches, schema).write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens without reading ids; start counts the ids of all documents before."""
    meta = spark.read.parquet(path).select("doc_id", "part", "start_in_part", "n_tokens")
    return _with_offsets(meta, meta).select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens")


def _with_offsets(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """`rows` with `_before`, the ids of the files before; a row a file, sent to all tasks unless there are more than BROADCAST_FILES."""
    offsets = _offsets(whole.select("part", "n_tokens"))
    return rows.join(F.broadcast(offsets) if len(whole.inputFiles()) <= BROADCAST_FILES else offsets.hint("merge"), "part")


def _offsets(meta: DataFrame) -> DataFrame:
    """part, _before: one row of two integers per file."""
    each = meta.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of the documents from `first` to `last`; the bounds reach the page index."""
    df = spark.read.parquet(path).select("doc_id", "n_tokens", "ids")
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    return df if last is None else df.filter(F.col("doc_id") <= last)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files' own ids (crc32 of them as little-endian 32-bit integers)."""
    whole = spark.read.parquet(path)
    schema = T.StructType([whole.schema["doc_id"], T.StructField("part", T.LongType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(3)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            crc = [zlib.crc32(ids[i:j].data) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], [f.name for f in schema])

    read = whole.select("doc_id", "part", "start_in_part", "ids").mapInArrow(batches, schema)
    return _with_offsets(read, whole).select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
