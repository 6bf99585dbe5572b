"""Best-fit packing of documents into sequences, with large-item matching.

Pieces above a third of the capacity go at most two to a sequence: the largest is matched, greedily, with the largest that
fits beside it.  Smaller pieces, largest first, go into the smallest gap that holds them; a sequence is opened where none does.

How many pieces have each length is all that the plan needs: `capacity` numbers at most, whatever the corpus.  The driver makes the plan from
them as runs (length, first rank, count, first sequence, offset).  Executors then find each piece's run from its length
and its rank among the pieces of that length.  Ranks come from counts per (salt, length), so that a length which a third of
all pieces share is ranked by many tasks.

Defined results: null and empty texts are one piece with the end id alone.  Longer documents than the capacity are cut so that all pieces
but the first are full.  Repeated rows are packed as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normwerk.llm.common import stored
from normwerk.llm.pieces import slices
from normwerk.llm.tokens import encoder

CAPACITY = 2048
ROWS_PER_SALT = 200_000


def pieces(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each whole text of `df` (doc_id, text)."""
    rows = df.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(special=True)
        for b in (x for whole in it for x in slices(whole, 1)):
            ids, at = tool.arrays(b.column(1).to_pylist(), end=True)
            n = np.diff(at)
            parts = -(-n // capacity)  # all but the first are full
            of = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = (n - (parts - 1) * capacity)[of]
            start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first)
            crc = [zlib.crc32(ids[a:z]) for a, z in zip((at[of] + start).tolist(), (at[of] + start + length).tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return rows.mapInArrow(batches, schema)


class _Open:
    """Groups of equal sequences: what is in them, their gap, how many."""

    def __init__(self):
        self.by_gap: dict[int, list[list]] = {}
        self.gaps: list[int] = []

    def add(self, inside: tuple, gap: int, count: int) -> None:
        if count:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append([inside, count])

    def smallest(self, least: int) -> tuple[tuple, int, int] | None:
        """Take out a group with the smallest gap of at least `least`."""
        i = bisect_left(self.gaps, least)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        inside, count = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[i]
        return inside, gap, count


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place counts[length] pieces of each length.

    `inside` of a group is a chain of (length, how many, the chain before), so that adding to a group costs the same however full it is.
    """
    left = dict(counts)
    large = sorted((x for x in left if 3 * x > capacity and left[x]), reverse=True)
    opened = _Open()
    for x in large:
        while left[x]:
            fits = [y for y in large if y <= capacity - x and left[y] - (y == x) > 0]
            if not fits:
                opened.add((x, 1, None), capacity - x, left[x])
                left[x] = 0
                break
            y = fits[0]  # the largest
            n = left[x] // 2 if y == x else min(left[x], left[y])
            opened.add((y, 1, (x, 1, None)), capacity - x - y, n)
            left[x] -= n
            left[y] -= n
    for x in sorted((x for x in left if left[x] and 3 * x <= capacity), reverse=True):
        n = left[x]
        while n:
            inside, gap, count = opened.smallest(x) or (None, capacity, -(-n // (capacity // x)))
            each = gap // x
            full = min(count, n // each)
            opened.add((x, each, inside), gap - each * x, full)
            n -= full * each
            if full < count:  # then fewer than `each` are left
                if n:
                    opened.add((x, n, inside), gap - n * x, 1)
                if inside is not None:
                    opened.add(inside, gap, count - full - (n > 0))
                n = 0
    runs, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in opened.gaps:
        for inside, count in opened.by_gap[gap]:
            chain, offset = [], 0
            while inside:
                x, each, inside = inside
                chain.append((x, each))
            for x, each in reversed(chain):
                for _ in range(each):
                    runs.append((x, rank[x], count, sequence, offset))
                    rank[x] += count
                    offset += x
            sequence += count
    return runs


def ranked(cut: DataFrame) -> DataFrame:
    """`cut` with `rank`, from 0, among its rows of the same length; `cut` is a stored table."""
    salts = max(16, cut.count() // ROWS_PER_SALT)
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    salted = cut.withColumn("_s", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    inner = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "length").orderBy(*order)) - 1)
    before = Window.partitionBy("length").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_s").count().select("length", "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_b"))
    return inner.join(bases, ["_s", "length"]).withColumn("rank", F.col("_b") + F.col("_r")).drop("_s", "_r", "_b")


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of `df` (doc_id, text)."""
    cut = stored(pieces(df, capacity), "packing-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan(counts, capacity)) or np.zeros((0, 5)), dtype=np.int64)
    key = runs[:, 0] << 44 | runs[:, 1]
    rows = ranked(cut).select(*cut.columns, "rank")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.names.index
            length, rank = (b.column(at(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [f.name for f in schema])

    return rows.mapInArrow(batches, schema)
