"""Similarity joins of distributed tables of vectors, and a stored index for approximate ones.

Both sides of a join are dealt to cells: a cell holds a block of one side, of at most HELD_BYTES and HELD_ROWS, and the other side streams past it.  Nothing
goes through the driver but counts and, for links, PIVOTS vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normwerk.operators.archetypes import clusters
from normwerk.sources.shared import new_path, stored

#: Of the block that a cell holds; rows that stream past it before there is another cell; tasks of a join.
HELD_BYTES, HELD_ROWS, STREAMED, TASKS = 32 << 20, 4096, 1 << 18, 4096
#: Most rows that a join of links takes for pivots.
PIVOTS = 256
_AT_ONCE = 1024


def units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors of one length: a matrix of unit rows, and which have a direction (finite, and not zero)."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    ok = np.isfinite(rows).all(1)
    norms = np.linalg.norm(np.where(ok[:, None], rows, 0), axis=1)
    return np.where(ok[:, None], rows, 0) / np.maximum(norms, 1e-300)[:, None], ok & (norms > 0)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if len(keys[0]) else []
    cuts = [0, *np.asarray(changes).tolist(), len(keys[0])]
    return [(a, e) for a, e in zip(cuts, cuts[1:], strict=False) if e > a]


class Cell(Protocol):
    def hold(self, part: pa.RecordBatch) -> None: ...

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def end(self) -> Iterator[pa.RecordBatch]: ...


def joined(rows: DataFrame, cells: int, make: Callable[[], Cell], schema: str) -> DataFrame:
    """`rows` (cell, side, ...) through one `make()` a cell: those of side 0 are held, the others streamed."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for b in it:
            cell, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "side"))
            for a, e in _runs(cell, side):
                if cell[a] != now:
                    if state:
                        yield from state.end()
                    state, now = make(), cell[a]
                part = b.slice(a, e - a)
                if side[a]:
                    yield from state.meet(part)
                else:
                    state.hold(part)
        if state:
            yield from state.end()

    n = max(1, min(cells, TASKS))
    return rows.repartitionById(n, F.pmod("cell", F.lit(n).cast("long")).cast("int")).sortWithinPartitions("cell", "side").mapInArrow(batches, schema)


def _held_rows(width: int) -> int:
    return max(1, min(HELD_ROWS, HELD_BYTES // (8 * max(1, width))))


# --- nearest --------------------------------------------------------------------------------------


class _Nearest:
    """The k most similar rows for each held one, among those of its length and group."""

    def __init__(self, k: int, threshold: float | None):
        self.k, self.threshold = k, threshold
        self.parts: list[pa.RecordBatch] = []
        self.found = [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)]  # held row, similarity, id
        self.of: dict | None = None

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    @staticmethod
    def _by_kind(part: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
        """(length and group), rows, ids and unit vectors."""
        length = part.column("length").to_numpy(zero_copy_only=False)
        kinds = list(zip(length.tolist(), part.column("g").to_pylist(), strict=True))
        number = {x: i for i, x in enumerate(dict.fromkeys(kinds))}
        which = np.array([number[x] for x in kinds])
        for x, i in number.items():
            at = np.flatnonzero(which == i)
            unit, ok = units(part.column("v").take(pa.array(at)))
            yield x, at[ok], part.column("id").to_numpy(zero_copy_only=False)[at[ok]], unit[ok]

    def _ready(self) -> None:
        self.of, self.ids = {}, np.zeros(0, dtype=np.int64)
        if self.parts:
            held = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
            self.ids = held.column("id").to_numpy(zero_copy_only=False)
            self.of = {x: (at, unit) for x, at, _, unit in self._by_kind(held)}
        self.parts, self.least = [], np.full(len(self.ids), -np.inf)

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.of is None:
            self._ready()
        for x, _, ids, unit in self._by_kind(part):
            if x not in self.of:
                continue
            at, held = self.of[x]
            for i in range(0, len(ids), _AT_ONCE):
                sim = np.round(held @ unit[i : i + _AT_ONCE].T, 12)  # products of equal vectors differ in their last bits
                near = sim >= self.least[at][:, None]
                if self.threshold is not None:
                    near &= sim >= self.threshold
                q, r = np.nonzero(near)
                new = (at[q], sim[q, r], ids[i : i + _AT_ONCE][r])
                self.found = [np.concatenate(p) for p in zip(self.found, new, strict=True)]
                self._cut()
        yield from ()

    def _cut(self) -> None:
        q, sim, ids = self.found
        order = np.lexsort((ids, -sim, q))
        q, sim, ids = q[order], sim[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.found = [q[keep], sim[keep], ids[keep]]
        full = place == self.k - 1
        self.least[q[full]] = sim[full]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.of is not None and len(self.found[0]):
            q, sim, ids = self.found
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(sim)], ["query_id", "id", "sim"])


def _side(df: DataFrame, id_col: str, group: str | None, kind: str) -> DataFrame:
    v = F.col("embedding").cast(kind)
    rows = df.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull()))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("length"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"))


def batch_vector_search(df: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, group: str | None = None) -> DataFrame:
    """query_id, id, sim, rank: for every row of `queries` (query_id, embedding) its k nearest rows of `df` (id, embedding), of at least the threshold.

    Cells are blocks of queries by parts of `df`; a cell keeps k rows a query, and these alone are shuffled again.  Vectors meet those of their length, and with
    `group` (a column of both) those of equal values; null, empty and zero ones, and those with components that are null or not finite, have no neighbours.  Query rows that repeat count once.
    """
    wide = any("double" in t.schema["embedding"].dataType.simpleString() for t in (df, queries))
    kind = "array<double>" if wide else "array<float>"
    q, rows = stored(_side(queries, "query_id", group, kind).distinct(), "similarity-queries"), _side(df, "id", group, kind)
    n, width = q.agg(F.count("*"), F.max("length")).first()
    blocks = max(1, -(-n // _held_rows(width or 1)))
    parts = max(1, -(-df.count() // STREAMED), -(-df.sparkSession.sparkContext.defaultParallelism // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    of = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n).cast("long"))
    asked = q.withColumn("block", of(blocks, "id", "v")).withColumn("part", every(parts)).withColumn("side", F.lit(0))
    met = rows.withColumn("part", of(parts, "id", "v")).withColumn("block", every(blocks)).withColumn("side", F.lit(1))
    both = asked.unionByName(met).withColumn("cell", F.col("block") * parts + F.col("part")).drop("block", "part")
    found = joined(both, blocks * parts, lambda: _Nearest(k, threshold), "query_id long, id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- links ----------------------------------------------------------------------------------------


def _reached(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows and columns that a matrix of links joins: a component's number for each row and column (-1: no link)."""
    rows, columns = (np.full(n, -1, dtype=np.int64) for n in near.shape)
    for start in np.flatnonzero(near.any(1)):
        if rows[start] >= 0:
            continue
        new = np.array([start])
        while len(new):
            rows[new] = start
            reached = near[new].any(0) & (columns < 0)
            columns[reached] = start
            new = np.flatnonzero(near[:, reached].any(1) & (rows < 0)) if reached.any() else new[:0]
    return rows, columns


class _Links:
    """Links between what is held and what streams past, and among what is held: enough to make their components, and no more than a few for each row."""

    def __init__(self, threshold: float):
        self.threshold, self.parts = threshold, []
        self.unit: np.ndarray | None = None

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _ready(self) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0] if self.parts else None
        self.ids = held.column("id").to_numpy() if held else np.zeros(0, dtype=np.int64)
        self.unit, self.parts = (units(held.column("v"))[0] if held else np.zeros((0, 1))), []
        self.label = np.arange(len(self.ids))  # of components found so far
        for i in range(0, len(self.ids), _AT_ONCE):
            yield from self._met(self.ids[i : i + _AT_ONCE], self.unit[i : i + _AT_ONCE])

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.unit is None:
            yield from self._ready()
        if not len(self.ids):
            return
        for i in range(0, part.num_rows, _AT_ONCE):
            some = part.slice(i, _AT_ONCE)
            yield from self._met(some.column("id").to_numpy(), units(some.column("v"))[0])

    def _met(self, ids: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, column = _reached(np.round(unit @ self.unit.T, 12) >= self.threshold)
        a, b = [], []
        for c in np.unique(column[column >= 0]).tolist():
            at = np.flatnonzero(column == c)
            labels = np.unique(self.label[at])
            if len(labels) > 1:  # components that were apart so far
                a.append(self.ids[labels[1:]])
                b.append(np.full(len(labels) - 1, self.ids[labels[0]]))
                self.label[np.isin(self.label, labels)] = labels[0]
            mine = ids[row == c]
            a.append(mine)
            b.append(np.full(len(mine), self.ids[at[0]]))
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], ["a", "b"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.unit is None:
            yield from self._ready()


def _places(lists: pa.Array, length: np.ndarray, pivots: list[np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own): its nearest pivot's cell, and those of earlier pivots that lie less than 2 `reach` further off."""
    rows, cells, own = [], [], []
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        mine = [i for i, p in enumerate(pivots) if len(p) == n]
        if not mine:  # no pivot of this length: a cell of their own
            rows.append(at)
            cells.append(np.full(len(at), len(pivots) + n))
            own.append(np.ones(len(at), dtype=bool))
            continue
        unit, _ = units(lists.take(pa.array(at)))
        angle = np.arccos(np.clip(unit @ np.array([pivots[i] for i in mine]).T, -1, 1))
        home = angle.argmin(1)
        least = angle[np.arange(len(at)), home]
        close = (angle - least[:, None] <= 2 * reach + 1e-6) & (np.arange(len(mine)) <= home[:, None])
        r, c = np.nonzero(close)
        rows.append(at[r])
        cells.append(np.array(mine)[c])
        own.append(c == home[r])
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, cells, own))


def _directed(df: DataFrame) -> DataFrame:
    """Rows of `df` (id, embedding) whose vector has a direction."""
    good = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("embedding", lambda e: e != 0)
    return df.filter(F.coalesce(good, F.lit(False)))


def _distinct(df: DataFrame) -> DataFrame:
    """id (the least), v, length, w (how many) of each distinct vector, stored."""
    return stored(df.groupBy("embedding").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("w")).select("id", F.col("embedding").alias("v"), F.size("embedding").alias("length"), "w"), "distinct-vectors")


def _near_cells(rows: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """Cells (cell, side, id, v, w) in which each pair of `rows` (id, v, length, w; stored) of at least the threshold comes together once, and how many cells there are.

    Rows go to the cell of their nearest pivot (of at most PIVOTS, those with the smallest hashes) and to those cells in which, by the triangle
    inequality of angles, a partner can lie; vectors in groups meet few others, and at worst, with a low threshold, every row meets all.  A cell's own rows are held in blocks, so
    one that a third of all rows are in is many tasks.
    """
    n, width = rows.agg(F.count("*"), F.max("length")).first()
    held = _held_rows(width)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, -(-n // held)))).select("v").collect()  # bounded by PIVOTS
    pivots = [np.array(r["v"], dtype=np.float64) / np.linalg.norm(np.array(r["v"], dtype=np.float64)) for r in chosen]
    reach = math.acos(max(-1.0, min(1.0, threshold)))

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            _, cell, own = _places(b.column("v"), b.column("length").to_numpy(), pivots, reach)
            numbers, count = np.unique(cell[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(count)], ["cell", "n"])

    own_rows = rows.select("v", "length").mapInArrow(placed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row for each cell
    first, blocks, total = {}, {}, 0
    for r in own_rows:
        first[r["cell"]], blocks[r["cell"]] = total, -(-r["n"] // held)
        total += blocks[r["cell"]]

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column("id").to_numpy()
            row, cell, own = _places(b.column("v"), b.column("length").to_numpy(), pivots, reach)
            n = np.array([blocks.get(c, 0) for c in cell.tolist()], dtype=np.int64)  # a cell without rows of its own has none
            start = np.array([first.get(c, 0) for c in cell.tolist()], dtype=np.int64)
            block = ((ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)
            n = np.where(own, block + 1, n)  # own rows meet the blocks up to theirs
            which = np.repeat(np.arange(len(row)), n)
            j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            side = np.where(own[which] & (j == block[which]), 0, 1)
            for i in range(0, len(which), 4096):
                some = slice(i, i + 4096)
                taken = pa.array(row[which[some]])
                yield pa.RecordBatch.from_arrays([pa.array((start[which] + j)[some]), pa.array(side[some].astype(np.int32)), *(b.column(c).take(taken) for c in ("id", "v", "w"))], ["cell", "side", "id", "v", "w"])

    return rows.mapInArrow(dealt, f"cell long, side int, id long, v {rows.schema['v'].dataType.simpleString()}, w long"), total


def similarity_links(df: DataFrame, threshold: float) -> DataFrame:
    """a, b: links among the rows of `df` (id, embedding), enough of them to make all components of pairs of at least the threshold.

    Equal vectors are one row first; see `_near_cells` for what is compared.
    """
    kept = _directed(df)
    rows = _distinct(kept)
    copies = kept.join(rows.select(F.col("id").alias("_first"), F.col("v").alias("embedding")), "embedding").filter("id <> _first").select(F.col("id").cast("long").alias("a"), F.col("_first").alias("b"))
    if rows.isEmpty():
        return copies
    cells, n = _near_cells(rows, threshold)
    return joined(cells, n, lambda: _Links(threshold), "a long, b long").unionByName(copies).distinct()


class _Counts:
    """How many rows of at least the threshold each row has, copies counted: for what is held among itself and for both sides of what streams past."""

    def __init__(self, threshold: float):
        self.threshold, self.parts = threshold, []
        self.unit: np.ndarray | None = None

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _near(self, unit: np.ndarray) -> np.ndarray:
        return (np.round(unit @ self.unit.T, 12) >= self.threshold).astype(np.int64)

    def _ready(self) -> None:
        held = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0] if self.parts else None
        self.ids, self.w = (held.column(c).to_numpy() if held else np.zeros(0, dtype=np.int64) for c in ("id", "w"))
        self.unit, self.parts = (units(held.column("v"))[0] if held else np.zeros((0, 1))), []
        self.n = np.concatenate([self._near(self.unit[i : i + _AT_ONCE]) @ self.w for i in range(0, len(self.ids), _AT_ONCE)] or [self.w])

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.unit is None:
            self._ready()
        for i in range(0, part.num_rows if len(self.ids) else 0, _AT_ONCE):
            some = part.slice(i, _AT_ONCE)
            near = self._near(units(some.column("v"))[0])
            self.n += some.column("w").to_numpy() @ near
            yield self._batch(some.column("id").to_numpy(), near @ self.w)

    @staticmethod
    def _batch(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["id", "n"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.unit is None:
            self._ready()
        yield self._batch(self.ids, self.n)


def neighbour_counts(df: DataFrame, threshold: float) -> DataFrame:
    """id, n: how many rows of `df` (id, embedding) are at least so similar, itself among them; rows without a direction are left out.

    A pair is compared once and counts for both; vectors with copies count as often as there are such.
    """
    kept = _directed(df)
    rows = _distinct(kept)
    if rows.isEmpty():
        return kept.select(F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("n"))
    cells, cell_count = _near_cells(rows, threshold)
    n = joined(cells, cell_count, lambda: _Counts(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    of = rows.join(n, "id").select(F.col("v").alias("embedding"), "n")
    return kept.join(of, "embedding").select(F.col("id").cast("long").alias("id"), "n")


def density_clusters(df: DataFrame, threshold: float, least: int = 3) -> DataFrame:
    """id, cluster, core of every row of `df` (id, embedding; distinct ids).

    A core row has at least `least` rows of at least the threshold, itself among them.  Core rows that are so similar are of one cluster, named by its smallest id; other rows belong to the cluster of their most
    similar core row, of equal ones that with the smallest id, if there is one so similar, and to none (null) otherwise.  So clusters join only where rows lie densely, and not by a chain of single ones.
    """
    rows = df.select(F.col("id").cast("long").alias("id"), "embedding")
    counted = stored(rows.join(neighbour_counts(rows, threshold).filter(F.col("n") >= least), "id", "left").select("id", "embedding", F.col("n").isNotNull().alias("core")), "density")
    core = counted.filter("core").select("id", "embedding")
    of = stored(clusters(similarity_links(core, threshold), core), "density-clusters")
    near = batch_vector_search(core, counted.filter(~F.col("core")).select(F.col("id").alias("query_id"), "embedding"), 1, threshold)
    border = near.join(of, "id").select(F.col("query_id").alias("id"), "cluster")
    return counted.select("id", "core").join(of.unionByName(border), "id", "left").select("id", "cluster", "core")


# --- approximate ----------------------------------------------------------------------------------


@dataclass
class HyperplaneIndex:
    """Buckets of vectors by the sides of `bits` random planes on which they lie, in `tables` tables; `vectors` (id, v) and `buckets` (t, bucket, id) are stored, and rows are added by `add`."""

    spark: SparkSession
    path: str
    width: int
    bits: int
    tables: int
    seed: int

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>").parquet(f"{self.path}/vectors")

    def buckets(self) -> DataFrame:
        return self.spark.read.schema("bucket long, id long, t int").parquet(f"{self.path}/buckets")

    def add(self, df: DataFrame) -> None:
        """The rows of `df` (id, embedding) of the index's length; ids that aren't in it yet."""
        rows = _side(df, "id", None, "array<double>").filter(F.col("length") == self.width).select("id", "v")
        rows.write.mode("append").parquet(f"{self.path}/vectors")
        self.signed(rows, probes=False).write.mode("append").partitionBy("t").parquet(f"{self.path}/buckets")

    def signed(self, rows: DataFrame, probes: bool) -> DataFrame:
        """bucket, id, t: each row's bucket in every table, and with `probes` those across one plane; rows without a direction have none."""
        bits, tables, width, seed = self.bits, self.tables, self.width, self.seed

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.random.default_rng(seed).normal(size=(width, tables * bits))
            powers = 1 << np.arange(bits, dtype=np.int64)
            for b in it:
                unit, ok = units(b.column("v"))
                ids = b.column("id").to_numpy()[ok]
                home = ((unit[ok] @ planes > 0).reshape(len(ids), tables, bits) * powers).sum(2)
                every = np.concatenate([home[:, :, None], home[:, :, None] ^ powers], axis=2) if probes else home[:, :, None]
                n = every.shape[2]
                yield pa.RecordBatch.from_arrays([pa.array(every.ravel()), pa.array(np.repeat(ids, tables * n)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), n), len(ids)))], ["bucket", "id", "t"])

        return rows.mapInArrow(batches, "bucket long, id long, t int")


def hyperplane_index(df: DataFrame, tables: int = 10, a_bucket: int = 64, bits: int | None = None, seed: int = 17, path: str | None = None) -> HyperplaneIndex:
    """An index of the vectors of `df` (id, embedding; those of the longest length) with about `a_bucket` vectors a bucket if they lie evenly."""
    n, width = df.agg(F.count("embedding"), F.max(F.size("embedding"))).first()
    index = HyperplaneIndex(df.sparkSession, path or new_path(df.sparkSession, "hyperplanes"), max(1, width or 1), bits or min(62, max(3, math.ceil(math.log2(max(1, n / a_bucket))))), tables, seed)
    index.add(df)
    return index


def _cosines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            x, y = units(b.column("v"))[0], units(b.column("_v"))[0]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(np.round((x * y).sum(1), 12))], ["query_id", "id", "sim"])


def approximate_vector_search(index: HyperplaneIndex, queries: DataFrame, k: int = 5, floor: float = 0.8, hot: int = 4096) -> DataFrame:
    """query_id, id, sim, rank: as `batch_vector_search` over the index's vectors, most of it without looking at them all.

    A query (query_id, embedding) meets the vectors of its own buckets and of those across one plane.  If it has k results of at least `floor` so, they are taken: with the default of ten tables and ten bits
    a neighbour of 0.8 is missed once in a hundred times, nearer ones more rarely.  The others, and queries that meet a bucket of more than `hot` vectors, are searched exactly.
    """
    asked = stored(_side(queries, "query_id", None, "array<double>").filter(F.col("length") == index.width).select("id", "v").distinct(), "asked")
    probes = stored(index.signed(asked, probes=True).withColumnRenamed("id", "query_id"), "probes")
    large = index.buckets().groupBy("t", "bucket").count().filter(F.col("count") > hot).select("t", "bucket")
    exact = stored(probes.join(large, ["t", "bucket"], "left_semi").select("query_id").distinct(), "asked-exactly")
    pairs = probes.join(exact, "query_id", "left_anti").join(index.buckets(), ["t", "bucket"]).select("query_id", "id").distinct()
    sides = pairs.join(index.vectors(), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("_v")), "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    found = sides.select("query_id", "id", "v", "_v").mapInArrow(_cosines, "query_id long, id long, sim double").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    found = stored(found, "found-near")
    certain = found.filter((F.col("rank") == k) & (F.col("sim") >= floor)).select("query_id")
    rest = asked.select(F.col("id").alias("query_id"), F.col("v").alias("embedding")).join(certain, "query_id", "left_anti")
    others = batch_vector_search(index.vectors().withColumnRenamed("v", "embedding"), rest, k)
    return found.join(certain, "query_id", "left_semi").unionByName(others)
