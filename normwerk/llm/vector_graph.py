"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards of about SHARD_ROWS by their hash, so copies of one vector, however many, are one node and no shard is hot.
Each shard's graph is built where its vectors are: levels are drawn from the hash; a level's nodes, those of higher levels first, are inserted in
batches.  A batch is searched in the graph so far, from the place where the descent through the finished levels above ends, and among itself;
each node is linked to the nearest that aren't nearer to a neighbour it already has, and back.  The graph is stored as a table of flat neighbour
arrays, a row for each node.  A search descends by the nearest node of each level and widens to a beam of EF on the last; the shards' best are
scored again in double precision and merged.

Vectors get one more component that makes all of a shard equally long; the largest inner product is then the least angle, for which such graphs are made.

Memory: a shard's vectors and neighbours (a few hundred bytes a node), and one batch of queries.  Queries meet every shard; more than QUERIES_A_TASK of
them read a shard's graph in several tasks.  A vector's copies count through their k + 1 smallest ids, found where they are read; no others can be among k results.

Defined results: vectors that are null, empty, zero or hold a null or a component that isn't finite take no part, nor do rows without id.  Vectors
meet those of their own length only.  Rows that repeat id and vector count once; an id with several vectors is a query for each.  Ties go to the smaller id.
Scores are sums of products in the order of the components, so equal vectors score equally.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normwerk.llm.common import row_key, stored

SHARD_ROWS = 8192
DEGREE = 16  # links that a new node gets; twice as many may end at a node of the last level
EF_BUILD = 64
EF = 112
QUERIES_A_TASK = 1 << 16
#: Queries, or new nodes, whose beams move together, and nodes that each expands at once.
BATCH, WIDTH = 256, 16
_ORDINARY = 1 << 24  # levels are drawn from so many values


# --- one shard ------------------------------------------------------------------------------------


def _nearness(x: np.ndarray, ids: np.ndarray, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[ids], q[rows])


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, nearness) of the `ef` nearest nodes found for each row of `q`, nearest first; -1 and -inf where there are fewer.

    All rows move together: each expands its nearest nodes that aren't expanded, until none in its beam is left.
    """
    n, width = len(q), links.shape[1]
    ids, near = np.full((n, ef), -1, dtype=np.int32), np.full((n, ef), -np.inf, dtype=np.float32)
    open_ = np.zeros((n, ef), dtype=bool)
    seen = np.zeros((n, len(x)), dtype=bool)
    every = np.arange(n)
    ids[:, 0], near[:, 0], open_[:, 0] = entry, _nearness(x, entry, q, every), True
    seen[every, entry] = True
    active = every
    while len(active):
        w = min(WIDTH, ef)
        some = open_[active]
        rank = np.where(some, np.cumsum(some, axis=1), ef + 1)
        now = rank <= w
        row, column = np.nonzero(now)
        node = ids[active[row], column]
        open_[active[row], column] = False
        row = active[row]
        found, of = links[node].ravel(), np.repeat(row, width)
        ok = found >= 0
        found, of = found[ok], of[ok]
        new = ~seen[of, found]
        found, of = found[new], of[new]
        if len(found):  # two expanded nodes can have one neighbour
            code = np.unique(of.astype(np.int64) * len(x) + found)
            of, found = (code // len(x)).astype(np.int64), (code % len(x)).astype(np.int32)
            seen[of, found] = True
            s = _nearness(x, found, q, of)
            ok = s > near[of, -1]
            of, found, s = of[ok], found[ok], s[ok]
        if len(found):
            rows, first, count = np.unique(of, return_index=True, return_counts=True)
            place = np.arange(len(of)) - np.repeat(first, count)
            at = np.repeat(np.arange(len(rows)), count)
            more = count.max()
            all_near = np.concatenate([near[rows], np.full((len(rows), more), -np.inf, dtype=np.float32)], axis=1)
            all_ids = np.concatenate([ids[rows], np.full((len(rows), more), -1, dtype=np.int32)], axis=1)
            all_open = np.concatenate([open_[rows], np.zeros((len(rows), more), dtype=bool)], axis=1)
            all_near[at, ef + place], all_ids[at, ef + place], all_open[at, ef + place] = s, found, True
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :ef]
            ids[rows], near[rows], open_[rows] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_near, all_open))
        active = active[open_[active].any(1)]
    return ids, near


def _chosen(x: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first (-1: none): those that aren't nearer to one already chosen, then the nearest of the rest; -1 for places left."""
    n, width = ids.shape
    v = x[ids]
    between = v @ v.transpose(0, 2, 1)
    valid = ids >= 0
    blocked, taken = ~valid, np.zeros((n, width), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    for j in range(width):
        take = ~blocked[:, j] & (count < most)
        taken[:, j] = take
        count += take
        blocked |= take[:, None] & (between[:, j] > near)
    order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - width))), constant_values=-1)


def _linked_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen neighbours to the new nodes; a full node chooses anew among all."""
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    width = links.shape[1]
    for some in np.array_split(np.arange(len(nodes)), -(-len(nodes) // 512)):
        all_ids = np.full((len(some), width + count[some].max()), -1, dtype=np.int32)
        all_ids[:, :width] = links[nodes[some]]
        at = np.repeat(np.arange(len(some)), count[some])
        place = np.arange(len(at)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        all_ids[at, width + place] = source[np.repeat(first[some], count[some]) + place]
        added = all_ids[:, width:]
        added[(added[:, :, None] == all_ids[:, None, :width]).any(2)] = -1  # of one batch, two can choose each other
        near = np.where(all_ids >= 0, np.einsum("ijk,ik->ij", x[all_ids], x[nodes[some]]), -np.inf).astype(np.float32)
        order = np.argsort(-near, axis=1, kind="stable")[:, : 2 * width]
        links[nodes[some]] = _chosen(x, np.take_along_axis(all_ids, order, 1), np.take_along_axis(near, order, 1), width)


def _inserted(x: np.ndarray, members: np.ndarray, entry: np.ndarray, width: int) -> np.ndarray:
    """The links of one level (rows of nodes not among `members` stay empty); entry: for each member, one to start from if it is there by then, or -1."""
    links = np.full((len(x), width), -1, dtype=np.int32)
    there = np.zeros(len(x) + 1, dtype=bool)
    at = 0
    while at < len(members):
        some = members[at : at + min(BATCH, max(DEGREE, at // 2))]
        near_own = x[some] @ x[some].T
        np.fill_diagonal(near_own, -np.inf)
        ids, near = np.broadcast_to(some, near_own.shape).astype(np.int32), near_own.astype(np.float32)
        if at:
            start = entry[at : at + len(some)]
            old_ids, old_near = beam(x, links, x[some], np.where(there[start], start, members[0]), EF_BUILD)
            ids, near = np.concatenate([old_ids, ids], axis=1), np.concatenate([old_near, near], axis=1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :EF_BUILD]
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        chosen = _chosen(x, np.where(np.isfinite(near), ids, -1), near, DEGREE)
        links[some, :DEGREE] = chosen
        _linked_back(x, links, some, chosen)
        there[some] = True
        at += len(some)
    return links


@dataclass
class Graph:
    """vectors (with the added component); per level, last first, a row of links for each node; the node to start from."""

    x: np.ndarray
    levels: list[np.ndarray]
    top: int

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The nearest nodes found on the level above `to`."""
        at = np.full(len(q), self.top, dtype=np.int64)
        for links in reversed(self.levels[to + 1 :]):
            at = beam(self.x, links, q, at, 1)[0][:, 0].astype(np.int64)
        return at

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.concatenate([q.astype(np.float32), np.zeros((len(q), 1), dtype=np.float32)], axis=1)
        return beam(self.x, self.levels[0], q, self.descend(q, 0), ef)


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Scaled to a length of at most 1, and to exactly 1 by one more component."""
    v = vectors / np.abs(vectors).max()
    v = v / np.linalg.norm(v, axis=1).max()
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], axis=1).astype(np.float32)


def build(vectors: np.ndarray, level: np.ndarray) -> Graph:
    """level: the highest of each node."""
    x = lengthened(vectors)
    order = np.argsort(-level, kind="stable")
    graph = Graph(x, [], int(order[0]))
    by_level: list[np.ndarray] = []
    for k in range(int(level.max()), -1, -1):
        members = order[level[order] >= k]
        entry = np.full(len(members), -1, dtype=np.int64)
        if by_level:
            graph.levels = [by_level[0], *reversed(by_level)]  # the first stands for the level that is being built
            for a in range(0, len(members), BATCH):
                entry[a : a + BATCH] = graph.descend(x[members[a : a + BATCH]], 0)
            entry[level[members] > k] = -1  # they come first, and may come before what they would start from
        by_level.append(_inserted(x, members, entry, 2 * DEGREE if not k else DEGREE))
    graph.levels = by_level[::-1]
    return graph


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in the order of the components."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j].astype(np.float64) * y[:, j]
    return out


# --- tables ---------------------------------------------------------------------------------------


def _taking_part(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v, _k1, _k2 (of v)."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.exists("v", lambda e: e != 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.withColumn("v", F.transform("v", lambda e: e + 0.0)).select("id", "v", *row_key("v"))  # no negative zeros


def nodes_of(df: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """_k1, _k2, vector (doubles), ids (the k + 1 smallest, ascending): a row for each distinct vector that takes part."""
    rows = _taking_part(df, vec_id, vector)
    # the window's limit is applied before the shuffle too, so a vector of many copies moves k + 1 of them a task
    first = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("id")) <= k + 1
    ids = rows.select("id", "_k1", "_k2").distinct().withColumn("_few", first).filter("_few").groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows.groupBy("_k1", "_k2").agg(F.first("v").alias("vector")).join(ids, ["_k1", "_k2"])


_NODE = "_k1 long, _k2 long, shard long, pos int, level int, vector array<double>, ids array<long>, links array<int>"


def _matrix(c: pa.Array) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches ordered by shard: a table for each shard."""
    held: list[pa.RecordBatch] = []
    for b in it:
        shard = b.column("shard").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, e in zip(cuts, cuts[1:], strict=False):
            if held and e > a and held[0].column("shard")[0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            if e > a:
                held.append(b.slice(a, e - a))
    if held:
        yield pa.Table.from_batches(held)


def _built(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _by_shard(it):
        t = t.combine_chunks()
        draw = ((t.column("_k2").to_numpy() % _ORDINARY) + 0.5) / _ORDINARY
        level = np.floor(-np.log(draw) / np.log(DEGREE)).astype(np.int64)
        graph = build(_matrix(t.column("vector").combine_chunks()), level)
        lists = [np.concatenate([graph.levels[k][i] for k in range(level[i] + 1)]) for i in range(len(level))]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        links = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
        t = t.append_column("pos", pa.array(np.arange(len(level), dtype=np.int32))).append_column("level", pa.array(level.astype(np.int32))).append_column("links", links)
        yield from t.select([c.split()[0] for c in _NODE.split(", ")]).to_batches(2048)


def index(nodes: DataFrame) -> DataFrame:
    """The stored graph of `nodes` (as from `nodes_of`): a row for each, with its place and its links on each level, the last level first, in one flat array."""
    nodes = stored(nodes, "graph-nodes")
    shards, n = {}, 0
    for r in nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # a row for each length of vectors
        shards[r["d"]] = (n, -(-r["n"] // SHARD_ROWS))
        n += shards[r["d"]][1]
    first, of = _of_length(shards)
    dealt = nodes.withColumn("shard", first + F.pmod("_k1", of))
    return stored(dealt.repartitionById(max(1, n), F.col("shard").cast("int")).sortWithinPartitions("shard", "_k1", "_k2").mapInArrow(_built, _NODE), "graph")


def _of_length(shards: dict[int, tuple[int, int]], vector: str = "vector") -> tuple[Column, Column]:
    """The first shard of a vector's length, and how many there are; null for other lengths."""
    each = [F.create_map(*[F.lit(x).cast("long") for d, v in shards.items() for x in (d, v[i])]) if shards else F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long")) for i in (0, 1)]
    return tuple(F.try_element_at(m, F.size(vector).cast("long")) for m in each)


def _loaded(t: pa.Table) -> tuple[Graph, np.ndarray, list, list[np.ndarray]]:
    t = t.combine_chunks()
    vectors, level = _matrix(t.column("vector").combine_chunks()), t.column("level").to_numpy()
    links = t.column("links").combine_chunks()
    flat, starts = links.values.to_numpy(), links.offsets.to_numpy()
    levels = []
    for k in range(int(level.max()) + 1):
        width, at = (2 * DEGREE, 0) if not k else (DEGREE, 2 * DEGREE + (k - 1) * DEGREE)
        table = np.full((len(level), width), -1, dtype=np.int32)
        some = np.flatnonzero(level >= k)
        table[some] = flat[starts[:-1][some][:, None] + at + np.arange(width)]
        levels.append(table)
    return Graph(lengthened(vectors), levels, int(level.argmax())), vectors, t.column("ids").to_pylist(), [t.column(c).to_numpy() for c in ("_k1", "_k2")]


_FOUND = "_q1 long, _q2 long, own boolean, ids array<long>, score double"


def nearest(graph: DataFrame, queries: DataFrame, k: int, ef: int = EF) -> DataFrame:
    """_q1, _q2, own, ids, score: for each row of `queries` (_k1, _k2, vector; distinct) the best nodes of each shard, enough for k results beside the query's own row.

    own: the node is the query's vector itself.
    """
    layout = graph.groupBy(F.size("vector").alias("d")).agg(F.min("shard").alias("a"), F.max("shard").alias("b")).collect()  # a row for each length
    shards = {r["d"]: (r["a"], r["b"] - r["a"] + 1) for r in layout}
    n, blocks = max([1, *(a + m for a, m in shards.values())]), max(1, -(-queries.count() // QUERIES_A_TASK))
    first, of = _of_length(shards)
    asked = queries.withColumn("block", F.pmod("_k2", F.lit(blocks).cast("long"))).withColumn("shard", F.explode(F.sequence(first, first + of - 1)))
    columns = ["shard", "block", "asked", "pos", "_k1", "_k2", "vector", "ids", "level", "links"]
    none = {"pos": "int", "ids": "array<long>", "level": "int", "links": "array<int>"}
    right = asked.select("shard", "block", F.lit(True).alias("asked"), "_k1", "_k2", "vector", *[F.lit(None).cast(v).alias(c) for c, v in none.items()]).select(columns)
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).withColumn("asked", F.lit(False)).select(columns)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ordered by shard and block: the graph's rows, then the queries'."""
        key, held, ready = None, [], None
        for b in it:
            place = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "block", "asked")])
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0).any(0)) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:], strict=False):
                if e == a:
                    continue
                if key != tuple(place[:2, a]):
                    key, held, ready = tuple(place[:2, a]), [], None
                some = b.slice(a, e - a)
                if not place[2, a]:
                    held.append(some)
                    continue
                if ready is None:
                    ready, held = _loaded(pa.Table.from_batches(held)), []
                g, vectors, ids, keys = ready
                for at in range(0, some.num_rows, BATCH):
                    part = some.slice(at, BATCH)
                    q = _matrix(part.column("vector"))
                    k1, k2 = (part.column(c).to_numpy() for c in ("_k1", "_k2"))
                    found, _ = g.search(q / np.abs(q).max(1)[:, None], max(ef, k + 1))
                    row, column = np.nonzero(found >= 0)
                    node = found[row, column]
                    score = exact(q[row], vectors[node])
                    order = np.lexsort((np.array([ids[i][0] for i in node.tolist()]), -score, row))
                    row, node, score = row[order], node[order], score[order]
                    place_of = np.arange(len(row)) - np.searchsorted(row, row)
                    keep = place_of <= k
                    row, node, score = row[keep], node[keep], score[keep]
                    own = (k1[row] == keys[0][node]) & (k2[row] == keys[1][node])
                    yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(own), pa.array([ids[i] for i in node.tolist()], pa.list_(pa.int64())), pa.array(score)], ["_q1", "_q2", "own", "ids", "score"])

    task = (F.col("shard") * blocks + F.col("block")).cast("int")
    return left.unionByName(right).repartitionById(n * blocks, task).sortWithinPartitions("shard", "block", "asked", "pos").mapInArrow(batches, _FOUND)


def search(df: DataFrame, queries: DataFrame, k: int, ef: int = EF, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row of `queries` its k nearest rows of `df`, itself excepted; both have `vec_id` and `vector`."""
    graph = index(nodes_of(df, k, vec_id, vector))
    rows = _taking_part(queries, vec_id, vector)
    asked = stored(rows.groupBy("_k1", "_k2").agg(F.first("v").alias("vector")), "graph-queries")
    each = nearest(graph, asked, k, ef).select("_q1", "_q2", "own", "score", F.explode("ids").alias("vec_id"))
    # k + 1 of each distinct vector are enough for all its rows, as each leaves out itself only
    w = Window.partitionBy("_q1", "_q2").orderBy(F.desc("score"), "vec_id")
    best = stored(each.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).drop("_r"), "graph-found")
    ids = rows.select(F.col("id").alias("query_id"), F.col("_k1").alias("_q1"), F.col("_k2").alias("_q2")).distinct()
    pairs = ids.join(best, ["_q1", "_q2"]).filter("not (own and query_id = vec_id)")
    rank = F.row_number().over(Window.partitionBy("query_id", "_q1", "_q2").orderBy(F.desc("score"), "vec_id")).cast("int")
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
