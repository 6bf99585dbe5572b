"""Near copies: groups of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Texts that are equal after lower-casing and white space are one node.  Candidates come from SimHash by anchor-point covering first (see `simhash`), over the
same shingles: nodes whose fingerprints share a pair of anchors and differ in at most RADIUS bits.  No two within simhash.BITS bits are missed; beyond,
whether anchors are shared is a matter of chance (two texts at 0.8 are about 10 bits apart).  So what the anchors haven't brought together is searched by
minhash after them: BANDS keys of ROWS minima each, of which two texts at 0.8 share at least one with a chance of 0.998 (more above).  Candidates of both
are confirmed by their whole shingle sets; components of what is confirmed are the groups.

The nodes of a minhash key are not all compared with each other.  First, rows are range-partitioned and ordered by key and a hash that differs
from key to key, and each row is a candidate with the REACH rows of its key before it: a key that most rows have is spread over all tasks, and
in a large group each member meets others in each of its keys.  That is complete for keys of up to REACH + 1 nodes, and for larger ones
all of whose nodes have come together.  In the others, the nodes outside the key's largest component are then compared with all that
are in another component, in cells of at most CELL times CELL nodes.  So no candidate is left out, and a large group of near copies isn't squared.

Missed are links of pairs without a common key; README.md has the measured recall.  A text of fewer than WORDS words is one shingle; null and empty texts
are one node and have no other links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normwerk.llm.common import stored
from normwerk.llm.simhash import _LOWER, components, links, majority

WORDS = 5
SIMILAR = 0.8
RADIUS = 14
BANDS = 20
ROWS = 6
REACH = 4
CELL = 256
_CHUNK = 4096
_ODD = np.random.default_rng(8).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """The node (hash of the words, signed) and the ascending hashes of its shingles."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    node = int(np.uint64(digest(line, 7)).view(np.int64))
    if not words:
        return node, np.zeros(0, dtype=np.uint64)
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])
    n = max(1, len(words) - WORDS + 1)
    ends = starts[WORDS:] - 1 if len(words) > WORDS else [len(line)]
    return node, np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), list(ends), strict=True)], dtype=np.uint64))


def band_keys(h: np.ndarray) -> list[int]:
    if not len(h):
        return []
    least = np.min([(_ODD[:, None] * h[None, i : i + _CHUNK]).min(1) for i in range(0, len(h), _CHUNK)], axis=0)
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def nodes_of(df: DataFrame, text: str = "text", bands: bool = True) -> DataFrame:
    """`df` with `text` replaced by node, n (shingles), fp (SimHash of the shingles, signed) and keys, or without `bands` by node and set (the hashes as bytes)."""
    keep = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in keep]
    more = [T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))] if bands else [T.StructField("set", T.BinaryType())]
    schema = T.StructType([*keep, T.StructField("node", T.LongType()), *more])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.names.index
            of = [shingles(t) for t in b.column(at(text)).to_pylist()]
            nodes = pa.array([k for k, _ in of], pa.int64())
            if bands:
                keys = [np.array(band_keys(h), dtype=np.uint64).view(np.int64) for _, h in of]
                fp = np.array([majority(h) for _, h in of], dtype=np.uint64).view(np.int64)
                new = [pa.array([len(h) for _, h in of], pa.int32()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))]
            else:
                new = [pa.array([h.tobytes() for _, h in of], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(at(x)) for x in names], nodes, *new], schema.names)

    return df.mapInArrow(batches, schema)


def _near_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, root) ordered by key -> candidates a, b: rows of one key and two roots, at most REACH apart, whose sizes allow the similarity."""
    kept = [np.zeros(0, dtype=np.int64)] * 4
    for batch in it:
        key, node, n, root = cols = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
        a, b = [], []
        for d in range(1, REACH + 1):
            i = np.arange(max(len(kept[0]), d), len(key))
            x, y = n[i], n[i - d]
            i = i[(key[i] == key[i - d]) & (root[i] != root[i - d]) & (np.minimum(x, y) >= SIMILAR * np.maximum(x, y))]
            a.append(np.maximum(node[i], node[i - d]))
            b.append(np.minimum(node[i], node[i - d]))
        kept = [c[-REACH:] for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= SIMILAR * (len(x) + len(y) - common)


def _confirmed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        sets = ([np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in batch.column(i)] for i in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array([_similar(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))


def _cell(g: pd.DataFrame) -> pd.DataFrame:
    """Links between components, of some nodes outside a key's largest component and some of all; what has come together isn't compared again."""
    few, every = g[g["few"]], g[~g["few"]]
    root, n = every["root"].to_numpy().copy(), every["n"].to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in every["set"]]
    merged: dict[int, int] = {}
    found = []
    for r, k, s in zip(few["root"], few["n"], few["set"], strict=True):
        s = np.frombuffer(s, dtype=np.uint64)
        while r in merged:
            r = merged[r]
        for i in np.flatnonzero((np.minimum(n, k) >= SIMILAR * np.maximum(n, k)) & (root != r)).tolist():
            if root[i] != r and _similar(s, sets[i]):
                found.append((max(r, root[i]), min(r, root[i])))
                merged[int(root[i])] = r
                root[root == root[i]] = r
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _sets(texts: DataFrame, keys: list[str], nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set of the `wanted` nodes, from one text of each."""
    of = nodes.join(wanted, "node", "left_semi").select("_of.*")
    some = texts.join(of, keys, "left_semi").select("text")
    return nodes_of(some, bands=False).groupBy("node").agg(F.first("set").alias("set"))


def _anchor_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes of equal fingerprints, or of two that share a pair of anchors and differ in at most RADIUS bits."""
    some = nodes.filter("n > 0")
    prints = stored(some.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    equal = some.select("node", "fp").join(prints, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    first = lambda c: prints.select(F.col("fp").alias(f"_{c}"), F.col("first").alias(c))
    near = links(prints.select("fp"), RADIUS, direct=True).withColumnsRenamed({"a": "_a", "b": "_b"})
    return equal.unionByName(near.join(first("a"), "_a").join(first("b"), "_b").select("a", "b"))


def _links(texts: DataFrame, keys: list[str], nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of the `pairs` (a, b) of nodes whose whole sets are similar."""
    some = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets(texts, keys, nodes, some), name)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("_y")), "b")
    return both.select("a", "b", "_x", "_y").mapInArrow(_confirmed, "a long, b long")


def _open_keys(banded: DataFrame, of: DataFrame) -> DataFrame:
    """key, node, n, root, main (the root of most of the key's nodes), few, all (nodes outside main, nodes) for keys of more than REACH + 1 nodes that aren't one component."""
    large = stored(banded.groupBy("key").count().filter(F.col("count") > REACH + 1).select("key"), "near-large")
    rows = stored(banded.select("key", "node", "n").join(large, "key").join(of, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "near-members")
    each = rows.groupBy("key", "root").count()
    several = each.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("_most")).filter(F.col("all") > F.col("_most"))
    several = stored(several.select("key", "main", "all", (F.col("all") - F.col("_most")).alias("few")), "near-open")
    return rows.join(several, "key")


def _further_links(texts: DataFrame, keys: list[str], nodes: DataFrame, banded: DataFrame, of: DataFrame) -> DataFrame:
    """a, b: links between components that the first pass hasn't seen."""
    rows = stored(_open_keys(banded, of), "near-open-members")
    sets = stored(_sets(texts, keys, nodes, rows.select("node").distinct()), "near-open-sets")
    blocks = {c: F.ceil(F.col(c) / CELL).cast("int") for c in ("few", "all")}
    place = lambda c, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), blocks[c]).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), blocks[c] - 1))
    few = rows.filter("root <> main").withColumn("_i", place("few", 1)).withColumn("_j", spread("all")).withColumn("_few", F.lit(True))
    every = rows.withColumn("_j", place("all", 2)).withColumn("_i", spread("few")).withColumn("_few", F.lit(False))
    cells = few.unionByName(every).join(sets, "node").select("key", "_i", "_j", F.col("_few").alias("few"), "root", "n", "set")
    return cells.groupBy("key", "_i", "_j").applyInPandas(_cell, "a long, b long").distinct()


def roots(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, root: a row per row of `df`, whose groups of near copies share a root; `keys` tell texts apart."""
    texts = df.select(*keys, F.col(text).cast("string").alias("text"))
    prints = stored(nodes_of(texts), "near-prints")
    nodes = stored(prints.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.struct(*keys)).alias("_of")), "near-nodes")
    anchored = components(_links(texts, keys, nodes, stored(_anchor_pairs(nodes), "near-anchor-pairs"), "near-anchor-sets"), "near-anchors")
    apart = nodes.join(anchored, "node", "left").select(F.explode("keys").alias("key"), "node", "n", F.coalesce("root", "node").alias("root"))
    banded = stored(apart.withColumn("_r", F.xxhash64("key", "node")), "near-bands")
    # ordered by key and hash, so that a key of many rows goes to several tasks
    ordered = banded.repartitionByRange("key", "_r").sortWithinPartitions("key", "_r").select("key", "node", "n", "root")
    pairs = stored(ordered.mapInArrow(_near_rows, "a long, b long").distinct(), "near-pairs")
    found = _links(texts, keys, nodes, pairs, "near-sets")
    of = components(found.unionByName(anchored.select(F.col("node").alias("a"), F.col("root").alias("b"))), "near")
    more = components(_further_links(texts, keys, nodes, banded, of), "near-further").withColumnsRenamed({"node": "_root", "root": "_new"})
    rooted = prints.select(*keys, "node").join(of, "node", "left").select(*keys, F.coalesce("root", "node").alias("_root"))
    return rooted.join(more, "_root", "left").select(*keys, F.coalesce("_new", "_root").alias("root"))
