"""SimHash near duplicates by anchor-point covering.

Fingerprints: 64 bits from the XXH64 values of a text's 4-word shingles.  Two documents link if their fingerprints differ in at
most 4 bits; components of links are the groups.

Search: the 64 bits are three blocks, each padded with zeros to 23 bits.  The binary Golay code of length 23 covers every block:
each word has exactly one anchor (code word) within distance 3.  Two fingerprints within 4 bits have two blocks in which they
differ in at most 2 bits together, and so a point in between that is at most 1 bit from either.  That point's anchors are
therefore within covering radius 3 in both blocks from either fingerprint, or within 3 + 1 in one of them.  Each fingerprint is
replicated, for each of the three pairs of blocks, to all pairs of anchors within that distance (29 on average, 33 at most),
and compared only with those that share a pair of anchors.  No link is missed.

Hot keys: equal fingerprints are one row from the start.  A pair of anchors with more than HOT fingerprints is compared in cells, block of rows
against block of rows, each its own group; a cell returns a spanning forest of its links, not the links.  Components come from
alternating large-star and small-star rounds on the remaining links: minima with partial sums, and joins whose hubs Spark splits, so no
node's neighbours have to be in one place.

Defined results: null and empty texts have fingerprint zero and link to each other.  Null ids take part, but the component's id is the smallest
id that isn't null (null if there is none).  Rows that repeat come out as often as they came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normwerk.llm.common import stored

WORDS = 4
SEED = 42
BITS = 4
HOT = 2048
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit (from the lowest) and bits
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b110001110101  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 or its mirror, as `_tables` verifies
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- fingerprints ---------------------------------------------------------------------------------


def majority(hashes: np.ndarray) -> int:
    """Unsigned; bit set if it is set in over half of these unsigned 64-bit hashes."""
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(len(hashes), 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """Unsigned; bit set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])
    digest = xxhash.xxh64_intdigest
    n = len(words) - WORDS + 1
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), (starts[WORDS:] - 1).tolist(), strict=True)], dtype=">u8"))


def fingerprints(df: DataFrame, text: str = "text", out: str = "_fp") -> DataFrame:
    """`df` with `text` replaced by `out`, the fingerprint as a signed long."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*keep, T.StructField(out, T.LongType())])
    names = [f.name for f in keep]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.names.index
            fp = np.array([fingerprint(t) for t in b.column(at(text)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(at(n)) for n in names], pa.array(fp)], [*names, out])

    return df.mapInArrow(batches, schema)


# --- anchors --------------------------------------------------------------------------------------


def _remainder(word: np.ndarray) -> np.ndarray:
    """Of 23-bit words, as polynomials, by the generator: the syndrome."""
    word = word.copy()
    for i in range(22, 10, -1):
        word = np.where((word >> i) & 1, word ^ (GENERATOR << (i - 11)), word)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the pattern of at most 3 bits that leads to the only anchor within 3, and those of 4 bits (five or none: zeros)."""
    near, next_ = np.full(2048, -1, dtype=np.int64), [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], dtype=np.int64)
        for p, s in zip(patterns.tolist(), _remainder(patterns).tolist(), strict=True):
            if weight < 4:
                assert near[s] < 0, "not a perfect code"
                near[s] = p
            else:
                next_[s].append(p)
    assert (near >= 0).all() and all(len(x) in (0, 5) for x in next_)
    return near, np.array([x or [0] * 5 for x in next_], dtype=np.int64)


_NEAR, _NEXT = _tables()


def anchor_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all anchors of unsigned fingerprints; a key is a pair of blocks and an anchor of 12 information bits in each."""
    near, further = [], []
    for first, bits in BLOCKS:
        word = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = _remainder(word)
        near.append((word ^ _NEAR[syndrome]) >> 11)
        patterns = _NEXT[syndrome]
        further.append((np.where(patterns > 0, (word[:, None] ^ patterns) >> 11, -1)))
    rows, keys = [], []
    every = np.arange(len(fp))
    for pair, (p, q) in enumerate(PAIRS):
        base = pair << 24
        rows.append(every)
        keys.append(base | near[p] << 12 | near[q])
        for i in range(5):
            for a, b, ok in ((further[p][:, i], near[q], further[p][:, i] >= 0), (near[p], further[q][:, i], further[q][:, i] >= 0)):
                rows.append(every[ok])
                keys.append(base | a[ok] << 12 | b[ok])
    return np.concatenate(rows), np.concatenate(keys)


def replicas(nodes: DataFrame) -> DataFrame:
    """fp -> key, fp: a row for each anchor pair."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = anchor_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(batches, "key long, fp long")


# --- links ----------------------------------------------------------------------------------------


def forest(fp: np.ndarray, bits: int = BITS, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the components of links among these fingerprints; roots and single ones are left out.  With `direct`, a member comes with that it links to.

    A search that compares each reached member only with those not reached yet: a large group of near copies is
    reached from its first few members, and no list of pairs is built.
    """
    rest = np.unique(fp.view(np.uint64))
    members, roots = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            at = queue.pop()
            close = np.bitwise_count(rest ^ at) <= bits
            if close.any():
                found = rest[close]
                rest = rest[~close]
                queue += list(found)
                members.append(found)
                roots.append(np.full(len(found), at if direct else root, dtype=np.uint64))
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(members) if members else none).view(np.int64), (np.concatenate(roots) if roots else none).view(np.int64)


def _links_of_sorted(it: Iterator[pa.RecordBatch], bits: int, direct: bool) -> Iterator[pa.RecordBatch]:
    """Rows ordered by key; holds one key's rows (those of a cell at most) and one batch, and returns each batch's links once."""
    kept_key, kept = None, np.zeros(0, dtype=np.int64)

    def out(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = [x for x in (forest(g, bits, direct) for g in groups) if len(x[0])]
        if found:
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in it:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        firsts = key[np.concatenate([[0], cuts])]
        ends = [0, *cuts.tolist(), len(key)]
        groups: list[np.ndarray] = []
        for k, first, last in zip(firsts.tolist(), ends, ends[1:], strict=False):
            if k != kept_key:
                if len(kept) > 1:
                    groups.append(kept)
                kept_key, kept = k, fp[first:last]
            else:
                kept = np.concatenate([kept, fp[first:last]])
        kept = kept.copy()  # not a view of the batch
        yield from out(groups)
    if len(kept) > 1:
        yield from out([kept])


def links(nodes: DataFrame, bits: int = BITS, direct: bool = False) -> DataFrame:
    """a, b: links among distinct fingerprints `fp`, enough of them to make all components.

    With `direct`, a and b always link to each other, for a check to follow.  Beyond BITS, links are those of fingerprints that share a pair of anchors.
    Cells of hot keys have their number's hash for a key; two that shared one would only be compared with each other too.
    """
    copies = stored(replicas(nodes), "simhash-replicas")
    hot = copies.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("_n"))
    few = copies.join(hot.select("key"), "key", "left_anti")
    block = F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int")
    cells = copies.join(hot, "key").withColumn("_b", block).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = few.unionByName(cells.select(F.xxhash64("key", F.least("_b", "_c"), F.greatest("_b", "_c")).alias("key"), "fp"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_links_of_sorted, bits=bits, direct=direct), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """node, root: each node of `edges` (a, b) with the smallest node of its component.

    Large-star then small-star (Kiveris et al., Connected Components in MapReduce and Beyond, 2014), both as a
    minimum and a join; every round's edges are written to the shared folder.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    state = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least are stored, so that the joins are broadcast, or between two plain shuffles of which Spark splits a hub's part
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
        large = stored(both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the component), a row per row of `df`."""
    prints = stored(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "text", "fp"), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    of = components(links(nodes))
    rooted = nodes.join(of, nodes["fp"] == of["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
