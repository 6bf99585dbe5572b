"""A dump, which is one JSON object with arrays of objects, read by as many tasks as its bytes ask for.

Spark reads the file in fragments that end with `}`, so that a byte range, a block here, is a task, be it one line or many.  Of each fragment a few numbers are worked out where it is read: its quotes,
and by how much it nests deeper, both for a start inside and outside of a string.  A first reading sums these up, to a row a block for either start; running sums over these rows tell how each block begins.
A second reading then tells of every `}` whether it stands in a string and how deep it is; those after which two levels are open end an element.  Fragments are put together by the number of ends before them.
So texts are shuffled once and nothing is stored for a fragment.

Defined results: text around the object is left out; escapes, braces and quotes in strings are text; other keys at the object's level are passed over, but for arrays of arrays of objects, which aren't read; arrays
that are missing, null or empty have no rows; a dump that breaks off has the elements before the break; each file is a dump of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normwerk.sources.shared import stored

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLAIN = rf'(?:{_STRING}|[-+\w.]++|\[[^\[\]{{}}"]*+(?:{_STRING}[^\[\]{{}}"]*+)*+\])'  # scalars and arrays of scalars
#: The end of the array before, keys with plain values, and the key and bracket that open the next container.
_HEAD = rf'(?s)^\s*+(?:\{{|\])?+\s*+(?:,?+\s*+{_STRING}\s*+:\s*+{_PLAIN}\s*+)*+,?+\s*+"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*+:\s*+([\[{{])\s*+'
_NUMBERS = ("first", "last", "q", "d0", "d1", "qa", "da", "closes")


def _deeper(bare: Column, start: int) -> Column:
    """Brackets opened less those closed in what is outside of strings, if the first quote opens (0) or closes (1) one."""
    outside = F.array_join(F.filter(F.split(bare, '"', -1), lambda x, i: i % 2 == start), "")
    count = lambda marks: F.length(outside) - F.length(F.translate(outside, marks, ""))
    return (count("{[") - count("]")).cast("long")


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Slices of batches (path, block, ...) that lie in one block, whether it begins with them and whether it ends; a block's rows come in their order."""
    held, begins, now = None, True, None
    for b in it:
        block, name = b.column("block").to_numpy(), b.column("path").dictionary_encode()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(name.indices.to_numpy()) != 0)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if e > a:
                of = name[a].as_py(), int(block[a])
                if held is not None:
                    yield held, begins, of != now
                held, begins, now = b.slice(a, e - a), of != now, of
    if held is not None:
        yield held, begins, True


def _numbers(part: pa.RecordBatch, started: bool) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """From which row on `part` lies in the object (its length: from none), and q, d0 and d1 from there; the object begins at the first brace of its file."""
    q, d0, d1 = (part.column(c).to_numpy() for c in ("q", "d0", "d1"))
    if started:
        return 0, q, d0, d1
    brace = np.flatnonzero(part.column("qa").is_valid().to_numpy(zero_copy_only=False))
    if not len(brace):
        return part.num_rows, q[:0], d0[:0], d1[:0]
    at = int(brace[0])
    q, d0, d1 = (x[at:].copy() for x in (q, d0, d1))
    q[0], d0[0] = part.column("qa")[at].as_py(), part.column("da")[at].as_py()
    return at, q, d0, d1


def _along(q: np.ndarray, d0: np.ndarray, d1: np.ndarray, quotes: int, depth: int, ended: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of fragments after so many quotes and at such a depth: whether they begin in a string, whether their brace stands outside of one, and the depth before and after it."""
    after = quotes + np.cumsum(q)
    within, closed = (after - q) % 2 == 1, after % 2 == 0
    if ended and len(closed):
        closed[-1] = False  # a file's last fragment has no brace
    step = np.where(within, d1, d0) - closed
    deep = depth + np.cumsum(step)
    return within, closed, deep - step, deep


def _summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: its quotes, and for a start outside and inside of a string how deep it leads and at which depths braces close."""
    for part, begins, ends in _parts(it):
        if begins:
            started, quotes, depth, levels = not part.column("first")[0].as_py(), 0, [0, 0], [Counter(), Counter()]
        at, q, d0, d1 = _numbers(part, started)
        started = started or at < part.num_rows
        for p in (0, 1) if len(q) else ():
            _, closed, _, deep = _along(q, d0, d1, quotes + p, depth[p], ends and part.column("last")[0].as_py())
            values, n = np.unique(deep[closed], return_counts=True)
            levels[p].update(dict(zip(values.tolist(), n.tolist(), strict=True)))
            depth[p] = int(deep[-1])
        quotes += int(q.sum())
        if ends:
            either = [[{"depth": depth[p], "levels": [{"level": k, "n": n} for k, n in levels[p].items()]}] for p in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("path").slice(0, 1), part.column("block").slice(0, 1), pa.array([quotes]), *(pa.array(x, _EITHER) for x in either)], ["path", "block", "quotes", "outside", "inside"])


_EITHER = pa.struct([("depth", pa.int64()), ("levels", pa.list_(pa.struct([("level", pa.int64()), ("n", pa.int64())])))])
_SUMS = "struct<depth: long, levels: array<struct<level: long, n: long>>>"


def _placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, block, n (in it), value, head (may tell of an array), whole (ends an element), element (ends before it) of the fragments from the object's begin on."""
    for part, begins, ends in _parts(it):
        if begins:
            started, n = not part.column("first")[0].as_py(), 0
            quotes, depth, element = (part.column(c)[0].as_py() for c in ("quotes", "depth", "element"))
        at, q, d0, d1 = _numbers(part, started)
        if not len(q):
            continue
        value, closes = part.column("value").slice(at), part.column("closes").to_numpy(zero_copy_only=False)[at:].copy()
        if not started:
            text = value[0].as_py()
            value, closes[0], started = pa.concat_arrays([pa.array([text[text.index("{") :]], value.type), value.slice(1)]), False, True
        within, closed, before, deep = _along(q, d0, d1, quotes, depth, ends and part.column("last")[0].as_py())
        end = closed & ((deep == 1) | (deep == 2))
        head = ~within & ((before < 2) | (before == 2) & closes)
        of = element + np.cumsum(end) - end
        yield pa.RecordBatch.from_arrays(
            [part.column("path").slice(at), part.column("block").slice(at), pa.array(n + np.arange(len(q))), value, pa.array(head), pa.array(end & (deep == 2)), pa.array(of)], ["path", "block", "n", "value", "head", "whole", "element"]
        )
        n, quotes, depth, element = n + len(q), quotes + int(q.sum()), int(deep[-1]), int(element + end.sum())


def elements(spark: SparkSession, path: str) -> DataFrame:
    """path, array (its key), element (JSON) for each object in an array of the dumps at `path`."""
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    brace = F.contains("value", F.lit("{"))
    files = text.groupBy("path").agg(F.min(F.when(brace, F.col("block"))).alias("_first"), F.max("block").alias("_last"))
    files = stored(files, "dump-files")  # a row a file; broadcast, so that fragments stay in their order
    inside = text.join(F.broadcast(files), "path").filter(F.col("block") >= F.col("_first")).withColumns({"first": F.col("block") == F.col("_first"), "last": F.col("block") == F.col("_last")})

    def quotes(bare: Column) -> Column:
        return (F.length(bare) - F.length(F.translate(bare, '"', ""))).cast("long")

    bare = lambda c: F.regexp_replace(c, r"(?s)\\.", "")
    # in a file's first block also for a text that begins at the fragment's first brace
    cut = F.when(F.col("first") & brace, bare(F.expr("substring(value, instr(value, '{'))")))
    marks = {"q": quotes(bare("value")), "d0": _deeper(bare("value"), 0), "d1": _deeper(bare("value"), 1), "qa": quotes(cut), "da": _deeper(cut, 0), "closes": F.rlike("value", F.lit(r"^\s*+\]"))}
    marked = inside.withColumns(marks)

    blocks = marked.select("path", "block", *_NUMBERS).mapInArrow(_summed, f"path string, block long, quotes long, outside {_SUMS}, inside {_SUMS}")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    blocks = stored(blocks, "dump-blocks").withColumn("_q", so_far("quotes"))
    blocks = blocks.withColumn("_of", F.when(F.col("_q") % 2 == 0, F.col("outside")).otherwise(F.col("inside"))).withColumn("depth", so_far("_of.depth"))
    ends = F.aggregate(F.filter("_of.levels", lambda x: (x["level"] + F.col("depth")).isin(1, 2)), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    starts = stored(blocks.withColumn("_ends", ends).select("path", "block", F.col("_q").alias("quotes"), "depth", so_far("_ends").alias("element")), "dump-starts")

    placed = marked.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "value", *_NUMBERS, "quotes", "depth", "element").mapInArrow(_placed, "path string, block long, n long, value string, head boolean, whole boolean, element long")
    # what stands before an element's brace is cut off, and tells of its array where that begins with it
    parts = F.sort_array(F.collect_list(F.struct("block", "n", "value", "head")))
    groups = placed.groupBy("path", F.col("element").alias("_element")).agg(parts.alias("_f"), F.bool_or("whole").alias("_whole")).filter("_whole")
    groups = groups.select("path", "_element", F.concat(F.array_join("_f.value", "}"), F.lit("}")).alias("_text"), F.col("_f")[0]["head"].alias("_head"))
    whole = stored(groups.withColumn("_head", F.col("_head") & F.rlike("_text", F.lit(_HEAD))), "dump-elements")
    name = F.when(F.regexp_extract("_text", _HEAD, 2) == "[", F.regexp_extract("_text", _HEAD, 1))
    heads = stored(whole.filter("_head").select("path", "_element", name.alias("array")), "dump-arrays")  # a row for each container at the object's level
    element = F.regexp_replace("_text", F.when(F.col("_head"), F.lit(_HEAD)).otherwise(F.lit(r"^\s*+,")), F.lit(""))
    return _with_arrays(whole.select("path", "_element", element.alias("element")), heads)


def _with_arrays(whole: DataFrame, heads: DataFrame) -> DataFrame:
    """Each element's array is that of the latest head at or before it; there are few heads, so their ends are found among themselves."""
    following = F.lead("_element").over(Window.partitionBy("path").orderBy("_element"))
    spans = heads.select("path", "array", F.col("_element").alias("_lo"), following.alias("_hi")).filter("array is not null")
    at = (F.col("_element") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_element") < F.col("_hi")))
    return whole.join(spans, "path").filter(at).select("path", "array", "element")
