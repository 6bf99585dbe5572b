"""Benchmark decontamination by template canonicalisation.

A text's words are put in canonical form: numbers, units after a number and names (capitalised words that don't begin a
sentence) become typed placeholders, other words are lower-cased.  Windows of WINDOW canonical words are hashed; documents and benchmark
items are joined on these.  A document's matches with an item are then checked for slots: over the windows at one distance between
the two, each value in the item must stand for one value in the document.  So a question with other numbers or names
is found, and a passage whose placeholders only happen to fall together isn't.  An item's first word, which begins no sentence in some
documents, stands both for itself and for a name.

Word for word copies are found by a second hash, of the lower-cased words without placeholders, which needs no slots: so are short items, items
of mostly numbers, and passages in which a repeated value was altered in one place.

A document is contaminated by an item if consistent windows, or literal ones, cover at least MIN_SHARE of the item's windows of that kind.

Before the join, document windows are looked up in a bitmap of BITMAP_BITS bits made from the benchmark's windows: its size is
fixed, so it can be sent to every task, and it only saves shuffling windows that can't match.

Defined results: null and empty texts match nothing.  An item shorter than WINDOW words is one window of its own length; one of fewer
than MIN_ITEM words, or whose windows hold fewer than MIN_LITERAL words that aren't placeholders, is only found word for word: one of a single word in every document that has the
word.  Items with null ids and several texts under one id are items of their own.  Equal documents get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normwerk.llm import pieces
from normwerk.llm.common import row_key, stored

WINDOW = 8
MIN_ITEM = 5
MIN_COPY = 1
MIN_LITERAL = 4
MIN_SHARE = 0.3
BITMAP_BITS = 1 << 24
# units
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours days weeks months years mph kmh kw kwh w v a hz percent usd eur dollars euros cents degrees".split())


_NUMBER, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(x, 1)) for x in ("<number>", "<name>", "<unit>"))
_LITERAL = np.uint64(xxhash.xxh64_intdigest("literal", 1))
# what a character is: part of a word, part of one between such, either a joint or the end of a sentence, the end of a sentence
_IN, _JOINT, _POINT, _END, _OTHER = range(5)
_characters = pieces.ByCodePoint(lambda c: _IN if c.isalnum() else _JOINT if c in "'’," else _POINT if c == "." else _END if c in "!?\n" else _OTHER)
# kinds of words
_WORD, _CAPITAL, _DIGITS, _UNITWORD = range(4)
#: Distinct words that a worker remembers (about 100 MB); later ones are looked at where they stand.
REMEMBERED = 500_000


@dataclass
class Words:
    """Of some texts, joined: for each word its number in Canonical, canonical hash, whether that is a placeholder, hash of the word itself; and where each text's words begin."""

    number: np.ndarray
    code: np.ndarray
    placeholder: np.ndarray
    literal: np.ndarray
    bounds: np.ndarray


class Canonical:
    """Texts -> words: runs of letters and digits, in which one of ' ’ . , may stand between two such.

    A name is a capitalised word after another word with no end of a sentence between, a unit a unit's word after a number.
    """

    def __init__(self, remembered: int = REMEMBERED):
        self.known, self.remembered = pieces.Table(), remembered
        self.low: list[str] = []
        self.kind, self.hash = np.zeros(1 << 12, dtype=np.uint8), np.zeros(1 << 12, dtype=np.uint64)
        self.could_be_name = np.zeros(1 << 12, dtype=bool)

    def _learn(self, words: list[str]) -> None:
        at = len(self.low)
        low = [w.lower() for w in words]
        while len(self.kind) < at + len(words):
            self.kind, self.hash, self.could_be_name = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.hash, self.could_be_name))
        for i, (w, v) in enumerate(zip(words, low, strict=True), at):
            c = w[0]
            self.could_be_name[i] = c.isupper() and w[1:] == v[1:]
            self.kind[i] = _DIGITS if c.isdigit() else _CAPITAL if self.could_be_name[i] else _UNITWORD if v in UNITS else _WORD
            self.hash[i] = xxhash.xxh64_intdigest(v, 1)
        self.low += low

    def slots(self, w: Words, at: int, placeholder: np.ndarray) -> str:
        """Values of a window's placeholders with their places in it, one after another."""
        return "\x1f".join(self.low[k] for k in w.number[at + np.flatnonzero(placeholder)].tolist())

    def forget(self) -> None:
        """Words beyond those to be remembered; their numbers have no meaning after this."""
        del self.low[self.known.count :]

    def _stretch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each word, whether a sentence ended before it, and the words' counts by text."""
        whole = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts])
        points = pieces.code_points(whole)
        kind = _characters(points)
        part, stop = kind == _IN, (kind == _POINT) | (kind == _END)
        joint = (kind == _JOINT) | (kind == _POINT)
        joint[1:-1] &= part[:-2] & part[2:]
        joint[0] = joint[-1] = False
        part |= joint
        stop &= ~joint
        stop[ends - 1] = True
        edge = np.diff(part.view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stops = np.cumsum(stop)[start]
        keys = pieces.keys(points, start, end)
        number = self.known.find(*keys).astype(np.int64)
        if (new := np.flatnonzero(number < 0)).size:
            _, first, again = np.unique(keys[0][new], return_index=True, return_inverse=True)
            at = new[first]
            number[new] = len(self.low) + again
            self._learn([whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            if len(self.low) <= self.remembered and len(self.low) == self.known.count + len(at):
                self.known.add(keys[0][at], keys[1][at])
        return number, np.diff(stops, prepend=0) > 0, np.diff(np.searchsorted(start, ends), prepend=0)

    def words(self, texts: list[str]) -> Words:
        number, stop, n = [], [], np.zeros(len(texts), dtype=np.int64)
        for some, of in pieces.chunks(texts):
            a, b, c = self._stretch(some)  # one that goes on with a text begins between two of its words
            number.append(a)
            stop.append(b)
            np.add.at(n, of, c)
        number = np.concatenate(number) if number else np.zeros(0, dtype=np.int64)
        stop = np.concatenate(stop) if stop else np.zeros(0, dtype=bool)
        kind, literal = self.kind[number], self.hash[number]
        bounds = np.concatenate([[0], np.cumsum(n)])
        stop[bounds[:-1][n > 0]] = True
        after_number = np.zeros(len(kind), dtype=bool)
        after_number[1:] = (kind[:-1] == _DIGITS) & ~stop[1:]
        name, unit, digits = (kind == _CAPITAL) & ~stop, (kind == _UNITWORD) & after_number, kind == _DIGITS
        code = literal.copy()
        code[digits], code[name], code[unit] = _NUMBER, _NAME, _UNIT
        return Words(number, code, digits | name | unit, literal, bounds)


def window_hashes(code: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(max(0, len(code) - size + 1))
    mixed = code ^ (code >> np.uint64(29))
    return pieces.sums(mixed, at, at + size)[0]


_ARROW = [("n", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("slots", pa.string())]


def _found(tool: Canonical, w: Words, size: int, template: bool, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Text, hash, place and slots of the windows of one size and kind."""
    if len(w.code) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    h = window_hashes(w.code if template else w.literal, size)
    n = np.diff(w.bounds)
    of = np.repeat(np.arange(len(n)), n)[: len(h)]
    ok = np.arange(len(h)) + size <= w.bounds[of + 1]
    ok &= (n >= (MIN_ITEM if template else MIN_COPY))[of]
    if template:
        known = np.concatenate([[0], np.cumsum(~w.placeholder)])
        ok &= known[size:] - known[:-size] >= min(MIN_LITERAL, size)
    else:
        h ^= _LITERAL
    if bitmap is not None:
        place = h & np.uint64(BITMAP_BITS - 1)
        ok &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    at = np.flatnonzero(ok)
    return of[at], h[at], at - w.bounds[of[at]], [tool.slots(w, a, w.placeholder[a : a + size]) if template else None for a in at.tolist()]


def windows(df: DataFrame, keys: list[str], text: str, sizes: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """keys, n (windows of the kind in the text), size, h, at, slots (null: a literal window).

    With `sizes` all windows of these sizes that pass the bitmap; without, those of one size: WINDOW or the text's own if shorter (benchmark items).
    """
    rows = df.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["n int, size int, h long, at int, slots string"])

    def of_documents(tool: Canonical, texts: list[str]) -> Iterator[tuple]:
        w = tool.words(texts)
        for size in sizes:
            for template in (True, False) if size >= MIN_ITEM else (False,):
                of, h, at, slots = _found(tool, w, size, template, bitmap)
                yield of, np.zeros(len(of), dtype=np.int64), np.full(len(of), size), h, at, slots

    def of_item(tool: Canonical, text: str, i: int) -> Iterator[tuple]:
        w = tool.words([text])
        size = min(WINDOW, len(w.code))
        if size < MIN_COPY:
            return
        for template in (True, False) if size >= MIN_ITEM else (False,):
            _, h, at, slots = _found(tool, w, size, template, None)
            n = len(at)
            if template and tool.could_be_name[w.number[0]] and not w.placeholder[0] and (~w.placeholder[:size]).sum() - 1 >= MIN_LITERAL:
                first, named = w.code[:size].copy(), w.placeholder[:size].copy()
                first[0], named[0] = _NAME, True
                at, h, slots = np.append(at, 0), np.append(h, window_hashes(first, size)), [*slots, tool.slots(w, 0, named)]
            yield np.full(len(at), i), np.full(len(at), n), np.full(len(at), size), h, at, slots

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Canonical()
        for b in (x for whole in it for x in pieces.slices(whole, len(keys), pieces.CHUNK)):
            texts = [t or "" for t in b.column(len(keys)).to_pylist()]
            for of, n, size, h, at, slots in of_documents(tool, texts) if sizes is not None else chain.from_iterable(of_item(tool, t, i) for i, t in enumerate(texts)):
                new = [pa.array(x, k) for x, (_, k) in zip((n, size, h.view(np.int64), at, slots), _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(j).take(pa.array(of)) for j in range(len(keys))], *new], [*keys, *[k for k, _ in _ARROW]])
            tool.forget()

    return rows.mapInArrow(batches, schema)


def _bitmap(items: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, or-ed together in Spark by 64-bit words; the driver gets at most BITMAP_BITS / 64 rows, whatever the benchmark's size."""
    place = F.col("h").bitwiseAND(BITMAP_BITS - 1)
    by_word = items.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    got = by_word.toPandas()
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def _probes(items: DataFrame) -> DataFrame:
    """Windows of `items` of which every document that an item contaminates holds at least one.

    A document needs a share MIN_SHARE of an item's windows, so it can't do without all of the others and one more: of these, those are taken that the fewest items have.
    What many items share, such as the instructions of a question set, finds no pairs of documents and items, unless it is that share of an item by itself.
    """
    often = items.groupBy("h").agg(F.count("*").alias("_often"))
    places = items.join(often, "h").groupBy("_item", "literal", "at").agg(F.max("_often").alias("_often"), F.first("n").alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_item", "literal").orderBy("_often", "at"))
    chosen = places.withColumn("_r", rank).filter(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * MIN_SHARE - 1e-9) + 1).select("_item", "literal", "at")
    return items.join(chosen, ["_item", "literal", "at"], "left_semi").select("_item", "literal", "h").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_keys, item_id, n_windows, share for every document and item id of which consistent windows cover MIN_SHARE.

    Each pair of id and text is an item of its own; of several under one id, null included, the largest share is given.
    """
    keys = list(doc_keys)
    literal = F.col("slots").isNull().alias("literal")
    texts = stored(benchmark.select("item_id", "text").distinct().withColumn("_item", F.monotonically_increasing_id()), "benchmark-items")
    items = windows(texts.select("_item", "text"), ["_item"], "text", None, None)
    items = stored(items.select("*", literal), "benchmark-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW of them
    hits = stored(windows(docs, keys, text, sizes, _bitmap(items)).select(*keys, "h", "at", "slots", literal), "document-windows")
    candidates = hits.join(_probes(items), ["h", "literal"]).select(*keys, "_item").distinct()
    b = items.select("_item", "n", "h", "literal", F.col("at").alias("_b"), F.col("slots").alias("_bs"))
    pairs = candidates.join(b, "_item").join(hits, [*keys, "h", "literal"])
    values = F.arrays_zip(F.split("_bs", "\x1f").alias("x"), F.split("slots", "\x1f").alias("y"))
    shift = F.when(~F.col("literal"), F.col("at") - F.col("_b"))  # places of literal windows need no distance: all are equal words
    by_shift = pairs.groupBy(*keys, "_item", "n", "literal", shift.alias("_shift")).agg(
        F.collect_set("_b").alias("_places"), F.array_distinct(F.flatten(F.collect_set(values))).alias("_values")
    )
    consistent = F.size("_values") == F.size(F.array_distinct(F.transform("_values", lambda v: v["x"])))
    covered = by_shift.filter(consistent).groupBy(*keys, "_item", "n", "literal").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_places")))).cast("long").alias("n_windows"))
    share = F.col("n_windows") / F.col("n")
    best = covered.filter(share >= MIN_SHARE).join(texts.select("_item", "item_id"), "_item").groupBy(*keys, "item_id").agg(F.max(F.struct(F.round(share, 6).alias("share"), "n_windows")).alias("_m"))
    return best.select(*keys, "item_id", "_m.n_windows", "_m.share")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: doc_id, contaminated, n_items, item_ids (ascending); a null id counts as one and isn't listed."""
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), "text")
    found = matches(keyed, benchmark, doc_keys=("_k1", "_k2")).groupBy("_k1", "_k2").agg(F.count("*").alias("_n"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return keyed.select("doc_id", "_k1", "_k2").join(found, ["_k1", "_k2"], "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that no item contaminates."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key("doc_id", "text"))
    keyed = docs.select(*row_key("doc_id", "text"), "text")
    found = matches(keyed, benchmark, doc_keys=("_k1", "_k2")).select("_k1", "_k2").distinct()
    return row.join(found, ["_k1", "_k2"], "left_anti").select("_row.*")
