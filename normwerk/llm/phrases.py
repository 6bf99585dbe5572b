"""Phrase collocations by prefix-free parsing.

Parsing: a window of two words whose hash is divisible by MODULUS is a trigger, wherever it stands.  A text's chunks run from one trigger to the end of the
next, so neighbours overlap in two words; equal passages have equal chunks, whatever stands around them.  The distinct chunks with their frequencies are
the dictionary: however often a passage was copied, its phrases are counted once, with a weight.  A phrase belongs to the chunk in which it begins before the
closing trigger (or to a text's last chunk), so each occurrence of up to three words lies whole in exactly one chunk.

Counting goes by size.  A phrase of `support` occurrences has parts of as many, so only phrases whose parts may have that many are looked at.  Their
hashes are counted first, as pairs of numbers; the few that reach the support are looked up again and counted by their words.  Bitmaps of BITMAP_BITS
bits, fixed in size and so sent to every task, tell what may reach the support; they only save shuffling: sums by hash can be too large but never too small,
and the counts by words decide.

Rows are summed in stretches of text before they are shuffled, so no word, phrase or language is hot.  Texts are cut at piece ends, which no phrase crosses.

Defined results: null and empty texts have no words, null languages are `und`.  Repeated rows count as often as they stand there.  Pieces, words and
order are those of bytes of UTF-8; no characters but A-Z are folded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normwerk.llm import pieces
from normwerk.llm.common import stored

MODULUS = 16
SUPPORT = 10
BITMAP_BITS = 1 << 25
#: Bytes that are worked on together, and phrases that are summed together.
STRETCH, TOGETHER = 1 << 20, 3_000_000
# What ends a piece, and what stands between words
_ENDS, _BLANKS = b".,;:!?\n\v\f\r", b" \t"
_CUT = re.compile(b"[.,;:!?\n\v\f\r]")
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_ENDS)] = 1, 2
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_VALUES = np.random.default_rng(13).integers(0, 2**63, 256, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]  # odd


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[3]
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """Of texts written one after another, each with a line end: bytes, and each word's place, text, hashes, and whether the next stands in its piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    next_: np.ndarray
    h: list[np.ndarray]


def words_of(texts: list[bytes]) -> Words:
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    next_ = np.append(breaks[starts[1:]] == breaks[ends[:-1] - 1], False) if len(starts) else np.zeros(0, dtype=bool)
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return Words(data, starts, ends, np.searchsorted(first, starts, "right") - 1, next_, pieces.sums(_VALUES[data], starts, ends, 2))


def _stretches(texts: list[bytes], stretch: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """About `stretch` bytes at a time, with the texts' numbers; a longer text comes in parts, cut where a piece ends."""
    some: list[bytes] = []
    of: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not t:
            cut = _CUT.search(t, at + stretch) if len(t) - at > 2 * stretch else None
            end = cut.end() if cut else len(t)
            some.append(t[at:end])
            of.append(i)
            size += end - at
            at = end
            if size >= stretch:
                yield some, of
                some, of, size = [], [], 0
            if not t:
                break
    if some:
        yield some, of


def _distinct(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair first stands, and each pair's number."""
    _, first, number = np.unique(k1, return_index=True, return_inverse=True)
    if (k2[first][number] != k2).any():  # two keys share their first half
        _, first, number = np.unique(np.stack([k1, k2], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, number.ravel()


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    n = ends - starts
    to = np.concatenate([[0], np.cumsum(n)])
    taken = data[np.repeat(starts - to[:-1], n) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(taken))).cast(pa.string())


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 5) for x in langs], dtype=np.uint64)


def _languages(b: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    d = b.column("lang").dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


# --- dictionary -----------------------------------------------------------------------------------


def _chunks(w: Words, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and whether it is its text's last, of each chunk."""
    new = np.diff(w.of, prepend=-1) != 0
    pair = _mixed(w.h[0][:-1] * _MIX[0] + w.h[0][1:] * _MIX[1])
    trigger = np.append(w.next_[:-1] & (pair % np.uint64(modulus) == 0), False) & ~new
    at = np.flatnonzero(new | trigger)
    following = np.append(at[1:], len(new))
    last = np.append(new[at[1:]], True)
    return at, np.where(last, following, following + 2), last


def dictionary(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, last, chunk (words with a space between, or a line end where a piece ends), c: every distinct chunk and how often it stands in the texts."""
    modulus, stretch = MODULUS, STRETCH  # workers get these, whatever their module says
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs, of_row = _languages(b)
            seeds = _seeds(langs)
            for texts, rows_of in _stretches(b.column("text").cast(pa.binary()).to_pylist(), stretch):
                w = words_of(texts)
                if not len(w.starts):
                    continue
                a, e, last = _chunks(w, modulus)
                kept = np.zeros(len(w.data), dtype=bool)
                kept[w.ends] = True
                kept |= _KIND[w.data] == 0
                w.data[w.ends] = np.where(w.next_, 32, 10)
                norm = w.data[kept]
                end = np.cumsum(w.ends - w.starts + 1)
                start = end - (w.ends - w.starts + 1)
                first, final = start[a], end[e - 1] - 1
                code = of_row[np.array(rows_of)][w.of[a]]
                own = _mixed(seeds[code] + last.astype(np.uint64))
                k1, k2 = (k + own for k in pieces.sums(_VALUES[norm], first, final, 2))
                distinct, number = _distinct(k1, k2)
                count = np.bincount(number, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in code[distinct].tolist()], pa.string()), pa.array(last[distinct]), _strings(norm, first[distinct], final[distinct]), pa.array(count.astype(np.int64))], ["lang", "last", "chunk", "c"])

    return rows.mapInArrow(batches, "lang string, last boolean, chunk string, c long").groupBy("lang", "last", "chunk").agg(F.sum("c").alias("c"))


# --- counts ---------------------------------------------------------------------------------------


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(hashes: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits for the column `h`, or-ed together in Spark: the driver gets at most BITMAP_BITS / 64 rows."""
    place = F.col("h").bitwiseAND(BITMAP_BITS - 1)
    by_word = hashes.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[by_word["w"].to_numpy()] = by_word["b"].to_numpy()
    return out.view(np.uint8)


def _phrase_hashes(w: Words, at: np.ndarray, size: int, seed: np.ndarray, bases: int) -> list[np.ndarray]:
    out = []
    for h in w.h[:bases]:
        total = seed[w.of[at]]
        for i in range(size):
            total = total + h[at + i] * _MIX[i]
        out.append(_mixed(total))
    return out


def grams(chunks: DataFrame, size: int, parts: np.ndarray | None = None, own: np.ndarray | None = None, by_words: bool = True) -> DataFrame:
    """lang, phrase, h, c of the phrases of `size` words in the dictionary, or h, c alone; rows of a stretch are summed.

    parts, own: bitmaps that the hashes of a phrase's two parts of one word less, and its own, must be in.
    """
    stretch, together = STRETCH, TOGETHER

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        have = base = 0
        for b in it:
            langs, of_row = _languages(b)
            count, last = b.column("c").to_numpy(), b.column("last").to_numpy(zero_copy_only=False)
            for texts, rows_of in _stretches(b.column("chunk").cast(pa.binary()).to_pylist(), stretch):
                w = words_of(texts)
                n, row = len(w.starts), np.array(rows_of)
                if not n:
                    continue
                row_end = np.searchsorted(w.of, np.arange(len(texts)), "right")
                same = np.append(np.diff(row) == 0, False)  # a part of a long chunk that isn't its end
                at = np.flatnonzero((last[row] | same)[w.of] | (np.arange(n) < row_end[w.of] - 2))
                for i in range(size - 1):
                    at = at[w.next_[np.minimum(at + i, n - 1)]]
                seed = _seeds(langs)[of_row[row]]
                if parts is not None:
                    for i in (0, 1):
                        at = at[_has(parts, _phrase_hashes(w, at + i, size - 1, seed, 1)[0])]
                k = _phrase_hashes(w, at, size, seed, 1)
                if own is not None:
                    ok = _has(own, k[0])
                    at, k = at[ok], [k[0][ok]]
                if by_words:
                    k += [_phrase_hashes(w, at, size, seed, 2)[1]]
                code = of_row[row][w.of[at]]
                held.append((count[row[w.of[at]]], k, w.starts[at] + base, w.ends[at + size - 1] + base, [langs[i] for i in range(len(langs))], code, w.data))
                have += len(at)
                base += len(w.data) if by_words else 0
                if have >= together:
                    yield from summed(held)
                    held, have, base = [], 0, 0
        if held:
            yield from summed(held)

    def summed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        k1 = np.concatenate([x[1][0] for x in held])
        c = np.concatenate([x[0] for x in held])
        if not len(k1):
            return
        if not by_words:
            h, number = np.unique(k1, return_inverse=True)
            yield from _cut(pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(_sums(number, c, len(h)))], ["h", "c"]))
            return
        first, number = _distinct(k1, np.concatenate([x[1][1] for x in held]))
        starts, ends = (np.concatenate([x[i] for x in held])[first] for i in (2, 3))
        names = sorted({x for h in held for x in h[4]})
        place = {x: i for i, x in enumerate(names)}
        code = np.concatenate([np.array([place[x] for x in h[4]])[h[5]] if len(h[5]) else h[5] for h in held])[first]
        phrase = _strings(np.concatenate([x[6] for x in held]), starts, ends)
        lang = pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        yield from _cut(pa.RecordBatch.from_arrays([lang, phrase, pa.array(k1[first].view(np.int64)), pa.array(_sums(number, c, len(first)))], ["lang", "phrase", "h", "c"]))

    return chunks.select("lang", "last", "chunk", "c").mapInArrow(batches, "lang string, phrase string, h long, c long" if by_words else "h long, c long")


def _sums(number: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, number, c)
    return out


def _cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, 50_000):
        yield b.slice(i, 50_000)


def counts(chunks: DataFrame, longest: int = 3, support: int = SUPPORT) -> list[DataFrame]:
    """For each size, the stored table lang, phrase, h, f of its phrases: all words, and longer phrases of at least `support` occurrences."""
    by = lambda g: g.groupBy("lang", "phrase", "h").agg(F.sum("c").alias("f"))
    out = [stored(by(grams(chunks, 1)), "phrase-words")]
    for size in range(2, longest + 1):
        parts = bitmap(out[-1].filter(F.col("f") >= support))
        often = grams(chunks, size, parts, by_words=False).groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= support)
        out.append(stored(by(grams(chunks, size, parts, bitmap(often))).filter(F.col("f") >= support), "phrase-counts"))
    return out


# --- collocations ---------------------------------------------------------------------------------


def collocations(df: DataFrame, support: int = SUPPORT, covered: int = 50, top: int | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of two and three words of at least `support` occurrences, best first, `top` of each language (None: all).

    a: occurrences.  l and r: those of the parts at the cut with the least score floor(1000000 a a / (l r)), the first of equal ones.  n: words of the language.
    Phrases are left out if a longer one that holds them has `covered` percent of their occurrences or more.  Products are decimals of 38 digits: exact up to 10^16 occurrences.
    """
    chunks = stored(dictionary(df, text, lang), "phrase-dictionary")
    words, pairs, triples = counts(chunks, 3, support)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words, pairs, triples = (t.select("lang", "phrase", F.col("f").alias("a")) for t in (words.filter(F.col("f") >= support), pairs, triples))

    def of(table: DataFrame, key: str, value: str) -> DataFrame:
        return table.select("lang", F.col("phrase").alias(key), F.col("a").alias(value))

    t = triples.withColumn("_x", F.substring_index("phrase", " ", 1)).withColumn("_z", F.substring_index("phrase", " ", -1))
    t = t.withColumn("_xy", F.substring_index("phrase", " ", 2)).withColumn("_yz", F.substring_index("phrase", " ", -2))
    for table, key in ((words, "_x"), (pairs, "_yz"), (pairs, "_xy"), (words, "_z")):
        t = t.join(of(table, key, f"{key}_f"), ["lang", key])
    t = stored(t.select("lang", "phrase", "a", "_xy", "_yz", F.array(F.struct(F.col("_x_f").alias("l"), F.col("_yz_f").alias("r")), F.struct(F.col("_xy_f").alias("l"), F.col("_z_f").alias("r"))).alias("cuts")), "phrase-triples")
    longer = t.select("lang", F.explode(F.array("_xy", "_yz")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    p = pairs.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("_longer") * 100 < F.col("a") * covered, F.lit(True)))
    p = p.withColumn("_x", F.substring_index("phrase", " ", 1)).withColumn("_z", F.substring_index("phrase", " ", -1))
    for key in ("_x", "_z"):
        p = p.join(of(words, key, f"{key}_f"), ["lang", key])
    both = p.select("lang", "phrase", "a", F.array(F.struct(F.col("_x_f").alias("l"), F.col("_z_f").alias("r"))).alias("cuts")).unionByName(t.select("lang", "phrase", "a", "cuts"))
    score = "transform(cuts, (c, i) -> struct(((cast(a as decimal(38,0)) * a * 1000000) div (cast(c.l as decimal(38,0)) * c.r)) as score, i as i, c.l as l, c.r as r))"
    scored = both.withColumn("_b", F.array_min(F.expr(score))).select("lang", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_b.score").cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank)
    if top is not None:
        best = best.filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM candidates WHERE size = 3
  ) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, unnest(range(1, c.size)) AS k, c.w FROM candidates c LEFT JOIN longer USING (lang, phrase)
  WHERE c.size = 3 OR longer IS NULL OR 100 * longer < 50 * c.a
), parts AS (
  SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y FROM cuts
), scored AS (
  SELECT p.lang, p.phrase, p.a, p.k, fx.f AS l, fy.f AS r, CAST((1000000::HUGEINT * p.a * p.a) // (fx.f::HUGEINT * fy.f) AS BIGINT) AS score
  FROM parts p JOIN f fx ON fx.lang = p.lang AND fx.size = p.k AND fx.phrase = p.x JOIN f fy ON fy.lang = p.lang AND fy.size = p.size - p.k AND fy.phrase = p.y
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE o = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
