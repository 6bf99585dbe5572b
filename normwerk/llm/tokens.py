"""Token ids of whole texts by a public byte-level BPE file of the tokenizers library.

The library splits a text before it merges bytes.  Where characters of certain classes meet, the split is certain whatever stands
around: before a space that precedes a visible character, between letters, digits and punctuation, around line ends.  Pieces between
such borders are encoded apart by the library, each distinct one once per worker, and their ids are joined.  The result is that of encoding
the whole text (tests/llm compares the two), at a fraction of the time.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from normwerk.llm import pieces

TOKENIZER = "byte_bpe_50k.json"
#: Distinct pieces that a worker remembers (about 80 MB); later ones are encoded where they stand.
REMEMBERED = 1_000_000
_LONG = 64  # longer pieces are not remembered
_LETTER, _DIGIT, _SIGN, _QUOTE, _WHITE, _OTHER, _EDGE = range(7)
_SPACE = ord(" ")


def _class(c: str) -> int:
    """Letters, digits and signs are those of Unicode 3.2 that are so today: every version of the library takes them for such."""
    if c in " \t\n\v\f\r":
        return _WHITE
    if c == "'":  # begins 's, 'll and the like
        return _QUOTE
    kinds = {unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]}
    if kinds <= {"P", "S"}:
        return _SIGN
    return {"L": _LETTER, "N": _DIGIT}.get(min(kinds), _OTHER) if len(kinds) == 1 else _OTHER


_classes = pieces.ByCodePoint(_class)


def _byte_characters() -> np.ndarray:
    """Byte-level vocabularies write each byte as a character: printable ones as themselves, the others, in order, from 256 on."""
    out = np.arange(256, dtype=np.uint32)
    printable = ((out >= 33) & (out < 127)) | ((out >= 161) & (out < 173)) | (out >= 174)
    out[~printable] = 256 + np.arange(256 - printable.sum())
    return out


_BYTES = _byte_characters()
_BETWEEN = chr(_BYTES[0])  # no piece that is merged here holds the byte 0


class Encoder:
    """Ids of texts.  With `special`, as the library does by default, an added token's string in a text is that token; otherwise it is ordinary text."""

    def __init__(self, path: str, special: bool = False, remembered: int = REMEMBERED):
        assert sys.byteorder == "little"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = not special
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()] if special else []  # texts that hold one are encoded whole
        self.known, self.rows, self.remembered = pieces.Table(), pieces.Rows(), remembered

    def _encode(self, some: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(some, add_special_tokens=False)]

    def _merged(self, some: list[str]) -> list[list[int]]:
        """Of pieces that the library doesn't divide: its model merges the bytes, written as the characters that stand for them."""
        if not some:
            return []
        written = _BYTES[np.frombuffer("\0".join(some).encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self.tool.model.tokenize
        return [[t.id for t in tokenize(w)] for w in written.split(_BETWEEN)]

    @staticmethod
    def _borders(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and the characters' classes; `bounds` are the texts' first characters and the end."""
        kind = _classes(points)
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        full = bounds[:-1][bounds[:-1] < bounds[1:]]
        before[full], after[np.append(full[1:], bounds[-1]) - 1] = _EDGE, _EDGE
        white, seen = kind == _WHITE, kind <= _QUOTE
        start = (kind != before) & (before <= _SIGN) & seen & ~((before == _SIGN) & (kind == _QUOTE))  # between classes
        start |= white & ((before <= _QUOTE) | (after <= _QUOTE))  # a run of white space, and the last of it
        start[1:] |= seen[1:] & white[:-1] & (points[:-1] != _SPACE)  # and after a last one that is no space
        start |= before == _EDGE
        return np.flatnonzero(start), kind

    def _learn(self, whole: str, kind: np.ndarray, start: np.ndarray, end: np.ndarray, keys: list[np.ndarray], number: np.ndarray) -> None:
        """Numbers for pieces that have none: those to be remembered first, then those for this stretch only."""
        new = np.flatnonzero(number < 0)
        _, first, again = np.unique(keys[0][new], return_index=True, return_inverse=True)
        at = new[first]
        odd = np.concatenate([[0], np.cumsum((kind == _QUOTE) | (kind == _OTHER))])
        apart = odd[end[at]] == odd[start[at]]
        keep = end[at] - start[at] <= _LONG
        keep &= np.cumsum(keep) <= self.remembered - self.known.count
        order = np.argsort(~keep, kind="stable")
        rank = np.empty(len(at), dtype=np.int64)
        rank[order] = np.arange(len(at))
        at, apart = at[order], apart[order]
        texts = [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        merged, rest = (iter(f([t for t, one in zip(texts, apart.tolist(), strict=True) if one is x])) for f, x in ((self._merged, True), (self._encode, False)))
        ids = [next(merged if one else rest) for one in apart.tolist()]
        number[new] = self.known.count + rank[again]
        self.rows.extend([len(x) for x in ids], [i for x in ids for i in x])
        kept = at[: int(keep.sum())]
        self.known.add(keys[0][kept], keys[1][kept])

    def _stretch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, joined, and where each text's begin (with the end of the last)."""
        whole = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not whole:
            return np.zeros(0, dtype=np.int32), np.zeros(len(bounds), dtype=np.int64)
        points = pieces.code_points(whole)
        start, kind = self._borders(points, bounds)
        end = np.append(start[1:], len(points))
        keys = pieces.keys(points, start, end)
        number = self.known.find(*keys).astype(np.int64)
        if (number < 0).any():
            self._learn(whole, kind, start, end, keys, number)
        ids, at = self.rows.take(number)
        self.rows.truncate(self.known.count)
        return ids, at[np.searchsorted(start, bounds)]

    def arrays(self, texts: list[str | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids (32-bit) of all texts, joined, and where each text's begin (with the end of the last); None is an empty text, `end` appends id 0 to each."""
        n, parts = np.zeros(len(texts), dtype=np.int64), []
        whole = {i for i, t in enumerate(texts) if t and any(x in t for x in self.added)}
        for some, of in pieces.chunks([None if i in whole else t for i, t in enumerate(texts)] if whole else texts):
            ids, at = self._stretch(some)
            np.add.at(n, of, np.diff(at))
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        bounds = np.concatenate([[0], np.cumsum(n)])
        for i in sorted(whole, reverse=True):
            got = self._encode([texts[i]])[0]
            ids = np.concatenate([ids[: bounds[i]], np.array(got, dtype=np.int32), ids[bounds[i] :]])
            bounds[i + 1 :] += len(got)
        if end:
            ids = np.insert(ids, bounds[1:], np.int32(0))
            bounds += np.arange(len(bounds))
        return ids, bounds

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, bounds = self.arrays(texts)
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER, special: bool = False) -> Encoder:
    """One per Python worker, which Spark keeps between tasks."""
    return Encoder(public_tokenizers.path(name), special)
