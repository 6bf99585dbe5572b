"""License scans: phrases, and templates of whole licences and notices with optional and replaceable regions.

A template is words with [[optional words]] and {{least,most}}, a region that any words may fill.  It is compiled
into a nondeterministic automaton over words; a text matches where its words run through it from the first to the last, so mandatory words must match exactly,
in order, with nothing else between.  The automaton starts only at places where the template's first words (up to the first region, ANCHOR at most) stand, which
are found in the joined words at the speed of a byte search.

Defined results: null and empty texts have no words, no labels (empty strings) and score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from normwerk.llm.license_texts import LICENSES


# Phrases whose label is given
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Wording of common notices
TEMPLATES = (
    ("apache-notice", "licensed under [[the]] apache license [[version]] 2 0 [[the license]]"),
    ("mit-notice", "released under [[the terms of]] the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this {{1,6}} to deal in the software without restriction"),
    ("gpl-notice", "licensed under the gnu [[lesser]] [[affero]] general public license [[version 2]] [[version 3]]"),
    ("gpl-grant", "you can redistribute it and or modify it under the terms of the gnu {{1,3}} license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-notice", "licensed under [[a]] [[the]] [[creative commons]] cc by [[nc]] [[sa]] [[nd]] {{0,1}}"),
    ("copyright-reserved", "copyright {{1,12}} all rights reserved"),
)

ANCHOR = 6
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters (lower-cased) and digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class Template:
    """`step[state]` is a list of (word or None for any, next state); `skip[state]` are states reached without a word."""

    def __init__(self, label: str, markup: str):
        self.label, self.step, self.skip = label, [], []
        at, first, certain = self._state(), [], True
        for part in re.split(r"(\[\[.*?\]\]|\{\{\d+,\d+\}\})", markup, flags=re.DOTALL):
            if part.startswith("[["):
                here = at
                for w in words_of(part[2:-2]):
                    at = self._word(at, w)
                self.skip[here].append(at)
            elif part.startswith("{{"):
                least, most = map(int, part[2:-2].split(","))
                loose = []
                for k in range(most):
                    if k >= least:
                        loose.append(at)
                    at = self._word(at, None)
                for x in loose:
                    self.skip[x].append(at)
            else:
                for w in words_of(part):
                    at = self._word(at, w)
                    if certain and len(first) < ANCHOR:
                        first.append(w)
                continue
            certain = False
        self.end = at
        self.start = self._closed({0})
        self.anchor = b" %s " % b" ".join(first)

    def _state(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        new = self._state()
        self.step[at].append((word, new))
        return new

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def at(self, words: list[bytes], place: int) -> bool:
        """Whether the words from `place` on run through the automaton."""
        states = self.start
        while states:
            if self.end in states:
                return True
            if place == len(words):
                return False
            w = words[place]
            states = self._closed({n for s in states for x, n in self.step[s] if x is None or x == w})
            place += 1
        return False


def _places(line: bytes, needle: bytes) -> Iterator[int]:
    """Numbers of the words at which `needle` (which begins with a space) stands; `line` is the words, a space before and after each."""
    at, counted, word = line.find(needle), 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        yield word
        at = line.find(needle, at + 1)


COMPILED = tuple(Template(*t) for t in TEMPLATES + LICENSES)


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES:
        found = list(_places(line, b" %s " % phrase.encode()))
        places += found
        if found:
            base.add(label)
    labels = base | {t.label for t in COMPILED if any(t.at(words, p) for p in _places(line, t.anchor))}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5 ** len(labels)


OUT = (("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()), ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` without `text`, with the columns of OUT; row by row, whole texts."""
    new = [n for n, _, _ in OUT]
    keep = [f for f in df.schema.fields if f.name not in (text, *new)]
    schema = T.StructType(keep + [T.StructField(n, t) for n, t, _ in OUT])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.names.index
            got = [scan_text(t) for t in b.column(at(text)).to_pylist()]
            columns = [b.column(at(f.name)) for f in keep] + [pa.array([g[i] for g in got], kind) for i, (_, _, kind) in enumerate(OUT)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return df.mapInArrow(batches, schema)
