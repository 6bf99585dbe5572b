"""URL filters: all glob rules at once by a bit-parallel automaton (Shift-And).

A rule is a glob over the host and one over the path; `*` stands for any run of characters.  A canonical URL is the symbols
START, '.', host, SLASH, path, END (START, SLASH and END are no bytes, so a host's wildcard can't run into the path).
Every rule's literals are packed, rule after rule, into 64-bit words; bit i of the state says that literal i has just
been matched.  One step of a symbol c is

    state = (state << 1, carried over words) & mask[c]  |  state & star & not at SLASH or END

and a rule has matched once its last bit is set.  NumPy makes the step for all URLs of a batch together.

Host rules such as example.org/en/ fit the host and its subdomains if the path starts with theirs; the longest that fits decides.
Where none fits, any matching block glob blocks, else the URL is allowed.

Defined results: null URLs and those without :// have empty host and path, which no host rule fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SLASH, END, PAD = 256, 257, 258, 259
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host and path, verdict)
HOST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: (host glob, path glob) that block where no host rule fits
BLOCK_GLOBS = (("*", "*/track/*"), ("*", "*/login*"), ("*", "*.exe"), ("ads.*", "*"), ("*", "*/tag/*/page/*"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class Globs:
    """The automaton of rules, each a list of symbols in which None is `*`."""

    def __init__(self, rules: list[list[int | None]]):
        bits = sum(x is not None for r in rules for x in r)
        self.words = max(1, -(-bits // 64))
        self.mask = np.zeros((PAD + 1, self.words), dtype=np.uint64)
        self.star, self.last = np.zeros(self.words, dtype=np.uint64), []
        at = -1
        for r in rules:
            for x in r:
                if x is None:
                    self.star[at // 64] |= np.uint64(1 << at % 64)
                else:
                    at += 1
                    self.mask[x, at // 64] |= np.uint64(1 << at % 64)
            self.last.append(at)

    def match(self, urls: list[np.ndarray]) -> np.ndarray:
        return self.match_joined(np.concatenate([np.zeros(0, dtype=np.int64), *urls]), np.concatenate([[0], np.cumsum([len(u) for u in urls], dtype=np.int64)]))

    def match_joined(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each sequence of symbols (they are joined; `bounds` has where each begins, and the end), which rules match it.

        Sequences of about the same length are stepped through together, so that a very long one holds up no other.
        """
        lengths = np.diff(bounds)
        done = np.zeros((len(lengths), self.words), dtype=np.uint64)
        size = np.ceil(np.log2(np.maximum(lengths, 1)))
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            done[at] = self._steps(symbols, bounds[at], lengths[at])
        last = np.array(self.last, dtype=np.int64)
        return (done[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1) > 0

    def _steps(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        state, done = (np.zeros((len(starts), self.words), dtype=np.uint64) for _ in range(2))
        for t in range(int(lengths.max())):
            symbol = np.where(t < lengths, symbols[np.minimum(starts + t, len(symbols) - 1)], PAD)
            if t == 0:
                state = self.mask[symbol]  # the first literal of every rule is START, and no other is
            else:
                moved = state << np.uint64(1)
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
                state = moved & self.mask[symbol] | np.where((symbol < START)[:, None], state & self.star, np.uint64(0))
            done |= state
        return done


def url_symbols(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """START, '.', host, SLASH, path, END of each URL, joined, and where each begins (with the end of the last)."""
    h, p = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (hosts, paths))
    bounds = np.concatenate([[0], np.cumsum(h + p + 4)])
    out = np.empty(bounds[-1], dtype=np.int64)
    out[bounds[:-1]], out[bounds[:-1] + 1], out[bounds[:-1] + 2 + h], out[bounds[1:] - 1] = START, ord("."), SLASH, END
    for part, n, first in ((hosts, h, bounds[:-1] + 2), (paths, p, bounds[:-1] + 3 + h)):
        before = np.cumsum(n) - n
        out[np.repeat(first - before, n) + np.arange(n.sum())] = np.frombuffer(b"".join(part), dtype=np.uint8)
    return out, bounds


def _symbols(glob: str) -> list[int | None]:
    out: list[int | None] = []
    for k, part in enumerate(glob.split("*")):
        out += [None] * (k > 0) + list(part.encode())
    return out


def host_rule(rule: str) -> list[int | None]:
    host, path = rule.split("/", 1)
    return [START, None, *_symbols("." + host), SLASH, *b"/", *path.encode()]


def block_glob(host: str, path: str) -> list[int | None]:
    return [START, *b".", *_symbols(host), SLASH, *_symbols(path), END]


def judge(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` without `url`, with host, path, rule, verdict and the number of block globs that match; row by row."""
    host, path = host_and_path(F.col(url))
    new = ["host", "path", "rule", "verdict", "n_globs"]
    keep = [c for c in df.columns if c not in (url, *new)]
    rows = df.select(*keep, host.alias("host"), path.alias("path"))
    tool = Globs([host_rule(r) for r, _ in HOST_RULES] + [block_glob(*g) for g in BLOCK_GLOBS])
    by_length = sorted(range(len(HOST_RULES)), key=lambda k: -len(HOST_RULES[k][0]))
    schema = T.StructType([*rows.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("n_globs", T.IntegerType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.names.index
            hosts, paths = ([x.encode("utf-8", "replace") for x in b.column(at(c)).to_pylist()] for c in ("host", "path"))
            found = tool.match_joined(*url_symbols(hosts, paths))
            rules, verdicts = [], []
            n = found[:, len(HOST_RULES) :].sum(1)
            for i in range(len(hosts)):
                k = next((k for k in by_length if found[i, k]), None)
                rules.append(None if k is None else HOST_RULES[k][0])
                verdicts.append(HOST_RULES[k][1] if k is not None else "block" if n[i] else "allow")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(n, pa.int32())], [f.name for f in schema])

    return rows.mapInArrow(batches, schema)


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
j AS (SELECT *,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  CAST(contains(path, '/track/') AS INTEGER) + CAST(contains(path, '/login') AS INTEGER) + CAST(ends_with(path, '.exe') AS INTEGER)
    + CAST(starts_with(host, 'ads.') AS INTEGER) + CAST(path LIKE '%/tag/%/page/%' AS INTEGER) AS n_globs FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN n_globs > 0 THEN 'block' ELSE 'allow' END AS verdict,
  n_globs FROM j
"""
