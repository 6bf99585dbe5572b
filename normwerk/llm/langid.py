"""Language by compression: the language whose raw-content dictionary compresses a text smallest.

Fitting reads a bounded sample: at most SAMPLE_ROWS whole texts a language.  Each gives to the language's dictionary stretches over its whole length.
Prediction reads whole texts, in pieces of PIECE bytes whose sizes are added up.

Defined results: a null text and one without a letter get `und`, score 0 and are rejected.  Where two languages
compress a text equally, the one with more sampled characters wins, then the first by name.  A text is rejected if the second best
language needs less than MIN_MARGIN_BYTES more than the best, or less than MIN_MARGIN of the best size, however short it is: so are most texts of a word or
two.  With a single language to learn from nothing is narrow; without any, all texts get `und`.  Columns that have the names of the outputs are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from normwerk.llm.compressors import Sizes, raw_dictionary, sample_per_label

SAMPLE_ROWS = 200
DICT_BYTES = 112_640
PIECE = 1024
LEVEL = 6  # below it zstandard looks for matches so quickly that it misses short ones: 0.97 of long texts are right instead of 0.999
MIN_MARGIN_BYTES = 1
MIN_MARGIN = 0.002
_LETTER = regex.compile(r"\p{L}")


def _canonical(text: str) -> str:
    return f" {unicodedata.normalize('NFC', text).lower()} "


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes]]:
    """(language, dictionary), most sampled first, from doc_id, text and lang; null languages don't count."""
    sample = sample_per_label(labelled, labelled.select("doc_id", "lang"), "lang", rows)
    order = sorted(sample, key=lambda k: (-sum(map(len, sample[k])), k))
    return [(k, raw_dictionary([_canonical(t) for t in sample[k]], DICT_BYTES)) for k in order]


def predict(df: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """`df` with lang_pred, score (0 to 1: one half to the power of the margin in bytes, from one) and rejected; only `text` is looked at."""
    df = df.drop("lang_pred", "score", "rejected")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *fields])
    names = [k for k, _ in model]

    def one(tool: Sizes, t: str | None) -> tuple[str, float, bool]:
        if not t or not names or not _LETTER.search(t):
            return "und", 0.0, True
        sizes = tool.of(_canonical(t)).sum(0)[1:]
        best = int(np.argmin(sizes))
        if len(names) == 1:
            return names[0], 1.0, False
        margin = float(np.partition(sizes, 1)[1] - sizes[best])
        return names[best], 1 - 0.5 ** min(margin, 60.0), margin < max(MIN_MARGIN_BYTES, MIN_MARGIN * sizes[best])

    sent = df.sparkSession.sparkContext.broadcast([d for _, d in model])  # once an executor, not once a task

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Sizes(sent.value, PIECE, LEVEL)
        for b in it:
            got = [one(tool, t) for t in b.column(b.schema.names.index(text)).to_pylist()]
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "lang_pred", "score", "rejected"])

    return df.mapInArrow(batches, schema)
