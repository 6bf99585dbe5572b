"""Quality score from compressed sizes.

Two zstandard raw-content dictionaries are built from texts labelled good and bad.  A text's score comes from the normalised difference of
its compressed sizes under the two, with the plain compressed size (no dictionary) as the norm: of the whole text, and the least and the largest of
its pieces.  Nothing else is looked at, neither length nor how well a text compresses by itself.  A logistic calibration turns these differences into
the probability of label 1.

Fitting uses a bounded sample: at most SAMPLE_ROWS texts a label, whole ones.  One half of it makes the dictionaries, of DICT_BYTES at most, to which
each text gives stretches over its whole length; the other half, scored with them, makes the calibration.  Scoring reads whole texts.

Defined results: null and empty texts have no pieces and the differences zero, so all get one score between
0 and 1; with no label 0 or no label 1 in the sample every score is the share of label 1 (0.5 without labels).
Repeated label rows of a document count once each; null labels don't count.  A column that has the name of the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normwerk.llm.compressors import Sizes, raw_dictionary, sample_per_label

SAMPLE_ROWS = 1000
DICT_BYTES = 1 << 20
PIECE = 1024


def features(sizes: np.ndarray) -> np.ndarray:
    """Of one text: sizes has a row per piece with bytes, plain, good and bad compressed size."""
    if not len(sizes):
        return np.zeros(3)
    total, each = sizes.sum(0), (sizes[:, 3] - sizes[:, 2]) / sizes[:, 1]
    return np.array([(total[3] - total[2]) / total[1], each.min(), each.max()])


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products, and a constant."""
    n = x.shape[1]
    cross = [x[:, i] * x[:, j] for i in range(n) for j in range(i, n)]
    return np.column_stack([np.ones(len(x)), x, *cross])


class Calibration:
    """Ridge logistic regression by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = self._matrix(x)
        w = np.zeros(a.shape[1])
        w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _matrix(self, x: np.ndarray) -> np.ndarray:
        return _expand(np.clip((x - self.mean) / self.scale, -4, 4))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._matrix(x) @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """A model from documents (doc_id, text) and labels (doc_id, quality: 0 or 1, others ignored)."""
    labelled = docs.select("doc_id").join(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct(), "doc_id")
    sample = sample_per_label(docs, labelled, "quality", rows)
    good, bad = sample.get("1", []), sample.get("0", [])
    if len(good) < 4 or len(bad) < 4:
        return {"constant": len(good) / (len(good) + len(bad)) if good or bad else 0.5}
    counts = labelled.groupBy("quality").count().collect()
    n = {r["quality"]: r["count"] for r in counts}
    dictionaries = [b"", raw_dictionary(good[::2], DICT_BYTES), raw_dictionary(bad[::2], DICT_BYTES)]
    tool = Sizes(dictionaries, PIECE)
    x = np.array([features(tool.of(t)) for t in good[1::2] + bad[1::2]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    shift = np.log(n[1] / max(1, n[0])) - np.log(y.sum() / (len(y) - y.sum()))  # the sample is balanced, the corpus isn't
    return {"dictionaries": dictionaries, "calibration": Calibration(x, y), "shift": float(shift)}


def score(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with `out`, the probability that a text's label is 1; only `text` is looked at."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    sent = df.sparkSession.sparkContext.broadcast(model)  # 2 MB; once an executor, not once a task

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tool = None if "constant" in model else Sizes(model["dictionaries"], PIECE)
        for b in it:
            texts = b.column(b.schema.names.index(text)).to_pylist()
            if tool is None or not texts:
                p = np.full(len(texts), model.get("constant", 0.5))
            else:
                p = model["calibration"](np.array([features(tool.of(t or "")) for t in texts]))
                odds = np.log(p / (1 - p)) + model["shift"]
                p = 1 / (1 + np.exp(-odds))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, out])

    return df.mapInArrow(batches, schema)
