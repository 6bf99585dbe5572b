"""Compressed sizes of texts under several zstandard dictionaries.

Texts are cut into pieces of `piece` bytes, all of which are compressed, each on its own: in one long frame a
text would soon be its own dictionary and the given ones would count for nothing.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 6  # below it zstandard looks for matches so quickly that it misses short ones
STRETCH = 256
#: More labels than these (times the sample's rows a label, so many texts come to the driver) are taken for a mistake.
MAX_LABELS = 500


def sample_per_label(docs: DataFrame, ids: DataFrame, label: str, rows: int) -> dict[str, list[str]]:
    """The whole texts of at most `rows` documents of each label: those whose ids have the smallest hash.

    `ids` has doc_id and `label`, `docs` has doc_id and text.  From the number of ids of each label follows a hash below which more than
    `rows` of them are, but not many more; those alone are brought together, and the choice is made among them.  What is chosen is bounded
    by `rows` and MAX_LABELS, so it can be broadcast to fetch the texts.  Null ids and labels and empty texts don't count; of several texts with
    one id, the least is taken.
    """
    h = F.xxhash64("doc_id")
    labelled = ids.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("string").alias("_label"), h.alias("_h"))
    counts = labelled.groupBy("_label").agg(F.approx_count_distinct("doc_id").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} values of {label}")
    if not counts:
        return {}
    # of 2^64 hashes, the share that holds twice `rows` of a label and some more: fewer than `rows` are out of the question
    below = {r["_label"]: min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, (2 * rows + 64) / max(1, r["n"])))) for r in counts}
    bound = F.create_map(*[F.lit(x) for k, v in below.items() for x in (k, v)])
    few = sorted({(r["_label"], r["_h"], r["doc_id"]) for r in labelled.filter(F.col("_h") <= bound[F.col("_label")]).distinct().collect()})
    chosen: dict[str, list[int]] = {}
    for k, _, i in few:
        if len(chosen.setdefault(k, [])) < rows:
            chosen[k].append(i)
    place = [(k, i, n) for k, some in chosen.items() for n, i in enumerate(some)]
    some = docs.sparkSession.createDataFrame(place, f"_label string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, _n int")
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(some), "doc_id").groupBy("_label", "_n").agg(F.min("text").alias("_text"))
    out: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["_label"], r["_n"])):
        out.setdefault(r["_label"], []).append(r["_text"])
    return out


def raw_dictionary(texts: list[str], size: int) -> bytes:
    """Raw content of at most `size` bytes, to which every text gives: the whole of it, or an equal share in stretches at even distances over its whole length."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    left, share = size, size
    for n, b in enumerate(sorted(raw, key=len)):  # what short texts leave goes to the others
        share = left // (len(raw) - n)
        if len(b) >= share:
            break
        left -= len(b) + 1
    parts = []
    for b in raw:
        if len(b) < share:
            parts.append(b)
            continue
        n = max(1, share // (STRETCH + 1))
        cut = max(1, share // n - 1)
        parts += [b[i * (len(b) - cut) // max(1, n - 1) :][:cut] for i in range(n)]
    return b"\n".join(parts)[:size]


class Sizes:
    """Compressed sizes under each dictionary; an empty dictionary stands for none."""

    def __init__(self, dictionaries: list[bytes], piece: int, level: int = LEVEL):
        self.piece, self.tools = piece, []
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        for raw in dictionaries:
            if len(raw) < 8:
                self.tools.append(zstandard.ZstdCompressor(level=level, **plain))
                continue
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(level=level, dict_data=d, **plain))

    def of(self, text: str) -> np.ndarray:
        """A row per piece: its bytes, then its compressed bytes under each dictionary."""
        raw = text.encode("utf-8", "replace")
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        return np.array([(len(p), *(len(t.compress(p)) for t in self.tools)) for p in pieces], dtype=np.float64).reshape(len(pieces), 1 + len(self.tools))
