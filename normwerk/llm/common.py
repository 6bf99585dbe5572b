"""What the operators of this subpackage share: shared-folder tables and row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normwerk.sources.shared import clean_up, new_path, shared_dir, stored

__all__ = ["clean_up", "crc_of_id", "new_path", "row_key", "shared_dir", "stored", "text_or_empty"]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def row_key(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes of the columns, never null: a 128-bit key that also works for null and repeated ids."""
    return [
        F.xxhash64(F.lit(salt), *columns, *[F.col(c).isNull() for c in columns]).alias(name)
        for salt, name in ((11, "_k1"), (23, "_k2"))
    ]
