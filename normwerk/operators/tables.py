"""Upserts, change detection, validation and other work on whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normwerk.sources.shared import stored


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _matched(old: DataFrame, new: DataFrame, key: str, how: str = "full_outer") -> DataFrame:
    """Old rows and the new ones with their key, whose columns begin with `_n_`; null keys are one key, as any other value is."""
    n = new.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    return old.join(n, F.col(key).eqNullSafe(F.col("_key")), how).withColumn(key, F.coalesce(key, "_key"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Incoming rows replace all columns of the old row with their key (null is a key too), nulls included, but for the columns named.  Keys are distinct on either side."""
    pick = lambda c: F.when(F.col("_new"), F.coalesce(f"_n_{c}", c) if c in keep_if_null else F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return _matched(old, new, key).select(key, *[pick(c) if c in new.columns else F.col(c) for c in old.columns if c != key])


def upsert_coalescing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Incoming values that aren't null replace the old ones."""
    return _matched(old, new, key).select(key, *[F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key])


def upsert_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: inserted, updated."""
    both = _matched(new.select(key).distinct(), old.select(key).distinct(), key, "left")
    return both.agg(F.count_if(F.col("_new").isNull()).alias("inserted"), F.count_if(F.col("_new").isNotNull()).alias("updated"))


def unchanged_skipped(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` whose keys (id and content hash, say) aren't in `old`."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def changed(df: DataFrame, old: str, new: str, skip_existing: bool = False) -> DataFrame:
    """Rows whose new value differs from the old one, nulls compared too; `skip_existing` keeps old values that aren't empty."""
    out = df.filter(~F.col(old).eqNullSafe(F.col(new)))
    return out.filter(F.coalesce(F.col(old), F.lit("")) == "") if skip_existing else out


def optional_filters(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters; None filters nothing."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def reasons(rules: Iterable[tuple[str, Column]]) -> Column:
    """Array of the names of broken rules; a rule is (name, condition that is true when broken)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]))


def outside(column: str, allowed: Sequence[str], nullable: bool = False) -> tuple[str, Column]:
    c = F.col(column)
    return f"{column}_not_allowed", ~c.isin(*allowed) if nullable else c.isNull() | ~c.isin(*allowed)


def missing(column: str) -> tuple[str, Column]:
    return f"{column}_missing", F.col(column).isNull()


def validated(df: DataFrame, rules: Iterable[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with `reasons`."""
    marked = df.withColumn("reasons", reasons(rules))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def with_defaults(df: DataFrame, **defaults: object) -> DataFrame:
    """Declared defaults in place of nulls and of columns that are missing."""
    for name, value in defaults.items():
        v = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(name, F.coalesce(F.col(name), v) if name in df.columns else v)
    return df


def day_spine(first: str, last: str, spark) -> DataFrame:
    """One row per day, `day`."""
    return spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")


def running_sum(df: DataFrame, value: str, order: list[Column], out: str, least: bool = False) -> DataFrame:
    """`df` with `out`, the sum of `value` (or its least value) over the rows up to each in the order of all.

    Rows go to ranges of the order, are summed inside their range, and start from the total of the ranges before; of these there is one row each.  The ranges
    are stored, so that they are the same for both.
    """
    total = F.min if least else F.sum
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(total(value).alias("_s")).select("_range", total("_s").over(before).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = F.least("_own", "_base") if least else F.col("_own") + F.coalesce("_base", F.lit(0))
    return ranged.withColumn("_own", total(value).over(inside)).join(bases, "_range").select(*df.columns, both.alias(out))


def numbered(df: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """`df` with `out`, the number from 1 of each row among those of its key (not null), by `order`.

    Rows go to ranges of key and order, so a key that a third of all rows have is numbered in many; each range starts from the counts of the ranges before.
    """
    ranged = stored(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a key lies in
    bases = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range", key).orderBy(*order)
    return ranged.withColumn("_own", F.row_number().over(inside)).join(bases, [key, "_range"]).select(*df.columns, (F.col("_own") + F.col("_base")).alias(out))
