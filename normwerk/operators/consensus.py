"""Reconciling what several models have found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_consensus(votes: DataFrame) -> DataFrame:
    """request_id, type, label (normalised), models: how many models report it."""
    norm = F.lower(F.trim(F.regexp_replace("label", r"(?U)\s+", " ")))
    return votes.groupBy("request_id", "type", norm.alias("label")).agg(F.countDistinct("model").alias("models"))


def levels(consensus: DataFrame, of: int = 3) -> DataFrame:
    """request_id: candidates, high (all models), medium (two), low (one), disagreement rate."""
    n = lambda c: F.count_if(c)
    m = F.col("models")
    return consensus.groupBy("request_id").agg(F.count("*").alias("candidates"), n(m >= of).alias("high"), n((m >= 2) & (m < of)).alias("medium"), n(m == 1).alias("low"), F.round(n(m < of) / F.count("*"), 6).alias("disagreement"))


def position_consensus(votes: DataFrame, within: float = 10.0) -> DataFrame:
    """Pairs of elements of one request and type that two models see within `within` percent points in both coordinates.

    Positions fall into cells of that width; only the same and the adjacent cells are joined, on equal keys, and then measured.
    """
    cell = lambda c: F.floor(F.col(c) / within)
    v = votes.withColumns({"_cx": cell("x"), "_cy": cell("y")})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = v.withColumn("_d", near).select("request_id", "type", (F.col("_cx") + F.col("_d.i")).alias("_cx"), (F.col("_cy") + F.col("_d.j")).alias("_cy"), F.col("model").alias("model_b"), F.col("element").alias("element_b"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    j = v.join(spread, ["request_id", "type", "_cx", "_cy"]).filter((F.col("model") < F.col("model_b")) & (F.abs(F.col("x") - F.col("_x")) <= within) & (F.abs(F.col("y") - F.col("_y")) <= within))
    return j.select("request_id", "type", F.col("model").alias("model_a"), F.col("element").alias("element_a"), "model_b", "element_b")


def majority(votes: DataFrame, field: str) -> DataFrame:
    """request_id and the value that most models give; of equally frequent ones the longest, then the last by order."""
    n = votes.filter(F.col(field).isNotNull()).groupBy("request_id", field).agg(F.countDistinct("model").alias("n"))
    return n.groupBy("request_id").agg(F.max_by(field, F.struct("n", F.length(field), field)).alias(field), F.max("n").alias("n"))


def unanimous(votes: DataFrame, models: list[str], columns: list[str]) -> DataFrame:
    """Rows that every model has: the models' intersection, from one pass."""
    n = votes.filter(F.col("model").isin(*models)).groupBy(*columns).agg(F.countDistinct("model").alias("_n"))
    return n.filter(F.col("_n") == len(set(models))).drop("_n")


def degraded(parsed: DataFrame, of: int = 3) -> DataFrame:
    """request_id, ok_count, degraded, failed from rows (request_id, ok)."""
    n = F.count_if("ok")
    return parsed.groupBy("request_id").agg(n.alias("ok_count"), (n < of).alias("degraded"), (n == 0).alias("failed"))
