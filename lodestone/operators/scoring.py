"""Scores of pairs, their rollups, gates and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def support_score(row: dict[str, Column], unknown: float, refusal: float) -> Column:
    """First of: supports 1, rejects -1, doesn't know, refuses; else 0."""
    return F.when(row["supports_true_claim"], 1.0).when(row["rejects_true_claim"], -1.0).when(row["says_unknown"], -unknown).when(row["refuses"], -refusal).otherwise(0.0)


def correction_score(row: dict[str, Column], unknown: float, refusal: float) -> Column:
    """First of: corrects 1, rejects 0.5, accepts -1, doesn't know, refuses; else 0."""
    return (
        F.when(row["corrects_to_original"], 1.0).when(row["rejects_counterfactual"], 0.5).when(row["accepts_counterfactual"], -1.0)
        .when(row["says_unknown"], -unknown).when(row["refuses"], -refusal).otherwise(0.0)
    )


def acceptance_penalty(row: dict[str, Column], penalty: float) -> Column:
    return F.when(row["accepts_counterfactual"], penalty).otherwise(0.0)


def pair_score(support: Column, correction: Column, penalty: Column) -> Column:
    """A side that is missing counts 0."""
    zero = F.lit(0.0)
    return F.coalesce(support, zero) + F.coalesce(correction, zero) - F.coalesce(penalty, zero)


def rollup(pairs: DataFrame, chunk: str, source: str, score: str) -> DataFrame:
    """source, n_chunks, n_pairs, score: the mean over chunks of the mean over pairs, each level weighing its members alike
    (rounded with a nudge, so that exact halves go up whatever the order of summing)."""
    chunks = pairs.groupBy(source, chunk).agg(F.count("*").alias("n"), F.avg(score).alias("c"))
    return chunks.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_pairs"), F.round(F.avg("c") + 1e-9, 6).alias("score"))


def weighted_mean(weight: Column, value: Column) -> Column:
    """Aggregate: weights below 0 count as 0; null without any weight."""
    w = F.greatest(weight, F.lit(0.0))
    return F.try_divide(F.sum(w * value), F.sum(w))


def knapsack(items: DataFrame, budget: int) -> DataFrame:
    """source, items, spent: in order of item, those that still fit. A source's items are one small array."""
    rows = items.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("item", "cost"))).alias("own"))
    empty = F.struct(F.array().cast("array<bigint>").alias("items"), F.lit(0).cast("bigint").alias("spent"))
    fits = lambda acc, x: F.when(acc["spent"] + x["cost"] <= budget, F.struct(F.array_append(acc["items"], x["item"]).alias("items"), (acc["spent"] + x["cost"]).alias("spent"))).otherwise(acc)
    return rows.select("source", F.aggregate("own", empty, fits).alias("x")).select("source", "x.items", "x.spent")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A row of violations: keys of one side only, repeated keys."""
    a, b = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((left, "n"), (right, "m")))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("n").isNull()).alias("right_only"), F.count_if(F.col("m").isNull()).alias("left_only"), F.count_if((F.col("n") > 1) | (F.col("m") > 1)).alias("repeated"))


def overlapping(spans: DataFrame, within: str, key: str, start: str, end: str) -> DataFrame:
    """left_key, right_key of spans in the same group that overlap."""
    x, y = spans.alias("x"), spans.alias("y")
    met = (F.col(f"x.{within}") == F.col(f"y.{within}")) & (F.col(f"x.{key}") < F.col(f"y.{key}")) & (F.col(f"x.{start}") < F.col(f"y.{end}")) & (F.col(f"y.{start}") < F.col(f"x.{end}"))
    return x.join(y, met).select(F.col(f"x.{key}").alias("left_key"), F.col(f"y.{key}").alias("right_key"))


def coverage_gate(opportunities: DataFrame, valid: DataFrame) -> DataFrame:
    """Types with 20 opportunities or more need min(20, max(3, 2 %)) valid pairs."""
    both = opportunities.join(valid, "type", "full_outer").na.fill(0, ["opportunities", "valid"])
    required = F.when(F.col("opportunities") >= 20, F.least(F.lit(20), F.greatest(F.lit(3), F.ceil(F.col("opportunities") * 0.02)))).otherwise(0)
    return both.select("type", "opportunities", "valid", required.cast("long").alias("required"), (F.col("valid") >= required).alias("passed"))
