"""Distributions of a value by group: summaries, histograms, ECDFs and Kolmogorov-Smirnov distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bins import left_closed
from ..functions.ks import ks_p
from .order import quantiles


def summarize(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, std (0 of one row), min, max, p90, p95, p99 by groups; percentiles are exact, with linear interpolation, and found over counted ranges of values."""
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    found = quantiles(df, value, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, *by).withColumnsRenamed({b: f"_q{i}" for i, b in enumerate(by)})
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_q{i}")) for i, b in enumerate(by)), F.lit(True))
    return out.join(found, same).select(*by, "n", "mean", "median", "std", "min", "max", "p90", "p95", "p99")


def non_null_counts(df: DataFrame, *by: str) -> DataFrame:
    """Of each group and each other column, how many values aren't missing."""
    return df.groupBy(*by).agg(*(F.count(c).alias(c) for c in df.columns if c not in by))


def top(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows by an order, with their rank from 1: a report of a few rows, not a way to sort a table (``order.numbered``)."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def histogram(df: DataFrame, group: str, value: str, width: int) -> DataFrame:
    """(<group>, bin_lo, n, density): counts and density over common intervals."""
    by = df.where(F.col(value).isNotNull()).groupBy(group, left_closed(value, width).alias("bin_lo")).agg(F.count("*").alias("n"))
    total = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("_all"))
    return by.join(total, group).select(group, "bin_lo", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """(<group>, x, n, f): each different value, its rows and the share of rows up to it.

    Rows are counted by value first, so the window runs over different values only.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("x")).agg(F.count("*").alias("n"))
    up = W.partitionBy(group).orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return by.select(group, "x", "n", (F.sum("n").over(up) / F.sum("n").over(W.partitionBy(group))).alias("f"))


def ks_pairwise(df: DataFrame, group: str, value: str, p: bool = False) -> DataFrame:
    """(A, B, n_a, n_b, KS_D[, p_value]) for all pairs A < B: the greatest distance of two groups' ECDFs.

    Each pair is laid out over the values of either group; shares carry on as running counts.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("x")).agg(F.count("*").alias("n"))
    size = by.groupBy("g").agg(F.sum("n").alias("n"))
    a, b = (size.select(F.col("g").alias(x), F.col("n").alias(f"n_{x.lower()}")) for x in "AB")
    pairs = a.join(b, F.col("A") < F.col("B"))  # groups, not rows
    each = by.join(pairs, (F.col("g") == F.col("A")) | (F.col("g") == F.col("B")))
    grid = each.groupBy("A", "B", "n_a", "n_b", "x").agg(F.sum(F.when(F.col("g") == F.col("A"), F.col("n")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("g") == F.col("B"), F.col("n")).otherwise(0)).alias("_b"))
    up = W.partitionBy("A", "B").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    d = F.abs(F.sum("_a").over(up) / F.col("n_a") - F.sum("_b").over(up) / F.col("n_b"))
    out = grid.withColumn("_d", d).groupBy("A", "B", "n_a", "n_b").agg(F.max("_d").alias("KS_D"))
    return out.withColumn("p_value", ks_p("KS_D", "n_a", "n_b")) if p else out
