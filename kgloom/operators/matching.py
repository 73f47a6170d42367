"""Hard matching: equally many rows of every group in each interval of a value, drawn by a seeded hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bins import interval, left_closed


def histogram(df: DataFrame, group: str, value: str, width: int) -> DataFrame:
    """(bin_lo, <group>, n): rows of each group in each interval that has any."""
    return df.where(F.col(value).isNotNull()).groupBy(left_closed(value, width).alias("bin_lo"), group).agg(F.count("*").alias("n"))


def targets(df: DataFrame, group: str, value: str, width: int) -> DataFrame:
    """(bin_lo, bin_interval, target): the least number of rows that a group has in an interval in which all have some."""
    groups = df.where(F.col(value).isNotNull()).agg(F.countDistinct(group).alias("_groups"))
    by = histogram(df, group, value, width).groupBy("bin_lo").agg(F.min("n").alias("target"), F.count("*").alias("_held"))
    return by.join(F.broadcast(groups), F.col("_held") == F.col("_groups")).select("bin_lo", interval("bin_lo", width).alias("bin_interval"), "target")


def match_histogram(df: DataFrame, group: str, value: str, width: int, groups: list[str]) -> DataFrame:
    """(bin_lo, bin_interval, one column a group, target): the counts side by side, 0 where a group has none."""
    wide = histogram(df, group, value, width).groupBy("bin_lo").pivot(group, groups).agg(F.first("n")).na.fill(0, groups)
    least = F.least(*groups) if len(groups) > 1 else F.col(groups[0])
    return wide.withColumn("target", least).where("target > 0").withColumn("bin_interval", interval("bin_lo", width)).select("bin_lo", "bin_interval", *groups, "target")


def hard_match(df: DataFrame, group: str, key: str, value: str, width: int, seed: int = 42) -> DataFrame:
    """Rows of df, of each group and interval those of least md5(seed|key) up to the interval's target; with bin_lo.

    The same rows come out wherever md5 is known, whatever the partitioning.
    """
    goal = targets(df, group, value, width).select("bin_lo", "target")
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    w = W.partitionBy(group, "bin_lo").orderBy(draw, F.col(key))
    rows = df.where(F.col(value).isNotNull()).withColumn("bin_lo", left_closed(value, width)).join(goal, "bin_lo")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r <= target").drop("_r", "target")


def violations(matched: DataFrame, original: DataFrame, group: str, key: str, value: str, width: int) -> DataFrame:
    """(rule, n): how many rows break what a matching promises; n is 0 for each if it holds."""
    dup = matched.groupBy(group, key).agg(F.count("*").alias("n")).where("n > 1")
    goal = targets(original, group, value, width)
    got = histogram(matched, group, value, width)
    uneven = got.join(goal, "bin_lo", "left").where("target is null or n != target")
    total = matched.groupBy(group).agg(F.count("*").alias("n")).agg((F.max("n") - F.min("n")).alias("d"))
    negative = original.where(F.col(value) < 0)
    one = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return one(dup, "duplicate").unionByName(one(uneven, "histogram")).unionByName(one(negative, "negative")).unionByName(total.select(F.lit("totals").alias("rule"), F.coalesce("d", F.lit(0)).cast("long").alias("n")))
