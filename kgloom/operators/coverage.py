"""Which sets of properties many entities share, per group and across groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import kept


def property_coverage(baskets: DataFrame, threshold: int, least: int = 4, most: int = 22) -> DataFrame:
    """baskets (props array) -> (properties, num_properties, coverage, score): all sets of a size in bounds that ``threshold`` entities or more have.

    Entities with the same properties are one row with their number. From there a row is a set, what its entities have
    beyond it in the order of names, and their number; a set grows by each of what is beyond. Rows that agree in both are
    added up at every size, so however many entities there are, k properties make at most k * 2^k rows, and rows of sets under the threshold
    go no further. Sets smaller than ``least`` are only passed through inside a task, never counted or shuffled, but for single
    properties: rare ones are left out first. Sets are sorted and comma-joined; nulls and repeats inside a basket don't count.
    """
    whole = kept(baskets.where(F.col("props").isNotNull()).groupBy(F.array_sort(F.array_distinct(F.array_compact("props"))).alias("props")).agg(F.count("*").alias("n")))
    each = whole.select("props", "n", F.explode("props").alias("prop"))
    often = each.groupBy("prop").agg(F.sum("n").alias("_n")).where(F.col("_n") >= threshold)
    beyond = each.join(often, "prop", "left_semi").groupBy("props", "n").agg(F.array_sort(F.collect_list("prop")).alias("rest")).where(F.size("rest") >= least)
    rows = beyond.groupBy(F.array().cast("array<string>").alias("set"), "rest").agg(F.sum("n").alias("n"))
    levels = []
    for size in range(1, most + 1):
        grown = rows.select("set", "rest", "n", F.posexplode("rest").alias("_at", "_prop"))
        rows = grown.select(F.concat("set", F.array("_prop")).alias("set"), F.slice("rest", F.col("_at") + 2, F.size("rest")).alias("rest"), "n").where(F.size("rest") >= least - size)
        if size < least:
            continue
        rows = kept(rows.groupBy("set", "rest").agg(F.sum("n").alias("n")))
        levels.append(kept(rows.groupBy("set").agg(F.sum("n").alias("coverage")).where(F.col("coverage") >= threshold)))
        if levels[-1].isEmpty():
            break
        rows = rows.where(F.size("rest") > 0).join(levels[-1], "set", "left_semi")
    n = F.size("set")
    return reduce(DataFrame.unionByName, levels).select(F.array_join("set", ", ").alias("properties"), n.alias("num_properties"), "coverage", (F.col("coverage") * n).alias("score"))


def coverage_table(coverage: DataFrame, groups: list[str], least: int = 100, exclude: str | None = None) -> DataFrame:
    """coverage (lang, properties, num_properties, coverage) -> a column for each group, Average and Score, only sets present in all groups.

    Score is average times size times the number of groups that have the set; sets that match ``exclude`` are left out.
    """
    kept = coverage.where(F.col("coverage") >= least)
    if exclude:
        kept = kept.where(~F.rlike("properties", F.lit(exclude)))
    wide = kept.groupBy(F.col("properties").alias("PropertiesSet"), F.col("num_properties").alias("size")).pivot("lang", groups).agg(F.first("coverage")).na.fill(0, groups)
    total = sum((F.col(g) for g in groups), F.lit(0))
    held = sum((F.when(F.col(g) > 0, 1).otherwise(0) for g in groups), F.lit(0))
    wide = wide.withColumn("Average", total / len(groups)).withColumn("Score", F.col("Average") * F.col("size") * held)
    return wide.where(held == len(groups))
