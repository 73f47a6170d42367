"""Orders over whole tables: gapless numbers, batches of ids and exact quantiles, without a window or a buffer over all rows.

Rows are dealt out by ranges of the order, sorted where they are and written with their place in the range; the sizes of the
ranges, a row for each task, give the numbers that go before. Rows that are equal in the order are dealt out too, so no
value is too frequent. The written table makes both steps see the same ranges, whatever is computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import kept

#: monotonically_increasing_id holds the task above these bits, the row's place in the task below.
PLACE_BITS = 33


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with _range (ranges ascend with the order) and _place (from 0, in order within the range), written."""
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    at = F.monotonically_increasing_id()
    return kept(spread.withColumns({"_range": F.shiftright(at, PLACE_BITS), "_place": at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}))


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", first: int = 1) -> DataFrame:
    """df with a gapless number of every row by the order, from ``first``; rows equal in it come in any order."""
    ranges = in_ranges(df, *order)
    spark, offsets, upto = df.sparkSession, [], first
    for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # a row for each task
        offsets.append((r["_range"], upto))
        upto += r["n"]
    before = F.broadcast(spark.createDataFrame(offsets, "_range long, _before long"))
    return ranges.join(before, "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def batched(ids: DataFrame, size: int, *order: Column | str, name: str = "batch") -> DataFrame:
    """ids with the number of their batch, from 0: batches of ``size`` rows in order, the last of what is left."""
    return numbered(ids, *order, name=name, first=0).withColumn(name, F.floor(F.col(name) / size))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles with linear interpolation by groups: a column for each name in ``shares``; missing values don't count.

    Values are counted first; running counts go through ranges of values and then over the ranges of each group, so a group
    with many different values is spread over tasks. A null group is a group.
    """
    count = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    ranges = in_ranges(count, *by, "_x")
    part = ranges.groupBy(*by, "_range").agg(F.sum("_n").alias("_part"))
    up = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumns({"_before": F.coalesce(F.sum("_part").over(up), F.lit(0)), "_all": F.sum("_part").over(W.partitionBy(*by))}).withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)} | {"_range": "_of"})
    same = F.col("_range") == F.col("_of")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    within = W.partitionBy(*by, "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    each = ranges.withColumn("_upto", F.sum("_n").over(within)).join(part, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    # the first value whose running count goes beyond a place is the value at that place
    reached = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_x")))
    at = {n: (F.col("_all") - 1) * F.lit(float(q)) for n, q in shares.items()}
    found = each.groupBy(*by).agg(F.max("_all").alias("_all"), *(x.alias(f"_{k}_{n}") for n in shares for k, x in (("lo", reached(F.floor(at[n]))), ("hi", reached(F.ceil(at[n]))))))

    def between(n: str) -> Column:
        lo, hi = F.col(f"_lo_{n}").cast("double"), F.col(f"_hi_{n}").cast("double")
        return F.when(F.floor(at[n]) == F.ceil(at[n]), lo).otherwise((F.ceil(at[n]) - at[n]) * lo + (at[n] - F.floor(at[n])) * hi)

    return found.select(*by, *(between(n).alias(n) for n in shares))
