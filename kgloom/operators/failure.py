"""Why date answers fail: modes, format, and by how many years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import year_bucket
from ..functions.dates import year
from ..functions.text import MISSING, let, strip

#: The asked format itself, in English and Polish.
ECHOES = ("YYYY-MM-DD", "RRRR-MM-DD")
DATE = r"^\d{4}-\d{2}-\d{2}\n?\z"


def as_read(output: Column | str) -> Column:
    """The answer as a reader with default missing values gives it: those, and null, are the text nan."""
    x = F.col(output) if isinstance(output, str) else output
    return F.when(x.isNull() | x.isin(*MISSING), "nan").otherwise(x)


def mode(output: Column | str) -> Column:
    def rule(x: Column) -> Column:
        return (
            F.when(x.isin(*ECHOES), "literal_format_echo").when(F.rlike(x, F.lit(r"^\d{4}\z")), "year_only_no_format").when(F.rlike(x, F.lit(DATE)), "wrong_date_correct_format")
            .when(F.length(x) > 40, "verbose_response").when(x.isin("nan", "", "None"), "empty/nan").otherwise("other_format")
        )

    return let(strip(as_read(output)), rule)


def tagged(graded: DataFrame) -> DataFrame:
    """Graded dates with their format, mode and year error."""
    return graded.withColumns({
        "correct_format": F.rlike(F.coalesce("llm_output", F.lit("")), F.lit(DATE)), "failure_mode": F.when(F.col("eval_type") == "no_match", mode("llm_output")), "year_diff": F.abs(year("llm_output") - year("gt")),
    })


def score_distribution(graded: DataFrame) -> DataFrame:
    """(eval_score, n, share)."""
    total = graded.agg(F.count("*").alias("_all"))
    return graded.groupBy("eval_score").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("eval_score", "n", (F.col("n") / F.col("_all")).alias("share"))


def format_compliance(tagged_: DataFrame) -> DataFrame:
    ok = F.col("correct_format")
    return tagged_.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_format"), F.count_if(ok & (F.col("eval_score") == 0)).alias("n_wrong")).withColumn("n_right", F.col("n_format") - F.col("n_wrong"))


def modes(tagged_: DataFrame) -> DataFrame:
    # a filter on the mode would be pushed below the count, and the mode worked out twice
    return tagged_.groupBy("failure_mode").agg(F.count("failure_mode").alias("n")).where("n > 0")


def wrong_years(tagged_: DataFrame) -> DataFrame:
    return tagged_.where("eval_type = 'no_match' and correct_format and year_diff is not null")


def year_buckets(tagged_: DataFrame) -> DataFrame:
    """(bucket, n, share, mean_diff, median_diff); errors of 0 and beyond the last bucket are in the row without a bucket, and all count in the share."""
    rows = wrong_years(tagged_)
    total = rows.agg(F.count("*").alias("_all"), F.avg("year_diff").alias("mean_diff"), F.percentile("year_diff", F.lit(0.5)).alias("median_diff"))
    return rows.groupBy(year_bucket("year_diff").alias("bucket")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("bucket", "n", (F.col("n") / F.col("_all")).alias("share"), "mean_diff", "median_diff")


def by_model(tagged_: DataFrame) -> DataFrame:
    """(model, format_share, mean_score)."""
    return tagged_.groupBy("model").agg(F.avg(F.col("correct_format").cast("int")).alias("format_share"), F.avg("eval_score").alias("mean_score"))
