"""Precision, recall and F1, plain and weighted, from graded rows (model, LoE, LoQ, eval, eval_type, provenance).

Rows are counted once, by all keys; every report is a roll-up of these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import ratio

KEYS = ("model", "LoE", "LoQ", "provenance")
#: Weights of match types in weighted reports, by property; all others weigh 0.
WEIGHTS = {
    "pob": {"exact_match": 1.0, "country_match": 0.8, "historical_match": 0.7},
    "country": {"exact_match": 1.0, "alias_match": 1.0, "demonym_match": 1.0, "historical_match": 0.7, "substring_match": 0.9},
    "dob": {"exact_match": 1.0, "swap_match": 1.0, "year_month_match": 0.7, "year_month_swap_match": 0.7},
}


def weight(eval_type: Column | str, prop: str) -> Column:
    of = F.create_map(*(F.lit(x) for kv in WEIGHTS[prop].items() for x in kv))
    return F.coalesce(F.try_element_at(of, F.col(eval_type) if isinstance(eval_type, str) else eval_type), F.lit(0.0))


def counts(graded: DataFrame, prop: str, *by: str) -> DataFrame:
    """(by ..., tp, fp, fn, w_tp)."""
    is_ = lambda x: F.col("eval") == x
    return graded.groupBy(*by).agg(*(F.count_if(is_(x.upper())).alias(x) for x in ("tp", "fp", "fn")), F.sum(F.when(is_("TP"), weight("eval_type", prop)).otherwise(0.0)).alias("w_tp"))


def rolled(count: DataFrame, *by: str) -> DataFrame:
    return count.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "w_tp")))


def scored(count: DataFrame, weighted: bool = False) -> DataFrame:
    """With precision, recall and f1; weighted, the weighted hits stand for the hits in numerator and denominator alike."""
    tp = F.col("w_tp" if weighted else "tp").cast("double")
    out = count.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def report(graded: DataFrame, prop: str, *by: str, weighted: bool = False) -> DataFrame:
    """F1 by keys."""
    return scored(rolled(counts(graded, prop, *KEYS), *by), weighted)


def dense(count: DataFrame, *by: str) -> DataFrame:
    """Counts for all combinations of the keys' values, 0 where there are no rows. The grid is of key values, not rows."""
    grid = None
    for c in by:
        own = count.select(c).distinct()
        grid = own if grid is None else grid.crossJoin(own)
    return grid.join(count, list(by), "left").na.fill(0, ["tp", "fp", "fn", "w_tp"])


def macro(graded: DataFrame, prop: str, rows: str = "LoE", cols: str = "LoQ", weighted: bool = False, provenance: str | None = None) -> DataFrame:
    """(rows, cols, f1): mean over models of each cell's F1; a model without rows in a cell counts as 0."""
    if provenance is not None:
        graded = graded.where(F.col("provenance") == provenance)
    each = scored(dense(rolled(counts(graded, prop, *KEYS), "model", rows, cols), "model", rows, cols), weighted)
    return each.groupBy(rows, cols).agg(F.avg("f1").alias("f1"))


def matrix(graded: DataFrame, prop: str, rows: str, cols: str, provenance: str | None = None, weighted: bool = False, model: str | None = None) -> DataFrame:
    """A dense (rows, cols, f1) matrix of all rows, or of one model or provenance."""
    for c, x in (("provenance", provenance), ("model", model)):
        if x is not None:
            graded = graded.where(F.col(c) == x)
    return scored(dense(rolled(counts(graded, prop, *KEYS), rows, cols), rows, cols), weighted).select(rows, cols, "f1")


def by_provenance(graded: DataFrame, prop: str, *by: str, weighted: bool = False) -> DataFrame:
    """F1 by provenance; rows without one (missed answers) aren't part of it."""
    return report(graded.where("provenance <> ''"), prop, "provenance", *by, weighted=weighted)


def grouping_sets(graded: DataFrame, prop: str, weighted: bool = False) -> DataFrame:
    """The reports by model, model and LoE, model and LoQ, and all three at once; level says which."""
    base = counts(graded, prop, *KEYS)
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "w_tp")]
    sets = [[F.col("model")], [F.col("model"), F.col("LoE")], [F.col("model"), F.col("LoQ")], [F.col("model"), F.col("LoE"), F.col("LoQ")]]
    at = F.grouping("LoE") * 2 + F.grouping("LoQ")
    out = base.groupingSets(sets, "model", "LoE", "LoQ").agg(*sums, at.cast("int").alias("level"))
    return scored(out, weighted)


def wide(matrix_: DataFrame, rows: str, cols: str, values: list[str]) -> DataFrame:
    """A matrix with one column a value, as a heatmap shows it."""
    return matrix_.groupBy(rows).pivot(cols, values).agg(F.first("f1")).na.fill(0.0)
