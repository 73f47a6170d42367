"""F1 reports over graded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from .views import view, with_views

PROP = "country"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def report(*by: str, weighted: bool = False):
    return lambda spark, d: rounded(metrics.report(view(spark, d, "g"), PROP, *by, weighted=weighted))


WEIGHT = "CASE eval_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in metrics.WEIGHTS[PROP].items()) + " ELSE 0 END"
SUMS = f"count(*) FILTER (eval = 'TP') AS tp, count(*) FILTER (eval = 'FP') AS fp, count(*) FILTER (eval = 'FN') AS fn, sum(CASE WHEN eval = 'TP' THEN {WEIGHT} ELSE 0.0 END)::DOUBLE AS w_tp"


def f1_columns(tp: str) -> str:
    p, r = f"CASE WHEN {tp} + fp > 0 THEN {tp}::DOUBLE / ({tp} + fp) ELSE 0.0 END", f"CASE WHEN {tp} + fn > 0 THEN {tp}::DOUBLE / ({tp} + fn) ELSE 0.0 END"
    return f"{p} AS precision, {r} AS recall, CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END AS f1"


def final(keys: str, source: str, tp: str) -> str:
    return f"SELECT {keys}, tp, fp, fn, round(w_tp, 6) AS w_tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {f1_columns(tp)} FROM {source})"


def report_sql(*by: str, weighted: bool = False, where: str = "") -> str:
    keys = ", ".join(by)
    return f"{with_views('g')}, c AS (SELECT {keys}, {SUMS} FROM g {where} GROUP BY {keys}) " + final(keys, "c", "w_tp" if weighted else "tp")


def macro_sql(rows: str = "LoE", cols: str = "LoQ", weighted: bool = False, where: str = "") -> str:
    return (
        f"{with_views('g')}, s AS (SELECT * FROM g {where}), c AS (SELECT model, {rows}, {cols}, {SUMS} FROM s GROUP BY ALL), d AS (SELECT model, {rows}, {cols}, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(w_tp, 0) AS w_tp"
        f" FROM (SELECT DISTINCT model FROM s) CROSS JOIN (SELECT DISTINCT {rows} FROM s) CROSS JOIN (SELECT DISTINCT {cols} FROM s) LEFT JOIN c USING (model, {rows}, {cols}))"
        f" SELECT {rows}, {cols}, round(avg(f1), 6) AS f1 FROM (SELECT *, {f1_columns('w_tp' if weighted else 'tp')} FROM d) GROUP BY ALL"
    )


def matrix_sql(rows: str, cols: str, weighted: bool, where: str) -> str:
    return f"{with_views('g')}, c AS (SELECT {rows}, {cols}, {SUMS} FROM g {where} GROUP BY ALL) SELECT {rows}, {cols}, round(f1, 6) AS f1 FROM (SELECT *, {f1_columns('w_tp' if weighted else 'tp')} FROM c)"


KEYS = {"overall": ("model",), "by_loe": ("model", "LoE"), "by_loq": ("model", "LoQ"), "matrix": ("model", "LoE", "LoQ")}
QUERIES = {f"{'w' * w}f1_{k}": report(*by, weighted=w) for w in (False, True) for k, by in KEYS.items()}
ORACLES = {f"{'w' * w}f1_{k}": report_sql(*by, weighted=w) for w in (False, True) for k, by in KEYS.items()}
for w in (False, True):
    QUERIES[f"{'w' * w}f1_macro_matrix"] = lambda spark, d, w=w: rounded(metrics.macro(view(spark, d, "g"), PROP, weighted=w))
    ORACLES[f"{'w' * w}f1_macro_matrix"] = macro_sql(weighted=w)
QUERIES |= {
    "f1_by_provenance": lambda spark, d: rounded(metrics.by_provenance(view(spark, d, "g"), PROP, "model")),
    "f1_by_provenance_loe": lambda spark, d: rounded(metrics.by_provenance(view(spark, d, "g"), PROP, "model", "LoE")),
    "f1_grouping_sets": lambda spark, d: rounded(metrics.grouping_sets(view(spark, d, "g"), PROP)),
    "f1_heatmap_auto": lambda spark, d: rounded(metrics.macro(view(spark, d, "g"), PROP, provenance="auto")),
    "wf1_heatmap_judge_model_loe": lambda spark, d: rounded(metrics.matrix(view(spark, d, "g"), PROP, "model", "LoE", provenance="judge", weighted=True)),
    "f1_heatmap_model_loq": lambda spark, d: rounded(metrics.matrix(view(spark, d, "g"), PROP, "model", "LoQ")),
}
ORACLES |= {
    "f1_by_provenance": report_sql("provenance", "model", where="WHERE provenance <> ''"),
    "f1_by_provenance_loe": report_sql("provenance", "model", "LoE", where="WHERE provenance <> ''"),
    "f1_grouping_sets": f"{with_views('g')}, c AS (SELECT model, LoE, LoQ, (GROUPING(LoE) * 2 + GROUPING(LoQ))::INT AS level, {SUMS} FROM g GROUP BY GROUPING SETS ((model), (model, LoE), (model, LoQ), (model, LoE, LoQ))) " + final("model, LoE, LoQ, level", "c", "tp"),
    "f1_heatmap_auto": macro_sql(where="WHERE provenance = 'auto'"),
    "wf1_heatmap_judge_model_loe": matrix_sql("model", "LoE", True, "WHERE provenance = 'judge'"),
    "f1_heatmap_model_loq": matrix_sql("model", "LoQ", False, ""),
}
