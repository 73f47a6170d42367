"""Graders: dates, countries and places against their truth, as one pass of Column expressions over joined rows.

Lookups (verdicts, places, vocabularies) are tables; what they don't know is left to a provider, asked once for each different
question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import first_date, whole_date
from ..functions.text import EMPTY_WORD, candidates, casefold, clean_place, is_empty, let, parse_list, similar, strip

#: Row scores by match type.
DOB_SCORES = {"exact_match": 1.0, "swap_match": 1.0, "year_month_match": 0.7, "year_month_swap_match": 0.7, "year_match": 0.5, "no_match": 0.0, "empty": 0.0}
COUNTRY_SCORES = {"exact_match": 1.0, "alias_match": 0.9, "substring_match": 0.85, "demonym_match": 0.8, "historical_match": 0.75, "no_match": 0.0}
PLACE_SCORES = {"exact_match": 1.0, "country_match": 0.8, "historical_match": 0.7, "llm_match": 0.65, "no_match": 0.0}


def score(eval_type: Column | str, scores: dict[str, float]) -> Column:
    of = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))
    return F.coalesce(F.try_element_at(of, F.col(eval_type) if isinstance(eval_type, str) else eval_type), F.lit(0.0))


def grade_dob(df: DataFrame, gt: str = "gt", output: str = "llm_output") -> DataFrame:
    """With eval, eval_type, eval_score. Parts are compared as text; a right year alone is counted as wrong.

    Only the swap of the whole date asks that the answer's month could be a day.
    """
    def rule(s: Column) -> Column:
        g, o = s["g"], s["o"]
        year, month, day = (lambda d: F.substring(d, 1, 4)), (lambda d: F.substring(d, 6, 2)), (lambda d: F.substring(d, 9, 2))
        swap = (month(g) == day(o)) & (day(o) <= "12")
        return (
            F.when(s["empty"], "empty")
            .when((g == "") | (o == "") | (year(g) != year(o)), "no_match")
            .when(g == o, "exact_match")
            .when(swap & (day(g) == month(o)) & (month(o) <= "31"), "swap_match")
            .when(month(g) == month(o), "year_month_match")
            .when(swap, "year_month_swap_match")
            .otherwise("year_match")
        )

    both = F.struct(F.coalesce(whole_date(gt), F.lit("")).alias("g"), F.coalesce(first_date(output), F.lit("")).alias("o"), is_empty(output, EMPTY_WORD).alias("empty"))
    df = df.withColumn("eval_type", let(both, rule))
    verdict = F.when(F.col("eval_type") == "empty", "FN").when(F.col("eval_type").isin("year_match", "no_match"), "FP").otherwise("TP")
    return df.withColumns({"eval": verdict, "eval_score": score("eval_type", DOB_SCORES)})


def country_match(cands: Column, truths: Column, names: Column, demonyms: Column) -> Column:
    """The best match type of any candidate: truth, alias or label, substring either way, demonym. All arrays are casefolded, without blanks."""
    some = lambda rule: F.exists(cands, rule)
    return (
        F.when(some(lambda c: F.array_contains(truths, c)), "exact_match")
        .when(some(lambda c: F.array_contains(names, c)), "alias_match")
        .when(some(lambda c: F.exists(truths, lambda g: similar(g, c))), "substring_match")
        .when(some(lambda c: F.array_contains(demonyms, c)), "demonym_match")
    )


def folded(x: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(x, empty), casefold), lambda c: c != "")


def with_verdict(df: DataFrame, kind: Column, missed: Column, verdicts: DataFrame, output: str, gt: str, known: list[str]) -> DataFrame:
    """eval, eval_type, provenance: the rules' match; else the verdict on (output, truth), both trimmed; an unknown verdict is no match."""
    table = verdicts.select(F.col("llm_output").alias("_vo"), F.col("gt_raw").alias("_vg"), F.col("match_type").alias("_v")).groupBy("_vo", "_vg").agg(F.min("_v").alias("_v"))
    df = df.withColumns({"_kind": kind, "_missed": missed, "_ko": strip(output), "_kg": strip(gt)})
    df = df.join(table, (F.col("_ko") == F.col("_vo")) & (F.col("_kg") == F.col("_vg")), "left")
    judged = F.coalesce(F.when(F.col("_v").isin(known), F.col("_v")), F.lit("no_match"))
    df = df.withColumn("eval_type", F.when(F.col("_missed"), "").otherwise(F.coalesce("_kind", judged)))
    df = df.withColumn("eval", F.when(F.col("_missed"), "FN").when(F.col("eval_type") == "no_match", "FP").otherwise("TP"))
    df = df.withColumn("provenance", F.when(F.col("_missed"), "").when(F.col("_kind").isNotNull(), "auto").otherwise("judge"))
    return df.drop("_kind", "_missed", "_ko", "_kg", "_vo", "_vg", "_v")


def grade_country(answers: DataFrame, vocab: DataFrame, verdicts: DataFrame, output: str = "llm_output_en", gt: str = "gt") -> DataFrame:
    """answers (Q_number, ...), vocab (entity_q, demonyms, aliases, labels) -> with eval, eval_type, provenance."""
    df = answers.join(vocab, F.col("Q_number") == F.col("entity_q"), "left")
    cands = candidates(output)
    df = df.withColumns({"_c": folded(cands), "_n": F.coalesce(F.size(cands), F.lit(0)), "_g": folded(parse_list(gt)), "_names": folded(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("labels", F.array().cast("array<string>")))), "_d": folded(F.col("demonyms"))})
    out = with_verdict(df, country_match(F.col("_c"), F.col("_g"), F.col("_names"), F.col("_d")), is_empty(output) | (F.col("_n") == 0), verdicts, output, gt, list(COUNTRY_SCORES))
    return out.drop("_c", "_n", "_g", "_names", "_d", *vocab.columns)


def grade_place(answers: DataFrame, places: DataFrame, verdicts: DataFrame, output: str = "llm_output_en", gt: str = "gt") -> DataFrame:
    """places (name_key, q, countries) resolve cleaned names, lower-cased. A contained name counts as exact, as does the same id; then a shared country."""
    known = places.dropDuplicates(["name_key"])
    df = answers.withColumns({"_out": clean_place(output), "_truths": parse_list(gt)})
    df = df.withColumns({"_cf": casefold("_out"), "_gcf": F.transform("_truths", casefold)})
    own = known.select(F.col("name_key").alias("_ok"), F.col("q").alias("_oq"), F.col("countries").alias("_oc"))
    df = df.withColumn("_lk", F.lower(strip("_out"))).join(own, F.col("_lk") == F.col("_ok"), "left")
    # the truth's names, each different list once
    lists = df.select(F.col("_truths").alias("_tl")).distinct().select("_tl", F.explode("_tl").alias("_t")).withColumn("_tk", F.lower(strip(clean_place("_t"))))
    found = lists.join(known, F.col("_tk") == F.col("name_key")).groupBy("_tl").agg(F.collect_set("q").alias("_tq"), F.array_distinct(F.flatten(F.collect_list("countries"))).alias("_tc"))
    df = df.join(found, F.col("_truths") == F.col("_tl"), "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when((F.col("_cf") != "") & F.array_contains("_gcf", F.col("_cf")), "exact_match")
        .when(no(F.exists("_gcf", lambda g: similar(g, F.col("_cf")))), "exact_match")
        .when(no(F.array_contains("_tq", F.col("_oq"))), "exact_match")
        .when(no(F.arrays_overlap("_oc", "_tc")), "country_match")
    )
    out = with_verdict(df, kind, is_empty(output) | (F.col("_out") == ""), verdicts, output, gt, list(PLACE_SCORES))
    return out.select(*answers.columns, "eval", "eval_type", "provenance")


def open_questions(graded: DataFrame, verdicts: DataFrame, output: str = "llm_output_en", gt: str = "gt") -> DataFrame:
    """(llm_output, gt_raw): different questions for the judge that the table of verdicts can't answer."""
    asked = graded.where("provenance = 'judge'").select(strip(output).alias("llm_output"), strip(gt).alias("gt_raw")).distinct()
    return asked.join(verdicts, ["llm_output", "gt_raw"], "left_anti")


def resume(answers: DataFrame, previous: DataFrame, grade, keys: tuple[str, ...] = ("Q_number", "LoQ", "LoE")) -> DataFrame:
    """Rows that an earlier output has graded are taken from it; ``grade`` (a function of a DataFrame) sees the others only."""
    done = previous.where(F.coalesce("eval", F.lit("")) != "")
    fresh = grade(answers.join(done.select(*keys).distinct(), list(keys), "left_anti"))
    old = answers.select(*keys).join(done.dropDuplicates(list(keys)), list(keys))
    return fresh.unionByName(old.select(fresh.columns))


def summary(graded: DataFrame, *by: str) -> DataFrame:
    """Counts by verdict and match type; with scores their mean."""
    mean = [F.avg("eval_score").alias("mean_score")] if "eval_score" in graded.columns else []
    return graded.groupBy(*by, "eval", "eval_type").agg(F.count("*").alias("n"), *mean)
