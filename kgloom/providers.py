"""What stands outside the engine: translators, judges, scorers and models. Each takes and gives DataFrames, so that a table,
a Python function or a remote service can stand in for another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import Formatter
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import json_list

#: Verdicts that a judge may give, by property.
VERDICTS = {
    "country": ("exact_match", "alias_match", "substring_match", "demonym_match", "historical_match", "no_match"),
    "pob": ("exact_match", "country_match", "historical_match", "no_match"),
}
#: Our own wording of what the judge is asked.
JUDGE_PROMPTS = {
    "country": "Does the answer name the same country as the truth? Say one of: {verdicts}.\nAnswer: {output}\nTruth: {truth}\nDemonyms: {demonyms}\nAliases: {aliases}",
    "pob": "Does the answer name the same place as the truth, or one in its country? Say one of: {verdicts}.\nAnswer: {output}\nTruth: {truth}",
}
#: How many demonyms and aliases a judge is shown.
SHOWN = 20


def asked_of_judge(property_: str, **parts: Column) -> Column:
    """The judge's question on a row: the property's wording with verdicts, output, truth and, where it has them, the first SHOWN demonyms and aliases.

    ``output`` and ``truth`` are texts, the others arrays; braces in them mean nothing.
    """
    shown = {k: v if k in ("output", "truth") else F.array_join(F.slice(F.coalesce(v, F.array().cast("array<string>")), 1, SHOWN), ", ") for k, v in parts.items()}
    shown["verdicts"] = F.lit(", ".join(VERDICTS[property_]))
    said = [x for text, name, *_ in Formatter().parse(JUDGE_PROMPTS[property_]) for x in (F.lit(text), *([F.coalesce(shown[name], F.lit(""))] if name else []))]
    return F.concat(*said)


def translation_of(answer: Column, text: Column) -> Column:
    """What a translator's JSON ``{"en": text or list}`` says, a list as JSON; the text itself if it is no such answer."""
    one, several = F.from_json(answer, "struct<en:string>")["en"], F.from_json(answer, "struct<en:array<string>>")["en"]
    return F.coalesce(F.when(several.isNotNull(), json_list(several)), one, text)


def verdict_of(answer: Column, known: tuple[str, ...] | list[str]) -> Column:
    """The verdict in a judge's JSON ``{"match_type": ..., "reason": ...}``; no match if it is none of those known."""
    said = F.from_json(answer, "struct<match_type:string>")["match_type"]
    return F.when(said.isin(*known), said).otherwise("no_match")


class Translator(Protocol):
    def translate(self, misses: DataFrame) -> DataFrame:
        """(loq, text) -> (loq, text, en)."""


class Judge(Protocol):
    def judge(self, questions: DataFrame) -> DataFrame:
        """(llm_output, gt_raw, ...) -> (llm_output, gt_raw, match_type)."""


class Generator(Protocol):
    def generate(self, samples: DataFrame) -> DataFrame:
        """samples with input messages -> with llm_output."""


class TableTranslator:
    """Answers from a table of (loq, text, en); unknown texts stay null."""

    def __init__(self, table: DataFrame):
        self.table = table.dropDuplicates(["loq", "text"])

    def translate(self, misses: DataFrame) -> DataFrame:
        return misses.join(self.table.select("loq", "text", "en"), ["loq", "text"], "left")


class TableJudge:
    def __init__(self, table: DataFrame):
        self.table = table.dropDuplicates(["llm_output", "gt_raw"])

    def judge(self, questions: DataFrame) -> DataFrame:
        found = questions.join(self.table.select("llm_output", "gt_raw", "match_type"), ["llm_output", "gt_raw"], "left")
        return found.withColumn("match_type", F.coalesce("match_type", F.lit("no_match")))


class Called:
    """A Python function of a batch of rows, called in Arrow batches by ``tasks`` tasks at most; errors leave null.

    The number of tasks bounds the calls that a service sees at once.
    """

    def __init__(self, function: Callable[[pd.DataFrame], pd.Series], output: str, schema: str = "string", tasks: int = 15):
        self.function, self.output, self.schema, self.tasks = function, output, schema, tasks

    def __call__(self, rows: DataFrame) -> DataFrame:
        function, output = self.function, self.output

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                try:
                    got = function(b)
                except Exception:  # a provider's failure is a missing answer, which a rerun asks for again
                    got = pd.Series([None] * len(b))
                yield b.assign(**{output: list(got)})

        schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{output}` {self.schema}"])
        return rows.repartition(self.tasks).mapInPandas(call, schema)

    def translate(self, misses: DataFrame) -> DataFrame:
        return self(misses).select("loq", "text", F.coalesce(self.output, "text").alias("en"))

    def judge(self, questions: DataFrame) -> DataFrame:
        return self(questions).withColumnRenamed(self.output, "match_type")

    def generate(self, samples: DataFrame) -> DataFrame:
        return self(samples)
