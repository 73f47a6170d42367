"""Translation of answers to English by lookup, in three steps; what remains goes to a provider, each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMPTY_WORD, is_empty, json_list, split_list, unwrap_one
from ..sources.files import kept
from .order import numbered


def lookup(answers: DataFrame, table: DataFrame, output: str = "llm_output", loq: str = "LoQ") -> DataFrame:
    """answers with llm_output_en; table (loq, text, en, pos), pos the order of insertion.

    English stays, empty answers become NONE. Else the translation of (language, text); else that of the text in any
    language, first inserted; else, for a bracketed list all of whose items are known (bare or bracketed), the list of theirs.
    """
    exact = table.groupBy(F.col("loq").alias("_loq"), F.col("text").alias("_text")).agg(F.min_by("en", "pos").alias("_exact"))
    any_ = table.groupBy(F.col("text").alias("_any_text")).agg(F.min_by("en", "pos").alias("_any"))
    texts = answers.select(F.col(output).alias("_list")).distinct().select("_list", split_list("_list").alias("_items")).where(F.size("_items") > 0)
    item = texts.select("_list", F.posexplode("_items").alias("_i", "_item"))
    bare, wrapped = any_.select(F.col("_any_text").alias("_k1"), F.col("_any").alias("_v1")), any_.select(F.col("_any_text").alias("_k2"), F.col("_any").alias("_v2"))
    item = item.join(bare, F.col("_item") == F.col("_k1"), "left").join(wrapped, F.concat(F.lit("["), "_item", F.lit("]")) == F.col("_k2"), "left")
    item = item.withColumn("_v", unwrap_one(F.coalesce("_v1", "_v2")))
    lists = item.groupBy("_list").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_all"), F.count_if(F.col("_v").isNull()).alias("_open")).where("_open = 0")
    lists = lists.select("_list", json_list(F.col("_all._v")).alias("_joined"))
    out = answers.join(exact, (F.col(loq) == F.col("_loq")) & (F.col(output) == F.col("_text")), "left")
    out = out.join(any_, F.col(output) == F.col("_any_text"), "left").join(lists, F.col(output) == F.col("_list"), "left")
    en = F.when(is_empty(output, EMPTY_WORD), "NONE").when(F.col(loq) == "en", F.col(output)).otherwise(F.coalesce("_exact", "_any", "_joined"))
    return out.withColumn("llm_output_en", en).select(*answers.columns, "llm_output_en")


def misses(translated: DataFrame, output: str = "llm_output", loq: str = "LoQ") -> DataFrame:
    """(loq, text): different answers that no lookup knows."""
    return translated.where("llm_output_en is null").select(F.col(loq).alias("loq"), F.col(output).alias("text")).distinct()


def translate(answers: DataFrame, table: DataFrame, provider, output: str = "llm_output", loq: str = "LoQ") -> tuple[DataFrame, DataFrame]:
    """The answers, all translated, and the table with what the provider added; a text that it can't translate stays as it is.

    The provider is asked once; its rows follow those of the table in the order of text and language, so that a rerun finds the same first one.
    """
    first = lookup(answers, table, output, loq)
    new = kept(provider.translate(misses(first, output, loq)).select("loq", "text", F.coalesce("en", "text").alias("en")))
    upto = table.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    merged = table.unionByName(numbered(new, "text", "loq", name="pos", first=upto + 1))
    out = first.join(new.withColumnsRenamed({"loq": "_l", "text": "_t", "en": "_e"}), (F.col(loq) == F.col("_l")) & (F.col(output) == F.col("_t")), "left")
    return out.withColumn("llm_output_en", F.coalesce("llm_output_en", "_e")).drop("_l", "_t", "_e"), merged
