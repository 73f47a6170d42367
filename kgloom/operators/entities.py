"""Entity documents: nested facts with labels by language, and filters on how completely they are labelled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_of


def documents(facts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """facts (qid, property, value, labels, value_labels) -> (qid, labels, labels_count, props, sitelinks).

    props maps a property to its values (value, value_id, labels, labels_count), sorted by value, and their number.
    """
    of = F.coalesce("value_labels", F.create_map().cast("map<string,string>"))
    value = F.struct(F.col("value"), id_of("value").alias("value_id"), of.alias("labels"), F.size(of).alias("labels_count"))
    by = facts.groupBy("qid", "property").agg(F.first("labels", ignorenulls=True).alias("labels"), F.array_sort(F.collect_list(value), lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0)).alias("values"))
    out = by.groupBy("qid").agg(F.first("labels", ignorenulls=True).alias("labels"), F.map_from_entries(F.collect_list(F.struct("property", F.struct("values", F.size("values").alias("count"))))).alias("props"))
    out = out.withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,string>"))).withColumn("labels_count", F.size("labels"))
    if links is not None:
        out = out.join(links.select(F.col("entity").alias("qid"), F.col("n").alias("sitelinks")), "qid", "left")
    return out


def in_all(labels: Column, languages: list[str]) -> Column:
    """Labels in all the languages."""
    return F.forall(F.array(*map(F.lit, languages)), lambda c: F.coalesce(F.map_contains_key(labels, c), F.lit(False)))


def has_label(lang: str) -> Column:
    return F.coalesce(F.map_contains_key("labels", lang), F.lit(False))


def values(prop: str) -> Column:
    return F.try_element_at("props", F.lit(prop))["values"]


def has_value_in(prop: str, lang: str) -> Column:
    return F.coalesce(F.exists(values(prop), lambda v: F.map_contains_key(v["labels"], F.lit(lang))), F.lit(False))


def has_value_in_all(prop: str, languages: list[str]) -> Column:
    """Some value of the property has labels in all the languages; false without values."""
    return F.coalesce(F.exists(values(prop), lambda v: in_all(v["labels"], languages)), F.lit(False))


def is_complete(props: list[str], languages: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (has_value_in_all(p, languages) for p in props))


def with_links(least: int) -> Column:
    """Enough links; none counts as 0."""
    return F.coalesce("sitelinks", F.lit(0)) >= least


def completeness(entities: DataFrame, props: list[str], languages: list[str], least_links: int = 9, group: str = "lang") -> DataFrame:
    """By group: entities in all, and of those with enough links how many have each property, and all, labelled throughout."""
    ok = with_links(least_links)
    return entities.groupBy(group).agg(
        F.count("*").alias("n_entities"), *(F.count_if(ok & has_value_in_all(p, languages)).alias(p) for p in props), F.count_if(ok & is_complete(props, languages)).alias("complete")
    )


def complete(entities: DataFrame, props: list[str], languages: list[str], least_links: int = 9) -> DataFrame:
    return entities.where(with_links(least_links) & is_complete(props, languages))


def present(matrix: DataFrame, required: list[str]) -> DataFrame:
    """(entity_id) of a presence matrix with 1 in every required column."""
    return matrix.where(reduce(lambda a, b: a & b, (F.col(c) == 1 for c in required))).select("entity_id")


def valid_numbers(df: DataFrame, value: str) -> DataFrame:
    """Rows with a number; a negative one is an error."""
    checked = F.when(F.col(value) < 0, F.raise_error(F.concat(F.lit(f"negative {value}: "), F.col(value).cast("string"))).cast("double")).otherwise(F.col(value))
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn(value, checked.cast(df.schema[value].dataType))
