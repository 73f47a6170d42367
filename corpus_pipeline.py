"""A corpus pipeline over documents (doc_id, text, lang, source, n_chars): five operators, one after another.

Each stage works on all rows that its predecessor kept. Rows without a text go in the first stage, as they have no language
(where no row has a label there is no model, and all rows stay); rows without an id are never dropped for an id of others; ties, repeated rows and further columns, whatever their names, are handled as each stage
says. Empty tables give empty results. All stages but the last return the columns of documents; the last one returns the
places of documents in shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import op2_jaccard_join, op4_language, op6_sharding, op8_decontamination, op9_mixing
from kgloom.llm.common import drop, scratch

STAGES = [
    ("language ID", op4_language.stage),
    ("n-gram Jaccard join", op2_jaccard_join.stage),
    ("benchmark decontamination", op8_decontamination.stage),
    ("mixing sources to target weights", op9_mixing.stage),
    ("sharding", op6_sharding.stage),
]

#: Hashed draws, language models and seeded selection can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder, read again by the next and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
