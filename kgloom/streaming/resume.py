"""Grading that goes on where it stopped: a stream over a folder of answer files, each key graded once.

The stream's state holds the keys that it has seen (RocksDB, in the checkpoint), so what a micro-batch costs depends on the
batch alone, not on what has been graded before. Each batch writes a folder of its own; one that is run again
after a failure replaces it, so nothing is added twice. Keys that other runs have graded (``done``) come first, as rows
that are seen and not graded. ``availableNow`` ends when all files present are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import ANSWERS
from ..sources.files import CSV

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ("Q_number", "LoQ", "LoE", "property")


def answer_stream(spark: SparkSession, path: str, schema: str = ANSWERS, files_per_batch: int = 100) -> DataFrame:
    df = spark.readStream.schema(schema).options(**CSV, maxFilesPerTrigger=files_per_batch).csv(path)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns))


def grade_stream(answers: DataFrame, grade: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: tuple[str, ...] = KEYS, done: DataFrame | None = None) -> StreamingQuery:
    """Starts grading of each key's first row to Parquet: a folder ``batch=n`` for each micro-batch (``graded`` reads them).

    ``done``, a table of keys graded elsewhere, is left out by a join on each batch's keys; give it only where there is one.
    """
    spark = answers.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch if done is None else batch.join(done.select(*keys), list(keys), "left_anti").select(batch.columns)
        grade(fresh).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return answers.dropDuplicates(list(keys)).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graded(spark: SparkSession, out: str) -> DataFrame:
    """All batches."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
