"""Readers and writers of the files that the pipeline's steps exchange. Paths may lie in any store that Spark reads."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import MISSING, id_of, model_of, strip
from ..schemas import ANSWERS, ENTITIES, ENTITY_JSON, PROMPTS, PROPERTY_JSON

CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kgloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_ours: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted when this application ends."""
    app, path = spark.sparkContext.applicationId, f"{shared(spark)}/exchange-{uuid.uuid4().hex}"
    if app not in _ours:
        _ours[app] = []
        atexit.register(sweep, spark, app)
    _ours[app].append(path)
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def sweep(spark: SparkSession, app: str) -> None:
    """Deletes what an application has put in scratch places; nothing can be deleted once the JVM is gone."""
    with contextlib.suppress(Py4JError, ConnectionError, AttributeError):
        for path in _ours.pop(app, ()):
            fs, at = filesystem(spark, path)
            fs.delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and any executor can read it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(qid): one id a line, blanks cut, empty lines left out."""
    return spark.read.text(path).select(strip("value").alias("qid")).where("qid <> ''")


def write_ids(ids: DataFrame, path: str, header: bool = False) -> None:
    """One column of ids as text lines."""
    ids.select(F.col(ids.columns[0]).alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: str, missing_as_null: bool = True) -> DataFrame:
    """CSV with a header and a schema of our own; texts that mean missing become null."""
    df = spark.read.schema(schema).options(**CSV).csv(path)
    if missing_as_null:
        df = df.select(*(F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    return df


def read_answers(spark: SparkSession, path: str, schema: str = ANSWERS) -> DataFrame:
    """CSV as texts only: line breaks in quotes, doubled quotes, empty fields as empty texts."""
    df = spark.read.schema(schema).options(**CSV).csv(path)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns))


def read_model_answers(spark: SparkSession, path: str, prefix: str, schema: str = ANSWERS) -> DataFrame:
    """All files of a folder named by prefix (else all CSV files), with the model's name from each file's."""

    def some(glob: str) -> DataFrame:
        df = spark.read.schema(schema).options(**CSV, pathGlobFilter=glob).csv(path)
        named = df.select("*", F.col("_metadata.file_name").alias("_file"))
        return named.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns), model_of("_file", prefix).alias("model"))

    found = some(f"{prefix}*.csv")
    return found if not found.isEmpty() else some("*.csv")


def members(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the members of a JSON object in one file or in the parts of a folder, taken in the order of their names; values are JSON texts.

    The file is read in splits, by as many tasks as it has blocks. A JSON text holds no line break, so each line tells by itself
    how many brackets it opens and closes; sums over each split and then over the splits give the depth at which it starts. A
    member begins on a line that starts at depth 1 with a key, and has all lines up to the next one. Only the lines of a
    member meet in a task. An object on a single line is a split of its own.
    """
    lines = spark.read.text(path).withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    bare = F.regexp_replace("value", r'"(?:[^"\\\\]|\\\\.)*"', "")
    opened = F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[}]", ""))
    closed = F.length(F.translate(bare, "{[", "")) - F.length(F.translate(bare, "{[}]", ""))
    lines = kept(lines.where(F.trim("value") != "").withColumn("_net", opened - closed))
    part = W.partitionBy("_file", "_block")
    so_far = lambda c: F.coalesce(F.sum(c).over(part.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("_file", "_block").agg(F.sum("_net").alias("_net")).orderBy("_file", "_block").collect()  # a row for each split
    depth, at = [], 0
    for k, r in enumerate(blocks):
        depth.append((r["_file"], r["_block"], k, at))
        at += r["_net"]
    before = F.broadcast(spark.createDataFrame(depth, "_file string, _block long, _split int, _depth long"))
    placed = lines.withColumn("_own", so_far("_net")).join(before, ["_file", "_block"]).withColumn("_depth", F.col("_depth") + F.col("_own"))
    # the object's own brackets go; what a line opens before its first member stands at depth 0
    text = F.when(F.col("_depth") == 0, F.regexp_replace("value", r"^\s*[{]", "")).otherwise(F.col("value"))
    starts = ((F.col("_depth") == 1) & F.rlike("value", F.lit(r'^[\s,]*"'))) | ((F.col("_depth") == 0) & F.rlike(text, F.lit(r'^\s*"')))
    placed = kept(placed.select("_split", "_file", "_block", "_at", text.alias("value"), starts.cast("int").alias("_new")))
    own = F.sum("_new").over(part.orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    numbers, upto = [], 0
    for r in placed.groupBy("_split").agg(F.sum("_new").alias("n")).orderBy("_split").collect():
        numbers.append((r["_split"], upto))
        upto += r["n"]
    number = F.broadcast(spark.createDataFrame(numbers, "_split int, _members long"))
    each = placed.withColumn("_own", own).join(number, "_split").withColumn("_member", F.col("_members") + F.col("_own")).where("_member > 0")
    joined = each.groupBy("_member").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_split", "_at", "value"))), lambda x: x["value"]), "\n").alias("_text"))
    body = F.regexp_replace(F.regexp_replace("_text", r"^[\s,]+", ""), r"[\s,]+\z", "")
    last = F.regexp_replace(body, r"\s*\}\z", "")  # the object's own end, on the last member only
    text = F.when(F.col("_member") == upto, last).otherwise(body)
    return joined.select(F.explode(F.from_json(F.concat(F.lit("{"), text, F.lit("}")), "map<string,string>")).alias("key", "value"))


def read_entities(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """A JSON object of entities by id, each with labels and one member a property -> rows like those of entities.documents."""
    each = members(spark, path).select(F.col("key").alias("qid"), F.from_json("value", ENTITY_JSON).alias("e"), F.from_json("value", "map<string,string>").alias("_all"))

    def prop(p: str) -> Column:
        of = F.from_json(F.try_element_at("_all", F.lit(p)), PROPERTY_JSON)
        values = F.transform(of["values"], lambda v: F.struct(v["qid"].alias("value"), id_of(v["qid"]).alias("value_id"), v["labels"].alias("labels"), v["labels_count"].alias("labels_count")))
        return F.when(of.isNotNull(), F.struct(F.lit(p).alias("property"), F.struct(values.alias("values"), F.size(values).alias("count")).alias("v")))

    props = F.map_from_entries(F.filter(F.array(*map(prop, properties)), lambda x: x.isNotNull()))
    return each.select("qid", "e.labels", props.alias("props"), "e.labels_count", "e.sitelinks")


def write_entities(entities: DataFrame, path: str) -> None:
    """JSON lines, one entity each, written by as many tasks as there are."""
    entities.write.mode("overwrite").json(path)


def read_entity_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_entities wrote; any number of tasks reads it."""
    return spark.read.schema(ENTITIES).json(path)


def write_entity_object(entities: DataFrame, path: str) -> None:
    """One JSON object of all entities by id, in the parts of a folder: put end to end in the order of their names they are the object.

    Entities are dealt out by ranges of ids, so the parts follow one another; the first begins and the last ends the object.
    """
    inner = lambda x: F.regexp_replace(x, r"(?s)^\{(.*)\}\z", "$1")
    value = lambda v: F.struct(v["value"].alias("qid"), v["labels"].alias("labels"), v["labels_count"].alias("labels_count"))
    props = F.transform_values("props", lambda _, p: F.struct(F.transform(p["values"], value).alias("values"), p["count"].alias("count")))
    parts = F.filter(F.array(inner(F.to_json(F.struct("labels", "labels_count", "sitelinks"))), inner(F.to_json(props))), lambda x: x != "")
    key = F.regexp_replace(F.to_json(F.array("qid")), r"^\[|\]\z", "")
    line = kept(entities.select("qid", F.concat(key, F.lit(": {"), F.array_join(parts, ", "), F.lit("}")).alias("value")))
    ends = line.agg(F.min("qid").alias("_least"), F.max("qid").alias("_most"))
    framed = F.concat(F.when(F.col("qid") == F.col("_least"), "{\n").otherwise(","), "value", F.when(F.col("qid") == F.col("_most"), "\n}").otherwise(""))
    out = line.join(F.broadcast(ends)).repartitionByRange("qid").sortWithinPartitions("qid").select(framed.alias("value"))
    (out if not line.isEmpty() else entities.sparkSession.createDataFrame([("{}",)], "value string")).write.mode("overwrite").text(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or lines) of prompt records, with the entity language from the file's name."""
    df = spark.read.schema(PROMPTS).json(path, multiLine=True)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json", 1).alias("LoE"))


def write_prompts(prompts: DataFrame, path: str) -> None:
    prompts.write.mode("overwrite").partitionBy("LoE").json(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed table; none yet is an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = (), header: bool = True) -> None:
    df.drop(*drop).write.mode("overwrite").options(quote='"', escape='"', header=str(header).lower()).csv(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """One folder for each property and model; a rerun replaces the folders it writes only."""
    answers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("property", "model").options(quote='"', escape='"', header="true").csv(path)


def has_columns(df: DataFrame, *columns: str) -> bool:
    """Whether a file has been graded or translated already, by its columns."""
    return set(columns) <= set(df.columns)
