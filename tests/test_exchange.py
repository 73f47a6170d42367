"""JSON objects in splits, keyed caches, and the state of the grading stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kgloom.schemas import ANSWERS
from kgloom.sources import caches, files
from kgloom.streaming.resume import answer_stream, grade_stream, graded


def odd_object(n):
    r = random.Random(2)
    text = lambda: r.choice(['a "quoted" }', "back\\slash", "{[", "é\nü", "", "}, {", '\\"', "x" * 300])
    return {f"Q{i} {text()}": r.choice([{"labels": {"en": text()}, "list": [1, {"k": text()}, []]}, [], {}, 7, None, text(), {"deep": {"deeper": {"end": [text()]}}}]) for i in range(n)}


@pytest.mark.parametrize("indent", [None, 0, 2])
@pytest.mark.parametrize("split", ["1k", "128m"])
def test_members_of_an_object_in_many_splits(spark, tmp_path, indent, split):
    data = odd_object(400)
    (tmp_path / "o.json").write_text(json.dumps(data, indent=indent, ensure_ascii=False), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = files.members(spark, str(tmp_path / "o.json"))
        got = {r["key"]: r["value"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.keys() == data.keys()
    for k, v in data.items():
        assert (got[k] if isinstance(v, str) or v is None else json.loads(got[k])) == v, (k, got[k])


def test_an_empty_object(spark, tmp_path):
    for text in ("{}", "{\n}\n"):
        (tmp_path / "o.json").write_text(text)
        assert files.members(spark, str(tmp_path / "o.json")).collect() == []


def test_the_parts_of_a_written_object_follow_one_another(spark, tmp_path):
    """Several tasks write; put end to end in the order of their names the parts are one object."""
    schema = "qid string, labels map<string,string>, props map<string, struct<values: array<struct<value:string, value_id:string, labels: map<string,string>, labels_count:int>>, count:int>>, labels_count int, sitelinks int"
    entities = spark.createDataFrame([(f"Q{i}", {"en": f'{{"{i}\n'}, {}, 1, i) for i in range(300)], schema).repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files.write_entity_object(entities, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = sorted((tmp_path / "out").glob("part-*"))
    data = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and list(data) == sorted(data) and data["Q7"] == {"labels": {"en": '{"7\n'}, "labels_count": 1, "sitelinks": 7}
    assert files.members(spark, str(tmp_path / "out")).count() == 300
    files.write_entity_object(entities.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == {}


def test_cache_puts_take_the_place_of_keys(spark, tmp_path):
    cache = caches.Cache(spark, str(tmp_path / "c"), "loq string, text string, en string", ("loq", "text"), 4)
    frame = lambda rows: spark.createDataFrame(rows, "loq string, text string, en string")
    assert cache.read().collect() == []
    cache.put(frame([]))
    cache.put(frame([("fr", f"t{i}", "old") for i in range(50)] + [(None, None, "nothing")]))
    cache.put(frame([("fr", "t3", "new"), ("fr", "t3", "aaa"), ("de", "t3", "x"), (None, None, "still nothing")]))
    got = {(r["loq"], r["text"]): r["en"] for r in cache.read().collect()}
    assert len(got) == cache.read().count() == 52
    assert got["fr", "t3"] == "new" and got["fr", "t4"] == "old" and got["de", "t3"] == "x" and got[None, None] == "still nothing"
    some = cache.read(frame([("fr", "t3", "")]))
    assert 0 < some.count() < 52 and some.where("loq = 'fr' AND text = 't3'").first()["en"] == "new"


def test_cache_takes_the_latest_and_keeps_its_buckets(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", "first", 9), ("a", "second", 10), ("b", "only", 1)], "k string, v string, at int")
    caches.Cache(spark, path, "k string, v string", ("k",), 8).put(rows, latest="at")
    again = caches.Cache(spark, path, "k string, v string", ("k",), 2)
    assert {tuple(r) for r in again.read().collect()} == {("a", "second"), ("b", "only")} and again.manifest()["buckets"] == 8


def test_a_put_that_fails_changes_nothing_and_readers_keep_their_version(spark, tmp_path):
    cache = caches.Cache(spark, str(tmp_path / "c"), "k int, v int", ("k",), 2)
    cache.put(spark.createDataFrame([(i, 0) for i in range(20)], "k int, v int"))
    reader = cache.read()
    with pytest.raises(Exception):  # noqa: B017
        cache.put(spark.range(5).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("broken")).cast("int")).otherwise(1).alias("v")))
    assert cache.read().agg(F.sum("v")).first()[0] == 0
    cache.put(spark.createDataFrame([(1, 7)], "k int, v int"))
    assert reader.agg(F.sum("v"), F.count("*")).first()[:] == (0, 20), "what was replaced is still there for those who read it"
    assert cache.read().agg(F.sum("v"), F.count("*")).first()[:] == (7, 20)
    cache.put(spark.createDataFrame([(1, 8)], "k int, v int"))
    assert len([p for p in (tmp_path / "c").glob("v-*/_bucket=*") if any(p.iterdir())]) <= 4


def test_a_batch_does_not_read_what_was_graded(spark, tmp_path):
    """The output can be taken away: keys that were seen are known from the stream's state."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = []

    def run(ids, done=None):
        rows = [(str(i), "en", "en", "dob", "", "", "p") for i in ids]
        spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").options(header="true", quote='"', escape='"').csv(src)
        grade = lambda b: seen.append(sorted(r[0] for r in b.select("Q_number").collect())) or b
        grade_stream(answer_stream(spark, src), grade, out, check, done=done).awaitTermination()

    run([1, 2, 2])
    (tmp_path / "out").rename(tmp_path / "moved")
    run([2, 3])
    known = spark.createDataFrame([("4", "en", "en", "dob")], "Q_number string, LoQ string, LoE string, property string")
    run([3, 4, 5], known)
    assert [x for x in seen if x] == [["1", "2"], ["3"], ["5"]]
    assert sorted(r["Q_number"] for r in graded(spark, out).collect()) == ["3", "5"]
