import json
import urllib.error

import pytest

from kgloom import providers
from kgloom.operators import grading, inference
from kgloom.plans import plots
from kgloom.schemas import ANSWERS, PROPERTIES, VERDICTS, requested
from kgloom.sources import files, places, sparql
from kgloom.streaming.resume import answer_stream, grade_stream, graded


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ids(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("Q1\n  Q2 \n\nQ3")
    ids = files.read_ids(spark, str(tmp_path / "ids.csv"))
    assert rows(ids) == [("Q1",), ("Q2",), ("Q3",)]
    files.write_ids(ids, str(tmp_path / "out"))
    assert rows(files.read_ids(spark, str(tmp_path / "out"))) == rows(ids)


def test_answers_round_trip(spark, tmp_path):
    data = [("Q1", "en", "fr", "pob", "['a']", 'two\nlines, "quoted"', "p"), ("Q2", "en", "fr", "dob", "", "", "")]
    df = spark.createDataFrame(data, ANSWERS)
    files.write_csv(df, str(tmp_path / "a"))
    assert rows(files.read_answers(spark, str(tmp_path / "a"))) == rows(df)
    from pyspark.sql import functions as F

    files.write_answers(df.withColumn("model", F.lit("m1")), str(tmp_path / "split"))
    assert {p.name for p in (tmp_path / "split").glob("property=*/model=*")} == {"model=m1"} and len(list((tmp_path / "split").glob("property=*"))) == 2
    assert files.has_columns(df, "gt") and not files.has_columns(df, "eval")


def test_model_from_file_name(spark, tmp_path):
    head = ANSWERS.replace(" string", "").replace(", ", ",")
    (tmp_path / "property_pob_phi-4.csv").write_text(head + "\nQ1,en,fr,pob,x,y,z\n")
    (tmp_path / "other.csv").write_text(head + "\nQ2,en,fr,pob,x,y,z\n")
    assert [(r["Q_number"], r["model"]) for r in files.read_model_answers(spark, str(tmp_path), "property_pob").collect()] == [("Q1", "phi-4")]
    assert files.read_model_answers(spark, str(tmp_path), "property_dob").count() == 2


def test_missing_texts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\nN/A,1\nNONE,\n")
    assert rows(files.read_csv(spark, str(tmp_path / "x.csv"), "a string, b int")) == [("NONE", None), (None, 1)]


def test_entities_file(spark, tmp_path):
    value = {"qid": "http://x/Q9", "labels": {"en": "London"}, "labels_count": 1}
    (tmp_path / "e.json").write_text(json.dumps({"Q1": {"labels": {"en": "A"}, "labels_count": 1, "sitelinks": 12, "P19": {"values": [value], "count": 2}}, "Q2": {}}))
    got = {r["qid"]: r for r in files.read_entities(spark, str(tmp_path / "e.json"), ["P19", "P27"]).collect()}
    assert got["Q1"]["sitelinks"] == 12 and got["Q1"]["props"]["P19"]["count"] == 1 and got["Q1"]["props"]["P19"]["values"][0]["value_id"] == "Q9"
    assert got["Q2"]["props"] == {} and got["Q2"]["labels"] is None


def test_prompt_file(spark, tmp_path):
    (tmp_path / "Arabic.json").write_text(json.dumps([{"ent_ID": "Q1", "lang": "fr", "pob_ground_truth": ["x"], "pob_prompt": "## a ## b", "num_sitelinks": 3}]))
    r = files.read_prompts(spark, str(tmp_path)).first()
    assert (r["LoE"], r["pob_ground_truth"], r["dob_prompt"]) == ("Arabic", ["x"], None)


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.read_cache(spark, path, VERDICTS).collect() == []
    for i in range(2):
        files.append_cache(spark.createDataFrame([(str(i), "b", "c")], VERDICTS), path)
    assert files.read_cache(spark, path, VERDICTS).count() == 2


def test_retries():
    waits, calls = [], []
    retry = sparql.Retry(tries=4, step=10, pace=0.5, sleep=waits.append)

    def ask():
        calls.append(1)
        if len(calls) == 1:
            raise urllib.error.URLError("down")
        if len(calls) == 2:
            raise urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "3"}, None)
        return "ok"

    assert retry(ask) == "ok" and waits == [0.5, 10.0, 0.5, 6.0, 0.5]
    with pytest.raises(urllib.error.URLError):
        sparql.Retry(tries=2, sleep=waits.append)(lambda: (_ for _ in ()).throw(urllib.error.URLError("down")))
    with pytest.raises(urllib.error.HTTPError):
        sparql.Retry(tries=2, sleep=waits.append)(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 500, "x", {}, None)))


def test_sparql_source(monkeypatch):
    asked = []
    answer = {"results": {"bindings": [{"qid": {"value": "Q1"}, "v": {"value": "7"}}, {"qid": {"value": "Q2"}}]}}
    monkeypatch.setattr(sparql, "get", lambda url, params, timeout: asked.append(params["query"]) or json.dumps(answer))
    monkeypatch.setattr(sparql.Retry, "pace", 0)
    source = sparql.SparqlSource({"endpoint": "http://e", "query": "SELECT * {{ VALUES ?q {{ {ids} }} }}", "ids": "Q1, Q2,Q3", "batch": "2", "variables": "qid,v"})
    reader = source.reader(None)
    parts = reader.partitions()
    assert source.schema() == "qid string, v string" and [p.value for p in parts] == [["Q1", "Q2"], ["Q3"]]
    assert list(reader.read(parts[0])) == [("Q1", "7"), ("Q2", None)] and "VALUES ?q { wd:Q1 wd:Q2 }" in asked[0] and asked[0].startswith("PREFIX wd:")


def test_providers(spark):
    misses = spark.createDataFrame([("fr", "a"), ("fr", "b")], "loq string, text string")
    assert rows(providers.TableTranslator(spark.createDataFrame([("fr", "a", "A")], "loq string, text string, en string")).translate(misses)) == [("fr", "a", "A"), ("fr", "b", None)]
    assert rows(providers.Called(lambda b: b["text"].str.upper(), "out", tasks=2).translate(misses)) == [("fr", "a", "A"), ("fr", "b", "B")]

    def fails(b):
        raise OSError("service is down")

    assert rows(providers.Called(fails, "out").translate(misses)) == [("fr", "a", "a"), ("fr", "b", "b")]
    questions = spark.createDataFrame([("x", "y")], "llm_output string, gt_raw string")
    assert providers.TableJudge(spark.createDataFrame([], VERDICTS)).judge(questions).first()["match_type"] == "no_match"
    assert providers.Called(lambda b: b["llm_output"] + "!", "m").judge(questions).first()["match_type"] == "x!"


def test_stream_grades_each_key_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    row = lambda i: (str(i), "en", "en", "dob", "1901-01-01", "1901-01-01", "p")

    def run(ids):
        spark.createDataFrame([row(i) for i in ids], ANSWERS).coalesce(1).write.mode("append").options(header="true", quote='"', escape='"').csv(src)
        grade_stream(answer_stream(spark, src), grading.grade_dob, out, check).awaitTermination()
        return sorted(r["Q_number"] for r in graded(spark, out).collect())

    assert run([1, 2, 2]) == ["1", "2"] and run([2, 3]) == ["1", "2", "3"]


def test_inference(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    samples = spark.createDataFrame([("Q1", "en", "dob", "fr", "['x']", "## say\n", "## when?"), ("Q2", "en", "dob", "de", "['y']", "## say ", "## where?")], "Q_number string, LoE string, property string, LoQ string, gt string, instruction string, question string")

    def answer(batch):
        return pd.Series([m[-1]["content"] + "<think>no</think> yes </think> 7 " for m in batch["input"]])

    class Echo:
        def generate(self, rows):
            return providers.Called(answer, "llm_output", tasks=2).generate(rows).withColumn("previous", F.element_at("input", -1)["content"])

    assert inference.settings("Qwen/Qwen3-14B") == {"max_new_tokens": 128, "do_sample": True, "temperature": 0.6, "batch_size": 128, "enable_thinking": False}
    got = rows(inference.infer(samples, "google/gemma-2-9b-it", Echo()))
    assert [r[5:] for r in got] == [("<think>no</think> yes </think> 7", "## say ## when?"), ("<think>no</think> yes </think> 7", "## say ## where?")]
    assert [r[5] for r in rows(inference.infer(samples, "deepseek-ai/DeepSeek-R1-Distill", Echo(), "user"))] == ["yes", "yes"]


def test_places_are_resolved_once_each(spark):
    asked = []

    def ask(url, params, timeout):
        asked.append(url)
        if url == "api":
            return json.dumps({"search": {"lyon": [{"id": "Q456"}], "down": []}.get(params["search"], [])}) if params["search"] != "broken" else "<html>"
        return json.dumps({"results": {"bindings": [{"country": {"value": "http://e/Q142"}}]}})

    r = places.Resolver("api", "sparql", ask, sparql.Retry(tries=2, pace=0, sleep=lambda _: None))
    assert r.search("lyon") == "Q456" and r.search("down") is None and r.search("broken") is None and r.countries("Q456") == ["Q142"]

    def broken(url, params, timeout):
        asked.append("broken")
        raise urllib.error.URLError("down")

    asked.clear()
    assert places.Resolver("api", "sparql", broken, sparql.Retry(tries=3, pace=0, sleep=lambda _: None)).countries("Q1") == [] and len(asked) == 3

    def here(url, params, timeout):
        return json.dumps({"search": [{"id": "Q" + params["search"]}]} if url == "api" else {"results": {"bindings": [{"country": {"value": "http://e/Q7"}}]}})

    names = spark.createDataFrame([(" A ",), ("a",), ("b",), ("",), (None,)], "name string")
    known = spark.createDataFrame([("b", "Qold", ["Q1"])], "name_key string, q string, countries array<string>")
    got = places.Resolver("api", "sparql", here, sparql.Retry(tries=1, pace=0)).resolve(names, known, 2)
    assert rows(got) == [("a", "Qa", ["Q7"]), ("b", "Qold", ["Q1"])]


def test_entity_object_round_trip(spark, tmp_path):
    value = {"qid": "http://x/Q9", "labels": {"en": "Zoë \"Z\""}, "labels_count": 1}
    data = {"Q1": {"labels": {"en": "A"}, "labels_count": 1, "sitelinks": 12, "P19": {"values": [value], "count": 1}}, "Q2": {"labels_count": 0}}
    (tmp_path / "e.json").write_text(json.dumps(data))
    got = files.read_entities(spark, str(tmp_path / "e.json"), ["P19"])
    files.write_entity_object(got, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert json.loads(part.read_text())["Q1"] == data["Q1"] and "Zoë" in part.read_text()
    assert rows(files.read_entities(spark, str(tmp_path / "out"), ["P19"])) == rows(got)


def test_plots(spark):
    import xml.etree.ElementTree as ET

    df = spark.createDataFrame([("a <x>", 0.5, None), ("b", 1.0, 0.25)], "model string, en double, fr double")
    root = ET.fromstring(plots.heatmap(df, "model", "F1"))
    texts = [t.text for t in root.iter("{http://www.w3.org/2000/svg}text")]
    assert texts == ["F1", "en", "fr", "a <x>", "0.50", "b", "1.00", "0.25"] and len(list(root.iter("{http://www.w3.org/2000/svg}rect"))) == 4
    line = spark.createDataFrame([("g", 1, 0.5), ("g", 3, 1.0), ("h", 2, 1.0)], "g string, x int, f double")
    root = ET.fromstring(plots.curves(line, "g", "x", "f", "ECDF", steps=True))
    assert [p.get("d") for p in root.iter("{http://www.w3.org/2000/svg}path")][1:] == ["M60.0 190.0H620.0V40.0", "M340.0 40.0"]


def test_contracts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in ('{"en": "France"}', '{"en": ["France", "Spa\\"in"]}', "broken", None, '{"en": null}', '{"match_type": "exact_match"}', '{"match_type": "x"}')], "a string")
    assert [r[0] for r in df.select(providers.translation_of(F.col("a"), F.lit("as it was"))).collect()] == ["France", '["France", "Spa\\"in"]', *["as it was"] * 5]
    assert [r[0] for r in df.select(providers.verdict_of(F.col("a"), providers.VERDICTS["pob"])).collect()] == [*["no_match"] * 5, "exact_match", "no_match"]


def test_requested_properties():
    assert len(PROPERTIES) == 33 and "P21" not in requested({"sex": "P21", "place_of_birth": "P19"}).values()
