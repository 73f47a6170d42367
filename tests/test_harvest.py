"""A harvest in pages against a small store on this machine, and batches of prompts."""

import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from kgloom.operators import inference
from kgloom.sources import sparql

CLASSES = {f"Q{k}": [f"E{k}_{i:03}" for i in range(7 * k)] for k in range(1, 6)}


class Store(BaseHTTPRequestHandler):
    asked: list[str] = []
    broken_at = None

    def do_GET(self):
        query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0]
        limit, offset = map(int, re.search(r"LIMIT (\d+) OFFSET (\d+)", query).groups())
        Store.asked.append(query)
        if Store.broken_at is not None and offset >= Store.broken_at:
            self.send_response(500)
            self.end_headers()
            return
        found = sorted(e for c in re.findall(r"wd:(Q\d+)", query) for e in CLASSES[c])[offset : offset + limit]
        body = json.dumps({"results": {"bindings": [{"entity": {"value": e}} for e in found]}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def store():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Store.asked, Store.broken_at = [], None
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def options(store):
    return {"endpoint": store, "query": "SELECT ?entity {{ VALUES ?c {{ {classes} }} }} LIMIT {limit} OFFSET {offset}", "classes": ",".join(CLASSES), "batch": "2", "limit": "10", "variables": "entity", "tries": "1", "pace": "0"}


def test_a_broken_harvest_goes_on_at_its_page(spark, store, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    everything = {e for es in CLASSES.values() for e in es}
    Store.broken_at = 20
    with pytest.raises(StreamingQueryException):
        sparql.finish(sparql.harvest(spark, options(store), out, check))
    before = {r["entity"] for r in sparql.harvested(spark, out, "entity").collect()}
    assert 0 < len(before) < len(everything)
    first, Store.asked, Store.broken_at = len(Store.asked), [], None
    sparql.finish(sparql.harvest(spark, options(store), out, check))
    assert {r["entity"] for r in sparql.harvested(spark, out, "entity").collect()} == everything
    assert first and all(int(q.rsplit(" ", 1)[1]) >= 20 for q in Store.asked), "pages that were done are not asked for again"


def test_gate_and_ended_batches(spark, store, tmp_path):
    out = str(tmp_path / "out")
    even = lambda page: page.where(F.substring("entity", -1, 1).cast("int") % 2 == 0)
    sparql.finish(sparql.harvest(spark, options(store), out, str(tmp_path / "check"), even))
    assert {r["entity"] for r in sparql.harvested(spark, out, "entity").collect()} == {e for es in CLASSES.values() for e in es if int(e[-1]) % 2 == 0}
    # 21, 49 and 35 entities in pages of 10: 3, 5 and 4 pages, the last of each not full
    assert len(Store.asked) == 12


def test_filters_become_values():
    reader = sparql.SparqlReader({"query": "Q {ids} P {properties}", "variables": "qid,property,v", "batch": "2", "ids": "", "endpoint": "e"})
    left = list(reader.pushFilters([In(("qid",), ("Q1", "Q2", "Q3")), In(("qid",), ("Q3", "Q2", "Q9")), EqualTo(("property",), "P27"), GreaterThan(("v",), "1")]))
    assert left == [GreaterThan(("v",), "1")]
    assert [p.value for p in reader.partitions()] == [["Q2", "Q3"]] and reader.only["property"] == ["P27"]
    list(reader.pushFilters([EqualTo(("qid",), "Q7")]))
    assert reader.partitions() == []


def test_pushdown_through_spark(spark, store):
    spark.dataSource.register(sparql.SparqlSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        o = {"endpoint": store, "query": "SELECT ?entity {{ VALUES ?c {{ {ids} }} }} LIMIT 100 OFFSET 0", "variables": "entity", "tries": "1", "pace": "0"}
        df = spark.read.format("sparql").options(**o).load().where(F.col("entity").isin("Q1", "Q2"))
        assert df.count() == 21 and "wd:Q1 wd:Q2" in Store.asked[-1]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_ids_of_a_table_are_asked_in_batches(spark, store):
    o = {"endpoint": store, "query": "SELECT ?entity {{ VALUES ?c {{ {ids} }} }} LIMIT 100 OFFSET 0", "variables": "entity", "tries": "1", "pace": "0"}
    ids = spark.createDataFrame([(c,) for c in CLASSES] * 2 + [(None,)], "qid string").repartition(3)
    assert {r["entity"] for r in sparql.asked(ids, o, size=2, tasks=2).collect()} == {e for es in CLASSES.values() for e in es}
    assert sorted(len(re.findall(r"wd:Q\d", q)) for q in Store.asked) == [1, 2, 2]


def samples(spark, n):
    rows = [(f"Q{i}", "en", "dob", "fr", "[]", "say ", "x" * (i * 7 % 50)) for i in range(n)]
    return spark.createDataFrame(rows, "Q_number string, LoE string, property string, LoQ string, gt string, instruction string, question string").repartition(5)


def test_batches_are_full_and_of_like_length(spark):
    how = inference.settings("microsoft/phi-4") | {"batch_size": 16}
    out = inference.Batched("microsoft/phi-4", lambda batch, how: [f"{len(batch)} {how['batch_size']}"] * len(batch), settings_=how)
    got = inference.infer(samples(spark, 100), "microsoft/phi-4", out).groupBy("llm_output").count().collect()
    assert {r["llm_output"]: r["count"] for r in got} == {"16 16": 96, "4 16": 4}
    asked = inference.in_batches(samples(spark, 100).withColumn("input", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))), 16)
    report = {r["batch"]: r for r in inference.batch_report(asked).collect()}
    lengths = sorted(i * 7 % 50 for i in range(100))
    assert {b: (r["n"], r["longest"], r["padding"]) for b, r in report.items()} == {b: (len(x), max(x), max(x) * len(x) - sum(x)) for b, x in enumerate(lengths[i : i + 16] for i in range(0, 100, 16))}


def test_a_failing_row_fails_alone():
    calls = []

    def model(batch, how):
        calls.append(list(batch))
        if "bad" in batch:
            raise OSError("no")
        return [x.upper() for x in batch]

    got = inference.asked_for(model, ["a", "b", "bad", "d", "e"], {}, 2)
    assert got == [("A", None), ("B", None), (None, "OSError: no"), ("D", None), ("E", None)] and calls.count(["a", "b", "bad", "d", "e"]) == 2
    flaky = iter([OSError("once"), None])

    def once(batch, how):
        e = next(flaky)
        if e:
            raise e
        return batch

    assert inference.asked_for(once, ["a", "b"], {}, 2) == [("a", None), ("b", None)]
    assert inference.asked_for(lambda b, h: ["too", "many"][: 3 - len(b)] if len(b) < 3 else [], ["x"], {}, 1)[0][0] is None
