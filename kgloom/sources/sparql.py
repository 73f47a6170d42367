"""A triple store as a Spark source: one partition a batch of ids, each asked for with pace, timeout and retries.

    spark.dataSource.register(SparqlSource)
    spark.read.format("sparql").options(endpoint=..., query="SELECT ... VALUES ?qid {{ {ids} }} ...", ids="Q1,Q2", batch=200, variables="qid,value").load()

With spark.sql.python.filterPushdown.enabled, filters ``qid = ...`` and ``qid IN (...)`` take the place of the ids, and filters on the
column ``property`` fill ``{properties}``, so that the store is asked for these only. ``asked`` takes the ids from a DataFrame of any size.

``PagedSparql`` harvests as a stream of pages: its offsets are page numbers, so a harvest that broke off goes on at its page.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..operators.order import batched


@dataclass
class Retry:
    """``tries`` attempts; a broken connection waits ``step`` seconds more each time, a 429 as told times the attempt. Then the error is raised."""

    tries: int = 5
    step: float = 10.0
    pace: float = 0.5
    jitter: tuple[float, float] | None = None
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, ask: Callable[[], str]) -> str:
        for n in range(1, self.tries + 1):
            self.sleep(random.uniform(*self.jitter) if self.jitter else self.pace)
            try:
                return ask()
            except urllib.error.HTTPError as e:
                if e.code != 429 or n == self.tries:
                    raise
                self.sleep(float(e.headers.get("Retry-After", self.step)) * n)
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n == self.tries:
                    raise
                self.sleep(self.step * n)
        raise ValueError("tries must be positive")


def get(url: str, params: dict[str, str], timeout: float = 300, agent: str = "kgloom") -> str:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"User-Agent": agent, "Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode("utf-8")


def batches(ids: list[str], size: int) -> list[list[str]]:
    return [ids[i : i + size] for i in range(0, len(ids), size)]


PREFIXES = {"wd": "http://www.wikidata.org/entity/", "wdt": "http://www.wikidata.org/prop/direct/", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "skos": "http://www.w3.org/2004/02/skos/core#", "schema": "http://schema.org/"}


def with_prefixes(query: str, prefixes: dict[str, str] = PREFIXES) -> str:
    return "\n".join([*(f"PREFIX {p}: <{u}>" for p, u in prefixes.items()), query])


def bindings(options: dict, query: str) -> Iterator[dict[str, str]]:
    """What the endpoint answers: each binding's values by variable."""
    ask = lambda: get(options["endpoint"], {"query": with_prefixes(query), "format": "json"}, float(options.get("timeout", 300)))
    retry = Retry(tries=int(options.get("tries", 5)), pace=float(options.get("pace", Retry.pace)), step=float(options.get("step", Retry.step)))
    for b in json.loads(retry(ask))["results"]["bindings"]:
        yield {v: x.get("value") for v, x in b.items()}


def terms(names: list[str], prefix: str) -> str:
    return " ".join(f"{prefix}:{n}" for n in names)


def listed(options: dict, name: str) -> list[str]:
    return [x.strip() for x in (options.get(name) or "").split(",") if x.strip()]


class SparqlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.only: dict[str, list[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes lists of ids and properties, the common part of several; Spark keeps all other filters."""
        key = self.options["variables"].split(",")[0]
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in (key, "property"):
                yield f
                continue
            values = [str(v) for v in (f.value if isinstance(f, In) else [f.value])]
            known = self.only.get(column)
            self.only[column] = values if known is None else [v for v in known if v in values]

    def partitions(self) -> list[InputPartition]:
        key = self.options["variables"].split(",")[0]
        ids = listed(self.options, "ids")
        if key in self.only:
            ids = [i for i in self.only[key] if not ids or i in ids]
            if not ids:
                return []
        return [InputPartition(b) for b in batches(ids, int(self.options.get("batch", 200)))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        properties = self.only.get("property", listed(self.options, "properties"))
        query = self.options["query"].format(ids=terms(partition.value, "wd"), properties=terms(properties, "wdt"))
        names = self.options["variables"].split(",")
        for b in bindings(self.options, query):
            yield tuple(b.get(v) for v in names)


class SparqlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return ", ".join(f"{v} string" for v in self.options["variables"].split(","))

    def reader(self, schema) -> SparqlReader:
        return SparqlReader(dict(self.options))


def asked(ids: DataFrame, options: dict[str, str], size: int = 200, tasks: int = 4) -> DataFrame:
    """One column of ids, of any size -> the variables of the query, asked in batches of ``size`` ids by ``tasks`` tasks at most."""
    (qid,) = ids.columns
    names = options["variables"].split(",")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for found in frame["ids"]:
                rows = bindings(options, options["query"].format(ids=terms(found.tolist(), "wd"), properties=terms(listed(options, "properties"), "wdt")))
                yield pd.DataFrame([[b.get(v) for v in names] for b in rows], columns=names, dtype=object)

    requests = batched(ids.where(F.col(qid).isNotNull()).distinct(), size, F.length(qid), qid).groupBy("batch").agg(F.collect_list(qid).alias("ids"))
    return requests.repartition(tasks, "batch").select("ids").mapInPandas(ask, ", ".join(f"{v} string" for v in names))


class PageReader(SimpleDataSourceStreamReader):
    """Pages of all batches of classes; an offset is the next page and the batches that have more, numbers joined by commas.

    A batch of classes ends with its first page that isn't full. A page is asked for again after a failure, the pages before never.
    """

    def __init__(self, options: dict):
        self.options = options
        self.limit = int(options.get("limit", 100))
        self.classes = batches(listed(options, "classes"), int(options.get("batch", 4)))

    def initialOffset(self) -> dict:
        return {"page": 0, "live": ",".join(map(str, range(len(self.classes))))}

    def page(self, start: dict) -> tuple[list[tuple], dict]:
        rows, live = [], []
        for k in listed(start, "live"):
            query = self.options["query"].format(classes=terms(self.classes[int(k)], "wd"), limit=self.limit, offset=start["page"] * self.limit)
            found = [tuple(b.get(v) for v in self.options["variables"].split(",")) for b in bindings(self.options, query)]
            rows += found
            if len(found) >= self.limit:
                live.append(k)
        return rows, {"page": start["page"] + 1, "live": ",".join(live)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not start["live"]:
            return iter([]), start
        rows, end = self.page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["page"] < end["page"]:
            rows, start = self.page(start)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


class PagedSparql(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql_pages"

    def schema(self) -> str:
        return ", ".join(f"{v} string" for v in self.options["variables"].split(","))

    def simpleStreamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def harvest(spark: SparkSession, options: dict[str, str], out: str, checkpoint: str, gate: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts a harvest to Parquet: different rows of each page, those that pass the gate (enough links, for one), a folder for each page.

    A harvest with the same checkpoint goes on at the page where the last one broke off; a page that is done again
    replaces its folder. ``harvested`` reads all pages.
    """
    spark.dataSource.register(PagedSparql)

    def step(page: DataFrame, number: int) -> None:
        rows = page.distinct()
        (gate(rows) if gate else rows).write.mode("overwrite").parquet(f"{out}/page={number}")

    return spark.readStream.format("sparql_pages").options(**options).load().writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def finish(query: StreamingQuery, pause: float = 0.2) -> None:
    """Waits until a harvest has all pages, and stops it; raises what made it fail."""
    while query.isActive:
        seen = query.lastProgress
        if seen is not None and ended(seen["sources"][0]["endOffset"]):
            query.processAllAvailable()
            query.stop()
            return
        time.sleep(pause)
    if query.exception() is not None:
        raise query.exception()


def ended(offset: str | dict | None) -> bool:
    """Whether no batch of classes has more pages after an offset, which progress reports as a dict or as its text."""
    live = offset.get("live") if isinstance(offset, dict) else (re.findall(r"""live['"]: *['"]([\d,]*)['"]""", offset or "") or [None])[0]
    return live == ""


def harvested(spark: SparkSession, out: str, variables: str) -> DataFrame:
    """Different rows of all pages."""
    return spark.read.schema(", ".join(f"{v} string" for v in variables.split(","))).parquet(f"{out}/page=*").distinct()
