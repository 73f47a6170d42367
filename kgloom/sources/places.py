"""Places by name: the first hit of an entity search, and the countries it lies in, each different name asked once.

What a service can't tell after its retries is a place without an id, as one that nobody knows; a later run asks again.
"""

from __future__ import annotations

import json
import urllib.error
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import PLACES
from .sparql import Retry, get, with_prefixes

#: Attempts, and seconds that each waits more after a broken connection.
TRIES, STEP = 3, 5.0


class Resolver:
    """Asks a search API for names and a triple store for countries; ``ask`` (url, parameters, timeout -> text) stands for the network."""

    def __init__(self, api: str, endpoint: str, ask: Callable[[str, dict, float], str] = get, retry: Retry | None = None):
        self.api, self.endpoint, self.ask = api, endpoint, ask
        self.retry = retry or Retry(tries=TRIES, step=STEP, pace=0.1)

    def answer(self, url: str, params: dict, timeout: float) -> dict:
        try:
            return json.loads(self.retry(lambda: self.ask(url, params, timeout)))
        except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError):
            return {}

    def search(self, name: str, lang: str = "en") -> str | None:
        found = self.answer(self.api, {"action": "wbsearchentities", "search": name, "language": lang, "type": "item", "limit": "1", "format": "json"}, 10).get("search", [])
        return found[0]["id"] if found else None

    def countries(self, q: str, property_id: str = "P17") -> list[str]:
        query = with_prefixes(f"SELECT ?country WHERE {{ wd:{q} wdt:{property_id} ?country . }}")
        rows = self.answer(self.endpoint, {"query": query, "format": "json"}, 15).get("results", {}).get("bindings", [])
        return [r["country"]["value"].rpartition("/")[2] for r in rows]

    def resolve(self, names: DataFrame, known: DataFrame | None = None, tasks: int = 8) -> DataFrame:
        """names (name) -> PLACES: those of ``known``, and the others asked by ``tasks`` tasks at most."""
        wanted = names.select(F.lower(strip(names.columns[0])).alias("name_key")).where("name_key <> ''").distinct()
        if known is not None:
            wanted = wanted.join(known, "name_key", "left_anti")

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = [self.search(n) for n in batch["name_key"]]
                yield pd.DataFrame({"name_key": batch["name_key"], "q": ids, "countries": [self.countries(q) if q else [] for q in ids]})

        new = wanted.repartition(tasks).mapInPandas(rows, PLACES)
        return new if known is None else known.select("name_key", "q", "countries").unionByName(new)
