"""One request per row: looked up in a table of pages by default, over the network where a fetcher is given."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import render

SCHEMA = "row_id long, status_code int, body string, error string"


@dataclass(frozen=True)
class HttpRequest:
    url: str
    method: str = "GET"
    params: dict[str, str] = field(default_factory=dict)
    body: str | None = None
    retries: int = 2
    concurrency: int = 4
    delay_s: float = 0.0
    fail_open: bool = True

    def __post_init__(self):
        if self.method not in ("GET", "POST"):
            raise ValueError("method is GET or POST")
        if self.method == "POST" and self.body is None:
            raise ValueError("POST needs a body")
        if not any("{query}" in x for x in (self.url, self.body or "", *self.params.values())):
            raise ValueError("{query} must stand in the url, a parameter or the body")
        if not 0 <= self.retries <= 10 or not 1 <= self.concurrency <= 8:
            raise ValueError("0 to 10 retries, 1 to 8 at once")

    def url_of(self, query: Column, kind) -> Column:
        """The full url of a row."""
        text = render(self.url, {"query": (query, kind)})
        for i, (k, v) in enumerate(self.params.items()):
            text = F.concat(text, F.lit(("&" if "?" in self.url or i else "?") + f"{k}="), F.url_encode(render(v, {"query": (query, kind)})))
        return text


def fetch_from_pages(queries: DataFrame, request: HttpRequest, pages: DataFrame) -> DataFrame:
    """Offline: the page whose url a row asks for; no page is status 404, with an error if the request fails open. A page without a body is found.

    A url names one page: a row that asks for a url of several pages gets a row from each.
    """
    asked = queries.select("row_id", request.url_of(F.col("value"), queries.schema["value"].dataType).alias("url"))
    found = asked.join(pages.select("url", F.col("html").alias("body"), F.lit(True).alias("__found")), "url", "left")
    missing = F.col("__found").isNull()
    error = F.when(missing, F.lit("not found") if request.fail_open else F.raise_error(F.concat(F.lit("not found: "), F.col("url"))))
    return found.select("row_id", F.when(missing, 404).otherwise(200).alias("status_code"), "body", error.alias("error"))


def over_network(method: str, url: str, body: str | None) -> tuple[int, str]:
    """A plain request with the standard library; error statuses are results."""
    request = urllib.request.Request(url, body.encode() if body is not None else None, {"Content-Type": "application/json"} if body is not None else {}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as bad:
        return bad.code, ""


def fetch(queries: DataFrame, request: HttpRequest, fetcher: Callable[[str, str, str | None], tuple[int, str]]) -> DataFrame:
    """Over ``fetcher(method, url, body) -> (status, text)``: bounded threads in each task, retries with doubling waits."""
    kind = queries.schema["value"].dataType
    asked = queries.select("row_id", request.url_of(F.col("value"), kind).alias("url"), (render(request.body, {"query": (F.col("value"), kind)}) if request.body else F.lit(None).cast("string")).alias("payload"))

    def one(row) -> tuple:
        error = None
        for attempt in range(request.retries + 1):
            try:
                status, text = fetcher(request.method, row[1], row[2])
                if status < 500:
                    return row[0], status, text if status < 400 else None, None if status < 400 else f"status {status}"
                error = f"status {status}"
            except OSError as bad:
                error = str(bad)
            time.sleep(min(30, 2**attempt) * 0.1)
        if not request.fail_open:
            raise RuntimeError(f"{row[1]}: {error}")
        return row[0], 500, None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(request.concurrency) as pool:
            for frame in frames:
                waiting = []
                for row in frame.itertuples(index=False, name=None):
                    waiting.append(pool.submit(one, row))
                    time.sleep(request.delay_s)
                yield pd.DataFrame([w.result() for w in waiting], columns=["row_id", "status_code", "body", "error"])

    return asked.mapInPandas(run, SCHEMA)
