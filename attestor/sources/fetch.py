"""Fetching of pages as a data source: ``spark.read.format("http_pages")``."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "url string, final_url string, status int, content_type string, body string, error string"
RETRY_STATUS = {403, 429}


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def fetch(url: str, timeout: float = 15.0, tries: int = 3, wait: float = 1.0, opener=urllib.request.urlopen) -> tuple:
    """One row of SCHEMA. Lost connections and the statuses 403 and 429 are tried again after 1, 2, 4 ... times
    ``wait``; any other status, and the last failure, is returned as a row, never raised, so that one page does not
    fail a job."""
    status, error = None, ""
    for turn in range(tries):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
            with opener(request, timeout=timeout) as got:
                kind = got.headers.get("Content-Type", "")
                charset = got.headers.get_content_charset() or "utf-8"
                return url, got.geturl(), got.status, kind, got.read().decode(charset, "replace"), None
        except urllib.error.HTTPError as e:
            status, error = e.code, str(e)
            if e.code not in RETRY_STATUS:
                break
        except (OSError, ValueError) as e:
            status, error = None, str(e)
        if turn + 1 < tries:
            time.sleep(wait * 2**turn)
    return url, None, status, None, None, error


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.per_task = int(options.get("perTask", 20))
        self.timeout, self.tries = float(options.get("timeout", 15)), int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, self.timeout, self.tries)


class HttpPages(DataSource):
    """Options: ``urls`` (one on a line), ``perTask``, ``timeout``, ``tries``. For url tables of any size use
    :func:`fetch_table`."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options)


def fetch_table(urls, url_col: str = "url", timeout: float = 15.0, tries: int = 3):
    """Fetches each different address of a table once and returns rows of SCHEMA."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([fetch(u, timeout, tries) for u in batch["url"]], columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return urls.selectExpr(f"{url_col} as url").where("url is not null").distinct().mapInPandas(run, SCHEMA)


def resolved(fetched):
    """``url, final_url`` of fetched rows: where each address led, where that is an http address."""
    return fetched.where("final_url rlike '(?i)^https?://'").select("url", "final_url").dropDuplicates(["url"])
