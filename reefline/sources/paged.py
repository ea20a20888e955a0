"""Paged services as a source of Spark, batch and stream.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("url", ...).load()
    spark.readStream.format("paged").option("url", ...).option("changedSince", ...).load()

Pages are read by tasks: reader k of n takes pages k, k + n and so on until one isn't full, so no total is
needed and the driver holds no record. A stream's offset is a mark of time: a batch asks for what changed
since the last mark and keeps what isn't newer than the next one; that comes with the next batch.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Answers after which a request is made again.
AGAIN = (408, 425, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Service:
    """What options say about a service. Names in it (``pageParam`` and so on) are those of its interface;
    ``rows`` and ``latest`` are paths of dots into its answers."""

    url: str
    page_size: int = 1000
    readers: int = 8
    attempts: int = 6
    wait: float = 1.0
    timeout: float = 60.0
    first: int = 1
    page_param: str = "page"
    size_param: str = "limit"
    since_param: str = "changed_since"
    rows: str = "data"
    latest: str = "meta.latest"
    id_field: str = "id"
    updated_field: str = "updated_at"

    @staticmethod
    def of(options: dict[str, str]) -> Service:
        low = {k.lower(): v for k, v in options.items()}
        kinds = {"int": int, "float": float, "str": str}
        names = Service.__dataclass_fields__
        return Service(**{n: kinds[f.type](low[n.replace("_", "")]) for n, f in names.items() if n.replace("_", "") in low})

    def ask(self, **parameters) -> dict:
        """One answer. Refusals and failures that pass are asked again, after what the service says in
        Retry-After or twice as long as before."""
        url = f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode(parameters)}"
        for attempt in range(self.attempts):
            pause = self.wait * 2**attempt
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or attempt + 1 == self.attempts:
                    raise
                told = e.headers.get("Retry-After", "")
                pause = float(told) if told.replace(".", "", 1).isdigit() else pause
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
                if attempt + 1 == self.attempts:
                    raise
            time.sleep(pause)
        raise RuntimeError("no attempt was made")

    def page(self, number: int, since: str | None) -> list[dict]:
        more = {self.since_param: since} if since else {}
        return _at(self.ask(**{self.page_param: number, self.size_param: self.page_size}, **more), self.rows) or []

    def newest(self) -> str | None:
        """The time of the service's last change."""
        return _at(self.ask(**{self.page_param: self.first, self.size_param: 1}), self.latest)


def _at(value, path: str):
    for p in path.split("."):
        value = value.get(p) if isinstance(value, dict) else None
    return value


@dataclass
class Pages(InputPartition):
    first: int
    since: str | None = None
    upto: str | None = None


def _records(service: Service, part: Pages) -> Iterator[tuple]:
    number = part.first
    while True:
        rows = service.page(number, part.since)
        for r in rows:
            at = r.get(service.updated_field)
            if (part.since is None or at is None or at > part.since) and (part.upto is None or (at is not None and at <= part.upto)):
                i = r.get(service.id_field)
                yield (None if i is None else str(i), at, json.dumps(r))
        if len(rows) < service.page_size:
            return
        number += service.readers


class _Reader(DataSourceReader):
    def __init__(self, service: Service, since: str | None):
        self.service, self.since = service, since

    def partitions(self) -> list[Pages]:
        return [Pages(self.service.first + k, self.since) for k in range(self.service.readers)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _records(self.service, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, service: Service, since: str | None):
        self.service, self.since = service, since or ""

    def initialOffset(self) -> dict:
        return {"mark": self.since}

    def latestOffset(self) -> dict:
        return {"mark": self.service.newest() or self.since}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if not end["mark"] or start["mark"] >= end["mark"]:
            return []
        return [Pages(self.service.first + k, start["mark"] or None, end["mark"]) for k in range(self.service.readers)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _records(self.service, partition)


class PagedSource(DataSource):
    """(id, updated_at, record): records of a paged service as JSON; ``parsed`` makes columns of them."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, updated_at string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Service.of(self.options), self.options.get("changedSince"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(Service.of(self.options), self.options.get("changedSince"))


def parsed(records: DataFrame, schema: str) -> DataFrame:
    """Records as columns: what isn't in the schema is dropped, what is missing is null."""
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")
