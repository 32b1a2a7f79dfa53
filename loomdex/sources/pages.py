"""A batch data source for the page service: a list of page ids, and a page per id, over HTTP POST."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from http.client import HTTPConnection, HTTPException

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _Link:
    """One connection that is kept open, and opened anew when the service has closed it; tries are bounded."""

    def __init__(self, host: str, port: int, tries: int, wait: float):
        self.at, self.tries, self.wait, self.open = (host, port), tries, wait, None

    def post(self, path: str, body: str) -> str:
        last: Exception | None = None
        for n in range(self.tries):
            try:
                if self.open is None:
                    self.open = HTTPConnection(*self.at, timeout=30)
                self.open.request("POST", path, body, {"Content-Type": "application/x-www-form-urlencoded"})
                answer = self.open.getresponse()
                text = answer.read().decode("utf-8", "replace")
                if answer.status == 200:
                    return text
                last = HTTPException(f"status {answer.status}")
            except (OSError, HTTPException) as e:
                last = e
            self.open = None
            time.sleep(self.wait * (n + 1))
        raise RuntimeError(f"no answer to {path} after {self.tries} tries") from last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "localhost"), int(options.get("port", "80"))
        self.name, self.passcode = options.get("name", ""), options.get("passcode", "")
        self.parts, self.tries, self.wait = int(options.get("partitions", "8")), int(options.get("tries", "5")), float(options.get("wait", "0.2"))

    def _link(self) -> _Link:
        return _Link(self.host, self.port, self.tries, self.wait)

    def partitions(self) -> list[_Range]:
        ids = [str(x).strip() for x in json.loads(self._link().post("/pull_page_names", f"name={self.name}&passcode={self.passcode}"))]
        size = max(1, -(-len(ids) // self.parts))
        return [_Range(ids[i : i + size]) for i in range(0, len(ids), size)] or [_Range([])]

    def read(self, partition: _Range) -> Iterator[tuple[str, str]]:
        link = self._link()
        for i in partition.ids:
            yield i, link.post("/pull_data", f"unique_id={i}&name={self.name}&passcode={self.passcode}")


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("pages").option("host", ..).option("port", ..).load().

    Options: host, port, name, passcode, partitions (8), tries (5) and wait (seconds, growing with each try)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page_id string, body string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)
