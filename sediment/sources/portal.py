"""Published tables behind a JSON query interface, as a Spark data source.

The interface takes ``$select``, ``$where``, ``$order``, ``$group``, ``$limit`` and ``$offset``. Reading is split into
pages in a stable order; the number of readers is bounded, and each reader keeps a pause between its requests.
"""

from __future__ import annotations

import email.message
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY_ON = frozenset((429, 500, 502, 503, 504))
PAUSE_S = 0.7
RETRIES = 4
LONGEST_WAIT_S = 60.0
PAGE = 2000
#: Headers that tell when and from what a response was made, two of them the portal's own account of its data.
PROVENANCE = ("last-modified", "etag", "x-soda2-truth-last-modified", "x-soda2-data-out-of-date", "age", "date")


class PortalError(RuntimeError):
    pass


class Response(NamedTuple):
    data: Any
    headers: dict[str, str]


def _get(url: str, timeout: float = 60.0) -> Response:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return Response(json.load(r), dict(r.headers.items()))


class Client:
    """Requests with a pause between them and retries after failures that may pass."""

    def __init__(self, get: Callable[[str], Response] = _get, pause: float = PAUSE_S, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.get, self.pause, self.retries, self.sleep, self.clock = get, pause, retries, sleep, clock
        self.last = -1e9

    def fetch(self, url: str) -> Response:
        why: Exception | None = None
        for attempt in range(self.retries + 1):
            if (wait := self.last + self.pause - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            delay = 2.0 * 2**attempt
            try:
                return self.get(url)
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_ON:
                    raise PortalError(f"{url}: {e.code}") from e
                after = (e.headers or email.message.Message()).get("Retry-After", "")
                why, delay = e, float(after) if after.replace(".", "", 1).isdigit() else delay
                delay = min(delay, LONGEST_WAIT_S)
            except (OSError, json.JSONDecodeError) as e:
                why = e
            if attempt < self.retries:
                self.sleep(delay)
        raise PortalError(f"{url}: {why}")

    def query(self, domain: str, dataset: str, **clauses: Any) -> Response:
        text = urllib.parse.urlencode({f"${k}": v for k, v in clauses.items() if v is not None})
        return self.fetch(f"https://{domain}/resource/{dataset}.json" + (f"?{text}" if text else ""))

    def rows(self, domain: str, dataset: str, **clauses: Any) -> list[dict]:
        data = self.query(domain, dataset, **clauses).data
        if not isinstance(data, list):
            raise PortalError(f"{domain}/{dataset}: rows expected")
        return data

    def count(self, domain: str, dataset: str, where: str | None = None) -> int:
        got = self.rows(domain, dataset, select="count(*) AS n", where=where)
        return int(got[0]["n"]) if got else 0

    def pages(self, domain: str, dataset: str, size: int = PAGE, most: int | None = None, order: str = ":id", **clauses: Any) -> Iterator[dict]:
        """All rows, page by page, up to the first short page."""
        offset = 0
        while most is None or offset < most:
            want = size if most is None else min(size, most - offset)
            got = self.rows(domain, dataset, order=order, limit=want, offset=offset, **clauses)
            yield from got
            if len(got) < want:
                return
            offset += want

    def metadata(self, domain: str, dataset: str) -> dict:
        return self.fetch(f"https://{domain}/api/views/{dataset}.json").data

    def catalog(self, domain: str, limit: int = 100, offset: int = 0) -> list[dict]:
        text = urllib.parse.urlencode({"domains": domain, "limit": limit, "offset": offset, "only": "dataset"})
        return self.fetch(f"https://{domain}/api/catalog/v1?{text}").data.get("results", [])


def provenance(headers: dict[str, str]) -> dict[str, str]:
    low = {k.lower(): v for k, v in headers.items()}
    return {k: low[k] for k in PROVENANCE if k in low}


class _Page(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PortalReader(DataSourceReader):
    def __init__(self, options: dict, client: Callable[[], Client] = Client):
        self.options, self.client = options, client

    def _clauses(self) -> dict[str, str]:
        return {k: self.options[k] for k in ("where", "select") if k in self.options}

    def partitions(self) -> list[InputPartition]:
        o = self.options
        n = self.client().count(o["domain"], o["dataset"], o.get("where"))
        size, readers = int(o.get("page", PAGE)), int(o.get("readers", 1))
        pages = -(-n // size)
        per = -(-pages // max(1, readers)) or 1
        return [_Page(p * size, min(n, (p + per) * size)) for p in range(0, pages, per)] or [_Page(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, c = self.options, self.client()
        size = int(o.get("page", PAGE))
        for at in range(partition.first, partition.last, size):
            for row in c.rows(o["domain"], o["dataset"], order=o.get("order", ":id"), limit=min(size, partition.last - at), offset=at, **self._clauses()):
                yield (json.dumps(row, sort_keys=True, ensure_ascii=False),)


class PortalSource(DataSource):
    """``spark.dataSource.register(PortalSource)``, then ``spark.read.format("portal").option("domain", …)``; one JSON text a row."""

    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> DataSourceReader:
        return PortalReader(dict(self.options))
