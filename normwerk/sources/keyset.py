"""Remote tables page by page: a data source over a REST endpoint that filters, orders and limits rows by a key.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeysetSource)
    spark.read.format("keyset").schema("id long, name string").option("url", ...).option("table", ...).option("bounds", "[1000, 2000]").load()

A page is asked for as `{url}/{table}?select=columns&order=key.asc&limit=page&key=gt.last`, and answered by a JSON array of objects.  Each page starts after the last key of the
one before, so no page is found by counting rows, and rows that come or go meanwhile shift nothing.  `bounds` (a JSON array, ascending) cuts the keys into ranges that are read side by side, a task each;
with none there is one.  Only the schema's columns are asked for.  Comparisons with columns are sent along, for which Spark wants that setting; the rest stays with Spark.

As a stream, an offset is a key: a batch has the rows after the last batch's key up to the largest one there is, cut at `bounds` too.  So rows must get growing keys.

Options: url, table, key (id), page (500), bounds, token (sent as a bearer token), retries (3).  An answer that can't be had after `retries` more attempts fails the task, which Spark repeats
from its range's start.  Keys are unique and not null.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

_COMPARED = {ds.EqualTo: "eq", ds.GreaterThan: "gt", ds.GreaterThanOrEqual: "gte", ds.LessThan: "lt", ds.LessThanOrEqual: "lte"}


@dataclass
class KeyRange(ds.InputPartition):
    """Keys after `after` and up to `upto`; None: no bound."""

    after: object = None
    upto: object = None


@dataclass
class Endpoint:
    url: str
    table: str
    key: str = "id"
    page: int = 500
    token: str | None = None
    retries: int = 3
    wait: float = 0.5
    where: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, options: dict[str, str]) -> Endpoint:
        return cls(options["url"].rstrip("/"), options["table"], options.get("key", "id"), int(options.get("page", 500)), options.get("token"), int(options.get("retries", 3)), float(options.get("wait", 0.5)))

    def ask(self, *params: tuple[str, str]) -> list[dict]:
        request = urllib.request.Request(f"{self.url}/{self.table}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {}))
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429 or attempt == self.retries:  # the request itself is at fault
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.retries:
                    raise
            time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def pages(self, columns: list[str], keys: KeyRange) -> Iterator[list[dict]]:
        asked = list(dict.fromkeys([*columns, self.key]))
        after = keys.after
        while True:
            bounds = [(self.key, f"gt.{after}")] * (after is not None) + [(self.key, f"lte.{keys.upto}")] * (keys.upto is not None)
            rows = self.ask(("select", ",".join(asked)), ("order", f"{self.key}.asc"), ("limit", str(self.page)), *bounds, *self.where)
            if rows:
                yield rows
            if len(rows) < self.page:
                return
            after = rows[-1][self.key]

    def last_key(self) -> object:
        rows = self.ask(("select", self.key), ("order", f"{self.key}.desc"), ("limit", "1"))
        return rows[0][self.key] if rows else None


def _ranges(bounds: list, after: object = None, upto: object = None) -> list[KeyRange]:
    inner = [b for b in bounds if (after is None or b > after) and (upto is None or b < upto)]
    cuts = [after, *inner, upto]
    return [KeyRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(v: object, kind: pa.DataType) -> object:
    if isinstance(v, str) and pa.types.is_timestamp(kind):
        return datetime.fromisoformat(v)
    if isinstance(v, str) and pa.types.is_date(kind):
        return date.fromisoformat(v)
    return json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) and pa.types.is_string(kind) else v


def _batches(endpoint: Endpoint, schema: StructType, keys: KeyRange) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    for rows in endpoint.pages(schema.names, keys):
        yield pa.RecordBatch.from_arrays([pa.array([_value(r.get(f.name), f.type) for r in rows], f.type) for f in wanted], schema=wanted)


class KeysetReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.endpoint, self.schema, self.bounds = Endpoint.of(options), schema, json.loads(options.get("bounds", "[]"))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            simple = len(getattr(f, "attribute", ())) == 1 and isinstance(getattr(f, "value", None), int | float | str) and not isinstance(f.value, bool)
            if type(f) in _COMPARED and simple:
                self.endpoint.where.append((f.attribute[0], f"{_COMPARED[type(f)]}.{f.value}"))
            elif isinstance(f, ds.IsNotNull) and len(f.attribute) == 1:
                self.endpoint.where.append((f.attribute[0], "not.is.null"))
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        return _ranges(self.bounds)

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.endpoint, self.schema, partition)


class KeysetStream(ds.DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.endpoint, self.schema, self.bounds = Endpoint.of(options), schema, json.loads(options.get("bounds", "[]"))

    def initialOffset(self) -> dict:
        return {"key": None}

    def latestOffset(self) -> dict:
        return {"key": self.endpoint.last_key()}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        if end["key"] is None or end["key"] == start["key"]:
            return []
        return _ranges(self.bounds, start["key"], end["key"])

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.endpoint, self.schema, partition)

    def commit(self, end: dict) -> None:
        pass


class KeysetSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        raise ValueError("give the columns by .schema(...)")

    def reader(self, schema: StructType) -> KeysetReader:
        return KeysetReader(self.options, schema)

    def streamReader(self, schema: StructType) -> KeysetStream:
        return KeysetStream(self.options, schema)
