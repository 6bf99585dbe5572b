"""Paged reading of a table behind a small server that answers like a REST front of a database."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from normwerk.sources import keyset, readers, sinks
from normwerk.streaming import streams

OPS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}


class Table:
    def __init__(self, rows):
        self.rows, self.asked, self.fail = rows, [], 0

    def answer(self, query):
        self.asked.append(query)
        rows, limit, order = self.rows, None, None
        for name, value in query:
            if name == "select":
                columns = value.split(",")
            elif name == "limit":
                limit = int(value)
            elif name == "order":
                order = value.split(".")
            elif value == "not.is.null":
                rows = [r for r in rows if r[name] is not None]
            else:
                op, v = value.split(".", 1)
                rows = [r for r in rows if r[name] is not None and OPS[op](r[name], type(r[name])(v))]
        rows = sorted(rows, key=lambda r: r[order[0]], reverse=order[1] == "desc")[:limit]
        return [{c: r[c] for c in columns} for r in rows]


@pytest.fixture
def served():
    table = Table([{"id": i * 3, "name": f"n{i}" if i % 7 else None, "tags": ["a", "b"], "score": i / 2, "at": f"2026-01-{i % 28 + 1:02d}T10:00:00+00:00", "version": i} for i in range(1, 251)])

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if table.fail:
                table.fail -= 1
                self.send_error(503)
                return
            body = json.dumps(table.answer(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield table, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


SCHEMA = "id long, name string, tags array<string>, score double, at timestamp"


def test_ranges_are_read_side_by_side(spark, served):
    table, url = served
    df = readers.read_table(spark, url, "things", bounds=(0, 751), partitions=4, schema=SCHEMA, options={"page": "20"})
    assert df.rdd.getNumPartitions() == 4
    got = {r["id"]: r for r in df.collect()}
    assert sorted(got) == [r["id"] for r in table.rows] and got[6]["name"] == "n2" and got[21]["name"] is None and got[9]["tags"] == ["a", "b"] and got[9]["score"] == 1.5 and got[9]["at"].day == 4
    pages = [q for q in table.asked if dict(q)["limit"] == "20"]
    assert len(pages) >= 13 and all("offset" not in dict(q) for q in pages)


def test_columns_and_comparisons_are_sent_along(spark, served):
    table, url = served
    df = readers.read_table(spark, url, "things", schema="id long, score double, name string")
    assert sorted(r["id"] for r in df.filter("score >= 100 and name is not null and id % 2 = 0").select("id").collect()) == [r["id"] for r in table.rows if r["score"] >= 100 and r["name"] and r["id"] % 2 == 0]
    assert any(("score", "gte.100.0") in q for q in table.asked) and all("tags" not in dict(q)["select"] for q in table.asked)


def test_failing_answers_are_asked_for_again(spark, served):
    table, url = served
    table.fail = 2
    assert readers.read_table(spark, url, "things", schema="id long", options={"wait": "0.01"}).count() == 250
    with pytest.raises(Exception, match="404|Not Found|HTTP"):
        table.fail = 99
        readers.read_table(spark, url, "things", schema="id long", options={"wait": "0.01", "retries": "1"}).count()


def test_stream_goes_on_from_the_last_key(spark, served, tmp_path):
    table, url = served
    readers.register(spark)

    def run():
        s = spark.readStream.format("keyset").schema("id long, version long").options(url=url, table="things", page="40", bounds="[300, 600]").load()
        streams.sync(s.select((F.col("id") % 10).alias("k"), "version"), f"{tmp_path}/t", "k", "version", f"{tmp_path}/cp").awaitTermination()
        return {r["k"]: r["version"] for r in sinks.read_ordered(spark, f"{tmp_path}/t").collect()}

    want = lambda: {k: max(r["version"] for r in table.rows if r["id"] % 10 == k) for k in {r["id"] % 10 for r in table.rows}}
    assert run() == want()
    asked = len(table.asked)
    table.rows += [{"id": 1000 + i, "version": 900 + i, "name": "x", "tags": [], "score": 0.0, "at": "2026-02-01T00:00:00+00:00"} for i in range(15)]
    assert run() == want()
    assert all(("id", "gt.750") in q for q in table.asked[asked:] if dict(q)["order"] == "id.asc")


def test_ranges():
    assert [(r.after, r.upto) for r in keyset._ranges([10, 20, 30], 15, 25)] == [(15, 20), (20, 25)]
    assert [(r.after, r.upto) for r in keyset._ranges([])] == [(None, None)]
