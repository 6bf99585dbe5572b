"""Dumps read by ranges of bytes against the json module."""

import json
import random

import pytest

from normwerk.sources import dump, readers, shared


def plain(texts):
    """(array, element) of each text's object."""
    out = []
    for t in texts:
        whole = json.loads(t[t.index("{") : t.rindex("}") + 1])
        out += [(k, e) for k, v in whole.items() if isinstance(v, list) for e in v if isinstance(e, dict)]
    return sorted(map(repr, out))


def random_value(rng, depth=0):
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", " ", '": [', "}]"]
    kind = rng.randrange(8)
    if kind < 4:
        return "".join(rng.choice(bits) for _ in range(rng.randrange(6)))
    if kind == 4 and depth < 3:
        return {random_value(rng, 9) if rng.random() < 0.2 else "k": random_value(rng, depth + 1) for _ in range(rng.randrange(3))} if depth else "x"
    if kind == 5 and depth < 3:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, True, -1.5, 7]) if depth < 9 else "k"


def dumps(rng, whole):
    return json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_json_module(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = []
    for n in range(5):
        element = lambda: {f"f{i}": random_value(rng, 1) for i in range(rng.randrange(1, 4))}
        whole = {"version": 3, "memory": [element() for _ in range(rng.randrange(40))], "meta": {"a": {"b": [{"c": 1}]}, "d": {}}, "projects": [], "none": None, "names": ["}", "[{"], "agent_logs": [element() for _ in range(rng.randrange(4))]}
        keys = list(whole)
        rng.shuffle(keys)
        texts.append(rng.choice(["", 'an odd " quote\n', "x] "]) + dumps(rng, {k: whole[k] for k in keys}) + rng.choice(["", "\n", ' and " after']))
        (tmp_path / f"{n}.json").write_text(texts[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "300b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = dump.elements(spark, str(tmp_path)).collect()
            assert sorted(repr((r["array"], json.loads(r["element"]))) for r in got) == plain(texts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_line_is_many_tasks(spark, tmp_path):
    rows = [{"id": str(i), "content": "a }{ \" \\ text " * 20, "tags": ["x", None]} for i in range(500)]
    (tmp_path / "d.json").write_text(json.dumps({"memory": rows, "agent_logs": None, "projects": [{"id": "p"}]}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = readers.read_dump(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["id"], r["content"], r["tags"]) for r in got["memory"].collect()) == sorted((r["id"], r["content"], r["tags"]) for r in rows)
    assert [r["id"] for r in got["projects"].collect()] == ["p"] and got["agent_logs"].count() == 0


def test_broken_and_empty_dumps(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"memory": [{"id": "1"}, {"id": "2"}, {"id": "3", "content": "brok')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text("no object")
    (tmp_path / "d.json").write_text("{}")
    assert sorted(r["id"] for r in readers.read_dump(spark, str(tmp_path))["memory"].collect()) == ["1", "2"]


def test_no_row_is_stored_for_a_fragment(spark, tmp_path, monkeypatch):
    rows = [{"id": str(i), "content": '}{ " \\ ]}' * (i % 9)} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps({"memory": rows, "projects": [{"id": "p"}]}))
    (tmp_path / "b.json").write_text("} \" {" + json.dumps({"agent_logs": [{"agent_id": "}"}], "memory": [{"id": "x"}]})[1:] + " } x")
    paths, new_path = [], shared.new_path
    monkeypatch.setattr(shared, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, records in (("900b", "3"), ("128m", "7")):  # blocks of several batches
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            got = readers.read_dump(spark, str(tmp_path))
            assert sorted((r["id"], r["content"]) for r in got["memory"].collect()) == sorted([*((r["id"], r["content"]) for r in rows), ("x", None)], key=lambda r: r[0])
            assert [r["id"] for r in got["projects"].collect()] == ["p"] and [r["agent_id"] for r in got["agent_logs"].collect()] == ["}"]
            stored = {p: spark.read.parquet(p).count() for p in paths}
            blocks = sum(n for p, n in stored.items() if "blocks" in p or "starts" in p)
            assert sum(stored.values()) - blocks <= 303 + 10 and blocks <= 2 * 60  # elements once, a row for each block, file and array
            paths.clear()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
