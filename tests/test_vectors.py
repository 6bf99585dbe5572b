"""Similarity joins against all pairs."""

import math

import numpy as np
import pytest

from normwerk.operators import archetypes, vectors

ODD = [(900, None), (901, []), (902, [0.0] * 6), (903, [None] + [1.0] * 5), (904, [math.nan] * 6), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [math.inf] * 6)]


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>").repartition(4)


def points(rng, n, groups):
    centres = rng.normal(size=(groups, 6))
    return centres[rng.integers(0, groups, n)] + rng.normal(scale=0.12, size=(n, 6))


@pytest.mark.parametrize("held", [4096, 9])
def test_nearest_of_two_distributed_tables(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "HELD_ROWS", held)
    monkeypatch.setattr(vectors, "STREAMED", 70)
    rng = np.random.default_rng(2)
    m = points(rng, 300, 12)
    m[50:90] = m[50]  # ties
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = frame(spark, [*((i, v.tolist()) for i, v in enumerate(m)), *ODD])
    q = df.filter("id < 60 or id >= 900").withColumnRenamed("id", "query_id")
    got = {}
    for r in vectors.batch_vector_search(df, q.unionByName(q.filter("query_id < 5")), 7, threshold=0.3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    sim = np.round(n @ n.T, 12)
    for i in range(60):
        want = [j for j in sorted(range(300), key=lambda j: (-sim[i, j], j))[:7] if sim[i, j] >= 0.3]
        assert got[i] == dict(enumerate(want, 1))
    assert got[905] == got[906] == {1: 905, 2: 906} and set(got) == {*range(60), 905, 906}
    assert vectors.batch_vector_search(df.limit(0), q, 3).count() == 0


def test_no_vector_goes_through_the_driver(spark, monkeypatch):
    """The joins collect counts alone."""
    df = frame(spark, [(i, [float(i), 1.0]) for i in range(50)])
    plain = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: pytest.fail("collect") if "array" in self._jdf.schema().catalogString() else plain(self))
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("toPandas"))
    assert vectors.batch_vector_search(df, df.withColumnRenamed("id", "query_id"), 2).count() == 100


@pytest.mark.parametrize(("threshold", "groups", "held"), [(0.97, 25, 10), (0.9, 6, 40), (0.2, 9, 15), (0.97, 1, 20), (0.99, 40, 4096)])
def test_links_make_all_components(spark, monkeypatch, threshold, groups, held):
    monkeypatch.setattr(vectors, "HELD_ROWS", held)
    rng = np.random.default_rng(groups)
    m = points(rng, 220, groups)
    if groups > 1:
        m[::3] = m[0] + rng.normal(scale=0.02, size=(74, 6))  # a third lie together
    m[7] = m[8] = m[100]
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(n @ n.T, 12) >= threshold
    label = list(range(220))
    while (new := [min(label[j] for j in np.flatnonzero(near[i])) for i in range(220)]) != label:
        label = new
    df = frame(spark, [*((i, v.tolist()) for i, v in enumerate(m)), *ODD])
    links = vectors.similarity_links(df, threshold)
    got = {r["id"]: r["cluster"] for r in archetypes.clusters(links, df.select("id")).collect()}
    assert got == dict(enumerate(label)) | {i: i for i, _ in ODD} | {906: 905}


def test_pivots_leave_out_cells(spark, monkeypatch):
    """Groups that lie apart: rows are dealt to their own cells and hardly any other."""
    rng = np.random.default_rng(1)
    m = np.repeat(np.eye(16), 40, axis=0) + rng.normal(scale=0.01, size=(640, 16))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    import pyarrow as pa

    pivots = [unit[i * 40] for i in range(16)]
    row, cell, own = vectors._places(pa.array(m.tolist()), np.full(640, 16), pivots, math.acos(0.95))
    assert own.sum() == 640 and len(row) == 640
    row, cell, own = vectors._places(pa.array(m.tolist()), np.full(640, 16), pivots, math.acos(-1.0))
    assert len(row) > 640 * 8  # every earlier cell: all pairs


@pytest.mark.parametrize(("kind", "hot"), [("groups", 4096), ("even", 4096), ("groups", 30)])
def test_approximate_search_recalls(spark, kind, hot):
    """Near neighbours come from buckets, the others from the exact join; so do queries of buckets that are too large."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1500, 16))
    if kind == "groups":
        m = m[rng.integers(0, 90, 1500)] + rng.normal(scale=0.1, size=(1500, 16))
    df = frame(spark, [*((i, v.tolist()) for i, v in enumerate(m)), *((i + 5000, v) for i, v in ODD)])
    q = df.filter("id < 100 or id >= 5000").withColumnRenamed("id", "query_id")
    index = vectors.hyperplane_index(df.filter("id % 3 <> 0"), a_bucket=32)
    index.add(df.filter("id % 3 = 0"))
    want = {(r["query_id"], r["id"]): (r["rank"], r["sim"]) for r in vectors.batch_vector_search(df.filter("id < 5000"), q.filter("query_id < 5000"), 5).collect()}
    got = {(r["query_id"], r["id"]): (r["rank"], r["sim"]) for r in vectors.approximate_vector_search(index, q, 5, hot=hot).collect()}
    assert len(got) == len(want) == 500 and len(got.keys() & want.keys()) >= 0.97 * len(want)
    if kind == "even" or hot < 100:
        assert got.keys() == want.keys()
    assert all(got[x][1] == pytest.approx(want[x][1], abs=1e-9) for x in got.keys() & want.keys())


@pytest.mark.parametrize(("threshold", "groups", "held"), [(0.97, 12, 25), (0.9, 30, 4096), (0.5, 8, 30)])
def test_density_clusters(spark, monkeypatch, threshold, groups, held):
    monkeypatch.setattr(vectors, "HELD_ROWS", held)
    rng = np.random.default_rng(groups)
    m = np.concatenate([points(rng, 120, groups), rng.normal(size=(60, 6))])
    m[::4] = m[0] + rng.normal(scale=0.02, size=(45, 6))
    m[5] = m[9] = m[77]
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(n @ n.T, 12)
    near = sim >= threshold
    core = near.sum(1) >= 4
    label = {i: i for i in range(180) if core[i]}
    while (new := {i: min(label[j] for j in label if near[i, j]) for i in label}) != label:
        label = new
    for i in range(180):
        if not core[i]:
            some = [j for j in label if near[i, j] and core[j]]
            label[i] = label[min(some, key=lambda j: (-sim[i, j], j))] if some else None
    df = frame(spark, [*((i, v.tolist()) for i, v in enumerate(m)), *ODD[:5]])
    got = {r["id"]: (r["cluster"], r["core"]) for r in vectors.density_clusters(df, threshold, 4).collect()}
    assert got == {i: (label[i], bool(core[i])) for i in range(180)} | {i: (None, False) for i, _ in ODD[:5]}
    assert {c for c, _ in got.values()} >= {None} or threshold < 0.9
