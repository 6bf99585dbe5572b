"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from normwerk.llm import queries, vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int"


def save(spark, at, rows):
    spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def plain(rows, k, asked=lambda i: i % 20 == 0):
    """query id -> [(score, id)]"""
    good = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in good:
        if asked(i):
            near = [(sum(float(a) * float(b) for a, b in zip(q, v)), j) for j, v in good if (j, v) != (i, q) and len(v) == len(q)]
            out[i] = sorted(near, key=lambda x: (-x[0], x[1]))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {i: [x[1:] for x in sorted(v)] if [x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) else None for i, v in out.items()}


def recall(got, want):
    return np.mean([len({j for _, j in got.get(i, [])} & {j for _, j in w}) / len(w) for i, w in want.items() if w])


@pytest.mark.parametrize("shard", [8192, 100])
def test_odd_rows_and_copies(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", shard)
    rng = np.random.default_rng(3)
    same = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, same) for i in range(300, 700)] + [(i, [2 * x for x in same]) for i in range(700, 730)]
    rows += [(740, None), (760, []), (780, [0.0] * 8), (800, [1.0, None] * 4), (820, [math.nan] * 8), (840, [math.inf] * 8), (None, same), (860, [1.0, 2.0, 3.0]), (861, [1.0, 2.0, 4.0]), (880, [5.0, 1.0]), (320, same), (320, same)]
    want = plain(rows, 20)
    got = found(queries.op12_vector_graph(spark, save(spark, tmp_path, rows)))
    assert set(got) == {i for i, w in want.items() if w} and len(got[860]) == 1 and 880 not in got
    assert recall(got, want) > 0.97
    for i in (320, 340, 700, 720):  # of copies those with the smallest ids, and none is its own
        assert [j for _, j in got[i]] == [j for _, j in want[i]] and [s for s, _ in got[i]] == pytest.approx([s for s, _ in want[i]], rel=1e-12)


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "lengths", "hot"])
def test_recall(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 1500)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 32))
    if kind == "clusters":
        v = v[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=v.shape)
    if kind == "lengths":
        v *= rng.lognormal(size=(4000, 1))
    if kind == "hot":  # a third all but equal
        v[:1500] = v[0] + 1e-3 * rng.normal(size=(1500, 32))
    v = v.astype(np.float32)
    got = found(queries.op12_vector_graph(spark, save(spark, tmp_path, list(enumerate(v.tolist())))))
    exact = v.astype(np.float64)
    want = {}
    for i in range(0, 4000, 20):
        s = exact @ exact[i]
        s[i] = -np.inf
        want[i] = [(s[j], j) for j in np.lexsort((np.arange(4000), -s))[:20]]
    assert all(len(g) == 20 for g in got.values()) and recall(got, want) > 0.95
    for i, g in got.items():
        assert [s for s, _ in g] == pytest.approx([exact[j] @ exact[i] for _, j in g], rel=1e-9, abs=1e-12)


def test_blocks_of_queries_give_the_same(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    at = save(spark, tmp_path, list(enumerate(rng.normal(size=(600, 16)).tolist())))
    want = found(queries.op12_vector_graph(spark, at))
    monkeypatch.setattr(vector_graph, "QUERIES_A_TASK", 7)
    assert found(queries.op12_vector_graph(spark, at)) == want


def test_graphs_hold_neighbours_of_every_level():
    rng = np.random.default_rng(2)
    level = np.floor(-np.log(rng.random(2000)) / np.log(16)).astype(int)
    g = vector_graph.build(rng.normal(size=(2000, 12)), level)
    for k, links in enumerate(g.levels):
        some = np.flatnonzero(level >= k)
        assert set(np.unique(links[some])) <= {-1, *some.tolist()} and (links[level < k] == -1).all()
        assert all(i not in links[i] and len(set(r := links[i][links[i] >= 0])) == len(r) for i in some)
        assert len(some) == 1 or (links[some] >= 0).any(1).all()
