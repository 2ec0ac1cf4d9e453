"""Operators 1 and 7 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm.hnsw import build, heights_of, nearest_neighbours, usable_rows
from tidewright.llm.topk import exact_topk, one_row_per_id, sparse_rows

SCHEMA = "vec_id long, embedding array<float>, score string, id string"


def rows_of(n, dim, seed, kinds=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(kinds or n, dim)).astype(np.float32) / 4
    return [(i, base[i % len(base)].tolist(), "clash", "clash") for i in range(n)]


ODD = [(1000, None, "a", "b"), (1001, [0.1, None], "a", "b"), (1002, [math.nan, 1.0], "a", "b"), (1003, [math.inf, 1.0], "a", "b"), (None, [0.5, 0.5], "a", "b"), (1004, [], "a", "b")]


def brute_topk(rows, k, every):
    ints = {i: [math.floor(64 * float(x)) for x in v] for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ints:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q)
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("kinds", [None, 3])  # 3: nearly everything ties
def test_topk_is_exact(spark, kinds):
    rows = rows_of(90, 7, 1, kinds) + ODD
    vectors = one_row_per_id(sparse_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 64.0))
    found = exact_topk(vectors.where("id % 10 = 0"), vectors, 5, shard_rows=20, group_rows=4)
    assert {tuple(r) for r in found.collect()} == brute_topk(rows, 5, 10)


def test_topk_with_few_candidates_and_repeats(spark):
    rows = rows_of(4, 3, 2)
    vectors = one_row_per_id(sparse_rows(spark.createDataFrame(rows + rows, SCHEMA), "vec_id", "embedding", 64.0))
    found = exact_topk(vectors.where("id = 0"), vectors, 20)
    assert {tuple(r) for r in found.collect()} == brute_topk(rows, 20, 4)


def test_topk_of_sparse_terms(spark):
    rows = [(i, [j for j in range(i % 7, 200, 31)], [(i + j) % 5 - 2 for j in range(i % 7, 200, 31)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, terms array<int>, weights array<long>")
    weights = {i: dict(zip(t, w, strict=True)) for i, t, w in rows}
    expect = set()
    for q in range(0, 60, 6):
        scored = sorted((-sum(w * weights[c].get(t, 0) for t, w in weights[q].items()), c) for c in weights if c != q)
        expect |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:3])}
    assert {tuple(r) for r in exact_topk(vectors.where("id % 6 = 0"), vectors, 3, shard_rows=16).collect()} == expect


def test_topk_of_large_components(spark):
    """Every finite vector takes part, whatever its size; scores beyond 64 bits are the nearest that fit."""
    rows = [(0, [1.0, 1.0]), (1, [1e9, 1.0]), (2, [-1e9, 0.5]), (3, [1e30, 0.0]), (4, [2e30, 0.0]), (5, [3e7, 3e7]), (20, [1e9, 2.0]), (6, [float("nan"), 1e9]), (7, [1e307, 1.0])]
    vectors = one_row_per_id(sparse_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 64.0))
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_topk(vectors.where("id in (0, 20)"), vectors, 20, shard_rows=3).collect()}
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows if i not in (6, 7)}
    for q in (0, 20):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q)
        assert [found[q, r + 1] for r in range(len(scored))] == [(c, max(-(2**63), min(2**63 - 1, -s))) for s, c in scored]
    assert {q for q, _ in found} == {0, 20}


def test_neighbours_that_tie_across_shards(spark):
    """Equal distances go to the smaller id, in whichever shard it is."""
    rows = [(i, [float(i % 3), 0.0 if i % 2 else 1.0], "", "") for i in range(240)]
    near = usable_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    found = nearest_neighbours(near.where("id % 60 = 0"), near, 25, shard_rows=48)
    exact = {i: v for i, v, *_ in rows if any(v)}
    expect = {(q, r + 1, c, d) for q in range(0, 240, 60) for r, (d, c) in enumerate(sorted((math.dist(exact[q], exact[c]), c) for c in exact if c != q)[:25])}
    assert {tuple(r) for r in found.collect()} == expect


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    vectors = one_row_per_id(sparse_rows(none, "vec_id", "embedding", 64.0))
    assert exact_topk(vectors, vectors, 5).count() == 0
    near = usable_rows(none, "vec_id", "embedding")
    assert nearest_neighbours(near, near, 5).count() == 0


def test_neighbours_recall_order_and_scores(spark):
    rows = rows_of(1500, 16, 3) + ODD + [(2000, [0.0] * 16, "zero", "z")]
    near = usable_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    assert near.count() == 1500
    found = nearest_neighbours(near.where(F.col("id") % 50 == 0), near, 10, shard_rows=400).toPandas()
    exact = {i: np.array(v, np.float64) for i, v, *_ in rows[:1500]}
    hits = 0
    for q, part in found.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11)) and q not in set(part["vec_id"])
        distances = [math.dist(exact[q], exact[c]) for c in part["vec_id"]]
        assert np.allclose(distances, part["score"], rtol=1e-12) and (np.diff(part["score"]) >= 0).all()
        best = sorted((math.dist(exact[q], exact[c]), c) for c in exact if c != q)[:10]
        hits += len({c for _, c in best} & set(part["vec_id"]))
    assert found["query_id"].nunique() == 30 and hits >= 0.9 * 300


def test_neighbours_among_copies_and_other_lengths(spark):
    rows = [(i, [1.0, 2.0], "", "") for i in range(40)] + [(100 + i, [float(i), 1.0, 1.0], "", "") for i in range(5)]
    near = usable_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    found = {tuple(r) for r in nearest_neighbours(near.where("id in (0, 100)"), near, 3).collect()}
    assert {r for r in found if r[0] == 100} == {(100, 1, 101, 1.0), (100, 2, 102, 2.0), (100, 3, 103, 3.0)}
    assert {(r[1], r[3]) for r in found if r[0] == 0} == {(1, 0.0), (2, 0.0), (3, 0.0)}


def test_every_node_can_be_reached():
    points = np.random.default_rng(5).normal(size=(700, 8)).astype(np.float32)
    levels, entry = build(points, heights_of(np.arange(700)))
    seen, todo = {entry}, [entry]
    while todo:
        for other in levels[0][todo.pop()]:
            if other >= 0 and int(other) not in seen:
                seen.add(int(other))
                todo.append(int(other))
    assert len(seen) >= 0.98 * 700


def test_recall_where_a_third_is_one_vector():
    """A full shard whose entry node is one of many copies: the neighbours of queries outside of the copies are found, and copies by id."""
    import numpy as np
    import pandas as pd

    from tidewright.llm.hnsw import SHARD_ROWS, graphs_with, heights_of, search_with

    k, n, rng = 10, SHARD_ROWS, np.random.default_rng(1)
    # exact in 32 bits; the copies are the tallest third of the nodes, the entry among them
    ids, x = np.arange(n) * 3 + 1, rng.integers(-64, 65, (n, 16)).astype(float)
    copies = np.zeros(n, bool)
    copies[np.argsort(-heights_of(ids), kind="stable")[: n // 3]] = True
    x[copies] = x[copies][0]
    x[np.flatnonzero(~copies)[0], 0] = 64
    asked = np.r_[np.flatnonzero(~copies)[::40], np.flatnonzero(copies)[:3]]
    frame = pd.DataFrame({"id": ids, "x": list(x)})
    built = graphs_with(k, 16, 48)(frame.assign(shard_=0))
    found = search_with(k, 16, 128)(built, frame.iloc[asked].reset_index(drop=True))
    hits = 0
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if j != i][:k]
        got = found[found["query_id"] == ids[i]].sort_values(["score", "vec_id"])
        hits += len(set(got["vec_id"]) & set(ids[best]))
        if copies[i]:
            assert got["vec_id"].tolist() == ids[best].tolist()
    assert hits >= 0.95 * k * len(asked)
