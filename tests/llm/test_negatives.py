"""Operator 12 against brute force and its SQL."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewright.llm.hard_negatives import Tree, askers, labelled_rows, mine
from tidewright.llm.vector_queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id string, w string, shard_ string"


def rows_of(n, width, seed, labels=4, kinds=None):
    rng = random.Random(seed)
    pick = lambda: rng.choice([-0.5, 0.0, 0.5]) if kinds else rng.gauss(0.1, 0.3)
    return [(i, [pick() for _ in range(width)], rng.randrange(labels), "clash", "clash", "clash") for i in range(n)]


ODD = [(None, [1.0, 1.0], 1, "", "", ""), (900, None, 1, "", "", ""), (910, [1.0, None], 1, "", "", ""), (920, [float("nan"), 1.0], 1, "", "", ""), (930, [float("inf"), 0.0], 1, "", "", ""), (940, [1.0, 1.0], None, "", "", ""), (950, [], 1, "", "", ""), (960, [3.0], 1, "", "", "")]


def brute(rows, every, n_positives, k, low, high, scale=256.0):
    kept = {}
    for i, v, label, *_ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(scale * float(np.float32(x))) for x in v])
            kept[i] = min(kept.get(i, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, kept[c][1], strict=False)), c) for c in kept if c != a)
        for s, p in [(s, c) for s, c in scored if kept[c][0] == label][:n_positives]:
            fit = [(t, c) for t, c in scored if kept[c][0] != label and low * -s <= 100 * -t <= high * -s][:k]
            out |= {(a, p, r + 1, c, -s, -t) for r, (t, c) in enumerate(fit)}
    return out


def mined(spark, rows, every, shard_rows, **sizes):
    ready = labelled_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 256.0)
    found = mine(ready, ready.where(f"id % {every} = 0"), 3, 4, 30, 90, shard_rows, **sizes).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


@pytest.mark.parametrize("kinds", [None, 3])  # 3: nearly everything ties
@pytest.mark.parametrize("shard_rows", [40, 1000])
def test_mining_is_exact(spark, kinds, shard_rows):
    rows = rows_of(150, 6, 1, 4, kinds) + ODD
    found = mined(spark, rows, 10, shard_rows, group_rows=5, leaf_rows=4)
    assert found == brute(rows, 10, 3, 4, 30, 90) and found


def test_copies_rare_labels_and_repeated_ids(spark):
    rows = rows_of(60, 5, 2, 3)
    rows += [(100 + i, rows[7][1], 1 if i % 3 else 9, "", "", "") for i in range(60)]  # a third of all rows is one vector
    rows += [(20, rows[3][1], 0, "", "", ""), (20, rows[4][1], 0, "", "", ""), (500, rows[5][1], 77, "", "", "")]  # 77: an anchor without positives
    found = mined(spark, rows, 10, 50, leaf_rows=8)
    assert found == brute(rows, 10, 3, 4, 30, 90) and 500 not in {r[0] for r in found}


def test_empty_and_large(spark):
    assert mined(spark, [], 10, 50) == set()
    rows = [(i, [x * 3e6 for x in v], label, *rest) for i, v, label, *rest in rows_of(80, 4, 3)]
    assert mined(spark, rows, 10, 50, leaf_rows=4) == brute(rows, 10, 3, 4, 30, 90)  # sums beyond 2^53, within 2^62 here
    rows = [(i, [x * 1e30 for x in v], label, *rest) for i, v, label, *rest in rows_of(40, 4, 4)]
    assert {r[4] for r in mined(spark, rows, 10, 50, leaf_rows=4)} <= {1 << 62, -1 << 62}


def test_bounds_hold_and_leaves_are_left_out():
    """Clustered rows: every row lies within its leaf's bounds, and a search meets few of them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 8))
    w = np.floor(256 * (centres / np.linalg.norm(centres, axis=1)[:, None])[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 8)))
    frame = pd.DataFrame({"id": np.arange(4000), "label": np.arange(4000) % 3, "w": list(w)})
    tree = Tree.built(frame)
    met = []
    for row, asker in askers(Tree.read(pd.Series(tree.stored(0))), frame.iloc[::100]):
        scores = tree.rows @ row.w
        distance = np.sqrt(np.maximum(0, asker.base - 2 * scores / asker.unit**2))
        leaf = np.repeat(np.arange(tree.n_leaves), np.diff(tree.cuts))
        assert (asker.low[leaf] <= distance + asker.slack).all() and (distance - asker.slack <= asker.high[leaf]).all()
        asker.best(5, True)
        met.append(asker.visited)
    assert np.mean(met) < 0.4 * 4000


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    found = QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.001")
    expected = db.execute(ORACLE_SQL["op12_hard_negatives"])
    assert found.columns == [x[0] for x in expected.description]
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
