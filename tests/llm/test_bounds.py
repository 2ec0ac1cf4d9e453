"""Pairs are bounded many at once, each as it would be alone."""

import random

import numpy as np
import pandas as pd

from tidewright.llm import jaccard_join as J


def test_pairs_are_bounded_together(monkeypatch):
    rng, gen = random.Random(1), np.random.default_rng(1)
    rows = []
    for i in range(400):
        a = np.unique(gen.integers(0, 2**64, rng.randint(1, 90), np.uint64))
        b = np.unique(np.concatenate([a[gen.random(len(a)) < rng.choice([0.5, 0.9, 1])], gen.integers(0, 2**64, rng.randint(1, 20), np.uint64)]))
        rows.append((i, -i, len(a), len(b), J.point(a), J.point(b)))
    expect = []
    for i, _, n, m, p, q in rows:
        if n > m:
            n, m, p, q = m, n, q, p
        if J.DEN * n >= J.NUM * m and J.fine_bound(J.occupied(p, n, J.fine_bits(n)), [q], J.fine_bits(m))[0] >= J.least_overlap(n, m):
            expect.append(i)
    calls, plain = [], J.groups_of
    monkeypatch.setattr(J, "groups_of", lambda points: calls.append(len(points)) or plain(points))
    frame = pd.DataFrame(rows, columns=["a", "b", "n", "m", "p", "q"])
    found = next(J._not_bounded_away(iter([frame])))
    assert found["a"].tolist() == expect and 20 < len(expect) < 300
    assert len(calls) < 40  # not two for each pair
    assert len(next(J._not_bounded_away(iter([frame.iloc[:0]])))) == 0
