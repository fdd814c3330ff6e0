"""The metric range join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from microbook.llm import metric_join

SCHEMA = "vec_id long, embedding array<double>, label int, row string, n string, cell string"


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs and a plain search."""
    width = max([len(v) for _, v in rows if v], default=1)
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([np.pad(np.array(rows[i][1], float), (0, width - len(rows[i][1]))) for i in good]).reshape(len(good), width)
    x = x / np.abs(x).max(1, initial=1e-300, keepdims=True)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    comp, seen = {}, set()
    for s in range(len(good)):
        if s in seen:
            continue
        stack, group = [s], []
        seen.add(s)
        while stack:
            a = stack.pop()
            group.append(a)
            for b in np.flatnonzero(hit[a]).tolist():
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        low = min([rows[good[g]][0] for g in group if rows[good[g]][0] is not None], default=None)
        comp |= {good[g]: low for g in group}
    n = {g: int(c) for g, c in zip(good, hit.sum(1), strict=True)}
    return sorted(((k, n.get(i, 0), comp.get(i, k), comp.get(i, k) == k) for i, (k, _) in enumerate(rows)), key=str)


def told(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(k, v and [c if c is None else float(c) for c in v], 1, "r", "n", "c") for k, v in rows], SCHEMA)


def clouds(seed, n, dims, groups, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    x = centres[rng.integers(groups, size=n)] + noise * rng.standard_normal((n, dims))
    x[: n // 3] = centres[0] + noise / 3 * rng.standard_normal((n // 3, dims))  # a group with a third of all rows
    return [(int(k), v.tolist()) for k, v in zip(rng.permutation(n), x * rng.uniform(0.1, 9, (n, 1)), strict=True)]


@pytest.mark.parametrize(("dims", "groups", "noise"), [(3, 12, 0.2), (16, 5, 0.3), (64, 300, 0.1)])
def test_join_against_all_pairs(spark, dims, groups, noise):
    rows = clouds(dims, 900, dims, groups, noise)
    assert told(metric_join.near_duplicates(frame(spark, rows).repartition(5), per_pivot=40, tile=32)) == brute(rows)


def test_defaults_and_other_thresholds(spark):
    rows = clouds(7, 500, 12, 9, 0.3)
    assert told(metric_join.near_duplicates(frame(spark, rows))) == brute(rows)
    assert told(metric_join.near_duplicates(frame(spark, rows), threshold=0.6, per_pivot=30, tile=16)) == brute(rows, 0.6)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [-1.0, 0.0]), (10, [1e200, 1e199]), (11, [1e-200, 0.0]), (12, [-0.0, -3.0]), (13, [5.0]), (None, [0.0, 1.0]), (None, None)]
    got = told(metric_join.near_duplicates(frame(spark, rows), per_pivot=3, tile=2))
    assert got == brute(rows)


def test_cosine_at_the_threshold_counts(spark):
    """(9, 3, 3, 1) has a length of 10: its cosine with an axis is 0.9 exactly."""
    rows = [(1, [1.0, 0, 0, 0]), (2, [9.0, 3, 3, 1]), (3, [-7.0, 0, 0, 0]), (4, [-9.0, 3, 3, 1]), (5, [9.0, 3.001, 3, 1])]
    got = told(metric_join.near_duplicates(frame(spark, rows)))
    assert (1, 1, 1, True) in got and (4, 1, 3, False) in got and (2, 2, 1, False) in got and (5, 1, 1, False) in got


def test_copies_are_counted_without_comparing_them(spark):
    """All tiles of a group of copies are certain of each other: nothing is left to compare."""
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(400)]
    assert told(metric_join.near_duplicates(frame(spark, rows), tile=16)) == sorted([(k, 399, 0, k == 0) for k in range(400)], key=str)
    import pyarrow as pa

    tiles = pa.table({"cell": pa.array([0] * 25, pa.int32()), "side": [0] * 25, "tile": list(range(25)), "n": [16] * 25, "low": [0.0] * 25, "high": [1e-8] * 25, "head": list(range(25))})
    plan = metric_join.plan_cell(0.45)(tiles).to_pylist()
    assert len(plan) == 25 and all(p["lo"] is None and p["sure"] == 399 and p["heads"] == [0] for p in plan)


def test_empty_table(spark):
    assert told(metric_join.near_duplicates(frame(spark, []))) == []
    assert told(metric_join.near_duplicates(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]


def test_pivots_are_apart_and_dense_first():
    rng = np.random.default_rng(0)
    dense = np.array([1.0] + [0.0] * 15) + 0.01 * rng.standard_normal((50, 16))
    sample = np.concatenate([rng.standard_normal((200, 16)), dense])
    pivots = metric_join.choose_pivots(sample, 20, 0.45)
    between = metric_join.angles(pivots, pivots)[~np.eye(len(pivots), dtype=bool)]
    assert len(pivots) == 20 and between.min() > 0.45 and pivots[0][0] > 0.99
