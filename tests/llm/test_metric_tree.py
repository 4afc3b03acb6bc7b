"""The M-tree: exact for large components, repeated ids and vectors, small pages; its bounds hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import metric_tree

SCHEMA = "vec_id long, embedding array<double>, node int, ids int, page int"


def brute(rows, every=50, k=5):
    """Whole-number products over one vector per id, the smallest."""
    held = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            held[vec_id] = min(held.get(vec_id, q), q)
    out = []
    for query, q in held.items():
        if query % every == 0:
            ends = -2 ** 63, 2 ** 63 - 1
            scores = sorted((-max(min(sum(a * b for a, b in zip(q, v)), ends[1]), ends[0]), i) for i, v in held.items() if i != query)
            out += [(query, r, i, -s) for r, (s, i) in enumerate(scores[:k], start=1)]
    return sorted(out)


def result(spark, rows, every=50):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in metric_tree.query(spark, df, every).collect())


def test_large_components_and_repeated_ids(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 2.0]), (1, [-1e7, 2.0]), (2, [3e12, 5.0]), (3, [3e12, 7.0]), (50, [2.0, -1e9]), (50, [3.0, 1e9]),
            (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, None), (None, [1.0, 1.0]), (8, [None, 1.0]), (9, [1.0])]
    assert result(spark, rows) == brute(rows)


def test_a_deep_tree_with_copies(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "PAGE", 6)
    monkeypatch.setattr(metric_tree, "FANOUT", 3)
    monkeypatch.setattr(metric_tree, "GROUP", 20)
    monkeypatch.setattr(metric_tree, "QUERY_BLOCK", 4)
    monkeypatch.setattr(metric_tree, "BATCHES", (1, 2, None))
    rnd = random.Random(8)
    rows = [(i, [round(rnd.gauss(c, 0.3), 2) for c in ((0, 0, 0), (3, 0, 1), (0, -4, 2))[i % 3]]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(130)] + [(530 + i, [0.5, 0.5, 0.5]) for i in range(60)]  # copies
    assert result(spark, rows, 20) == brute(rows, 20)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    tree = metric_tree.build(metric_tree.quantised(df))
    nodes = {r.node: r for r in tree.nodes.collect()}
    entries = tree.entries.collect()
    assert tree.depth >= 3 and len(entries) == len({tuple(r[1]) for r in rows})
    assert max(sum(e.node == n for e in entries) for n in {e.node for e in entries}) <= 6

    def lift(v):
        return np.array([*v, math.sqrt(max(tree.top - sum(x * x for x in v), 0))])

    for e in entries:  # stored distances and covering radii hold on the whole way up
        n = nodes[e.node]
        assert n.leaf and e.parent == pytest.approx(np.linalg.norm(lift(e.v) - lift(n.pivot)), abs=1e-3)
        while n.up is not None:
            assert np.linalg.norm(lift(e.v) - lift(n.pivot)) <= n.radius + 1e-3
            above = nodes[n.up]
            if above.pivot is not None:
                assert n.apart == pytest.approx(np.linalg.norm(lift(n.pivot) - lift(above.pivot)), abs=1e-3)
            n = above


def test_the_search_leaves_entries_out(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + rnd.normal(size=8) * 0.02).tolist()) for i in range(6000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    vectors = metric_tree.quantised(df)
    counter = spark.sparkContext.accumulator(0)
    queries = vectors.where(F.col("vec_id") % 50 == 0)
    got = metric_tree.search(metric_tree.build(vectors), queries, counter=counter)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert 0 < counter.value < 0.5 * 6000 * 120
