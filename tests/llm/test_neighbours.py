"""The neighbour search against brute force."""

import math

import numpy as np
import pyarrow as pa
from metrelle.llm import neighbours


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 60, 0) + rng.normal(size=(2400, 16)) * 0.4
    x[100:400] = x[100]  # one very common vector
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    odd = [(5000, None, "e"), (5050, [0.0] * 16, "e"), (5100, [1.0, None] + [0.0] * 14, "e"), (5150, [float("nan")] * 16, "e"), (5200, [1.0, 2.0], "e"), (None, [1.0] * 16, "e")]
    got = neighbours.digest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, v string")).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 2400, 50):
        s = u @ u[q]
        near = sorted((i for i in range(2400) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        own = got[got.query_id == q].sort_values("rank")
        hit, total = hit + len(set(near) & set(own.vec_id)), total + 5
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and np.allclose(own.score, s[own.vec_id])
    assert hit / total >= 0.9 and not set(got.query_id) & {5000, 5050, 5100, 5150, 5200}
    assert list(got[got.query_id == 150].sort_values("rank").vec_id) == [100, 101, 102, 103, 104]
    assert neighbours.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    alone = [r for r in rows if r[0] == 50]
    assert neighbours.digest(spark.createDataFrame(alone + odd, "vec_id long, embedding array<double>, v string")).count() == 0


def test_neighbours_of_many_rescaled_copies_go_by_id(spark):
    v = np.random.default_rng(4).normal(size=8)
    rows = [(i, (v * s).tolist()) for i, s in enumerate(np.random.default_rng(5).permutation(np.arange(1, 201)).tolist())]
    got = neighbours.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in (0, 50, 100, 150):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in range(6) if i != q][:5]


def test_split_buckets_and_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6))
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 6))  # a third of all rows and more in few buckets
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, neighbours.digest(frame).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "QUERIES", 5)
    assert sorted(map(tuple, neighbours.digest(frame).collect())) == want and len(want) == 90


def test_few_rows_give_all_candidates(spark):
    """k candidates or fewer (with those of id 7 and 100): every one is found, of the query's length alone."""
    rng = np.random.default_rng(8)
    for n in (2, 3, 4, 5):
        x = rng.normal(size=(n, 64)) * rng.choice([1e-200, 1.0, 1e200], size=(n, 1))
        rows = [(50 * i, v.tolist()) for i, v in enumerate(x)] + [(7, [1.0, 2.0]), (100, [3.0, 1.0])]
        got = neighbours.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        x = x / np.abs(x).max(1, keepdims=True)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(n):
            want = {50 * j: float(u[j] @ u[i]) for j in range(n) if j != i}
            if i == 2:
                want[7] = 5 / math.sqrt(50)
            near = sorted(want, key=lambda j: (-round(want[j], 13), j))[:5]
            own = sorted((r for r in got if r["query_id"] == 50 * i), key=lambda r: r["rank"])
            assert [r["vec_id"] for r in own] == near and np.allclose([r["score"] for r in own], [want[j] for j in near], rtol=0, atol=1e-14)


def test_scores_are_not_rounded_and_parallel_vectors_tie():
    a = np.random.default_rng(3).normal(size=(200, 64))
    scale = np.random.default_rng(4).integers(1, 10**6, (200, 1))
    assert (neighbours._cosine(a * scale, a) == 1.0).all()
    near = np.array([[1.0, 0.0], [1.0, 2e-7], [1.0, 4e-7]])
    assert len(set(neighbours._cosine(near, np.array([[1.0, 1e-3]] * 3)).tolist())) == 3


def test_blocks_of_far_queries(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(120, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "REST", 20)
    items = neighbours.entries(neighbours.usable(frame), 5)
    queries = neighbours.usable(frame).select(neighbours.F.col("vec_id").alias("query_id"), "v")
    got = neighbours._ranked(neighbours._exhaustive(items, queries, 5), 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(q, k + 1, int(j)) for q in range(120) for k, j in enumerate(np.argsort(-s[q])[:5])}


def test_repeated_rows_and_ids_with_several_vectors(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.1]
    rows = [(0, v)] + [(1, v)] * 8 + [(i, v) for i in (2, 3, 4)] + [(5, w), (5, [1.0, 0.1, 0.2]), (6, w), (7, w)]
    got = neighbours.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert got[0]["query_id"] == 0 and max(r["score"] for r in got) == 1.0


def test_share_of_rows_compared_falls_as_vectors_grow():
    """Clustered vectors: what a query visits, by probes alone, against all rows; recall of the 5 nearest stays."""
    rng = np.random.default_rng(1)
    shares = []
    for n in (1500, 12000):
        centres = rng.normal(size=(n // 100, 32))
        x = centres[rng.integers(len(centres), size=n)] + 0.4 * rng.normal(size=(n, 32))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        m, hit, seen = neighbours.n_directions(n), 0, 0
        near = np.argsort(-(u[:40] @ u.T), axis=1)[:, 1:6]
        cosine = float(np.quantile([u[i] @ u[near[i, -1]] for i in range(40)], 0.25))
        met = np.zeros((40, n), bool)
        for table in range(neighbours.TABLES):
            a, b = neighbours.directions(32, m, table)
            name = neighbours._bucket(32, table, np.floor((u @ a + b) / neighbours.WIDTH))
            for i in range(40):
                met[i] |= np.isin(name, neighbours._bucket(32, table, neighbours.probes(u[i] @ a, b, cosine, neighbours.TABLE_SUCCESS, np.random.default_rng(0))))
        hit, seen = np.take_along_axis(met, near, 1).mean(), met.mean()
        assert hit >= 0.9
        shares.append(seen)
    assert shares[1] < 0.6 * shares[0] and not math.isnan(shares[0])


def test_only_pairs_that_can_be_among_the_best_are_ranked(monkeypatch):
    """Every pair of a share was sorted twice, however far below the best; their number grows with the square of the rows."""
    rng = np.random.default_rng(11)
    x, asked, cells = rng.normal(size=(4000, 16)), rng.normal(size=(50, 16)), np.arange(4000) // 20
    left = pa.table({"share": [0] * 4000, "cell": cells, "v": x.tolist(), "ids": [[i] for i in range(4000)]})
    right = pa.table({"share": [0] * 50, "cells": [list(range(200))] * 50, "query_id": range(10_000, 10_050), "v": asked.tolist()})
    ranked, best = [], neighbours._best
    monkeypatch.setattr(neighbours, "_best", lambda q, *rest: ranked.append(len(q)) or best(q, *rest))
    got = neighbours._compared(5)(left, right).to_pylist()
    assert sum(ranked) < 50 * 4000 / 4
    score = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    for q in range(50):
        assert {r["vec_id"] for r in got if r["query_id"] == 10_000 + q} == set(np.argsort(-score[q])[:5].tolist())
