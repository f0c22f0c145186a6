"""Recall and exactness of the search against brute force."""

import heapq

import numpy as np
from pyspark.sql import functions as F

from tremolo.llm import neighbours
from tremolo.llm.queries import op5_neighbours

SF = "/root/testdata/sf0.1"


def test_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    place = {int(v): k for k, v in enumerate(ids)}
    got = {}
    for r in op5_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {int(v) for v in ids if v % 100 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: (f[2], f[1]))
        assert all(abs(s - np.linalg.norm(x[place[q]] - x[place[v]])) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(neighbours.exact(x, ids, place[q], 10)))
    recall = hits / (10 * len(got))
    print("recall", recall)
    assert recall >= 0.9


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(0)
    one, two = rng.random(7), rng.random(5)
    counts = rng.integers(0, 4, (7, 5))
    every = [(i, j) for _, i, j in heapq.nsmallest(35, ((one[i] + two[j], i, j) for i in range(7) for j in range(5)))]
    assert neighbours.cells(one, two, counts, 10**9) == every
    some = neighbours.cells(one, two, counts, 12)
    assert some == every[: len(some)] and sum(counts[c] for c in some) >= 12 > sum(counts[c] for c in some[:-1])


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [2.0, 1.0]), (6, [3.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "'x' as one")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 5, 0.0), (0, 2, 500, 0.0), (0, 3, 7, 2.0), (500, 1, 0, 0.0), (500, 2, 5, 0.0), (500, 3, 7, 2.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_a_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else rng.normal(size=4).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    p = neighbours.Params(centroids=8, pack=32, queries=4)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 150 == 0, 5, p).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all(sorted(f)[0][2] == 0.0 and [v for _, v, _ in sorted(f)] == [v for v in range(0, 30, 3) if v != q][:5] for q, f in got.items())


def test_an_id_with_several_vectors_counts_by_its_nearest(spark):
    rows = [(0, [0.0, 1.0]), (0, [9.0, 9.0]), (1, [0.0, 2.0]), (1, [9.0, 8.0]), (2, [0.0, 4.0]), (3, [50.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for p in (neighbours.Params(), neighbours.Params(pack=1, queries=1, held=1)):
        got = sorted((r["rank"], r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") == 0, 10, p).collect())
        assert [(n, v) for n, v, _ in got] == [(1, 1), (2, 2), (3, 3)] and got[0][2] == 1.0 and got[1][2] == 3.0


def test_clusters_need_a_small_share(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 4
    x = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    rows = neighbours.search(df, F.col("vec_id") % 100 == 0, 10, neighbours.Params(share=0.05)).collect()
    for q in range(0, 3000, 100):
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(neighbours.exact(x, np.arange(3000), q, 10)))
    assert hits / 300 >= 0.95
