"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids; a cell is a pair of
centroids. A query walks the cells in the order of the summed distances of its halves to
their centroids, by a heap, until cells with a set share of all vectors are met; the vectors of
these cells are ranked by their exact distance.

Vectors travel in packs: those of a first-half centroid in packs of bounded size, and
the queries that visit it likewise, so a centroid that holds a third of all vectors
is only more packs. Of a query and a pack only its nearest few go on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.session import Stage


@dataclass(frozen=True)
class Params:
    """centroids: of each half; None: the fourth root of the number of vectors, from 64 to 1024, as cells
    are pairs and every visited centroid costs a row. sample: vectors that they are fitted on at
    most. share: of all vectors that a query's cells must hold (0.45 gives a recall of 0.94 on data
    without any clusters). held: queries whose best a task keeps before it passes them on."""

    centroids: int | None = None
    sample: int = 8000
    share: float = 0.45
    held: int = 20_000
    rounds: int = 12
    pack: int = 512
    queries: int = 128
    seed: int = 3


@dataclass(frozen=True)
class Index:
    one: np.ndarray
    two: np.ndarray
    counts: np.ndarray  # of vectors, by pair of centroids

    @property
    def total(self) -> int:
        return int(self.counts.sum())


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def cells(one: np.ndarray, two: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance, by a heap over two sorted lists, until they hold ``wanted`` vectors."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, out, held = [(one[a[0]] + two[b[0]], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        held += int(counts[a[i], b[j]])
        out.append((int(a[i]), int(b[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (one[a[i]] + two[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (one[a[i + 1]] + two[b[0]], i + 1, 0))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build(vectors: DataFrame, p: Params, stage: Stage) -> tuple[Index | None, DataFrame]:
    """The index, and (vec_id, one, two, v), written: every usable vector with its cell."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return None, rows
    width = widths[0]["w"]
    rows = rows.where(F.size("v") == width)
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("v").collect()])
    half = max(1, width // 2)
    k = p.centroids or min(1024, max(64, round(widths[0]["count"] ** 0.25)))
    one, two = kmeans(sample[:, :half], k, p.rounds, p.seed), kmeans(sample[:, half:] if width > 1 else np.zeros((len(sample), 1)), k, p.rounds, p.seed + 1)
    shared = vectors.sparkSession.sparkContext.broadcast((one, two))  # 2 x centroids x half the width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                second = x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(x[:, :half], one), pa.int32()), pa.array(nearest(second, two), pa.int32()), b.column(1)], ["vec_id", "one", "two", "v"])

    listed = stage.write(rows.mapInArrow(run, "vec_id long, one int, two int, v array<double>"))
    counts = np.zeros((len(one), len(two)), np.int64)
    for r in listed.groupBy("one", "two").count().collect():  # centroids squared rows at most
        counts[r.one, r.two] = r["count"]
    return Index(one, two, counts), listed


def search(vectors: DataFrame, queries: Column, k: int = 10, params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``vectors`` that ``queries`` selects, the k nearest found.

    ``vectors`` has vec_id and embedding; other columns aren't read. Score is the Euclidean
    distance in double precision; ties go to the smaller vec_id, and a query's own id is no
    candidate. Vectors that are null, zero, without an id, of another length than most, or
    hold null or non-finite components take no part; rows that repeat an id and a vector count
    once, and of an id with several vectors the nearest pair counts, as query and as candidate; with fewer candidates all are returned; an empty table gives no rows.
    """
    p, spark = params, vectors.sparkSession
    stage = Stage(spark, "neighbours")
    out = "query_id long, rank int, vec_id long, score double"
    index, listed = build(vectors, p, stage)
    if index is None:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(index)
    half = max(1, index.one.shape[1])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        wanted = max(int(np.ceil(p.share * index.total)), min(index.total, 20 * k))
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            d1 = distances(x[:, :half], index.one)
            d2 = distances(x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1)), index.two)
            for r in range(len(x)):
                seen = np.zeros(index.counts.shape, np.uint8)
                for i, j in cells(d1[r], d2[r], index.counts, wanted):
                    seen[i, j] = 1
                visited = np.flatnonzero((seen * (index.counts > 0)).any(1))
                n = len(visited)
                take = pa.array([r] * n, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(visited, pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array([np.packbits(seen[i]).tobytes() for i in visited], pa.binary())], ["one", "query_id", "v", "seen"])

    def packed(names: tuple[str, ...]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            flat = np.stack(pdf.v.to_list()).astype(np.float64).tobytes()
            ids = pdf[names[0]].to_numpy(np.int64).tobytes()
            rest = b"".join(pdf.seen) if names[1] == "seen" else pdf.two.to_numpy(np.int32).tobytes()
            return pd.DataFrame({"one": [pdf.one[0]], "n": [len(pdf)], "ids": [ids], "rest": [rest], "v": [flat]})

        return run

    asked = listed.where(queries).select("vec_id", "v").distinct()
    asked = asked.repartition(max(1, spark.sparkContext.defaultParallelism), "vec_id").mapInArrow(walk, "one int, query_id long, v array<double>, seen binary")
    pack = "one int, n int, ids binary, rest binary, v binary"

    def parts(df: DataFrame, size: int, key: str, rename: str) -> DataFrame:
        """The packs of a centroid, of about ``size`` rows, dealt by the id's hash."""
        sizes = df.groupBy("one").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))  # a row for each centroid
        dealt = df.join(F.broadcast(sizes), "one").withColumn("part", F.pmod(F.xxhash64(key), "parts"))
        made = dealt.drop("parts").groupBy("one", "part").applyInPandas(packed((key, "seen" if rename else "two")), pack)
        return made.select("one", *[F.col(c).alias(rename + c) for c in ("n", "ids", "rest", "v")])

    met = parts(listed, p.pack, "vec_id", "").join(parts(stage.write(asked), p.queries, "query_id", "q"), "one")
    # Each row holds two matrices: dealt out evenly, and taken a few at a time.
    met = met.select("n", "ids", "rest", "v", "qn", "qids", "qrest", "qv")

    def compare(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, dict[int, float]] = {}  # of a query the nearest ids that this task has met

        def passed_on() -> pd.DataFrame:
            got = [(q, v, d) for q, own in best.items() for v, d in own.items()]
            best.clear()
            return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        for pdf in rows:
            for r in pdf.itertuples(index=False):
                ids, two, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rest, np.int32), np.frombuffer(r.v).reshape(r.n, -1)
                qids, q = np.frombuffer(r.qids, np.int64), np.frombuffer(r.qv).reshape(r.qn, -1)
                seen = np.unpackbits(np.frombuffer(r.qrest, np.uint8).reshape(r.qn, -1), axis=1)
                for a in range(r.qn):
                    at = np.flatnonzero(seen[a][two] & (ids != qids[a]))
                    d = np.sqrt(((x[at] - q[a]) ** 2).sum(1))
                    if len(at) > 4 * k:
                        close = d <= np.partition(d, 2 * k)[2 * k]
                        if len(np.unique(ids[at][close])) >= k:
                            at, d = at[close], d[close]
                    own = best.setdefault(int(qids[a]), {})
                    for s, v in zip(d.tolist(), ids[at].tolist()):
                        if s < own.get(v, np.inf):
                            own[v] = s
                    if len(own) > k:
                        best[int(qids[a])] = {v: s for s, v in sorted((s, v) for v, s in own.items())[:k]}
                if len(best) > p.held:
                    yield passed_on()
        if best:
            yield passed_on()

    found = met.mapInPandas(compare, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: np.ndarray, ids: np.ndarray, query: int, k: int) -> list[int]:
    """Brute force for one query, to measure recall against."""
    d = np.sqrt(((vectors - vectors[query]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]]
    return [int(ids[i]) for i in order[:k]]
