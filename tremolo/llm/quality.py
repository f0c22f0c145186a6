"""Quality: random-indexing word vectors, pooled by document, under a small calibrated network.

Random indexing gives every word (hashed to a bucket) a fixed sparse random vector; a
word's vector is the sum of those of its neighbours over the whole corpus. A document is the weighted
mean and spread of its words' vectors; a network of two layers scores it, and one
temperature, fitted on documents that the network has not seen, calibrates the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import labelled
from tremolo.llm.common import Memo, lean, slices, whole_texts
from tremolo.session import Stage

_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


@dataclass(frozen=True)
class Params:
    """buckets: of hashed words. width: of a vector. reach: neighbours on either side. sample:
    labelled documents to fit on at most. rare: weight rare / (rare + frequency) of a word."""

    buckets: int = 8192
    width: int = 48
    reach: int = 2
    sample: int = labelled.SAMPLE
    rare: float = 1e-3
    hidden: int = 32
    epochs: int = 30
    rate: float = 3e-3
    seed: int = 5


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    weight: np.ndarray  # by bucket
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float


def word_ids(buckets: int):
    """A function from a text to its words' buckets, in order: letter runs without case, each
    after a mark if it is in capitals, digit runs by length, and runs of other marks."""

    def of_chunk(chunk: str) -> bytes:
        out = []
        for w in _PIECE.findall(chunk):
            if w.isalpha():
                if len(w) > 1 and w.isupper():
                    out.append("\x01AA")
                out.append(w.lower())
            else:
                out.append(f"\x01{len(w)}" if w.isdigit() else w)
        return b"".join((zlib.crc32(w.encode()) % buckets).to_bytes(4, "little") for w in out)

    memo = Memo(of_chunk, 100_000)
    return lambda text: np.frombuffer(b"".join(map(memo.__getitem__, text.split())), np.uint32)


def index_vectors(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """By bucket the places of its +1 and of its -1; the bucket after the last stands between documents."""
    rng = np.random.default_rng(p.seed)
    plus = rng.integers(0, p.width, p.buckets + 1)
    return plus, (plus + rng.integers(1, p.width, p.buckets + 1)) % p.width


def add_neighbours(ids: np.ndarray, sums: np.ndarray, p: Params) -> None:
    """Adds to each bucket's row the index vectors of its neighbours within reach."""
    plus, minus = index_vectors(p)
    for off in range(1, p.reach + 1):
        left, right = ids[:-off].astype(np.int64), ids[off:].astype(np.int64)
        both = (left < p.buckets) & (right < p.buckets)
        left, right = left[both], right[both]
        for word, near in ((left, right), (right, left)):
            sums += (np.bincount(word * p.width + plus[near], minlength=sums.size) - np.bincount(word * p.width + minus[near], minlength=sums.size)).reshape(sums.shape)


def word_vectors(docs: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(sums by bucket, occurrences by bucket) over all of ``docs``.

    Each task sums what it reads in one matrix of a fixed size and gives it out in slabs of
    rows; these are added in groups of a bounded number of tasks, over as many levels as it takes.
    """
    stage, slab, fan = Stage(docs.sparkSession, "indexing"), 1024, 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(p.buckets)
        sums, seen = np.zeros((p.buckets, p.width)), np.zeros(p.buckets)
        gap = np.full(p.reach, p.buckets, np.uint32)
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                parts = [x for t in b.column(0).to_pylist() for x in (ids_of(t), gap)]
                ids = np.concatenate(parts)
                add_neighbours(ids, sums, p)
                seen += np.bincount(ids, minlength=p.buckets + 1)[:-1]
        if seen.any():
            both = np.hstack([sums, seen[:, None]])
            part = TaskContext.get().partitionId()
            slabs = [both[k : k + slab].tobytes() for k in range(0, p.buckets, slab)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slabs)), pa.int32()), pa.array([part] * len(slabs), pa.int32()), pa.array(slabs, pa.binary())], ["slab", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf.sums)
        return pd.DataFrame({"slab": [pdf.slab[0]], "part": [pdf.part[0]], "sums": [total.tobytes()]})

    schema = "slab int, part int, sums binary"
    parts = stage.write(whole_texts(docs.select(F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(lean(run), schema))
    while True:
        most = parts.agg(F.max("part")).first()[0]
        if most is None:
            stage.close()
            return np.zeros((p.buckets, p.width)), np.zeros(p.buckets)
        parts = stage.write(parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("slab", "part").applyInPandas(add, schema))
        if most < fan:
            break
    rows = sorted(parts.collect(), key=lambda r: r.slab)  # one row for each slab: a matrix of fixed size
    both = np.concatenate([np.frombuffer(r.sums) for r in rows]).reshape(p.buckets, p.width + 1)
    stage.close()
    return both[:, :-1], both[:, -1]


def pooled(ids: np.ndarray, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean and standard deviation of the vectors of a document's words; zeros without words."""
    if not len(ids):
        return np.zeros(2 * vectors.shape[1])
    seen, n = np.unique(ids, return_counts=True)
    w = weight[seen] * n
    w = w / max(w.sum(), 1e-12)
    mean = w @ vectors[seen]
    return np.concatenate([mean, np.sqrt(np.maximum(w @ vectors[seen] ** 2 - mean**2, 0))])


def _forward(x: np.ndarray, layers: tuple) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    h = np.tanh(x @ a + b)
    return h, h @ c + d


def normalised(sums: np.ndarray, seen: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors, and the weight of each bucket."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(norm > 0, norm, 1), p.rare / (p.rare + seen / max(seen.sum(), 1))


def gradients(x: np.ndarray, y: np.ndarray, layers: list) -> list[np.ndarray]:
    """Of the mean logistic loss and a small decay of the two matrices, by layer."""
    h, raw = _forward(x, tuple(layers))
    off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(x)
    back = np.outer(off, layers[2]) * (1 - h**2)
    return [x.T @ back + 1e-4 * layers[0], back.sum(0), h.T @ off + 1e-4 * layers[2], np.array([off.sum()])]


def best_temperature(raw: np.ndarray, y: np.ndarray) -> float:
    """Of a range of temperatures that of the least logistic loss."""
    sign = np.where(y > 0.5, 1, -1)
    return float(min(np.exp(np.linspace(-2, 3, 101)), key=lambda t: float(np.logaddexp(0, -sign * raw / t).mean())))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, weight: np.ndarray, p: Params) -> Model:
    """Fits the network to pooled documents, the temperature to a fifth of them that it hasn't seen."""
    width = 2 * p.width
    rng = np.random.default_rng(p.seed)
    layers = [rng.normal(0, 1 / np.sqrt(width), (width, p.hidden)), np.zeros(p.hidden), rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden), np.zeros(1)]
    if not len(y) or y.min() == y.max():
        layers[2][:] = 0
        layers[3][:] = 20.0 if len(y) and y[0] else -20.0
        return Model(vectors, weight, np.zeros(width), np.ones(width), tuple(layers), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    apart, own = order[:cut], order[cut:]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    step = 0
    for _ in range(p.epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            step += 1
            for k, g in enumerate(gradients(x[part], y[part], layers)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                layers[k] = layers[k] - p.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(vectors, weight, mean, scale, tuple(layers), best_temperature(_forward(x[apart], tuple(layers))[1], y[apart]))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Word vectors over all documents; the network on a bounded sample of labelled ones.

    Without labelled documents, or with one label only, all scores are that label's (without any, 0).
    """
    vectors, weight = normalised(*word_vectors(docs, p), p)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, weight))  # of a fixed size

    def features():
        ids_of, (vectors, weight) = word_ids(p.buckets), shared.value
        return lambda text: pooled(ids_of(text), vectors, weight)

    # A sampled document comes to the driver as two vectors.
    rows, y = labelled.collected(labelled.sample(docs, labels, "quality", features, p.sample), np.float64)
    return fit(np.array(rows).reshape(len(rows), 2 * p.width), y, vectors, weight, p)


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score) for each row of ``docs`` (doc_id, text); other columns aren't read.

    Null and empty texts get the score of a document without words; null ids are not held
    out; texts of any length are scored whole; repeated rows each get a row; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by ``buckets`` and ``width``

    def make():
        m, ids_of = shared.value, word_ids(p.buckets)

        def scores(texts: list[str]) -> np.ndarray:
            x = np.array([pooled(ids_of(t), m.vectors, m.weight) for t in texts]).reshape(len(texts), -1)
            if not len(texts):
                return np.zeros(0)
            raw = _forward((x - m.mean) / m.scale, m.layers)[1] / m.temperature
            return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

        return scores

    return labelled.scored(docs, make)
