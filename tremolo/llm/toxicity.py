"""Toxicity: a factorization machine over hashed terms.

A document's features are the hashed terms that it has. Beside a weight, each has a short
vector; the product of two terms' vectors is the weight of their meeting in one text, such as an
insult with the mention of a group, which additive weights miss.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import labelled
from tremolo.llm.common import Memo, lean
from tremolo.session import Stage

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Params:
    """bits: of a hashed term. factors: of a term's vector. sample: labelled documents to fit on at
    most. z: a term takes part if its rates among the two labels differ by so many standard errors,
    in all documents or in those that hold a term more frequent in toxic ones."""

    bits: int = 18
    factors: int = 8
    sample: int = labelled.SAMPLE
    z: float = 4.5
    epochs: int = 12
    rate: float = 0.15
    decay: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    place: np.ndarray  # by hashed term: its place among the terms that take part, or -1
    bias: float
    weight: np.ndarray
    vectors: np.ndarray


def term_ids(bits: int):
    """A function from a text to its distinct hashed terms: runs of letters and digits, lower-cased."""
    mask = (1 << bits) - 1

    def of_chunk(chunk: str) -> bytes:
        return b"".join((zlib.crc32(w.encode()) & mask).to_bytes(4, "little") for w in _WORD.findall(chunk.lower()))

    memo = Memo(of_chunk, 100_000)
    return lambda text: np.unique(np.frombuffer(b"".join(map(memo.__getitem__, text.split())), np.uint32))


def raw_scores(ids: np.ndarray, starts: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The machine's sums for documents whose features follow one another, and their vector sums."""
    bias, weight, vectors = model
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    linear = np.bincount(doc, weight[ids], n)
    total = np.stack([np.bincount(doc, vectors[ids, f], n) for f in range(vectors.shape[1])], 1)
    squares = np.bincount(doc, (vectors[ids] ** 2).sum(1), n)
    return bias + linear + 0.5 * ((total**2).sum(1) - squares), total


def differs(have: np.ndarray, docs: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """By hashed term: whether its rates differ enough between the labels, and whether it is more frequent in toxic documents.

    ``have`` counts the documents with a term, ``docs`` all documents, by label.
    """
    neg, pos = map(float, docs)
    if not pos or not neg:
        return np.zeros(1 << p.bits, bool), np.zeros(1 << p.bits, bool)
    rate = have.sum(0) / (pos + neg)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / pos + 1 / neg))
    more = have[1] / pos - have[0] / neg
    return np.abs(more) >= p.z * error, more > 0


def counted(features: Iterable[tuple[np.ndarray, int]], among: np.ndarray | None, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """``have`` and ``docs`` of documents, of those only that hold a term of ``among`` (None: of all)."""
    have, docs = np.zeros((2, 1 << p.bits), np.int64), np.zeros(2, np.int64)
    for ids, y in features:
        if among is None or among[ids].any():
            have[y, ids] += 1
            docs[y] += 1
    return have, docs


def _counted_apart(rows: DataFrame, among: np.ndarray | None, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """``counted`` on the executors: a row for each label and term comes to the driver at most."""
    shared = rows.sparkSession.sparkContext.broadcast(among)  # a flag for each hashed term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((np.frombuffer(x, np.uint32), y) for b in batches for y, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
        have, docs = counted(each, shared.value, p)
        y, term = np.nonzero(have)
        columns = [(np.append(y, [0, 1]), pa.int32()), (np.append(term, [-1, -1]), pa.int32()), (np.append(have[y, term], docs), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], ["y", "term", "n"])

    sums = rows.mapInArrow(lean(run), "y int, term int, n long").groupBy("y", "term").agg(F.sum("n").alias("n")).toArrow()
    y, term, n = (sums.column(c).to_numpy() for c in ("y", "term", "n"))
    have, docs = np.zeros((2, 1 << p.bits)), np.zeros(2)
    have[y[term >= 0], term[term >= 0]] = n[term >= 0]
    docs[y[term < 0]] = n[term < 0]
    return have, docs


def choose(count: Callable, p: Params) -> np.ndarray:
    """By hashed term its place among those that take part, or -1; ``count`` counts documents, of those only that hold a term of its argument.

    Terms are chosen twice: over all documents, and over those that hold a term of the first choice that is
    more frequent in toxic ones. So a mention that is as frequent in clean documents, but tells
    beside an insult, takes part too.
    """
    first, more = differs(*count(None), p)
    second, _ = differs(*count(first & more), p)
    chosen = np.flatnonzero(first | second)
    place = np.full(1 << p.bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    return place


def fit(features: list[np.ndarray], y: np.ndarray, p: Params) -> Model:
    """Chooses terms and descends, all on the driver."""
    place = choose(lambda among: counted(zip(features, y.astype(int)), among, p), p)
    return descend([x[x >= 0] for x in (place[ids] for ids in features)], y, place, p)


def descend(own: list[np.ndarray], y: np.ndarray, place: np.ndarray, p: Params) -> Model:
    """Descends the logistic loss in small batches with Adagrad steps; ``own`` has the places of each document's terms."""
    pos, neg, terms = float(y.sum()), float(len(y) - y.sum()), int(place.max(initial=-1)) + 1
    if not pos or not neg:
        return Model(np.full_like(place, -1), -20.0 if not pos else 20.0, np.zeros(0), np.zeros((0, p.factors)))
    rng = np.random.default_rng(p.seed)
    bias, weight, vectors = np.log(pos / neg), np.zeros(terms), rng.normal(0, 0.05, (terms, p.factors))
    g_bias, g_weight, g_vectors = 1e-6, np.full(terms, 1e-6), np.full(vectors.shape, 1e-6)
    for _ in range(p.epochs):
        order = rng.permutation(len(own))
        for k in range(0, len(order), 256):
            part = [own[i] for i in order[k : k + 256]]
            ids = np.concatenate(part)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            raw, total = raw_scores(ids, starts, (bias, weight, vectors))
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[order[k : k + 256]]) / len(part)
            each = np.repeat(off, np.diff(starts))
            dw = np.bincount(ids, each, terms) + p.decay * weight
            pull = each[:, None] * (np.repeat(total, np.diff(starts), axis=0) - vectors[ids])
            dv = np.stack([np.bincount(ids, pull[:, f], terms) for f in range(p.factors)], 1) + p.decay * vectors
            g_bias, g_weight, g_vectors = g_bias + off.sum() ** 2, g_weight + dw**2, g_vectors + dv**2
            bias -= p.rate * off.sum() / np.sqrt(g_bias)
            weight -= p.rate * dw / np.sqrt(g_weight)
            vectors -= p.rate / 3 * dv / np.sqrt(g_vectors)
    return Model(place, float(bias), weight, vectors)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fits on a bounded sample of labelled documents outside the held-out fold.

    Without labelled documents, or with one label only, all scores are that label's
    (without any, 0).
    """
    stage = Stage(docs.sparkSession, "toxicity")
    rows = stage.write(labelled.sample(docs, labels, "toxic", lambda: term_ids(p.bits), p.sample))
    place = choose(lambda among: _counted_apart(rows, among, p), p)
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = (shared.value[np.frombuffer(x, np.uint32)] for x in b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[x >= 0].tobytes() for x in kept], pa.binary())], ["doc_id", "y", "x"])

    # A sampled document comes to the driver as the terms that take part.
    model = descend(*labelled.collected(rows.mapInArrow(lean(own), rows.schema), np.int32), place, p)
    stage.close()
    return model


def _scorer(docs: DataFrame, model: Model, p: Params):
    """The model is broadcast; its size is set by ``bits`` and by the terms that a bounded sample can hold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, ids_of = shared.value, term_ids(p.bits)

        def score(texts: list[str]) -> np.ndarray:
            own = [x[x >= 0] for x in (m.place[ids_of(t)] for t in texts)]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(int)
            raw, _ = raw_scores(np.concatenate(own) if own else np.zeros(0, int), starts, (m.bias, m.weight, m.vectors))
            return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

        return score

    return make


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score) for each row of ``docs`` (doc_id, text); other columns aren't read.

    Null and empty texts get the score of a text without terms; null ids are not held out;
    texts of any length are scored whole; repeated rows each get a row; an empty table none.
    """
    return labelled.scored(docs, _scorer(docs, model, p))


def reject(docs: DataFrame, model: Model, threshold: float = 0.3, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``."""
    return labelled.kept(docs, _scorer(docs, model, p), lambda s: s < threshold)


def predicted(threshold: float):
    return F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
