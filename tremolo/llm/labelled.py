"""Bounded samples of labelled documents, for the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import held_out, lean, slices, whole_texts

#: Labelled documents that a model is fitted on at most: those of the smallest hash of their id.
SAMPLE = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, features: Callable, most: int = SAMPLE) -> DataFrame:
    """(doc_id, y, x): features (an array's bytes) and labels of a sample outside the held-out fold.

    A document's label is the largest of its rows; null labels and ids don't count. The
    sample's ids and labels are broadcast, as many as ``most``; texts are turned into features on
    the executors.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = features()
        for whole in batches:
            for b in slices(whole, "text"):
                x = [make(t).tobytes() for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    return whole_texts(texts).mapInArrow(lean(run), "doc_id long, y int, x binary")


def collected(rows: DataFrame, kind: type) -> tuple[list[np.ndarray], np.ndarray]:
    """The features (arrays of ``kind``) and labels of a sample, on the driver, in an order that reruns repeat."""
    table = rows.toArrow()
    ids, x, y = table.column("doc_id").to_pylist(), table.column("x").to_pylist(), table.column("y").to_numpy()
    order = sorted(range(len(x)), key=lambda k: (ids[k], x[k]))
    return [np.frombuffer(x[k], kind) for k in order], y[order].astype(float)


def scored(docs: DataFrame, scorer: Callable) -> DataFrame:
    """(doc_id, held_out, score): ``scorer()`` makes, in each worker, a function from texts to scores."""
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score(b.column(2).to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])

    return whole_texts(source).mapInArrow(lean(run), "doc_id long, held_out boolean, score double")


def kept(docs: DataFrame, scorer: Callable, keep: Callable) -> DataFrame:
    """The rows of ``docs``, all columns, whose text's score passes ``keep``; texts go through Arrow once."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for whole in batches:
            for b in slices(whole, "text"):
                yield b.filter(pa.array([keep(s) for s in score([t or "" for t in b.column(at).to_pylist()])], pa.bool_()))

    return whole_texts(docs).mapInArrow(lean(run), docs.schema)
