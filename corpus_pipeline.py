"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` applies them to the table ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm import bpe, jaccard, mix, pii, toxicity
from tremolo.llm.common import table
from tremolo.session import Stage, passing


#: Bytes that an encoding worker remembers: executors still hold what earlier stages made their heaps grow to.
ENCODER_MEMO = 8 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.3 or more go.

    It learns from the labelled documents of the whole table, outside the held-out fold.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-shingles of a Jaccard similarity of 0.8 or more the smallest id stays."""
    return jaccard.distinct(docs)


def clean_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are taken out of the texts; every document stays."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources meet their target weights."""
    return mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token ids, as little-endian unsigned 32-bit integers, with their number, and the digest of what they decode to."""
    from tremolo.llm.queries import tokenizer_path

    made = bpe.bpe_round_trip(docs.select("doc_id", "source", "text"), tokenizer_path(), memo=ENCODER_MEMO)
    return made.select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", clean_private),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return step(spark, docs, sf_dir)
        before = docs
        with passing():  # what a step stages by itself goes once its result is written
            docs = stage.write(step(spark, docs, sf_dir))
        if k:
            stage.drop(before)
