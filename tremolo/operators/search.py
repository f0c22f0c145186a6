"""Search of knowledge entries: by words, or by words and vectors of chunks, with a fallback that says why."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolo import config
from tremolo.operators import retrieval
from tremolo.session import Stage
from tremolo.sources import versioned


def lexical_text() -> Column:
    """What an entry is found by."""
    return F.concat_ws(" ", "title", "applicable", F.array_join("typical_features", " "), "frequency_signature", "frequency_family", "body")


def header(chunk_id: Column) -> Column:
    """The lines that stand before the text of each chunk of an entry: what its front matter says."""
    first = F.get("sources", F.lit(0))
    names = F.array_join(F.transform("sources", lambda s: F.coalesce(s["name"], F.lit(""))), "；")
    fields = [
        ("fault_type", F.col("fault_type")), ("title", F.col("title")), ("applicable", F.col("applicable")), ("typical_features", F.array_join("typical_features", "；")), ("frequency_signature", F.col("frequency_signature")),
        ("source", first["name"]), ("sources", names), ("source_url", first["url"]), ("locator", first["locator"]), ("document", F.col("document")), ("chunk_id", chunk_id),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(""))) for name, value in fields])


def entry_chunks(entries: DataFrame, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """(chunk_id, chunk_index, entry_index, fault_type, title, source, source_url, locator, document, body, text) of all entries.

    Ids are the entry's type and the chunk's number; an entry without a body has one chunk, its header.
    """
    pieces = retrieval.chunks(entries, "fault_type", "body", size, overlap).withColumnRenamed("chunk", "_piece")
    rows = entries.join(pieces, "fault_type")
    first = F.get("sources", F.lit(0))
    part = lambda name: F.coalesce(first[name], F.lit(""))
    return rows.select(
        "chunk_id", "chunk_index", "entry_index", "fault_type", "title", part("name").alias("source"), part("url").alias("source_url"), part("locator").alias("locator"),
        "document", F.col("_piece").alias("body"), F.trim(F.concat(header(F.col("chunk_id")), F.lit("\n\n"), "_piece")).alias("text"),
    )


def write_index(entries: DataFrame, embed: Callable[[Column], Column], path: str, model: str = "") -> DataFrame:
    """Brings the stored index at ``path`` up to date; a row of counts: upserted, pruned, added, count.

    Chunks of equal id are replaced, ids that are gone are removed, and a second run changes nothing. Only
    chunks whose text is new are embedded, unless ``model``, the embedder's name, is another than before; only
    buckets that hold a changed or removed chunk are written. The index is kept in versions: until the new one is
    whole, and if writing it fails, the old one is read.
    """
    spark = entries.sparkSession
    stage = Stage(spark, "vectors")
    new = stage.write(entry_chunks(entries))
    if new.isEmpty():
        raise RuntimeError("there are no entries to index")
    old, known = new.limit(0), None
    try:
        known = versioned.current(spark, path)
        old = versioned.read(spark, path)
    except FileNotFoundError:
        pass
    counts = retrieval.rebuilt(old.select("chunk_id"), new.select("chunk_id"))[1].withColumn("count", F.col("upserted")).collect()
    same = known is not None and known.notes.get("model") == model and {*new.columns, "embedding"} == set(old.columns)
    if same:
        # A chunk stays as it is if all its columns but the vector are equal.
        both = old.select(F.col("chunk_id").alias("_id"), F.sha2(F.to_json(F.struct(*sorted(new.columns))), 256).alias("_text"), "embedding")
        met = new.withColumn("_now", F.sha2(F.to_json(F.struct(*sorted(new.columns))), 256)).join(both, F.col("chunk_id") == F.col("_id"), "full_outer")
        met = stage.write(met.withColumn("_kept", F.col("_now").eqNullSafe(F.col("_text"))).withColumn("_bucket", versioned.bucket(F.coalesce("chunk_id", "_id"), known.buckets)))
        changed = {r[0] for r in met.where(~F.col("_kept")).select("_bucket").distinct().collect()}  # as many as there are buckets at most
        touched = met.where(F.col("_bucket").isin(sorted(changed)) & F.col("chunk_id").isNotNull()) if changed else met.limit(0)
        kept = touched.where("_kept").select(*new.columns, "embedding")
        rows = kept.unionByName(touched.where("NOT _kept").select(*new.columns).withColumn("embedding", embed(F.col("text"))))
    else:
        changed, rows = None, new.withColumn("embedding", embed(F.col("text")))
    if changed is None or changed:
        versioned.write(rows, "chunk_id", path, changed, known.buckets if known else versioned.BUCKETS, {"model": model})
    return spark.createDataFrame(counts, "upserted long, pruned long, added long, count long")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks and vectors; FileNotFoundError if there are none."""
    return versioned.read(spark, path)


def status(spark: SparkSession, path: str) -> DataFrame:
    """(path, exists, count, error): the state of the stored index; nothing is created."""
    try:
        row = (path, True, open_index(spark, path).count(), None)
    except FileNotFoundError:
        there = versioned.exists(spark, path)
        row = (path, there, 0, "the folder holds no index" if there else None)
    except Exception as e:  # the folder holds no readable table
        row = (path, True, 0, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")
    return spark.createDataFrame([row], "path string, exists boolean, count long, error string")


def clause_hits(queries: DataFrame, entries: DataFrame, most: int = 2, query_key: str = "request_id") -> DataFrame:
    """(query_key, entry_index, k, id, claim, score): of each query and entry the clauses of the best BM25 score over all clauses, above 0."""
    clauses = entries.select("entry_index", F.posexplode("criteria").alias("pos", "c")).select("entry_index", "pos", F.col("c.id").alias("id"), F.coalesce("c.claim", F.lit("")).alias("claim"))
    clauses = clauses.withColumn("clause_no", F.col("entry_index") * 100_000 + F.col("pos"))
    scores = retrieval.bm25_scores(queries, retrieval.index(clauses, "clause_no", "claim"), query_key)
    return best_clauses(scores.join(clauses, "clause_no"), "entry_index", "pos", most, query_key).select(query_key, "entry_index", "k", "id", "claim", "score")


def best_clauses(scored: DataFrame, entry: str, order: str, most: int = 2, query_key: str = "request_id") -> DataFrame:
    """Of each query and entry the ``most`` rows of the highest score above 0, ties in ``order``; numbered in k."""
    ranked = Window.partitionBy(query_key, entry).orderBy(F.desc("score"), order)
    return scored.where("score > 0").withColumn("k", F.row_number().over(ranked).cast("long")).where(F.col("k") <= most)


@dataclass
class Found:
    """Ranked entries (query_key, entry_index, score, rank, chunk_id, vector_score, bm25_score, retrieval, degraded_reason), and the mode."""

    rows: DataFrame
    mode: str
    reason: str | None


def search(queries: DataFrame, entries: DataFrame, embed: Callable[[Column], Column] | None = None, index_path: str | None = None, top_k: int = config.TOP_K, query_key: str = "request_id") -> Found:
    """The ``top_k`` entries for each query (query_key, query); scores have 4 digits.

    With ``embed`` chunks are scored by words and vectors, and an entry counts by its best chunk, the
    first if several; vectors come from the stored index at ``index_path``, if given. Without, or where
    that fails, whole entries are scored by words, and the rows say why.
    """
    if embed is None:
        return _lexical(queries, entries, None, top_k, query_key)
    stage = Stage(queries.sparkSession, "search")
    try:
        stored = open_index(queries.sparkSession, index_path) if index_path else stage.write(entry_chunks(entries).withColumn("embedding", embed(F.col("text"))))
        asked = stage.write(queries.select(query_key, embed(F.col("query")).alias("v")))
    except Exception as e:  # whatever an embedder or a store may raise
        return _lexical(queries, entries, f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}", top_k, query_key)
    entries = stored.select("chunk_id", "entry_index", "chunk_index")
    found = retrieval.hybrid_best(queries, asked, stored, retrieval.index(stored, "chunk_id", "text"), entries, top_k, query_key=query_key)
    best = retrieval.best_chunk(found, "entry_index", "chunk_index", query_key)
    rows = retrieval.top(best, "entry_index", top_k, query_key)
    digits = {c: F.round(c, 4) for c in ("score", "vector_score", "bm25_score")}
    return Found(_labelled(rows.withColumns(digits), "hybrid", None, query_key), "hybrid", None)


def _lexical(queries: DataFrame, entries: DataFrame, reason: str | None, top_k: int, query_key: str) -> Found:
    texts = entries.select("entry_index", lexical_text().alias("text"))
    scores = retrieval.bm25_scores(queries, retrieval.index(texts, "entry_index", "text"), query_key)
    rows = retrieval.top(scores, "entry_index", top_k, query_key).withColumn("score", F.round("score", 4))
    none = {"chunk_id": F.lit(None).cast("string"), "vector_score": F.lit(None).cast("double"), "bm25_score": F.col("score")}
    return Found(_labelled(rows.withColumns(none), "bm25", reason, query_key), "bm25", reason)


def _labelled(rows: DataFrame, mode: str, reason: str | None, query_key: str) -> DataFrame:
    return rows.select(query_key, "entry_index", "score", "rank", "chunk_id", "vector_score", "bm25_score", F.lit(mode).alias("retrieval"), F.lit(reason).cast("string").alias("degraded_reason"))
