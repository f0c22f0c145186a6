"""Canonical exact fingerprints: fold a text, hash it widely, compare bytes within equal buckets.

All of it is DataFrame and SQL functions. Unicode normalisation and case folding come
from the ICU classes that Spark itself ships, called by ``java_method``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.session import Stage


#: Broadcast at most so many buckets (of 32 characters, so under 50 MB).
BROADCAST_BUCKETS = 400_000
#: Bytes of texts dealt to a range of ids.
RANGE_BYTES = 8 << 20


def canonical(text: Column) -> Column:
    """NFKC, full case folding (normalised again after it), runs of white space to one space, trimmed."""
    plain = F.octet_length(text) == F.char_length(text)
    nfkc = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(plain, F.lower(text)).otherwise(nfkc(fold(nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column, bits: int = 128) -> Column:
    """Two xxhash64 values of different seeds as hex; fewer bits only serve tests of collisions."""
    both = F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0"))
    return F.lower(F.substring(both, 1, bits // 4))


def collisions(canon: DataFrame, stage: Stage) -> DataFrame | None:
    """(bucket, canon, other): the texts that share a bucket with other bytes, numbered in byte
    order within it; None where every bucket holds one text.

    ``canon`` has the columns bucket and canon. Only texts of buckets with several rows are
    compared: their smallest and largest, which partial aggregation reduces to two a task
    and bucket, are equal exactly when all are.
    """
    shared = stage.write(canon.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    # Without a shuffle of texts where the buckets' measured number allows it, else by Spark's own choice.
    several = canon.join(F.broadcast(shared) if shared.count() <= BROADCAST_BUCKETS else shared, "bucket", "left_semi")
    mixed = several.groupBy("bucket").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).where("a <> z").select("bucket")
    mixed = stage.write(mixed)
    if mixed.isEmpty():
        return None
    texts = canon.join(mixed, "bucket", "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("canon")) - 1
    return stage.write(texts.withColumn("other", rank)).where("other > 0")


def _numbered(df: DataFrame, canon: str, bucket: str, clash: DataFrame | None, out: str) -> DataFrame:
    """Adds ``out``: the bucket, and where its texts differ a dash and the text's number in it."""
    if clash is None:
        return df.withColumn(out, F.col(bucket))
    clash = clash.select(F.col("bucket").alias(bucket), F.col("canon").alias(canon), F.col("other").alias("_tremolo_other"))
    named = F.concat(bucket, F.coalesce(F.concat(F.lit("-"), "_tremolo_other"), F.lit("")))
    return df.join(clash, [bucket, canon], "left").withColumn(out, named).drop("_tremolo_other")


def _clashes(df: DataFrame, text: str, bits: int) -> DataFrame | None:
    stage = Stage(df.sparkSession, "fingerprint")
    canon = df.select(canonical(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("canon"))
    clash = collisions(canon.select(wide_hash(F.col("canon"), bits).alias("bucket"), "canon"), stage)
    if clash is None:
        stage.close()
    return clash


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", bits: int = 128) -> DataFrame:
    """``df`` with the column ``out``: equal for texts of equal canonical form, and only for these.

    The value is the wide hash of the canonical text; where the byte comparison finds
    another text in the same bucket, a dash and that text's number in the bucket follow.
    Null counts as empty; empty and blank texts share one fingerprint; texts of any length
    are folded whole; repeated rows keep theirs; an empty table stays empty. A column named
    like ``out`` is replaced, all others pass through.
    """
    clash = _clashes(df, text, bits)
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    canon = canonical(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    kept = df.select(*rest, canon.alias("_tremolo_canon")).withColumn("_tremolo_bucket", wide_hash(F.col("_tremolo_canon"), bits))
    return _numbered(kept, "_tremolo_canon", "_tremolo_bucket", clash, "_tremolo_out").select(*rest, F.col("_tremolo_out").alias(out))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint``, ``group_id`` (the smallest id of the texts with that
    fingerprint; null ids are ignored) and ``group_size`` (its rows).

    The groups are sums and minima that each task aggregates before the shuffle, so a
    group with a third of all rows costs no more than others.
    """
    marked = fingerprints(df.drop("group_id", "group_size"), text)
    groups = marked.groupBy("fingerprint").agg(F.min(F.col(f"`{id_col}`")).alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return marked.join(groups, "fingerprint")


def _range(doc_id: Column, borders: list[int]) -> Column:
    """The number of ``borders`` (rising) that are not above the id; looked up in two steps, by the root of their number each."""
    step = max(1, int(len(borders) ** 0.5))
    parts = [borders[k : k + step] for k in range(0, len(borders), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= doc_id))
    first = upto(longs([x[0] for x in parts]))
    return F.when(first == 0, 0).otherwise((first - 1) * step + upto(F.element_at(F.array(*map(longs, parts)), first))) if parts else F.lit(0)


def with_next(rows: DataFrame, stage: Stage, carried: list[str], make: Callable[[DataFrame], DataFrame] = lambda df: df, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``make(rows)`` with ``next``, a struct of the columns ``carried`` of the next row by (doc_id, text);
    the last row's next is the first. ``rows`` has doc_id and text; ``make`` adds columns to its rows.

    Rows are dealt by ranges of doc_id whose borders are quantiles of all ids, as many as their texts'
    bytes take, so texts are shuffled once and ranges don't grow with the table; rows without an id form a
    range of their own before all others. Within a range the next row is a window's lead; across borders it is
    the first row of the next range that has any, so one row of each range is looked up apart.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    cuts = rows.select("doc_id").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], min(0.001, 0.25 / ranges)) if ranges > 1 else []
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(_range(F.col("doc_id"), sorted({int(x) for x in cuts})))
    dealt = rows.withColumn("_part", part)
    led = make(dealt).withColumn("_next", F.lead(F.struct(*carried)).over(Window.partitionBy("_part").orderBy("doc_id", "text")))
    # Ids alone say which rows come first; only these are made.
    ids = dealt.where("_part >= 0").groupBy("_part").agg(F.min("doc_id").alias("doc_id"))
    heads = dealt.join(F.broadcast(stage.write(ids)), ["_part", "doc_id"], "left_semi").unionByName(dealt.where("_part < 0"))
    first = stage.write(make(heads).groupBy("_part").agg(F.min(F.struct("doc_id", "text", *[c for c in carried if c != "text"])).alias("row")))
    order = Window.partitionBy(F.lit(0)).orderBy("_part")  # a row for each range
    start = F.struct(*[F.col(f"row.{c}").alias(c) for c in carried])
    head = F.first(start).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = first.select("_part", F.coalesce(F.lead(start).over(order), head).alias("_after"))
    return led.join(follow, "_part", "left").withColumn("next", F.coalesce("_next", "_after")).drop("_part", "_next", "_after")


def fingerprint_edits(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and its next document.

    ``docs`` has doc_id and text (null: empty). The edited text ends, instead of in its last
    floor(n/2) code points, in the first as many of the next document's, or all of them.
    An exact digest's likeness is 1.0 for equal fingerprints and else 0.0; the edited text
    is compared in bytes with the document's own where their hashes agree. Rows without a
    doc_id come before all others; rows that repeat an id follow one another in the order of
    their texts; a single row is its own next; an empty table stays empty.
    """
    stage = Stage(docs.sparkSession, "edits")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    clash = _clashes(rows, "text", bits)

    def printed(df: DataFrame) -> DataFrame:
        own = df.withColumn("canon", canonical(F.col("text"))).withColumn("bucket", wide_hash(F.col("canon"), bits))
        return _numbered(own, "canon", "bucket", clash, "fingerprint").drop("canon", "bucket")

    paired = with_next(rows, stage, ["text", "fingerprint"], printed)
    head = "substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"
    tail = "substring(next.text, 1, int(floor(char_length(text) / 2)))"
    edited = paired.withColumn("edited_text", F.expr(f"concat({head}, {tail})"))
    edited = edited.withColumn("canon", canonical(F.col("edited_text"))).withColumn("bucket", wide_hash(F.col("canon"), bits))
    edited = _numbered(edited, "canon", "bucket", clash, "edited_fingerprint")
    foreign = (F.col("edited_fingerprint") == F.col("fingerprint")) & (canonical(F.col("text")) != F.col("canon"))
    edited = edited.withColumn("edited_fingerprint", F.when(foreign, F.concat("edited_fingerprint", F.lit("-e"))).otherwise(F.col("edited_fingerprint")))
    like = lambda other: F.when(F.col("fingerprint") == other, 1.0).otherwise(0.0)
    return edited.select(
        "doc_id", "text", "edited_text", "fingerprint", "edited_fingerprint",
        like(F.col("edited_fingerprint")).alias("near_edited"), like(F.col("next.fingerprint")).alias("near_next"),
    )
