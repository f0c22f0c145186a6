"""Sessions, messages, events, questions and answers as tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo import config
from tremolo.functions.scalars import folded, formatted, normal_question, short_number, urls
from tremolo.operators.signals import indexed

#: The kinds of events, in the order in which they may occur (fixed values).
EVENTS = ("diagnosis_started", "node_started", "tool_started", "tool_completed", "node_completed", "branch_selected", "warning", "diagnosis_completed", "diagnosis_failed")
#: What an answer says that nothing supports.
NO_SUPPORT = "The record of this diagnosis does not support an answer."
EVENT = "session_id string, event string, node string, tool string, status string, label string, summary string, elapsed_ms long, payload string"

#: Topics of free questions: words that lead to each, tried in this order.
TOPICS = [
    ("confidence", ["confidence", "certain", "sure", "置信"]),
    ("frequency", ["frequency", "spectrum", "envelope", "频"]),
    ("feature", ["rms", "kurtosis", "crest", "feature", "特征"]),
    ("source", ["source", "reference", "来源"]),
    ("advice", ["advice", "next", "should", "建议"]),
]
QUESTIONS = [
    ("why_fault", "Why is it this fault?"),
    ("key_evidence", "What is the key evidence?"),
    ("why_confidence", "Why this confidence?"),
    ("why_unconfirmed", "Why can it not be confirmed?"),
    ("where_wrong", "Where may it be wrong?"),
    ("what_data", "What data is needed?"),
    ("full_report", "Show the full report"),
]


def upserted(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions with ``new`` ones in place of those of the same id."""
    return sessions.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)


def retained(sessions: DataFrame, messages: DataFrame, keep: int = config.SESSIONS_KEPT) -> tuple[DataFrame, DataFrame]:
    """The newest ``keep`` sessions and their messages. A limit, so Spark keeps as many rows a task."""
    kept = sessions.orderBy(F.desc("created_at"), F.desc("session_id")).limit(keep)
    return kept, messages.join(kept.select("session_id"), "session_id", "left_semi")


def session(sessions: DataFrame, messages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sessions of the ids in ``wanted`` (session_id), and their whole logs with pos, each message's place from 0."""
    ids = wanted.select("session_id").distinct()
    place = (F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1).cast("long")
    return sessions.join(ids, "session_id", "left_semi"), messages.join(ids, "session_id", "left_semi").withColumn("pos", place)


def session_list(sessions: DataFrame, messages: DataFrame, limit: int = config.SESSIONS_KEPT) -> DataFrame:
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    rows = sessions.orderBy(F.desc("created_at"), F.desc("session_id")).limit(limit).join(counts, "session_id", "left")
    return rows.withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def history(messages: DataFrame, turns: int = config.HISTORY_TURNS, chars: int = config.HISTORY_CHARS, key: str = "session_id", order: str = "id", text: str = "content") -> DataFrame:
    """The last 2 x ``turns`` messages of each session with folded, shortened contents; ``pos`` rises with time."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    rows = messages.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= 2 * turns)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("pos", (n - F.col("_k")).cast("long")).withColumn(text, folded(F.col(text), chars)).drop("_k")


def appended(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Messages with ``new`` (session_id, created_at, role, content, meta) after them; ids go on from the largest."""
    base = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    rows = indexed(new.withColumn("_all", F.lit(0)), "_all", F.floor(F.coalesce("created_at", F.lit(-1.0)) / 3600), "created_at", "session_id", "role")
    return messages.unionByName(rows.join(F.broadcast(base), F.lit(True)).withColumn("id", (F.col("_base") + F.col("idx") + 1).cast("long")).drop("_all", "idx", "_base"))


def answered(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """``messages`` with two more for each answer of a known session: the question, then the answer.

    ``answers`` is what ``answer`` gives, with created_at. Their meta says the question's key, the facts
    used, and whether nothing supports an answer. Ids go on from the largest.
    """
    known = answers.where("facts_used")
    kind = F.when(F.col("question_key").isNull(), "chat").otherwise("ask")
    asked = F.struct(F.lit(0).alias("_p"), F.lit("user").alias("role"), F.col("question").alias("content"), F.to_json(F.struct(kind.alias("kind"), "question_key")).alias("meta"))
    told = F.struct(F.lit(1).alias("_p"), F.lit("assistant").alias("role"), F.col("content").alias("content"), F.to_json(F.struct(kind.alias("kind"), "question_key", "facts_used", (F.col("content") == NO_SUPPORT).alias("no_support"))).alias("meta"))
    pairs = known.select("session_id", "created_at", "question", F.explode(F.array(asked, told)).alias("m")).select("session_id", "created_at", "question", "m.*")
    base = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    rows = indexed(pairs.withColumn("_all", F.lit(0)), "_all", F.floor(F.coalesce("created_at", F.lit(-1.0)) / 3600), "created_at", "session_id", "question", "_p")
    new = rows.join(F.broadcast(base), F.lit(True)).withColumn("id", (F.col("_base") + F.col("idx") + 1).cast("long"))
    return messages.unionByName(new.select(*messages.columns))


def session_id() -> Column:
    """A new random id: 32 hexadecimal digits."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


def audio_name(session: Column, slot: Column) -> Column:
    """The file of a session's sound; null where the id or the slot isn't of the allowed form."""
    return F.when(session.rlike(r"\A[A-Za-z0-9_-]{6,64}\z") & slot.isin("normal", "abnormal"), F.concat(session, F.lit("_"), slot, F.lit(".wav")))


def timed_events(events: DataFrame, at: str = "at") -> DataFrame:
    """``events`` (session_id, a timestamp and more) with seq, their place in the session from 0, and elapsed_ms since its first event."""
    own = Window.partitionBy("session_id")
    rows = events.drop("seq", "elapsed_ms").withColumn("_first", F.min(at).over(own)).withColumn("seq", (F.row_number().over(own.orderBy(at, "event")) - 1).cast("long"))
    return rows.withColumn("elapsed_ms", F.floor((F.unix_micros(at) - F.unix_micros("_first")) / 1000).cast("long")).drop("_first")


def topic(question: Column) -> Column:
    """The first topic one of whose words the question holds; null if none."""
    q, out = F.lower(question), F.lit(None).cast("string")
    for name, words in reversed(TOPICS):
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def known_question(question: Column, questions: list[tuple[str, str]] = QUESTIONS) -> Column:
    """The key of the first known question that the text equals or begins with, by letters and digits only."""
    q, out = normal_question(question), F.lit(None).cast("string")
    for key, text in reversed(questions):
        own = normal_question(F.lit(text))
        out = F.when((q == own) | q.startswith(own), key).otherwise(out)
    return out


def rejected_urls(answers: DataFrame, allowed: DataFrame, text: str, key: str) -> DataFrame:
    """(key, url) of the URLs in answers that neither begin nor are begun by an allowed one.

    ``allowed`` has key and url. A merge: the URLs of both sides stand in one order by key. A URL begins an allowed one if and only if it begins
    the next allowed one; an allowed one begins it if and only if the last one does that no other allowed one begins. So no pairs are made, and a session
    passes as a stream, of which two URLs are held. Null URLs allow nothing.
    """
    found = answers.select(F.col(key).alias("_k"), F.explode(F.array_distinct(urls(F.col(text)))).alias("url"), F.lit(1).alias("_side"))
    ok = allowed.where(F.col("url").isNotNull()).select(F.col(key).alias("_k"), "url", F.lit(0).alias("_side"))
    # The next allowed URL, in the order of bytes; at the same place an allowed one counts as next too.
    after = F.last(F.when(F.col("_side") == 0, F.col("url")), ignorenulls=True).over(Window.partitionBy("_k").orderBy(F.desc("url"), "_side").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.unionByName(ok).withColumn("_after", after).where((F.col("_side") == 0) | ~F.coalesce(F.col("_after").startswith(F.col("url")), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = kept = None
        for batch in batches:
            out = []
            for i, (k, url, side) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if k != now:
                    now, kept = k, None
                begun = kept is not None and url.startswith(kept)
                if side == 0 and not begun:
                    kept = url
                elif side == 1 and not begun:
                    out.append(i)
            yield batch.select([0, 1]).take(pa.array(out, pa.int64()))

    rows = rows.select("_k", "url", "_side").where("_k IS NOT NULL").repartition("_k").sortWithinPartitions("_k", "url", "_side")
    left = rows.mapInArrow(run, rows.select("_k", "url").schema)
    # Answers without a session have no allowed URLs.
    return left.unionByName(found.where("_k IS NULL").select("_k", "url")).withColumnRenamed("_k", key)


#: Bytes of names to an automaton; longer lists of names go by several, one after another.
NAME_BYTES = 32 << 20


def names_in(texts: DataFrame, text: str, key: str, names: DataFrame) -> DataFrame:
    """(key, name): the distinct ``names`` (one column) that each row's text holds anywhere, by one automaton over all of them.

    A text is read once for each automaton, whatever the number of names. Null texts hold none; empty and null names are held by none.
    """
    names = names.toDF("name").where("name <> ''").distinct()
    size = names.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    parts = -(-size // NAME_BYTES) or 1
    schema = texts.select(F.col(key).alias("_key")).schema.add("name", "string")
    found = []
    for k in range(parts):
        # About NAME_BYTES by its share of the names, so it may be collected and sent to all.
        own = names.sparkSession.sparkContext.broadcast([r.name for r in names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).collect()])

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for name in own.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            for batch in batches:
                rows, out = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    hits = {name for _, name in automaton.iter(t)} if t and len(automaton) else ()
                    rows += [i] * len(hits)
                    out += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], schema.names)

        found.append(texts.select(F.col(key).alias("_key"), text).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_key", key)


def rejected_types(answers: DataFrame, allowed: DataFrame, known: DataFrame, text: str, key: str) -> DataFrame:
    """(key, fault_type) of known fault types that an answer names but its session doesn't allow."""
    named = names_in(answers, text, key, known.where("fault_type <> 'normal'").select("fault_type")).withColumnRenamed("name", "fault_type")
    return named.join(allowed, [key, "fault_type"], "left_anti").distinct()


def allowed_types(report: DataFrame) -> DataFrame:
    """(session_id, fault_type): candidates' types, the conclusion's, and 'unconfirmed'."""
    each = report.select("session_id", F.explode(F.array_union(F.coalesce("candidate_types", F.array().cast("array<string>")), F.array(F.coalesce("conclusion", F.lit("unconfirmed")), F.lit("unconfirmed")))).alias("fault_type"))
    return each.distinct()


def answer(report: DataFrame, questions: DataFrame) -> DataFrame:
    """(session_id, question, question_key, content, facts_used): fixed answers, then topics, else a digest of facts.

    ``report`` has a row for each session with conclusion, status, confidence, confidence_reason, evidence,
    candidate_types, sources, suggestions, markdown.
    """
    rows = questions.join(report, "session_id", "left").withColumn("question_key", F.coalesce(known_question(F.col("question")), topic(F.col("question"))))
    head = lambda c, n: F.array_join(F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n), "; ")
    level = F.concat(F.lit("confidence is "), "confidence", F.lit(": "), "confidence_reason")
    facts = F.concat_ws("; ", F.concat(F.lit("conclusion "), "conclusion"), head("evidence", 4), level)
    sources = F.concat(F.lit("sources: "), head("sources", 5))
    content = {
        "why_fault": F.concat(F.lit("the conclusion is "), "conclusion", F.lit(", as "), head("evidence", 3)), "key_evidence": head("evidence", 6), "why_confidence": level,
        "why_unconfirmed": F.when(F.col("status") == "ok", F.lit("it is confirmed")).otherwise(F.concat(F.lit("not confirmed: "), "confidence_reason")),
        "where_wrong": F.concat(F.lit("to be reviewed: "), head("suggestions", 4)), "what_data": F.concat(F.lit("more data would help: "), head("suggestions", 3)), "full_report": F.col("markdown"),
        "confidence": level, "frequency": head("evidence", 6), "feature": head("evidence", 3), "source": sources, "advice": head("suggestions", 5),
    }
    out = facts
    for k, v in content.items():
        out = F.when(F.col("question_key") == k, v).otherwise(out)
    missing = F.col("status").isNull()
    return rows.select("session_id", "question", "question_key", F.when(missing, "session_not_found").otherwise(out).alias("content"), (~missing).alias("facts_used"))


def context_digest() -> Column:
    """What a model may know of a session, as lines: input, status, quality, candidates, sources, evidence, conclusion and advice.

    Columns: session_id, request (struct of normal_id, abnormal_id, sampling_rate, rotation_speed), status, error, quality
    (struct of valid, comparable, errors), candidates (array of structs with fault_type, title, score, evidence), sources,
    evidence, conclusion, confidence, confidence_reason, suggestions and warnings. What is null or empty has no line.
    """
    few = lambda c, n: F.when(F.size(c) > 0, F.array_join(F.transform(F.slice(c, 1, n), lambda x: F.concat(F.lit("\n- "), x)), ""))
    r, q = F.col("request"), F.col("quality")
    known = F.transform("candidates", lambda c: F.concat(c["fault_type"], F.lit(" ("), F.coalesce(c["title"], F.lit("")), formatted(", score %.4f): ", c["score"]), F.coalesce(c["evidence"], F.lit(""))))
    types = F.array_join(F.transform("candidates", lambda c: c["fault_type"]), ", ")
    return F.concat_ws(
        "\n", F.lit("Facts of this session; nothing else may be used:"),
        F.concat(F.lit("input: baseline "), F.coalesce(r["normal_id"], F.lit("unknown")), F.lit(", suspect "), F.coalesce(r["abnormal_id"], F.lit("unknown")), F.coalesce(F.concat(F.lit(", speed "), short_number(r["rotation_speed"])), F.lit("")), F.coalesce(F.concat(F.lit(", rate "), short_number(r["sampling_rate"])), F.lit(""))),
        F.concat(F.lit("status: "), "status"), F.concat(F.lit("error: "), "error"),
        F.when(q.isNotNull(), F.concat(F.lit("data: valid "), F.coalesce(q["valid"].cast("string"), F.lit("unknown")), F.lit(", comparable "), F.coalesce(q["comparable"].cast("string"), F.lit("unknown")), F.coalesce(few(q["errors"], 2), F.lit("")))),
        F.when(F.size("candidates") > 0, F.concat(F.lit("candidates:"), few(known, 1000), F.lit("\nfault types that may be named: "), types)),
        F.concat(F.lit("sources that may be named:"), few(F.col("sources"), 5)), F.concat(F.lit("evidence:"), few(F.col("evidence"), 4)),
        F.concat(F.lit("conclusion: "), "conclusion"), F.concat(F.lit("confidence: "), "confidence", F.lit("; "), F.coalesce("confidence_reason", F.lit(""))),
        F.concat(F.lit("to be reviewed:"), few(F.col("suggestions"), 5)), F.concat(F.lit("warnings:"), few(F.col("warnings"), 3)),
        F.concat(F.lit("If these facts don't answer the question, say: "), F.lit(NO_SUPPORT)),
    )


def digest_facts() -> Column:
    """The names of the parts that ``context_digest`` has lines of."""
    has = lambda name, ok: F.when(ok, name)
    parts = F.array(
        F.lit("request_summary"), F.lit("result.status"), has("result.error", F.col("error").isNotNull()), has("result.data_quality", F.col("quality").isNotNull()), has("result.candidates", F.size("candidates") > 0), has("result.sources", F.size("sources") > 0),
        has("result.comparison", F.size("evidence") > 0), has("result.report", F.col("conclusion").isNotNull()), has("result.trace", F.size("warnings") > 0),
    )
    return F.filter(parts, lambda x: x.isNotNull())


def event_log(rows: DataFrame) -> DataFrame:
    """Events of the known kinds in the envelope's nine fields; the payload is JSON or null."""
    return rows.where(F.col("event").isin(*EVENTS)).select(*[c.split()[0] for c in EVENT.split(", ")])


def sse(events: DataFrame) -> DataFrame:
    """(session_id, value): server-sent-event frames."""
    return events.select("session_id", F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("value"))


def newest_files(files: DataFrame, keep: int = config.AUDIO_KEPT) -> DataFrame:
    """The files (path, modified) that stay when all but the newest ``keep`` are evicted."""
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(keep)
