"""Structured Streaming: windowed statistics of event signals, and an append-only event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.operators.signals import stats
from tremolo.operators.sessions import event_log


def read_events(spark: SparkSession, path: str, schema, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_stats(events: DataFrame, window: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """rms, peak, kurtosis and crest factor by event type and event-time window; works on streams and tables alike.

    On a stream, events later than ``late`` behind the newest are dropped, and windows come out when the
    watermark has passed them.
    """
    rows = events.where("event_type IS NOT NULL AND value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    keyed = rows.select(F.col("event_type").alias("sample_id"), F.window("ts", window, slide).alias("window"), F.col("value").alias("amplitude"))
    made = stats(keyed, "sample_id", "window")
    return made.select("sample_id", F.col("window.start").alias("start"), "n_samples", "mean", "rms", "peak", "kurtosis", "crest_factor")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what there is, writes it as Parquet and stops; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def log_events(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the known events of a stream; readers never hold it up."""
    run_to_table(event_log(stream), path, checkpoint)


TIMED = "session_id string, event string, at timestamp, seq long, elapsed_ms long"


def timed_stream(events: DataFrame) -> DataFrame:
    """TIMED of a stream of events (session_id, event, at): numbered within the session, with the time since its first event.

    The state of a session is its first time and its count, so it doesn't grow with the session's events.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, count = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values(["at", "event"], kind="stable")
        first = rows["at"].iloc[0] if first is None else min(pd.Timestamp(first, unit="us"), rows["at"].iloc[0])
        since = ((rows["at"] - first) // pd.Timedelta(milliseconds=1)).astype("int64")
        yield pd.DataFrame({"session_id": key[0], "event": rows["event"], "at": rows["at"], "seq": range(count, count + len(rows)), "elapsed_ms": since})
        state.update((int(first.value // 1000), count + len(rows)))

    return events.select("session_id", "event", "at").groupBy("session_id").applyInPandasWithState(run, TIMED, "first long, count long", "append", "NoTimeout")
