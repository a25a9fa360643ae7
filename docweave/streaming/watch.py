"""File events: keyed debounce, immediate removals, counters, and incremental rescans.

The same expressions serve a batch and a stream; on a stream the watermark bounds session state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import State
from ..operators.state import unlink_stale

EVENT_SCHEMA = "event_id long, ts timestamp, path string, event string"
#: Debounce of a watcher in milliseconds, and the least that is taken.
DEBOUNCE_MS, LEAST_MS = 500, 100


def file_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A stream of Parquet files of events that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def is_watched(path: Column) -> Column:
    """Dotfiles and files in dot folders are not."""
    return ~path.rlike(r"(^|/)\.[^/.]")


def debounce_key(path: Column, doc_dirs: list[str]) -> Column:
    """``docs/`` and the documentation folder that the path is in, else ``code``."""
    key = F.lit("code")
    for d in doc_dirs:
        key = F.when(F.startswith(path, F.lit(f"{d.rstrip('/')}/")), F.concat(F.lit("docs/"), F.lit(d.rstrip("/").rsplit("/", 1)[-1]))).otherwise(key)
    return key


def debounce_sessions(events: DataFrame, key: Column, gap: str, watermark: str | None = None, ts: str = "ts", value: str = "path", order: str = "event_id") -> DataFrame:
    """(key, start, end, n_events, last): one firing for each run of events less than ``gap`` apart.

    Events exactly one gap apart are one session.  The last event of a session gives its value.
    """
    if watermark:
        events = events.withWatermark(ts, watermark)
    keyed = events.select(key.alias("key"), F.col(ts).alias("ts"), F.col(value).alias("value"), F.col(order).alias("order"))
    grouped = keyed.groupBy("key", F.session_window("ts", gap).alias("session"))
    last = F.max_by("value", F.struct("ts", "order"))
    found = grouped.agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"), last.alias("last"))
    return found.select("key", F.col("session.start").alias("start"), F.col("last_ts").alias("end"), "n_events", "last")


def start_debounce(events: DataFrame, key: Column, on_fire: Callable[[DataFrame, int], None], checkpoint: str, debounce_ms: int = DEBOUNCE_MS, watermark: str = "10 seconds", **trigger):
    """Runs ``on_fire(sessions, batch)`` for sessions as they close."""
    gap = f"{max(LEAST_MS, debounce_ms)} milliseconds"
    sessions = debounce_sessions(events.filter(is_watched(F.col("path")) & (F.col("event") != "unlink")), key, gap, watermark)
    return sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(on_fire).start()


def start_unlinks(events: DataFrame, load: Callable[[], State], store: Callable[[DataFrame, DataFrame], None], checkpoint: str, **trigger):
    """Removals are not debounced: each micro-batch marks sections and links (see ``unlink_stale``)."""

    def apply(batch: DataFrame, _: int) -> None:
        removed = batch.filter(F.col("event") == "unlink").select(F.col("path").alias("file"))
        if not removed.isEmpty():
            store(*unlink_stale(load(), removed))

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(apply).start()


def watch_status(events: DataFrame, key: Column) -> DataFrame:
    """Counters by key: events, distinct paths, removals, first and last event."""
    return events.groupBy(key.alias("key")).agg(F.count("*").alias("n_events"), F.count_distinct("path").alias("n_paths"), F.count_if(F.col("event") == "unlink").alias("n_unlinks"), F.max("event_id").alias("last_event"))


def incremental_filter(files: DataFrame, since: Column, tolerance_seconds: int = 1, modified: str = "modified") -> DataFrame:
    """Files modified more than the tolerance after the high-water mark; others are skipped."""
    return files.filter(F.col(modified) > since + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(tolerance_seconds)))
