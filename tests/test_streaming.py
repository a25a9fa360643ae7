from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docweave.model import State
from docweave.streaming import watch

T0 = datetime(2024, 1, 1)


def write_events(spark, folder, rows):
    spark.createDataFrame([(i, T0 + timedelta(milliseconds=ms), p, e) for i, ms, p, e in rows], watch.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_sessions_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(1, 0, "src/a.ts", "change"), (2, 300, "src/b.ts", "change"), (3, 2000, "src/c.ts", "change"), (4, 2100, "docs/x.md", "add"), (5, 2100, "src/.hidden", "add"), (6, 60_000, "src/z.ts", "change")]
    write_events(spark, folder, rows)
    events = spark.read.schema(watch.EVENT_SCHEMA).parquet(folder)
    key = watch.debounce_key(F.col("path"), ["docs"])
    batch = watch.debounce_sessions(events.filter(watch.is_watched(F.col("path"))), key, "500 milliseconds")
    fired = []
    q = watch.start_debounce(watch.file_events(spark, folder), key, lambda df, _: fired.extend(df.collect()), str(tmp_path / "check"), watermark="1 second")
    q.awaitTermination(120)
    tell = lambda rs: sorted((r.key, r.n_events, r["last"]) for r in rs)
    assert tell(batch.collect()) == [("code", 1, "src/c.ts"), ("code", 1, "src/z.ts"), ("code", 2, "src/b.ts"), ("docs/docs", 1, "docs/x.md")]
    # The last session stays open until the watermark passes it.
    assert tell(fired) == [t for t in tell(batch.collect()) if t[2] != "src/z.ts"]


def test_unlinks_are_applied(spark, tmp_path):
    folder = str(tmp_path / "events")
    write_events(spark, folder, [(1, 0, "src/a.ts", "unlink"), (2, 1, "src/b.ts", "change")])
    symbols = spark.createDataFrame([("s", "n", "function", "src/a.ts:1")], "id string, name string, kind string, location string")
    docs = spark.createDataFrame([("d", "in_sync")], "id string, status string")
    links = spark.createDataFrame([("s", "d", "describes", "confirmed")], "symbol_id string, doc_id string, rel_type string, review_status string")
    stored = []
    q = watch.start_unlinks(watch.file_events(spark, folder), lambda: State(symbols, docs, links, None), lambda s, m: stored.append((s.first().status, m.first().review_status)), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert stored == [("stale", "auto")]


def test_incremental_tolerance(spark):
    files = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(seconds=1)), ("c", T0 + timedelta(milliseconds=1001))], "path string, modified timestamp")
    assert [r.path for r in watch.incremental_filter(files, F.lit(T0)).collect()] == ["c"]
