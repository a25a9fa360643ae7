"""Sinks: snapshots with one switch, an append-only log, JSON export, reports as text."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, State

RELATIONS = ("symbols", "doc_sections", "mappings", "changelog", "metadata")
POINTER, WORK = "_current", "_work"


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path, so that any store that Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current snapshot: the last name in the pointer folder, whose names ascend."""
    fs, pointer = _fs(spark, f"{root}/{POINTER}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(pointer)) if fs.exists(pointer) else []
    return f"{root}/{names[-1]}" if names else None


def write_snapshot(state: State, root: str) -> str:
    """Writes all relations to a new folder, then switches to it by creating one empty file.

    Readers see the old state or the new one, never a mixture; a failed write leaves the old.
    """
    spark = state.symbols.sparkSession
    name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for relation in RELATIONS:
        table = getattr(state, relation)
        if table is not None:
            table.write.parquet(f"{root}/{name}/{relation}")
    fs, mark = _fs(spark, f"{root}/{POINTER}/{name}")
    fs.create(mark).close()
    return f"{root}/{name}"


def written(df: DataFrame, root: str) -> DataFrame:
    """A table written to the work folder of ``root`` and read again: what several steps need is computed once."""
    path = f"{root}/{WORK}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, root: str) -> None:
    """Deletes the work folder; results that still read it are lost."""
    fs, path = _fs(spark, f"{root}/{WORK}")
    fs.delete(path, True)


def read_snapshot(spark: SparkSession, root: str) -> State:
    folder = current(spark, root)
    tables = {}
    for relation in RELATIONS:
        fs, path = _fs(spark, f"{folder}/{relation}")
        tables[relation] = spark.read.parquet(f"{folder}/{relation}") if folder and fs.exists(path) else spark.createDataFrame([], SCHEMAS[relation])
    return State(**tables)


def backup(spark: SparkSession, root: str, to: str) -> str:
    """Copies the current snapshot."""
    folder = current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no snapshot in {root}")
    fs, source = _fs(spark, folder)
    other, target = _fs(spark, f"{to}/{folder.rsplit('/', 1)[-1]}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, False, spark._jsc.hadoopConfiguration())
    return f"{to}/{folder.rsplit('/', 1)[-1]}"


def restore(spark: SparkSession, saved: str, root: str) -> str:
    """Makes a saved snapshot the current one of ``root``."""
    name = f"v{time.time_ns():020d}-restored"
    fs, source = _fs(spark, saved)
    other, target = _fs(spark, f"{root}/{name}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, False, spark._jsc.hadoopConfiguration())
    other, mark = _fs(spark, f"{root}/{POINTER}/{name}")
    other.create(mark).close()
    return f"{root}/{name}"


def reset(spark: SparkSession, root: str) -> bool:
    """Forgets all snapshots of ``root``."""
    fs, path = _fs(spark, root)
    return bool(fs.delete(path, True))


def append_changes(changes: DataFrame, folder: str) -> None:
    changes.write.mode("append").parquet(folder)


def export_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


# ---- reports as text: a row a line, ordered, streamed to the caller -----------------


def render_check(stale: DataFrame, form: str = "markdown") -> str:
    """Stale sections (see ``reports.check_stale``) as markdown or as CI annotations.

    Lines are made on the executors; only finished lines reach the driver, a partition at a time.
    """
    if form == "ci":
        line = F.format_string("::warning file=%s::stale section %s (%d symbols)", "file", F.when(F.col("anchor") == "", "(top)").otherwise(F.col("anchor")), "n_symbols")
    else:
        line = F.format_string("- `%s` - %s: %d linked symbol(s)", "file", F.when(F.col("anchor") == "", "(top)").otherwise(F.col("anchor")), "n_symbols")
    lines = [r.line for r in stale.select("file", "anchor", line.alias("line")).orderBy("file", "anchor").select("line").toLocalIterator()]
    if form == "ci":
        return "\n".join(lines)
    return "\n".join([f"## Stale documentation: {len(lines)} section(s)", "", *lines]) if lines else "All documentation is in sync."


def _part(rank: int, title: str, rows: DataFrame, line, *order: str) -> DataFrame:
    """(rank, o, line): a heading with the number of rows, and a line a row in order of ``order``."""
    key = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    body = rows.select(F.lit(rank).alias("rank"), F.concat(F.lit("2"), key).alias("o"), line.alias("line"))
    head = rows.agg(F.count("*").alias("n")).select(F.lit(rank).alias("rank"), F.lit("1").alias("o"), F.format_string(f"### {title} (%d)", "n").alias("line"))
    return head.unionByName(body)


def _place(file: str, anchor: str):
    return F.concat(F.col(file), F.when(F.coalesce(F.length(anchor), F.lit(0)) > 0, F.concat(F.lit("#"), F.col(anchor))).otherwise(""))


def impact_lines(changed: DataFrame, symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Lines of an impact report (see ``reports.impact_symbols`` and ``impact_docs``)."""
    parts = [
        _part(1, "Changed files", changed.distinct(), F.format_string("- `%s`", "file"), "file"),
        _part(2, "Affected symbols", symbols, F.format_string("- `%s` (%s) at %s:%d", "name", "kind", "file", "line"), "name", "file", "symbol_id"),
        _part(3, "Affected documentation", docs, F.format_string("- `%s`: **%s** (%s)", _place("file", "anchor"), "status", "relationship"), "file", "anchor", "doc_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def diff_lines(symbol: DataFrame, changes: DataFrame, docs: DataFrame, width: int = 60) -> DataFrame:
    """Lines of a symbol's history: its changes (signatures cut to ``width``), newest first, and its sections."""
    cut = lambda c: F.substring(F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col(c)).otherwise("_"), 1, width)
    newest = changes.withColumn("o", F.lpad((F.lit(10**15) - F.unix_seconds("timestamp")).cast("string"), 16, "0"))
    change = F.format_string("| %s | %s | %s | %s | %s |", F.col("timestamp").cast("string"), "change_type", cut("old_sig"), cut("new_sig"), "sync_status")
    parts = [
        _part(1, "Symbol", symbol, F.format_string("- `%s`: `%s`", "name", "raw_signature"), "id"),
        _part(2, "Changes", newest, change, "o", "id"),
        _part(3, "Affected documentation", docs, F.format_string("- `%s`: **%s**", _place("file", "anchor"), "status"), "file", "anchor", "doc_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def review_lines(status: DataFrame, unlinked: DataFrame, unreviewed: DataFrame, orphaned: DataFrame) -> DataFrame:
    """Lines of a review (see ``reports.status``, ``review_grouped`` of unlinked symbols, and the other two)."""
    head = status.select(F.lit(0).alias("rank"), F.lit("").alias("o"), F.format_string("Symbols: %d of %d linked", "linked_symbols", "total_symbols").alias("line"))
    parts = [
        head,
        _part(1, "Unlinked symbols", unlinked, F.format_string("- `%s` (%s): %s", "name", "kind", F.when(F.col("locations") == "", "unknown location").otherwise(F.col("locations"))), "name", "kind"),
        _part(2, "Unreviewed links", unreviewed, F.format_string("- `%s` and %s (%s)", "symbol_name", _place("doc_file", "doc_anchor"), "rel_type"), "symbol_name", "doc_file", "doc_anchor", "rel_type"),
        _part(3, "Orphaned sections", orphaned, F.format_string("- %s", F.concat("file", F.lit("#"), F.when(F.col("anchor") == "", "(top)").otherwise(F.col("anchor")))), "file", "anchor"),
    ]
    return reduce(DataFrame.unionByName, parts)


def render_lines(lines: DataFrame) -> str:
    """A report's lines in order, streamed to the caller a partition at a time."""
    return "\n".join(r.line for r in lines.orderBy("rank", "o", "line").select("line").toLocalIterator())
