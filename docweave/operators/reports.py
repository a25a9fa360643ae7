"""Read-only reports over a State.

Each is one declarative plan: filters and column lists reach the scans, small sides are broadcast
only where Spark's own size statistics allow it, and lists are aggregated per group, never collected.
Row caps that only guarded memory are options here, off by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_location, percent
from ..model import State


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def symbols_filter(state: State, kind: str | None = None, project: str | None = None, limit: int | None = None) -> DataFrame:
    df = state.symbols
    for column, value in (("kind", kind), ("project", project)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df if limit is None else df.orderBy("project", "name", "id").limit(limit)


def sections_filter(state: State, doc_type: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    df = state.doc_sections
    for column, value in (("doc_type", doc_type), ("status", status)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df if limit is None else df.orderBy("file", "anchor", "id").limit(limit)


def scanned_existing(state: State, scanned: DataFrame) -> DataFrame:
    """Stored ids among the scanned ones (``scanned`` has id)."""
    return state.symbols.select("id").join(scanned.select("id"), "id", "left_semi")


def status(state: State) -> DataFrame:
    """One row of counts, coverage and sync percentages; each relation is read once."""
    symbols = state.symbols.agg(F.count("*").alias("total_symbols"))
    linked = state.mappings.agg(F.count_distinct("symbol_id").alias("linked_symbols"), F.count("*").alias("total_mappings"))
    docs = state.doc_sections.agg(F.count("*").alias("total_docs"), *(F.count_if(F.col("status") == s).alias(f"{s}_docs") for s in ("in_sync", "stale", "draft")))
    pending = state.changelog.agg(F.count_if(F.col("sync_status") == "pending").alias("pending_changes"))
    row = symbols.crossJoin(linked).crossJoin(docs).crossJoin(pending)  # four single rows
    return row.withColumns({"coverage": percent(F.col("linked_symbols"), F.col("total_symbols")), "sync_rate": percent(F.col("in_sync_docs"), F.col("total_docs"))})


def check_stale(state: State) -> DataFrame:
    """Stale sections with the ids of their symbols, in order; a symbol stands once for each relation."""
    stale = state.doc_sections.filter(F.col("status") == "stale").select("id", "file", "anchor", "doc_type")
    links = state.mappings.select("doc_id", "symbol_id", "rel_type")
    joined = stale.join(links, stale["id"] == links["doc_id"], "left")
    ids = F.array_sort(F.collect_list("symbol_id"))
    return joined.groupBy("id", "file", "anchor", "doc_type").agg(ids.alias("ids")).select(F.col("id").alias("doc_id"), "file", "anchor", "doc_type", F.size("ids").cast("long").alias("n_symbols"), F.array_join("ids", ",").alias("symbol_ids"))


def check_summary(state: State, file: str | None = None, strict: bool = False) -> DataFrame:
    """One row: stale sections and files, and whether the check passes (of one file: unless strict)."""
    stale = state.doc_sections.filter(F.col("status") == "stale")
    if file is not None:
        stale = stale.filter(F.col("file") == file)
    counts = stale.agg(F.count("*").alias("stale_sections"), F.count_distinct("file").alias("stale_files"))
    none = F.col("stale_sections") == 0
    return counts.withColumn("passed", none if file is None else F.lit(not strict) | none)


def check_file(state: State, strict: bool = False) -> DataFrame:
    """(file, stale_sections, passed) for every file: the file check of all files in one pass."""
    grouped = state.doc_sections.groupBy("file").agg(F.count_if(F.col("status") == "stale").alias("stale_sections"))
    return grouped.withColumn("passed", F.lit(not strict) | (F.col("stale_sections") == 0))


def _linked(state: State, symbol_columns: dict[str, str], section_columns: dict[str, str], mappings: DataFrame | None = None) -> DataFrame:
    """Mappings with columns of both ends; sections come first, as links are mostly dealt by section already."""
    s = state.symbols.select(F.col("id").alias("symbol_id"), *(F.col(c).alias(a) for c, a in symbol_columns.items()))
    d = state.doc_sections.select(F.col("id").alias("doc_id"), *(F.col(c).alias(a) for c, a in section_columns.items()))
    return (state.mappings if mappings is None else mappings).join(d, "doc_id").join(s, "symbol_id")


def export_mappings(state: State) -> DataFrame:
    return _linked(state, {"name": "symbol_name", "kind": "symbol_kind"}, {"file": "doc_file", "anchor": "doc_anchor"}).select(
        "symbol_id", "symbol_name", "symbol_kind", "doc_id", "doc_file", "doc_anchor", "rel_type", "review_status"
    )


def review_unlinked(state: State) -> DataFrame:
    return state.symbols.join(state.mappings.select(F.col("symbol_id").alias("id")), "id", "left_anti").select("id", "name", "kind", "location")


def review_orphaned(state: State) -> DataFrame:
    return state.doc_sections.join(state.mappings.select(F.col("doc_id").alias("id")), "id", "left_anti").select("id", "file", "anchor")


def review_unreviewed(state: State) -> DataFrame:
    auto = state.mappings.filter(F.col("review_status") == "auto")
    return _linked(state, {"name": "symbol_name"}, {"file": "doc_file", "anchor": "doc_anchor"}, auto).select("symbol_id", "symbol_name", "doc_id", "doc_file", "doc_anchor", "rel_type")


def review_summary(state: State) -> DataFrame:
    """One row of backlog sizes."""
    parts = [("unlinked", review_unlinked(state)), ("orphaned", review_orphaned(state)), ("unreviewed", review_unreviewed(state))]
    rows = [df.agg(F.count("*").alias(name)) for name, df in parts]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2])  # three single rows


def review_grouped(state: State, shown: int = 3) -> DataFrame:
    """Unlinked or not: symbols by (name, kind) with up to ``shown`` distinct locations and "+n more".

    The locations of a group are distinct and in order before they are cut; the count is of all.
    """
    places = state.symbols.select("name", "kind", "location").distinct()
    order = Window.partitionBy("name", "kind").orderBy("location")
    ranked = places.withColumn("rank", F.row_number().over(order))
    grouped = ranked.groupBy("name", "kind").agg(F.count("*").alias("n_locations"), F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.col("location")))).alias("first"))
    more = F.when(F.col("n_locations") > shown, F.concat(F.lit(" +"), (F.col("n_locations") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return grouped.select("name", "kind", "n_locations", F.concat(F.array_join("first", ", "), more).alias("locations"))


def section_fanout(state: State) -> DataFrame:
    counts = state.mappings.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    return state.doc_sections.select("id", "file", "anchor").join(counts, "id", "left").select("id", "file", "anchor", F.coalesce("n", F.lit(0)).cast("long").alias("n_mappings"))


def inline_stale(state: State) -> DataFrame:
    """Inline sections of each symbol; rejected links are not left out."""
    inline = state.doc_sections.filter(F.col("doc_type") == "inline").select(F.col("id").alias("doc_id"), "file", "status")
    return state.mappings.join(inline, "doc_id").select("symbol_id", "doc_id", "rel_type", "file", "status")


def impact_symbols(state: State, changed: DataFrame) -> DataFrame:
    """Symbols in the changed files (``changed`` has file): an equality on the location's file."""
    file, line = parse_location(F.col("location"))
    placed = state.symbols.select(F.col("id").alias("symbol_id"), "name", "kind", file.alias("file"), line.alias("line"))
    return placed.join(changed.select("file").distinct(), "file", "left_semi").select("symbol_id", "name", "kind", "file", "line")


def impact_docs(state: State, changed: DataFrame) -> DataFrame:
    """Sections behind the changed files, one row each; of several links the first by key gives the relation."""
    hit = impact_symbols(state, changed).select("symbol_id")
    links = state.mappings.join(hit, "symbol_id", "left_semi")
    first = links.groupBy("doc_id").agg(F.min(F.struct("symbol_id", "rel_type")).alias("first"), F.count("*").alias("n_links"))
    docs = state.doc_sections.select(F.col("id").alias("doc_id"), "file", "anchor", "status")
    return first.join(docs, "doc_id").select("doc_id", "file", "anchor", "status", F.col("first.rel_type").alias("relationship"), F.col("first.symbol_id").alias("symbol_id"), "n_links")


def diff_history(state: State, latest: int = 10) -> DataFrame:
    """The latest changes of each symbol, newest first; ties by the higher id."""
    order = Window.partitionBy("symbol_id").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    ranked = state.changelog.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= latest)
    return ranked.select("symbol_id", F.col("rank").cast("long").alias("rank"), "id", "change_type", "old_sig", "new_sig", "sync_status")


def diff_docs(state: State) -> DataFrame:
    """Sections of every symbol that has changed, with their status."""
    changed = state.changelog.select("symbol_id").distinct()
    docs = state.doc_sections.select(F.col("id").alias("doc_id"), "file", "anchor", "status")
    return state.mappings.join(changed, "symbol_id", "left_semi").join(docs, "doc_id").select("symbol_id", "doc_id", "rel_type", "file", "anchor", "status")


def stale_symbols(state: State) -> DataFrame:
    """Distinct symbols of stale sections."""
    stale = state.doc_sections.filter(F.col("status") == "stale").select(F.col("id").alias("doc_id"))
    return state.mappings.join(stale, "doc_id", "left_semi").select("symbol_id").distinct()


def old_sig_candidates(state: State, latest: int = 5) -> DataFrame:
    """The latest distinct former signatures of each symbol, newest first; ties by text."""
    changes = state.changelog.filter(F.col("change_type") == "signature_changed")
    last = changes.groupBy("symbol_id", "old_sig").agg(F.max("timestamp").alias("ts"))
    order = Window.partitionBy("symbol_id").orderBy(F.col("ts").desc(), "old_sig")
    return last.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= latest).select("symbol_id", F.col("rank").cast("long").alias("rank"), "old_sig")


def reject_pattern_candidates(state: State, pattern: str) -> DataFrame:
    """Links of symbols whose name is like ``%pattern%``, case apart; ``%`` and ``_`` in it stay wild."""
    named = state.symbols.filter(F.col("name").ilike(f"%{pattern}%")).select(F.col("id").alias("symbol_id"), "name")
    return state.mappings.join(named, "symbol_id").select("symbol_id", "name", "doc_id", "rel_type", "review_status")


def rejected_expired(state: State, as_of: str, days: int = 30) -> DataFrame:
    """Rejected links created at least ``days`` before ``as_of`` (a parameter, so that reruns agree)."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return state.mappings.filter((F.col("review_status") == "rejected") & (F.col("created_at") <= limit)).select("symbol_id", "doc_id", "rel_type")


def commit_annotation(state: State) -> DataFrame:
    """One row for a commit message: pending changes and stale sections, and whether to add it."""
    pending = state.changelog.agg(F.count_if(F.col("sync_status") == "pending").alias("pending_changes"))
    stale = state.doc_sections.agg(F.count_if(F.col("status") == "stale").alias("stale_docs"))
    return pending.crossJoin(stale).withColumn("annotate", (F.col("pending_changes") > 0) | (F.col("stale_docs") > 0))


def health_context(state: State, shown: int = 5) -> DataFrame:
    """One row: sizes, coverage, and the first stale files with "and n more".

    Only the first names are ever gathered (a top-k), the rest are counted.
    """
    counts = status(state).select("total_symbols", "total_docs", "stale_docs", "pending_changes", "coverage")
    stale = state.doc_sections.filter(F.col("status") == "stale").select("file").distinct()
    total = stale.agg(F.count("*").alias("n"))
    first = stale.orderBy("file").limit(shown).agg(F.array_sort(F.collect_list("file")).alias("files"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return counts.crossJoin(total).crossJoin(first).select("total_symbols", "total_docs", "stale_docs", "pending_changes", "coverage", F.col("n").alias("stale_files"), F.concat(F.array_join("files", ", "), more).alias("stale_list"))


def health(state: State, as_of: str, last_scan_at: str | None = None) -> DataFrame:
    """(name, status): the data checks, and the roll-up as ``overall``."""

    def ladder(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("name"), value.alias("status"))

    some = lambda df: F.when(F.col("n") > 0, "ok").otherwise("degraded")
    count = lambda df: df.agg(F.count("*").alias("n"))
    docs = state.doc_sections.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "stale").alias("stale"))
    ratio = F.col("stale") / F.col("n")
    stale = F.when((F.col("n") == 0) | (F.col("stale") == 0), "ok").when(ratio < 0.1, "degraded").otherwise("failed")
    scan_time = F.coalesce(*(F.try_to_timestamp(F.lit(last_scan_at), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss")))
    hours = F.round((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(scan_time)) / 3600)
    scan = F.when(hours < 24, "ok").otherwise("degraded")
    checks = (
        ladder(count(state.symbols), "symbols", some(None))
        .unionByName(ladder(count(state.doc_sections), "docs", some(None)))
        .unionByName(ladder(docs, "stale_docs", stale))
        .unionByName(ladder(docs, "last_scan", scan))
    )
    overall = checks.agg(F.count_if(F.col("status") == "failed").alias("f"), F.count_if(F.col("status") == "degraded").alias("d"))
    return checks.unionByName(ladder(overall, "overall", F.when(F.col("f") > 0, "failed").when(F.col("d") > 0, "degraded").otherwise("ok")))


def gate_prepush(state: State) -> DataFrame:
    """One row: a push passes unless sections are stale."""
    stale = state.doc_sections.agg(F.count_if(F.col("status") == "stale").alias("stale_docs"))
    return stale.withColumn("passed", F.col("stale_docs") == 0)


def gate_precommit(state: State, staged: DataFrame) -> DataFrame:
    """Stale sections in the staged files (``staged`` has file); a commit passes if there are none."""
    stale = state.doc_sections.filter(F.col("status") == "stale")
    return stale.join(staged.select("file").distinct(), "file", "left_semi").select("id", "file", "anchor")
