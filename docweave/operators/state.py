"""State transitions: pure functions from tables to tables.

Parquet has no in-place update, so each transition derives the next snapshot; ``sinks.snapshot``
switches to it as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import symbol_id
from ..functions.text import kind_map
from ..model import REL_TYPES, REVIEW_STATUSES, State

#: strategy by section type -> what a sync does (see ``sync_plan``).
DEFAULT_STRATEGIES = {"inline": "auto_update", "standalone": "auto_update", "generated": "auto_update", "architecture": "mark_stale"}


def mapping_fold(events: DataFrame, *order: str) -> DataFrame:
    """Mappings from a stream of upserts: the first review that is not auto sticks, else auto."""
    decided = F.when(F.col("review_status") != "auto", F.struct(*order, "review_status"))
    return events.groupBy("symbol_id", "doc_id", "rel_type").agg(F.coalesce(F.min_by("review_status", decided), F.lit("auto")).alias("review_status"))


def _merged(state: DataFrame, batch: DataFrame, kept: dict[str, Column]) -> DataFrame:
    """Full outer join on id: the batch's values win, except for ``kept`` (column -> value); columns of ``state``.

    Where ``batch`` lacks a column of ``state`` (or has none such), the stored value stays.
    """
    s, b = state.alias("s"), batch.alias("b")
    new = F.col("b.id").isNotNull()
    value = lambda c: kept.get(c, F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")) if c in batch.columns else F.col(f"s.{c}"))
    return s.join(b, F.col("s.id") == F.col("b.id"), "full_outer").select(F.coalesce("s.id", "b.id").alias("id"), *(value(c).alias(c) for c in state.columns if c != "id"))


def upsert_symbols(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Symbols after a batch: new values win, created_at stays, unknown kinds become ``unknown``.

    Rows that the batch does not name keep all their values, metadata and updated_at too.
    """
    named = batch.filter("id <> '' AND name <> ''").withColumn("kind", kind_map(F.col("kind")))
    return _merged(state, named, {"created_at": F.coalesce("s.created_at", "b.created_at")})


def upsert_sections(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Sections after a batch: new hash and type win; a stale or draft status survives, as does created_at."""
    new = F.col("b.id").isNotNull()
    kept = {"status": F.when(~new | F.col("s.status").isin("stale", "draft"), F.col("s.status")).otherwise(F.col("b.status"))}
    if "created_at" in batch.columns and "created_at" in state.columns:
        kept["created_at"] = F.coalesce("s.created_at", "b.created_at")
    return _merged(state, batch, kept)


def insert_absent(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Mappings and those of the batch whose key is not there yet; created_at is each one's own, if both have it."""
    key = ["symbol_id", "doc_id", "rel_type"]
    columns = [*key, "review_status", *(c for c in ("created_at",) if c in state.columns and c in batch.columns)]
    return state.select(*columns).unionByName(batch.dropDuplicates(key).join(state.select(*key), key, "left_anti").select(*columns))


def upsert_metadata(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Key-value rows after a batch of (key, value, updated_at): the batch's latest value of a key wins."""
    last = batch.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"), F.max("updated_at").alias("updated_at"))
    return state.join(last.select("key"), "key", "left_anti").select("key", "value", "updated_at").unionByName(last)


def symbol_dedup(extracted: DataFrame) -> DataFrame:
    """Extracted symbols without exact duplicates: same file, name and signature (the kind is no part
    of the key); the first by line, then by extraction order, stays.  A definition without signature
    goes where the file has one of its name with a signature."""
    order = Window.partitionBy("file", "name", "raw_signature").orderBy("line", "kind")
    signed = F.max(F.coalesce(F.length("raw_signature"), F.lit(0)) > 0).over(Window.partitionBy("file", "name"))
    first = extracted.withColumns({"_n": F.row_number().over(order), "_signed": signed}).filter("_n = 1")
    return first.filter((F.coalesce(F.length("raw_signature"), F.lit(0)) > 0) | ~F.col("_signed")).drop("_n", "_signed")


def symbol_ids(extracted: DataFrame, lang: Column) -> DataFrame:
    """Adds occurrence (per file, name and kind, by line) and id."""
    from ..functions.ids import qualified_name

    order = Window.partitionBy("file", "name", "kind").orderBy("line")
    numbered = extracted.withColumn("occurrence", F.row_number().over(order).cast("long"))
    return numbered.withColumn("id", symbol_id(lang, qualified_name(F.col("file"), F.col("name"), F.col("occurrence")), F.col("kind")))


def scan_diff(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """(id, change): created, signature_changed, unchanged or missing, by one full outer join on id.

    Both sides have id and signature.  An unchanged symbol is not written, not even a moved line.
    """
    s, n = state.select("id", F.col("signature").alias("old")), scanned.select(F.col("id").alias("id2"), F.col("signature").alias("new"))
    change = F.when(F.col("id").isNull(), "created").when(F.col("id2").isNull(), "missing").when(F.col("old") != F.col("new"), "signature_changed").otherwise("unchanged")
    return s.join(n, F.col("id") == F.col("id2"), "full_outer").select(F.coalesce("id", "id2").alias("id"), change.alias("change"))


def change_cascade(state: State, changed: DataFrame) -> DataFrame:
    """(symbol_id, n_affected, affected_docs, sync_status) of changed symbols (``changed`` has symbol_id).

    Rejected links do not cascade.  A change without affected sections is applied at once.
    """
    links = state.mappings.filter(F.col("review_status") != "rejected").select("symbol_id", "doc_id")
    hit = changed.select("symbol_id").distinct().join(links, "symbol_id", "left")
    grouped = hit.groupBy("symbol_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    pending = F.when(F.size("docs") > 0, "pending").otherwise("applied")
    return grouped.select("symbol_id", F.size("docs").cast("long").alias("n_affected"), F.array_join("docs", ",").alias("affected_docs"), pending.alias("sync_status"))


def mark_stale(state: State, symbols: DataFrame, now: Column | None = None) -> DataFrame:
    """Sections with the status stale wherever a link that is not rejected leads to one of ``symbols`` (symbol_id).

    With ``now`` their updated_at is set.
    """
    links = state.mappings.filter(F.col("review_status") != "rejected").join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi")
    hit = links.select(F.col("doc_id").alias("_hit")).distinct()
    joined = state.doc_sections.join(hit, F.col("id") == F.col("_hit"), "left")
    changed = {"status": F.when(F.col("_hit").isNotNull(), "stale").otherwise(F.col("status"))}
    if now is not None:
        changed["updated_at"] = F.when(F.col("_hit").isNotNull(), now).otherwise(F.col("updated_at"))
    return joined.withColumns(changed).drop("_hit")


def created_log(created: DataFrame, timestamp: Column) -> DataFrame:
    """Changelog rows of new symbols: applied, nothing affected."""
    return created.select(timestamp.alias("timestamp"), F.col("id").alias("symbol_id"), F.lit("created").alias("change_type"), F.lit("").alias("old_sig"), F.col("signature").alias("new_sig"), F.array().cast("array<string>").alias("affected_docs"), F.lit("applied").alias("sync_status"))


def inline_sections(symbols: DataFrame, state: State) -> DataFrame:
    """(symbol_id, anchor, content_hash, action): sections from docstrings (``symbols`` has id, name, docstring).

    With a docstring: upsert; without one where an inline section exists: mark it stale.
    """
    inline = state.doc_sections.filter(F.col("doc_type") == "inline").select(F.col("id").alias("doc_id"))
    held = state.mappings.join(inline, "doc_id", "left_semi").select(F.col("symbol_id").alias("_held")).distinct()
    joined = symbols.join(held, F.col("id") == F.col("_held"), "left")
    documented = F.coalesce(F.length("docstring"), F.lit(0)) > 0
    action = F.when(documented, "upsert").when(F.col("_held").isNotNull(), "mark_stale")
    return joined.select(F.col("id").alias("symbol_id"), F.concat(F.lit("inline:"), F.col("name")).alias("anchor"), F.when(documented, F.sha2("docstring", 256)).alias("content_hash"), action.alias("action")).filter("action IS NOT NULL")


#: Signature of a change that marks a symbol as missing once.
MISSING = "__stale__"


def gc_plan(state: State, scanned: DataFrame, marker: str = MISSING) -> DataFrame:
    """(symbol_id, action) of symbols that the scan missed: the first miss marks, a later one deletes.

    A mark is a ``deleted`` change whose old signature is ``marker``; it is never cleared.
    """
    missing = state.symbols.select("id").join(scanned.select("id"), "id", "left_anti")
    marked = state.changelog.filter((F.col("change_type") == "deleted") & (F.col("old_sig") == marker)).select(F.col("symbol_id").alias("_m")).distinct()
    joined = missing.join(marked, F.col("id") == F.col("_m"), "left")
    return joined.select(F.col("id").alias("symbol_id"), F.when(F.col("_m").isNotNull(), "delete").otherwise("mark").alias("action"))


def gc_log(state: State, marks: DataFrame, timestamp: Column, marker: str = MISSING) -> DataFrame:
    """Changelog rows of ``marks`` (symbol_id): the marker in both signatures, the sections that go stale with it."""
    affected = change_cascade(state, marks).withColumn("affected_docs", listed(F.col("affected_docs")))
    return affected.select(timestamp.alias("timestamp"), "symbol_id", F.lit("deleted").alias("change_type"), F.lit(marker).alias("old_sig"), F.lit(marker).alias("new_sig"), "affected_docs", F.lit("pending").alias("sync_status"))


def listed(text: Column) -> Column:
    """The array that a comma-joined text holds."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def numbered(log: DataFrame, after: DataFrame) -> DataFrame:
    """Changelog rows with distinct ids above those of ``after``; no order is implied, so no task holds all rows."""
    top = after.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    return log.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + 1 + F.monotonically_increasing_id()).select(*after.columns)


def cascade_delete(state: State, symbols: DataFrame | None = None, sections: DataFrame | None = None) -> State:
    """The state without some symbols and sections (each has id) and all that refers to them."""
    new = state
    if symbols is not None:
        gone = symbols.select(F.col("id").alias("_gone")).distinct()
        drop = lambda df, key: df.join(gone, F.col(key) == F.col("_gone"), "left_anti")
        new = new.with_(symbols=drop(new.symbols, "id"), mappings=drop(new.mappings, "symbol_id"), changelog=drop(new.changelog, "symbol_id"))
    if sections is not None:
        gone_docs = sections.select(F.col("id").alias("_gone")).distinct()
        drop_docs = lambda df, key: df.join(gone_docs, F.col(key) == F.col("_gone"), "left_anti")
        new = new.with_(doc_sections=drop_docs(new.doc_sections, "id"), mappings=drop_docs(new.mappings, "doc_id"))
    return new


def orphans(state: State, files: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(sections whose file is not in ``files``, rejected links of at least ``days`` days before ``as_of``)."""
    gone = state.doc_sections.join(files.select("file").distinct(), "file", "left_anti").select("id")
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return gone, state.mappings.filter((F.col("review_status") == "rejected") & (F.col("created_at") <= limit))


def cleanup_orphans(state: State, files: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row: sections whose file is not in ``files`` (file), links that go with them, old rejected links."""
    gone, old = orphans(state, files, as_of, days)
    doc = gone.select(F.col("id").alias("doc_id"))
    cascade, old = state.mappings.join(doc, "doc_id", "left_semi"), old.join(doc, "doc_id", "left_anti")
    rows = [df.agg(F.count("*").alias(n)) for df, n in ((gone, "removed_sections"), (cascade, "cascaded_mappings"), (old, "purged_rejected"))]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2])  # three single rows


def without_orphans(state: State, files: DataFrame, as_of: str, days: int = 30) -> State:
    """The state after a clean-up: what ``cleanup_orphans`` counts is gone."""
    gone, old = orphans(state, files, as_of, days)
    kept = state.mappings.join(old.select("symbol_id", "doc_id", "rel_type"), ["symbol_id", "doc_id", "rel_type"], "left_anti").select(*state.mappings.columns)
    return cascade_delete(state.with_(mappings=kept), sections=gone)


def link_validate(state: State, commands: DataFrame) -> DataFrame:
    """Commands (symbol_id, doc_id, rel_type, review_status) with their outcome: ok or what is wrong."""
    s, d = state.symbols.select(F.col("id").alias("_s")), state.doc_sections.select(F.col("id").alias("_d"))
    joined = commands.join(s, F.col("symbol_id") == F.col("_s"), "left").join(d, F.col("doc_id") == F.col("_d"), "left")
    outcome = (
        F.when(~F.col("rel_type").isin(*REL_TYPES), "invalid rel_type")
        .when(~F.col("review_status").isin(*REVIEW_STATUSES), "invalid review_status")
        .when(F.col("_s").isNull() & F.col("_d").isNull(), "symbol and section not found")
        .when(F.col("_s").isNull(), "symbol not found")
        .when(F.col("_d").isNull(), "section not found")
        .otherwise("ok")
    )
    return joined.select("symbol_id", "doc_id", "rel_type", "review_status", outcome.alias("outcome"))


def set_review(state: State, commands: DataFrame) -> DataFrame:
    """Mappings after explicit reviews (any transition is free); several commands of a key: the greatest status."""
    key = ["symbol_id", "doc_id", "rel_type"]
    new = commands.groupBy(*key).agg(F.max("review_status").alias("_new"))
    return state.mappings.join(new, key, "left").withColumn("review_status", F.coalesce("_new", "review_status")).drop("_new")


def bulk_review(mappings: DataFrame, to: str) -> DataFrame:
    """All auto links confirmed or rejected."""
    return mappings.withColumn("review_status", F.when(F.col("review_status") == "auto", to).otherwise(F.col("review_status")))


def sync_plan(state: State, symbols: DataFrame, strategies: dict[str, str] | None = None) -> DataFrame:
    """(symbol_id, doc_id, doc_type, strategy, action) for links of ``symbols`` (symbol_id), rejected ones too.

    The strategy table has a row per section type, so it is a literal map rather than a join.
    """
    strategies = DEFAULT_STRATEGIES | (strategies or {})
    strategy = F.element_at(F.create_map(*(F.lit(x) for p in strategies.items() for x in p)), F.col("doc_type"))
    docs = state.doc_sections.select(F.col("id").alias("doc_id"), "doc_type")
    planned = state.mappings.join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi").join(docs, "doc_id").withColumn("strategy", strategy)
    update = F.when(F.col("doc_type") == "inline", "update_inline").when(F.col("doc_type") == "generated", "regenerate").when(F.col("doc_type") == "standalone", "replace_signature").otherwise("mark_stale")
    action = F.when(F.col("strategy") == "auto_update", update).when(F.col("strategy") == "ignore", "skip").when(F.col("strategy") == "prompt", "prompt").otherwise("mark_stale")
    return planned.select("symbol_id", "doc_id", "rel_type", "doc_type", "strategy", action.alias("action"))


def sync_finalize(changelog: DataFrame, results: DataFrame) -> DataFrame:
    """Changelog after a sync: pending changes of a symbol fail if any of its actions did, else are applied.

    ``results`` has symbol_id and ok; symbols without results keep their changes pending.
    """
    done = results.groupBy("symbol_id").agg(F.bool_and("ok").alias("_ok"))
    joined = changelog.join(done, "symbol_id", "left")
    new = F.when((F.col("sync_status") == "pending") & F.col("_ok").isNotNull(), F.when(F.col("_ok"), "applied").otherwise("failed")).otherwise(F.col("sync_status"))
    return joined.withColumn("sync_status", new).drop("_ok")


def unlink_stale(state: State, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, mappings) after source files (file) were removed: their symbols' sections are stale,
    confirmed links are auto again."""
    from .reports import impact_symbols

    gone = impact_symbols(state, removed).select(F.col("symbol_id").alias("_s")).distinct()
    links = state.mappings.join(gone, F.col("symbol_id") == F.col("_s"), "left")
    hit = F.col("_s").isNotNull()
    mappings = links.withColumn("review_status", F.when(hit & (F.col("review_status") == "confirmed"), "auto").otherwise(F.col("review_status")))
    docs = links.filter(hit).select(F.col("doc_id").alias("_d")).distinct()
    sections = state.doc_sections.join(docs, F.col("id") == F.col("_d"), "left").withColumn("status", F.when(F.col("_d").isNotNull(), "stale").otherwise(F.col("status")))
    return sections.drop("_d"), mappings.drop("_s")
