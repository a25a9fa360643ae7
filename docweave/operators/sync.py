"""Executing a sync: documentation is brought in line with the signatures that the sources have now.

Nothing is written in place.  A sync gives the texts of the files that change, what became of each
link, and the next state; all edits of a file are applied in one pass over it, one row a file.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signatures
from ..functions.text import parse_location
from ..model import State
from ..sources.parsers import section_bounds
from . import reports
from . import state as transitions
from .rewrite import generator

_EDITED = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("outcomes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("symbol_id", "doc_id", "outcome", "hash")]))),
])


@dataclass(frozen=True)
class Sync:
    """results: (symbol_id, doc_id, doc_type, action, outcome, ok, status, hash); texts: (path, content) of changed files."""

    results: DataFrame
    texts: DataFrame
    state: State


def text_forms(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """What to look for and what to put there: both signatures whole, then without their tails."""
    if not old or not new or old == new:
        return []
    bare = [signatures.without_tail(s) for s in (old, new)]
    return [(old, new)] + ([(bare[0], bare[1])] if bare[0] != bare[1] and bare != [old, new] and bare[0] else [])


def edit_document(content: str, edits: list[dict]) -> tuple[str, list[tuple[str, str, str, str | None]]]:
    """Replaces old signatures within the sections that ``edits`` name.

    The first form that stands in the section is replaced wherever it stands there; the line ends of a
    section in CRLF are kept.  Outcomes: replaced, not found, no section, or unknown if there is
    nothing to look for; the hash is the section's after the edit.
    """
    outcomes = []
    for e in edits:
        bounds = section_bounds(content, e["anchor"])
        if bounds is None:
            outcomes.append((e["symbol_id"], e["doc_id"], "no section", None))
            continue
        lines = content.split("\n")
        section = "\n".join(lines[bounds[0] : bounds[1]])
        forms: dict[str, str] = {}
        for old in () if e["old"] is None else e["old"]:
            for a, b in text_forms(old, e["new"]):
                forms.setdefault(a, b)
        if "\r\n" in section:
            forms = {a.replace("\r\n", "\n").replace("\n", "\r\n"): b.replace("\r\n", "\n").replace("\n", "\r\n") for a, b in forms.items()}
        hit = next((a for a in forms if a in section), None)
        if hit is not None:
            section = section.replace(hit, forms[hit])
            content = "\n".join([*lines[: bounds[0]], section, *lines[bounds[1] :]])
        outcome = "replaced" if hit is not None else "not found" if forms else "unknown"
        outcomes.append((e["symbol_id"], e["doc_id"], outcome, hashlib.sha256(section.encode()).hexdigest()))
    return content, outcomes


def edit_source(path: str, content: str, edits: list[dict]) -> tuple[str, list[tuple[str, str, str, str | None]]]:
    """Regenerates the docstrings that ``edits`` name, from the last line up, so that earlier lines keep their numbers."""
    language, outcomes = signatures.doc_language(path), []
    for e in sorted(edits, key=lambda e: (-(e["line"] or 0), e["symbol_id"], e["doc_id"])):
        line = e["line"] - 1 if e["line"] else None
        span = signatures.docstring_span(content, e["name"], language, line)
        now = signatures.current_signature(content, e["name"], line) if span else None
        if span is None:
            outcome = "no docstring"
        elif not e["raw_signature"]:
            outcome = "no signature"
        elif now is None and language == "typescript":
            outcome = "missing signature"
        else:
            new = signatures.regenerate_docstring(span[2], e["raw_signature"], language)
            content, outcome = signatures.update_inline(content, e["name"], language, new, now or "", e["raw_signature"], line)
        span = signatures.docstring_span(content, e["name"], language, line) if outcome == "updated" else None
        outcomes.append((e["symbol_id"], e["doc_id"], outcome, span and hashlib.sha256(span[2].encode()).hexdigest()))
    return content, outcomes


def _edited(files: DataFrame, edits: DataFrame, edit, *fields: str) -> DataFrame:
    """(path, before, e: edited text and outcomes): a row a file, with the edits (path, ``fields``) of it."""

    @F.pandas_udf(_EDITED)
    def apply(path: pd.Series, content: pd.Series, todo: pd.Series) -> pd.DataFrame:
        rows = [edit(p, c, list(t)) for p, c, t in zip(path, content, todo, strict=True)]
        return pd.DataFrame({"content": [r[0] for r in rows], "outcomes": [[dict(zip(("symbol_id", "doc_id", "outcome", "hash"), o, strict=True)) for o in r[1]] for r in rows]})

    todo = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("symbol_id", "doc_id", *fields))).alias("todo"))
    held = todo.hint("merge").join(files.select(F.col("path").alias("path2"), "content"), F.col("path") == F.col("path2"))
    return held.select("path", F.col("content").alias("before"), apply("path", "content", "todo").alias("e"))


def sync(state: State, symbols: DataFrame, code_files: DataFrame, doc_files: DataFrame, as_of: Column, strategies: dict[str, str] | None = None, scripts: tuple[str, ...] = ()) -> Sync:
    """Syncs the sections that links of ``symbols`` (symbol_id) lead to.

    ``code_files`` and ``doc_files`` have path, content and (documents) modified.  Sections of several
    links: one that any link leaves stale is stale, else one that any link brought in sync is in sync.
    A generator is named and not run, so its section keeps its status.  Joins are merges: Spark takes a
    text that it has not read from a file for 20 bytes, and would broadcast all texts through the driver.
    """
    file, line = parse_location(F.col("location"))
    s = state.symbols.select(F.col("id").alias("symbol_id"), "name", "raw_signature", file.alias("src"), line.alias("line"))
    d = state.doc_sections.select(F.col("id").alias("doc_id"), F.col("file").alias("doc_file"), "anchor", F.col("status").alias("before"), F.col("content_hash").alias("old_hash"), F.col("updated_at").alias("doc_updated"))
    plan = transitions.sync_plan(state, symbols, strategies).filter("action <> 'skip'").select("symbol_id", "doc_id", "doc_type", "action").distinct()
    placed = plan.hint("merge").join(s, "symbol_id").hint("merge").join(d, "doc_id").hint("merge")

    inline = placed.filter("action = 'update_inline'")
    sources = _edited(code_files, inline.filter("src IS NOT NULL").withColumn("path", F.col("src")), edit_source, "name", "line", "raw_signature")

    wanted = placed.filter("action = 'replace_signature'")
    current = wanted.select("symbol_id", "name", "line", "src").distinct().hint("merge").join(code_files.select(F.col("path").alias("src"), "content"), "src")
    current = current.select("symbol_id", signatures.signature_udf()("content", "name", "line", "src").alias("new"))
    former = reports.old_sig_candidates(state).groupBy("symbol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "old_sig"))), lambda x: x["old_sig"]).alias("former"))
    known = wanted.join(current.hint("merge"), "symbol_id", "left").join(former.hint("merge"), "symbol_id", "left")
    old = F.concat(F.coalesce("former", F.array().cast("array<string>")), F.array("raw_signature"))
    known = known.select("symbol_id", "doc_id", "anchor", "new", F.when(F.col("new").isNotNull(), old).alias("old"), F.col("doc_file").alias("path"))
    documents = _edited(doc_files, known, lambda _, content, edits: edit_document(content, edits), "anchor", "new", "old")

    outcomes = documents.select(F.inline("e.outcomes")).unionByName(sources.select(F.inline("e.outcomes")))
    head = doc_files.select(F.col("path").alias("doc_file"), F.substring("content", 1, 1000).alias("head"), "modified")
    met = placed.join(outcomes.hint("merge"), ["symbol_id", "doc_id"], "left").join(head.hint("merge"), "doc_file", "left")
    script = generator(F.col("doc_file"), F.array(*map(F.lit, scripts)).cast("array<string>"), F.coalesce("head", F.lit("")))
    action, found = F.col("action"), F.coalesce("outcome", F.lit("no file"))
    outcome = (
        F.when(action == "mark_stale", "marked stale").when(action == "prompt", "needs review")
        .when(action == "regenerate", F.coalesce(F.concat(F.lit("run "), script), F.lit("no generator"))).otherwise(found)
    )
    edit = action.isin("update_inline", "replace_signature")
    rewritten = (outcome == "not found") & (F.col("hash") != F.col("old_hash"))
    touched = (outcome == "not found") & (F.col("before") == "stale") & (F.col("modified") > F.col("doc_updated"))
    synced = edit & F.coalesce(outcome.isin("updated", "replaced") | rewritten | touched, F.lit(False))
    lost = (action == "replace_signature") & outcome.isin("no section", "unknown", "no file")
    stale = (outcome == "marked stale") | (outcome == "no generator") | lost
    failed = (outcome == "no generator") | lost | ((action == "update_inline") & ~outcome.isin("updated", "no docstring"))
    results = met.select(
        "symbol_id", "doc_id", "doc_type", "action", outcome.alias("outcome"), (~failed).alias("ok"),
        F.when(stale, "stale").when(synced, "in_sync").otherwise(F.col("before")).alias("status"),
        F.when(synced & F.col("hash").isNotNull(), F.col("hash")).otherwise(F.col("old_hash")).alias("hash"),
    )
    texts = documents.unionByName(sources).filter("e.content <> before").select("path", "e.content")
    folded = results.groupBy("doc_id").agg(F.max(F.when(stale_result(), 1)).alias("_stale"), F.max(F.when(F.col("outcome").isin("updated", "replaced", "not found") & (F.col("status") == "in_sync"), 1)).alias("_synced"), F.max_by("hash", F.struct(F.col("status") == "in_sync", "symbol_id")).alias("_hash"))
    joined = state.doc_sections.join(folded.hint("merge"), F.col("id") == F.col("doc_id"), "left")
    moved = F.col("_stale").isNotNull() | F.col("_synced").isNotNull()
    values = {
        "status": F.when(F.col("_stale").isNotNull(), "stale").when(F.col("_synced").isNotNull(), "in_sync").otherwise(F.col("status")),
        "content_hash": F.when(F.col("_synced").isNotNull(), F.col("_hash")).otherwise(F.col("content_hash")),
        "updated_at": F.when(moved, as_of).otherwise(F.col("updated_at")),
    }
    sections = joined.select(*(values.get(c, F.col(c)).alias(c) for c in state.doc_sections.columns))
    changelog = transitions.sync_finalize(state.changelog, results.select("symbol_id", "ok")).select(*state.changelog.columns)
    return Sync(results, texts, state.with_(doc_sections=sections, changelog=changelog))


def stale_result() -> Column:
    return (F.col("status") == "stale") & (F.col("outcome").isin("marked stale", "no generator", "no section", "unknown", "no file"))


def sync_all(state: State, code_files: DataFrame, doc_files: DataFrame, as_of: Column, strategies: dict[str, str] | None = None, scripts: tuple[str, ...] = ()) -> Sync:
    """Syncs every symbol of a stale section, whatever their number."""
    return sync(state, reports.stale_symbols(state), code_files, doc_files, as_of, strategies, scripts)
