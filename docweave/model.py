"""The persistent relations, their allowed values, and a check of their constraints."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL_KINDS = ("function", "class", "module", "api_endpoint", "type", "interface", "variable", "unknown")
DOC_TYPES = ("inline", "standalone", "generated", "architecture")
DOC_STATUSES = ("in_sync", "stale", "draft")
REL_TYPES = ("describes", "references", "generates", "contracts")
REVIEW_STATUSES = ("auto", "confirmed", "rejected")
CHANGE_TYPES = ("created", "signature_changed", "moved", "deleted", "renamed")
SYNC_STATUSES = ("pending", "applied", "failed")

SCHEMAS = {
    "symbols": "id string, name string, kind string, project string, location string, signature string, raw_signature string, metadata string, created_at timestamp, updated_at timestamp",
    "doc_sections": "id string, file string, anchor string, content_hash string, doc_type string, status string, created_at timestamp, updated_at timestamp",
    "mappings": "symbol_id string, doc_id string, rel_type string, review_status string, created_at timestamp",
    "changelog": "id long, timestamp timestamp, symbol_id string, change_type string, old_sig string, new_sig string, affected_docs array<string>, sync_status string",
    "metadata": "key string, value string, updated_at timestamp",
}


@dataclass(frozen=True)
class State:
    """One snapshot of all relations.  Operators take a state and give tables or another state."""

    symbols: DataFrame
    doc_sections: DataFrame
    mappings: DataFrame
    changelog: DataFrame
    metadata: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def with_(self, **tables) -> State:
        return replace(self, **tables)


def violations(state: State) -> DataFrame:
    """(relation, rule, n): how many rows break each key, reference or allowed value."""
    s, d, m, c = state.symbols, state.doc_sections, state.mappings, state.changelog

    def bad(relation: str, rule: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(relation).alias("relation"), F.lit(rule).alias("rule"), "n")

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1")

    def dangling(df: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        return df.join(parent.select(F.col("id").alias("_id")), F.col(key) == F.col("_id"), "left_anti")

    def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
        return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))

    parts = [
        bad("symbols", "primary key", repeated(s, "id")),
        bad("symbols", "kind", outside(s, "kind", SYMBOL_KINDS)),
        bad("doc_sections", "primary key", repeated(d, "id")),
        bad("doc_sections", "doc_type", outside(d, "doc_type", DOC_TYPES)),
        bad("doc_sections", "status", outside(d, "status", DOC_STATUSES)),
        bad("mappings", "primary key", repeated(m, "symbol_id", "doc_id", "rel_type")),
        bad("mappings", "symbol_id", dangling(m, "symbol_id", s)),
        bad("mappings", "doc_id", dangling(m, "doc_id", d)),
        bad("mappings", "rel_type", outside(m, "rel_type", REL_TYPES)),
        bad("mappings", "review_status", outside(m, "review_status", REVIEW_STATUSES)),
        bad("changelog", "primary key", repeated(c, "id")),
        bad("changelog", "symbol_id", dangling(c, "symbol_id", s)),
        bad("changelog", "change_type", outside(c, "change_type", CHANGE_TYPES)),
        bad("changelog", "sync_status", outside(c, "sync_status", SYNC_STATUSES)),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("n", F.col("n").cast("long"))
