"""Surrogate keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def qualified_name(file: Column, name: Column, occurrence: Column | None = None) -> Column:
    """``file::name`` with ``::`` in either escaped, and ``::#n`` from the second occurrence on."""
    escaped = lambda c: F.replace(c, F.lit("::"), F.lit("%3A%3A"))
    base = F.concat(escaped(file), F.lit("::"), escaped(name))
    if occurrence is None:
        return base
    return F.when(occurrence > 1, F.concat(base, F.lit("::#"), occurrence.cast("string"))).otherwise(base)


def symbol_id(lang: Column, name: Column, kind: Column) -> Column:
    """SHA-256 of lower-case language, qualified name and lower-case kind; nulls count as empty."""
    part = lambda c: strip(F.coalesce(c, F.lit("")))
    return F.sha2(F.concat_ws(":", F.lower(part(lang)), part(name), F.lower(part(kind))), 256)


def doc_section_id(file: Column, anchor: Column) -> Column:
    """SHA-256 of file and anchor with ``#`` escaped in both."""
    part = lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("#"), F.lit("%23"))
    return F.sha2(F.concat_ws("#", part(file), part(anchor)), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)
