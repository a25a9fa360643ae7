"""Text rewriting as columns: files are never written here, the new text is the result."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signatures
from ..functions.signatures import strip_code
from ..functions.text import occurrence_count, strip_tail


def rewrite_signature(sections: DataFrame, text: str, old: Column, new: Column) -> DataFrame:
    """Replaces every occurrence of ``old`` within a section; adds n_replaced.

    Line ends are kept: in a text of CRLF lines, line ends of both signatures are taken as CRLF.
    """
    crlf = F.contains(F.col(text), F.lit("\r\n"))
    ends = lambda c: F.when(crlf, F.regexp_replace(c, "\r?\n", "\r\n")).otherwise(c)
    n = F.greatest(occurrence_count(F.col(text), ends(old)), F.lit(0))
    return sections.withColumns({"n_replaced": n, text: F.when(n > 0, F.replace(F.col(text), ends(old), ends(new))).otherwise(F.col(text))})


def rewrite_unique(sections: DataFrame, text: str, old: Column, new: Column) -> DataFrame:
    """Replaces ``old`` where it stands exactly once; adds outcome: replaced, not found or ambiguous."""
    n = occurrence_count(F.col(text), old)
    outcome = F.when(n == 0, "not found").when(n == 1, "replaced").otherwise("ambiguous")
    return sections.withColumns({"outcome": outcome, text: F.when(n == 1, F.replace(F.col(text), old, new)).otherwise(F.col(text))})


def sig_pairs(changes: DataFrame) -> DataFrame:
    """(symbol_id, old_text, new_text, form): texts to look for and what to put there.

    Form 0 is the whole signature, form 1 both without a closing brace, arrow or semicolon; of equal
    old texts the lower form stays, and pairs that change nothing are none.
    """
    whole = changes.select("symbol_id", F.col("old_sig").alias("o"), F.col("new_sig").alias("n")).filter("o <> '' AND n <> '' AND o <> n").distinct()
    bare_o, bare_n = strip_tail(F.col("o")), strip_tail(F.col("n"))
    forms = F.array(F.struct(F.col("o").alias("old_text"), F.col("n").alias("new_text"), F.lit(0).alias("form")), F.struct(bare_o.alias("old_text"), bare_n.alias("new_text"), F.lit(1).alias("form")))
    pairs = whole.select("symbol_id", F.inline(forms)).filter("old_text <> new_text")
    order = Window.partitionBy("symbol_id", "old_text").orderBy("form", "new_text")
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def stale_or_synced(sections: DataFrame, replaced: Column, new_hash: Column, modified: Column) -> DataFrame:
    """Status after a standalone sync: replaced or another hash gives in_sync; an unchanged stale
    section is in sync only if its file is newer than the row."""
    changed = replaced | (new_hash != F.col("content_hash"))
    status = F.when(changed, "in_sync").when((F.col("status") == "stale") & (modified > F.col("updated_at")), "in_sync").otherwise(F.col("status"))
    return sections.withColumns({"status": status, "content_hash": F.when(changed, new_hash).otherwise(F.col("content_hash"))})


def update_inline(files: DataFrame, content: str, old: str, new: str, language: str) -> DataFrame:
    """Replaces a docstring (column ``old``) where its text stands exactly once in a file.

    Adds outcome: updated, unchanged, not found, ambiguous, or broken if code outside of comments
    would change; only ``updated`` rows have a new text.
    """

    def one(text: str, before: str, after: str, lang: str) -> tuple[str, str]:
        if before == after:
            return text, "unchanged"
        n = text.count(before) if before else 0
        if n != 1:
            return text, "ambiguous" if n else "not found"
        written = text.replace(before, after)
        code = [re.sub(r"\s+", " ", strip_code(t, lang)) for t in (text, written)]
        return (written, "updated") if code[0] == code[1] else (text, "broken")

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("outcome", T.StringType())]))
    def update(text: pd.Series, before: pd.Series, after: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = [one(t or "", b or "", a or "", x or "typescript") for t, b, a, x in zip(text, before, after, lang, strict=True)]
        return pd.DataFrame(rows, columns=["text", "outcome"])

    found = files.withColumn("_u", update(content, old, new, language))
    return found.withColumns({content: F.col("_u.text"), "outcome": F.col("_u.outcome")}).drop("_u")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("outcome", T.StringType())]))
def inline_update(content: pd.Series, name: pd.Series, language: pd.Series, new_doc: pd.Series, old_signature: pd.Series, new_signature: pd.Series) -> pd.DataFrame:
    """(text, outcome) of ``signatures.update_inline`` row by row."""
    rows = zip(content, name, language, new_doc, old_signature, new_signature, strict=True)
    return pd.DataFrame([signatures.update_inline(*(x or "" for x in r)) for r in rows], columns=["text", "outcome"])


# Scripts that may generate a kind of file, in order of preference.
SPEC_SCRIPTS = ("generate:api", "generate:openapi")
DOC_SCRIPTS = ("docs:generate", "generate:docs", "build:docs", "docs:build")


def generator(file: Column, scripts: Column, head: Column) -> Column:
    """The script that a generated file comes from, or null: it is chosen here and never run.

    ``scripts`` is an array of script names, ``head`` the start of the file.  Interface specifications
    are told by name or by their first lines; any other file may come from a documentation script.
    """
    first = lambda names: F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(scripts, n)), F.lit(1))
    named = file.rlike(r"(?i)openapi|swagger|/api[-/]?(docs|spec|schema)")
    spec = file.rlike(r"(?i)\.ya?ml$") & (named | head.rlike(r"(?mi)^(openapi|swagger):\s*[\"']?\d"))
    return F.when(spec, first(SPEC_SCRIPTS)).otherwise(first(DOC_SCRIPTS))
