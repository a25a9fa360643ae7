"""Line deduplication by the share of a site's pages that hold a line (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column_name, materialize

#: A line is boilerplate of its host if more than this share of the host's pages holds it ...
MAX_SHARE = 0.05
#: ... and at least so many do: a line of a single page repeats nothing, whatever its share.
MIN_PAGES = 2
_BLANK = "\t\n\x0b\x0c\r "


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """64 bits for each line; white space at its ends and ASCII case do not count.  Blank lines: null.

    Keys are only ever compared within a host, against the few that its boilerplate has.
    """
    bare = lambda line: F.btrim(line, F.lit(_BLANK))
    return F.transform(F.transform(lines_of(ascii_lower(text)), bare), lambda line: F.when(line != "", F.xxhash64(line)))


def boilerplate(docs: DataFrame, host: str, text: str, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): the keys of each host's boilerplate lines.

    Pages of a host with the same whole text count as one page: copies are another operator's work
    and must not turn a page's own lines into boilerplate.  Distinct (host, line, page) triples are
    formed in the map tasks, counted by (host, line) and only then brought together by host, so no
    task sees all lines of a large site.  A host has at most (mean lines a page) / max_share keys.
    """
    pages = docs.select(F.col(host).alias("h"), F.xxhash64(text).alias("page"), F.col(text).alias("t"))
    keyed = pages.select("h", "page", F.explode(F.array_distinct(line_keys(F.col("t")))).alias("key")).filter("key IS NOT NULL")
    holding = keyed.distinct().groupBy("h", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.select("h", "page").distinct().groupBy("h").agg(F.count("*").alias("total"))
    over = holding.join(totals.withColumnRenamed("h", "h2"), F.col("h").eqNullSafe(F.col("h2"))).filter(F.col("n") > max_share * F.col("total"))
    return over.groupBy("h").agg(F.collect_set("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and columns n_lines, n_dropped.

    Null text has no lines and stays null; a null host is a host of its own; blank lines are never
    dropped; all occurrences of a boilerplate line go, repeated rows are treated alike; a share equal
    to ``max_share`` does not exceed it; very long texts are read whole; columns of ``docs`` that have
    one of the added names are replaced; an empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    # Written first: its true size decides whether the join broadcasts it or shuffles the texts.
    table = materialize(boilerplate(docs, host, text, max_share, min_pages))
    h, keys, lines, found, kept = (column_name(docs, c) for c in ("_host", "_keys", "_lines", "_found", "_kept"))
    joined = docs.join(table.select(F.col("h").alias(h), F.col("keys").alias(keys)), F.col(host).eqNullSafe(F.col(h)), "left")
    # Each line's key is looked for in the host's array of longs; texts of hosts without keys pass as they are.
    split = joined.withColumn(lines, F.when(F.col(text).isNotNull(), lines_of(F.col(text))))
    split = split.withColumn(found, F.when(F.col(keys).isNotNull(), line_keys(F.col(text))))
    bad = lambda i: F.coalesce(F.array_contains(F.col(keys), F.get(F.col(found), i)), F.lit(False))
    cleaned = split.withColumn(kept, F.when(F.col(keys).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x, i: ~bad(i))))
    n = F.coalesce(F.size(lines), F.lit(0))
    return cleaned.select(
        *(F.array_join(kept, "\n").alias(text) if c == text else F.col(c) for c in docs.columns),
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(n - F.size(kept)).cast("long").alias("n_dropped"),
    )
