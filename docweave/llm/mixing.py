"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, column_name, materialize


def slice_digits(rows: int) -> int:
    """Hex digits of the digest that deal a source's documents into slices: about the root of the rows.

    Then neither the slices of a source nor the documents of a slice are many.
    """
    return max(2, min(8, math.ceil(math.log(max(rows, 1), 16) / 2)))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets per source from rows (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes.  A source stops at ``max_epochs`` times its size; what it leaves is shared again by
    weight.  Sorted by the share at which each source fills up, the capped ones are a prefix, so
    running sums give the fixed point without iterating.  This is one row per source, never per
    document, and both windows sort with spill.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    capped = ranked.select("source", "source_size", "_rank", weight.alias("_w"), (F.col("source_size") * max_epochs).alias("_cap"))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = capped.select(
        "*",
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_cap_before"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w_before"),
        F.sum("source_size").over(whole).alias("_total"),
        F.sum("_w").over(whole).alias("_w_total"),
    ).withColumn("_full", F.col("_cap").cast("double") * (F.col("_w_total") - F.col("_w_before")) <= F.col("_w").cast("double") * (F.col("_total") - F.col("_cap_before")))
    level = filled.select(
        "*",
        F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(whole).alias("_cap_full"),
        F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0)).over(whole).alias("_w_full"),
    )
    share = F.col("_w").cast("double") * (F.col("_total") - F.col("_cap_full")) / (F.col("_w_total") - F.col("_w_full"))
    return level.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, size: str, seed: str = "mix-1", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``docs`` with source_size, target and taken: the words that the mix takes, repeats counted.

    ``docs`` has doc_id, source and a word count in column ``size``.  Every document is repeated
    whole ``floor(target / source_size)`` times; the remaining fraction takes documents in the order
    of a seeded digest of doc_id until the target is met, the last of them in part, so each source
    is met to the word and no document exceeds ``max_epochs`` times its size.  Reruns agree.

    Prefix sums run over (source, slice) totals first; only the one slice where a source's quota
    ends is ordered row by row, so a source with a third of all rows is never gathered in a task.
    Defined cases: null source is a source of its own, the last in order; a text without words has
    size 0 and takes 0; rows that repeat a doc_id count each; an empty table gives no rows; columns
    of ``docs`` that have one of the added names are replaced.
    """
    docs = docs.drop("source_size", "target", "taken")
    key, digest, cut = (column_name(docs, c) for c in ("_key", "_digest", "_slice"))
    # A key that is never null: joins on it are plain equi-joins, which can be split when skewed.
    rows = docs.withColumns({
        key: F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))),
        digest: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
    }).withColumn(cut, F.substring(digest, 1, slice_digits(docs.count())))
    slices = rows.groupBy(F.col(key).alias("k"), F.col("source").alias("s"), F.col(cut).alias("c")).agg(F.sum(size).alias("n"))
    sizes = slices.groupBy("s").agg(F.sum("n").alias("source_size")).select(F.col("s").alias("source"), "source_size")
    targets = source_targets(sizes, weights, max_epochs)
    quota = targets.select(
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("k"),
        "source_size",
        "target",
        F.floor(F.col("target") + 0.5).cast("long").alias("q"),
    )
    quota = quota.select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("q") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("rest", F.col("q") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    border = (
        slices.select("k", "c", "n", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
        .join(quota, "k")
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        .select("k", F.col("c").alias("border"), F.col("before").alias("border_before"))
    )
    plan = quota.join(border, "k", "left")
    base = [*docs.columns]
    names = {c: column_name(docs, f"_{c}") for c in ("source_size", "target", "whole", "rest", "border", "border_before")}
    # A row a source, written first: its true size decides whether the joins broadcast it or shuffle
    # the documents, texts and all.
    plan = materialize(plan.select(F.col("k").alias(key), *(F.col(c).alias(n) for c, n in names.items())))
    joined = rows.join(plan, key)
    # Joined on the slice too, the border rows of a large source do not wait in one task for the others.
    bordered = rows.join(plan.filter(F.col(names["border"]).isNotNull()).withColumn(column_name(docs, "_at"), F.col(names["border"])).withColumnRenamed(key, column_name(docs, "_key2")), (F.col(key) == F.col(column_name(docs, "_key2"))) & (F.col(cut) == F.col(column_name(docs, "_at"))))
    col = {c: F.col(n) for c, n in names.items()}
    out = lambda extra: [*(F.col(c) for c in base), col["source_size"].alias("source_size"), col["target"].alias("target"), (col["whole"] * F.col(size) + extra).cast("long").alias("taken")]
    at_border = F.col(cut).eqNullSafe(col["border"])
    apart = joined.filter(~at_border).select(*out(F.when(F.col(cut) < col["border"], F.col(size)).otherwise(0)))
    order = Window.partitionBy(key).orderBy(digest, "doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    before = col["border_before"] + F.coalesce(F.sum(size).over(order), F.lit(0))
    within = bordered.withColumn(column_name(docs, "_before"), before)
    b = F.col(column_name(docs, "_before"))
    within = within.select(*out(F.greatest(F.lit(0), F.least(F.col(size), col["rest"] - b))))
    return apart.unionByName(within)
