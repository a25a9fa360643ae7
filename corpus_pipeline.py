"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``;
the last adds what the mix takes.  Extra columns of the input pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, language_id, line_dedup, minhash, mixing
from docweave.llm.common import column_name, discard, materialize, table

#: A document stays if its language is known with at least this calibrated probability.
MIN_LANGUAGE_SCORE = 0.5


def _with_chars(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


def _holding(docs: DataFrame, operator, *names: str) -> DataFrame:
    """``operator(docs)`` although ``docs`` has extra columns with names that the operator adds.

    They are renamed before and are back under their names after; what the operator adds under
    ``names`` stands as ``_added_`` + name.
    """
    held = {c: column_name(docs, f"_held_{c}") for c in docs.columns if c in names}
    out = operator(docs.withColumnsRenamed(held)).withColumnsRenamed({n: f"_added_{n}" for n in names})
    return out.withColumnsRenamed({v: k for k, v in held.items()})


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a language (no letter, or no language likely enough) go."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = _holding(docs, lambda d: language_id.identify(d, model), "lang_pred", "score")
    kept = found.filter((F.col("_added_lang_pred") != language_id.UNKNOWN) & (F.col("_added_score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each source's boilerplate lines are cut; no document goes."""
    return _with_chars(_holding(docs, line_dedup.drop_boilerplate, "n_lines", "n_dropped").select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five words and 0.8: of each group of near copies the smallest doc_id stays.

    Rows that repeat a document (same id and text) are one.
    """
    version = column_name(docs, "_version")
    versioned = docs.withColumn(version, F.xxhash64("text"))
    found = materialize(minhash.near_duplicates(versioned.select("doc_id", "text", version), words=5, version=version))
    gone = materialize(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col(version).alias("_text")).distinct())
    # Filters of fixed size settle nearly all rows where they are read: what may go is looked up without
    # its text, and only what stays against the first filter is joined with its text.
    stays = lambda rows: rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col(version) == F.col("_text")), "left_anti")
    may_go = minhash.possibly_in("doc_id", gone.select(F.col("_gone").alias("id")))
    back = materialize(stays(versioned.filter(may_go).select("doc_id", version)).select(F.col("doc_id").alias("id")).distinct())
    kept = versioned.filter(~may_go).unionByName(stays(versioned.filter(may_go).filter(minhash.possibly_in("doc_id", back))))
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id", version).agg(F.count("*").alias("c")).filter("c > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", version])).select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: contaminated documents go, from the rest the spans of benchmark windows are cut.

    A document that such spans make up wholly goes too.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    found = _holding(docs, lambda d: decontaminate.decontaminate(d, benchmark, cut=True), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    left = (F.col("_added_n_hit") == 0) | (F.col("_added_n_hit") < F.col("_added_n_words"))
    return _with_chars(found.filter(~F.col("_added_contaminated") & left).select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the mix takes, with size, source_size, target and taken words."""
    inner = docs.drop("size", "source_size", "target", "taken")
    sized = inner.withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix(sized, "size").filter("taken > 0")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", site_lines),
    ("near_dedup", near_copies),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
]
#: Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next.

    A stage's input is deleted once its output is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
