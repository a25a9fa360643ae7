"""Quality scores: a document classifier, shrunk towards site and section by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED_BYTES, byte_table, column_name, materialize, seeded_order, text_slices, tidy, word_hashes, words_of

#: Bound of the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 20_000
KEEP_SCORE = 0.5
FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "sentence_end", "newline", "high", "distinct_words", "repeated_lines"]

_UPPER = byte_table(lambda b: 0x41 <= b <= 0x5A)
_DIGIT = byte_table(lambda b: 0x30 <= b <= 0x39)
_SYMBOL = byte_table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()")
_STOP = byte_table(lambda b: chr(b) in ".!?")
_NEWLINE = byte_table(lambda b: b == 10)
_HIGH = byte_table(lambda b: b >= 0x80)
_LINE = byte_table(lambda b: b != 10)


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes by row (rows ascend)."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: shares of bytes, words and lines."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda table: np.bincount(row, weights=table[data], minlength=n) / size
    starts, ends, rows = words_of(data, offsets, SPACED_BYTES)
    words = np.bincount(rows, minlength=n)
    some = np.maximum(words, 1)
    word_bytes = np.bincount(rows, weights=ends - starts, minlength=n)
    l_starts, l_ends, l_rows = words_of(data, offsets, _LINE)
    lines = np.bincount(l_rows, minlength=n)
    return np.stack(
        [
            np.log1p(words),
            word_bytes / some,
            share(_UPPER),
            share(_DIGIT),
            share(_SYMBOL),
            share(_STOP) * 10,
            share(_NEWLINE) * 10,
            share(_HIGH),
            _distinct(word_hashes(data, starts, ends), rows, n) / some,
            1 - _distinct(word_hashes(data, l_starts, l_ends), l_rows, n) / np.maximum(lines, 1),
        ],
        axis=1,
    )


class Classifier:
    """Logistic regression on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
    """Newton steps with a ridge; without both classes, the smoothed share of good rows for all."""
    k = len(FEATURES)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(k), np.ones(k))
    w = np.zeros(k + 1)
    share = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        penalty = np.diag([ridge] * k + [1e-6])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    return Classifier(mean, scale, w)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.concatenate([features_of(d, o) for _, d, o in text_slices(batch.column(1))]) if batch.num_rows else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], names=["good", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 2) -> Classifier:
    """Fits on at most ``sample_rows`` labelled documents, by a seeded hash of doc_id.

    Only their features reach the driver.  Several labels of a document are averaged; null labels
    and ids are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("good"))
    chosen = known.orderBy(seeded_order(seed, "doc_id"), "doc_id").limit(sample_rows)
    texts = docs.filter("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min(text).alias("text"))
    found = texts.select("good", "text").mapInArrow(_with_features, "good double, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.stack([found[f].to_numpy() for f in FEATURES], axis=1) if found.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, (found["good"].to_numpy() >= 0.5).astype(float) if found.num_rows else np.zeros(0))


def document_probability(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` without its text, with p_doc: the classifier's probability of a good document."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            p = [shared.value.probability(features_of(d, o)) for _, d, o in text_slices(batch.column(i))]
            kept = [j for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in kept), pa.array(np.concatenate(p) if p else np.zeros(0))], names=[*(batch.schema.names[j] for j in kept), "p_doc"])

    fields = [f for f in docs.schema.fields if f.name not in (text, "p_doc")]
    return docs.drop("p_doc").mapInArrow(tidy(score), T.StructType([*fields, T.StructField("p_doc", T.DoubleType())]))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without port and user; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def path_of(url: Column, levels: int = 1) -> Column:
    """The first ``levels`` folders of a URL's path, as ``/a/b/``; a file in the root is in ``/``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.split(path, "/")
    folders = F.slice(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), 1, levels)
    return F.when(host_of(url).isNotNull(), F.concat(F.lit("/"), F.array_join(F.transform(folders, lambda x: F.concat(x, F.lit("/"))), "")))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> DataFrame:
    """One row: how many rows the level above is worth, from variances within and between groups.

    ``groups`` has n, s (sum) and q (sum of squares) of p; ``mean`` is what each group is held against.
    """
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inner"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("outer"),
        (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("c"),
    )
    within = F.col("inner") / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    between = (F.col("outer") - (F.col("k") - 1) * within) / F.greatest(F.col("c"), F.lit(1.0))
    return row.select(F.least(F.greatest(within / F.greatest(between, F.lit(1e-9)), F.lit(1.0)), F.lit(1e6)).alias("kappa"))


def posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(host, path, mean, host_posterior, path_posterior) from p_doc, by grouped aggregation alone.

    A path with n rows counts n against kappa rows' worth of its host, and a host likewise against
    the whole corpus, so sparse ones shrink towards their prior.  Sums are formed by path in the map
    tasks, by host from those, and over all from the hosts'; kappas and the mean are single rows.
    """
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q"))
    paths = materialize(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = paths.agg((F.sum("s") / F.sum("n")).alias("mean"))
    hosts = hosts.crossJoin(F.broadcast(mean))  # one row
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, F.col("mean"))))
    hosts = hosts.select(F.col("host").alias("h"), "mean", ((F.col("kappa") * F.col("mean") + F.col("s")) / (F.col("kappa") + F.col("n"))).alias("host_posterior"))
    below = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    below = below.crossJoin(F.broadcast(_strength(below, F.col("host_posterior"))))
    return below.select("host", "path", "mean", "host_posterior", ((F.col("kappa") * F.col("host_posterior") + F.col("s")) / (F.col("kappa") + F.col("n"))).alias("path_posterior"))


def quality(docs: DataFrame, classifier: Classifier, host: str = "source", path: str = "lang", text: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """``docs`` without its text, with p_doc, host_posterior, path_posterior, score and keep.

    score adds, in log odds, how far the path's posterior lies from the corpus' mean to the
    document's own evidence.  Where documents have a URL, ``host_of`` and ``path_of`` give host and
    path; any other division of the corpus into sites and sections will do.  Null host and null path are groups of their own; null and empty texts
    are judged by their (zero) features; whole texts count; repeated rows count each; columns of
    these names in ``docs`` are replaced; an empty table gives no rows.
    """
    added = ["p_doc", "host_posterior", "path_posterior", "score", "keep"]
    scored = materialize(document_probability(docs.drop(*added), classifier, text))
    h, p, m = (column_name(scored, c) for c in ("_h", "_p", "_m"))
    groups = materialize(posteriors(scored, host, path)).select(F.col("host").alias(h), F.col("path").alias(p), F.col("mean").alias(m), "host_posterior", "path_posterior")
    joined = scored.join(groups, F.col(host).eqNullSafe(F.col(h)) & F.col(path).eqNullSafe(F.col(p)))
    odds = _logit(F.col("p_doc")) + _logit(F.col("path_posterior")) - _logit(F.col(m))
    score = 1 / (1 + F.exp(-odds))
    return joined.select(*scored.columns, "host_posterior", "path_posterior", score.alias("score"), (score >= keep_score).alias("keep"))
