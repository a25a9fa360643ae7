"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import seeded_order, tidy

#: N-grams of 1 to 3 characters fall into so many hashed features.
FEATURE_BITS, ORDERS = 15, 3
FEATURES = 1 << FEATURE_BITS
#: Bound of the labelled rows that the classifier is fitted on (counts for TF-IDF cover all).
SAMPLE_ROWS = 3000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, counts) of the whole text, case folded; None if it has no letter.

    All that is no letter counts as a space.
    """
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    symbol = np.where(letter, points, 32).astype(np.uint64)
    code, found = symbol + np.uint64(1), []
    for order in range(1, ORDERS + 1):
        if order > 1:
            code = code[:-1] * np.uint64(0x110001) + symbol[order - 1 :] + np.uint64(1)
        if len(code):
            found.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=FEATURES)
    features = np.flatnonzero(counts)
    return features, counts[features]


def weighted(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of a text, of length 1."""
    value = counts * idf[features]
    return value / max(float(np.sqrt(value @ value)), 1e-12)


class Model:
    """Weights by feature and language; the last weight row is the bias."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def logits(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[features] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngram_counts(text) if self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found[0], weighted(*found, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> np.ndarray:
    """Follow-the-regularised-leader (proximal, per coordinate) with an elastic net."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            features, values, label = rows[i]
            at = np.append(features, FEATURES)
            x = np.append(values, 1.0)
            za, na = z[at], n[at]
            w = weights(za, na)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            squared = na + g * g
            z[at] = za + g - (np.sqrt(squared) - np.sqrt(na)) / alpha * w
            n[at] = squared
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows that were not fitted on."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (found := ngram_counts(text)) is not None:
                counts[found[0]] += 1
                counts[FEATURES] += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["feature", "n"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngram_counts(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([None if f is None else f[0].astype(np.uint16).tobytes() for f in found], pa.binary()),
                pa.array([None if f is None else f[1].astype(np.int32).tobytes() for f in found], pa.binary()),
            ],
            names=["lang", "features", "counts"],
        )


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """Learns from text and non-null lang of the rows that ``held_out`` leaves.

    Document frequencies cover all those rows.  The classifier is fitted on at most ``sample_rows``
    of them: the rows of each language in the order of a seeded hash of doc_id, taken in turn, which
    top-k operators select from ids alone.  Their features, not their texts, reach the driver.
    """
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    df = known.select(text).mapInArrow(tidy(_document_counts), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(FEATURES + 1)
    counts[df["feature"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((1 + counts[FEATURES]) / (1 + counts[:FEATURES])) + 1
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = known.select("doc_id", F.col(lang).alias("lang"), seeded_order(seed, "doc_id").alias("h")).distinct()
    chosen = ranked.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= sample_rows).orderBy("turn", "h", "doc_id", "lang").limit(sample_rows)
    picked = known.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])
    texts = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    sample = texts.mapInArrow(tidy(_sample_features), "lang string, features binary, counts binary").toArrow().to_pylist()
    sample = sorted((r["lang"], r["features"], r["counts"]) for r in sample if r["features"] is not None)
    langs = sorted({r[0] for r in sample})
    rows = []
    for name, features, n in sample:
        features = np.frombuffer(features, np.uint16).astype(np.int64)
        rows.append((features, weighted(features, np.frombuffer(n, np.int32), idf), langs.index(name)))
    if len(langs) < 2:
        return Model(langs, idf, np.zeros((FEATURES + 1, len(langs))), 1.0)
    fit, check = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    model = Model(langs, idf, fit_ftrl(fit, len(langs)), 1.0)
    model.temperature = fit_temperature(np.array([model.logits(f, v) for f, v, _ in check]).reshape(-1, len(langs)), np.array([y for _, _, y in check], np.int64))
    return model


_ADDED = [("lang_pred", T.StringType()), ("score", T.DoubleType())]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the calibrated probability of lang_pred).

    Only the text is an input.  A text that is null, empty or without a letter is ``und`` with score
    0, as is every text if no language was learned; a single learned language has score 1.  Whole
    texts count, however long; repeated rows get equal results; columns of ``docs`` that have one of
    the added names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*(n for n, _ in _ADDED))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most sample_rows languages; usually a few

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(n for n, _ in _ADDED)])

    return docs.mapInArrow(tidy(predict), T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in _ADDED)]))
