"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_table, seeded_order, text_slices, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A text without any of these, lower-cased, has no assignment.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "markov")

#: Characters of a candidate, its least length, and the mean log-likelihood ratio a character that makes it a secret.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_LENGTH, MIN_RATIO = 20, 0.5
#: Documents, chosen by a seeded hash of doc_id, that labelled samples are taken from.
SAMPLE_DOCS = 2000

_INDEX = {c: i for i, c in enumerate(ALPHABET)}
_EDGE = len(ALPHABET)
_CANDIDATE_BYTES = byte_table(lambda b: chr(b) in ALPHABET)
_HEX_BYTES = byte_table(lambda b: chr(b) in "0123456789abcdef")


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost without overlap in each kind."""
    low = text.encode("utf-8", "surrogatepass").lower() if low is None else low
    out = []
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in low:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return out


def ordered(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def pairs_of(token: str) -> np.ndarray:
    """Transitions (from * size + to) of a token, its edges included; other characters are left out."""
    at = np.array([_EDGE, *(_INDEX[c] for c in token if c in _INDEX), _EDGE])
    return at[:-1] * (_EDGE + 1) + at[1:]


class MarkovPair:
    """Log-likelihood ratio of two first-order models with add-one smoothing."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray):
        self.ratio = (self._log(random_counts) - self._log(ordinary_counts)).ravel()

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        table = counts.reshape(_EDGE + 1, _EDGE + 1) + 1.0
        return np.log(table / table.sum(1, keepdims=True))

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio a transition; above 0, random is likelier."""
        return float(self.ratio[pairs_of(token)].mean())

    def is_secret(self, token: str) -> bool:
        """A long token of letters and digits that the model of random strings explains better."""
        return len(token) >= MIN_LENGTH and any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and self.score(token) > MIN_RATIO


def random_samples(seed: int = 5, each: int = 400) -> list[str]:
    """Labelled positives that hold without any corpus: keys in hex, base 32, 36, 62 and 64."""
    r = random.Random(seed)
    sets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET[:62], ALPHABET[:64])
    return ["".join(r.choices(s, k=r.randint(MIN_LENGTH, 64))) for s in sets for _ in range(each)]


def outside(tokens: Iterator[re.Match], spans: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    """The tokens (in order, apart from each other) that overlap no span; one sweep over both."""
    spans, k, reach = sorted(spans), 0, 0
    for m in tokens:
        while k < len(spans) and spans[k][0] < m.end():
            reach, k = max(reach, spans[k][1]), k + 1
        if reach <= m.start():
            yield m


def labelled_tokens(text: str) -> tuple[list[str], list[str]]:
    """(secrets, ordinary identifiers) of a text by the fixed patterns."""
    spans = base_spans(text)
    secrets = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [text[a:b] for a, b, k in spans if k != "assign"]
    ordinary = [m[0] for m in outside(re.finditer(r"[A-Za-z0-9_-]{3,}", text), spans)]
    # Long tokens that mix letters and digits are what is to be told, so they are no examples.
    return secrets, [t for t in ordinary if len(t) < MIN_LENGTH or t.isalpha()]


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = (_EDGE + 1) ** 2
    counts = np.zeros(2 * size, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for label, tokens in enumerate(labelled_tokens(text or "")):
                for token in tokens:
                    np.add.at(counts, label * size + pairs_of(token), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["at", "n"])


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, seed: int = 3) -> MarkovPair:
    """Fits both models on samples that the fixed patterns label, in a bounded number of documents.

    Seeded random keys stand beside the corpus' secrets, so the model holds on a corpus without any.
    Transitions are summed on the executors; a table of fixed size reaches the driver.
    """
    chosen = docs.filter("doc_id IS NOT NULL").select("doc_id", seeded_order(seed, "doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min(text).alias(text)).select(text)
    size = (_EDGE + 1) ** 2
    counts = np.zeros(2 * size)
    for row in sample.mapInArrow(_transitions, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[row.at] = row.n
    for token in random_samples():
        np.add.at(counts, pairs_of(token), 1)
    return MarkovPair(counts[:size], counts[size:])


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> set[int]:
    """Rows with a run of at least so many of these bytes."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    edge = np.diff(mask)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    first = np.searchsorted(offsets, starts[long], "right") - 1
    last = np.searchsorted(offsets, ends[long], "left") - 1  # a run may go on over rows
    return {r for a, b in zip(first.tolist(), last.tolist(), strict=True) for r in range(a, b + 1)}


def find_spans(text: str, low: bytes, models: MarkovPair) -> tuple[list, list]:
    """(base spans, spans that the models add: candidates that overlap no base span)."""
    base = base_spans(text, low)
    return base, [(m.start(), m.end(), "markov") for m in outside(CANDIDATE.finditer(text), base) if models.is_secret(m[0])]


_ADDED = [("n_assign", pa.int64(), T.LongType()), ("n_access", pa.int64(), T.LongType()), ("n_hex", pa.int64(), T.LongType()), ("base_sha256", pa.string(), T.StringType()), ("spans", pa.string(), T.StringType())]


def scan(docs: DataFrame, models: MarkovPair, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans; row by row, no shuffle.

    Spans are kind:start:end in code points, end exclusive, by start and then kind.  Null and empty
    texts have none.  Whole texts are read: those that a scan of their bytes shows to be free of all
    names, marks and long runs are passed over, which changes no result.  Repeated rows get equal
    results; columns of ``docs`` that have one of the added names are replaced; an empty table gives
    no rows.
    """
    docs = docs.drop(*(n for n, _, _ in _ADDED))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    nothing = hashlib.sha256(b"").hexdigest()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            n = batch.num_rows
            counts = {k: [0] * n for k in KINDS}
            digests, spans = [nothing] * n, [""] * n
            for base, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                rows = _runs(data, offsets, _CANDIDATE_BYTES, MIN_LENGTH) | _runs(data, offsets, _HEX_BYTES, 32)
                raw = data.tobytes()
                low = raw.lower()
                for mark in (*_NAMES, b"akia"):
                    at = low.find(mark)
                    while at >= 0:
                        row = int(np.searchsorted(offsets, at, "right")) - 1
                        rows.add(row)
                        at = low.find(mark, max(at + 1, int(offsets[row + 1])))
                for r in rows:
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    found, added = find_spans(raw[a:b].decode(), low[a:b], models)
                    for _, _, kind in found:
                        counts[kind][base + r] += 1
                    digests[base + r] = hashlib.sha256(ordered(found).encode()).hexdigest()
                    spans[base + r] = ordered(found + added)
            added = [pa.array(counts[k], pa.int64()) for k in KINDS[:3]] + [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(c for c, _, _ in _ADDED)])

    return docs.mapInArrow(tidy(search), T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, _, t in _ADDED)]))
