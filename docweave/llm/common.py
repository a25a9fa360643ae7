"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Java and RE2 class of the words that are divided by ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Java and RE2 class of words of ASCII letters, digits and all beyond ASCII (upper case is lowered before).
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would follow Unicode)."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor shares."""
    return f"{_shared_root(spark)}/{uuid.uuid4().hex}"


def _shared_root(spark: SparkSession) -> str:
    """The application's part of that folder.  Where the setting is absent, a local session (tests) has a folder
    of its own; a cluster is refused, as its machines share no temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/docweave-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; results that still read them are lost."""
    _delete(spark, _shared_root(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no result reads any more: what came of them is written itself."""
    for table in tables:
        _delete(table.sparkSession, table._written_to)


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


# ---- texts of an Arrow batch -------------------------------------------------


#: Bytes of text that are taken at once: what bounds the memory of a Python worker.
SLICE_BYTES = 1 << 19


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Cuts a string column into runs of rows with about ``limit`` bytes of text each.

    Yields (first row, UTF-8 bytes as uint8, row offsets); null rows have no bytes.
    A row is never divided, so one very long text forms a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:  # a null row may still cover bytes
        lengths = np.diff(offsets) * np.asarray(column.is_valid())
        if lengths.sum() != offsets[-1] - offsets[0]:
            column = column.fill_null("")
            yield from text_slices(column, limit)
            return
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Word starts, ends and rows; ``inside[byte]`` tells the bytes that words consist of."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    edge = np.diff(mask)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word that runs over the end of a row is cut there.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        cuts = cuts[(inside[data[cuts - 1]] != 0) & (inside[data[cuts]] != 0)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def _mixer(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


_BYTE = _mixer(20240501, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of each word: polynomial over a random byte table, taken from prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    value = table[data]
    value *= power[:n]
    np.cumsum(value, out=prefix[1:])
    value = prefix[ends] - prefix[starts]
    value *= inverse[starts]
    return mix64(value + (ends - starts).astype(np.uint64))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those of usual sizes are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    found = []
    for base in (_BASE, _BASE_INVERSE):
        power = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        power[0] = 1
        found.append(np.multiply.accumulate(power, out=power))
    if n <= SLICE_BYTES + 1:
        _POWERS[:] = found
    return found[0], found[1]


def byte_table(of) -> np.ndarray:
    return np.array([1 if of(b) else 0 for b in range(256)], np.int8)


#: Bytes of the words that white space divides, and of the words of letters and digits (either case).
SPACED_BYTES = byte_table(lambda b: not (b == 0x20 or 9 <= b <= 13))
ALNUM_BYTES = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Byte hashes that do not tell A-Z from a-z.
FOLDED = _BYTE.copy()
FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]


def seeded_order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in columns))


def tidy(function):
    """Wraps an Arrow function: at the end of a partition the worker gives free memory back.

    Workers are reused by later stages; what the allocators keep would add up beside the JVM.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run
