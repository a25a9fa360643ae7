"""Exact deduplication with a cuckoo-filter index over content digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column_name, materialize, tidy

SLOTS, MAX_KICKS = 4, 200
#: Live digests at which a map task hands on what it has folded; rows for which a shuffle partition is made.
FOLD_KEYS, PARTITION_ROWS = 200_000, 250_000


class CuckooIndex:
    """Live digests under 16-bit fingerprints, two candidate buckets each.

    A fingerprint hit is only a hint: it is verified against the whole key stored for that slot.
    Keys can be deleted again.  When an insertion finds no room after ``MAX_KICKS`` moves, the
    table doubles and is filled from the stored keys, so nothing is ever lost to an overflow.
    A key may be any bytes with at least 10 evenly distributed leading bytes (a digest).
    """

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.owner: list[int | None] = []
        self.count = array("q")
        self.free: list[int] = []  # rows of deleted keys, taken again by the next insertions
        self.live = 0
        self.resizes = 0
        self._room(max(2, 1 << (buckets - 1).bit_length()))

    def _room(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.rows = array("q", bytes(8 * SLOTS * buckets))

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 3) & self.mask

    def find(self, key: bytes) -> int:
        """Slot of ``key``, or -1."""
        mark, a = self._print(key), int.from_bytes(key[:8], "little") & self.mask
        for bucket in (a, self._other(a, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[self.rows[slot]] == key:
                    return slot
        return -1

    def _place(self, key: bytes, row: int) -> bool:
        mark, bucket = self._print(key), int.from_bytes(key[:8], "little") & self.mask
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.rows[slot] = mark, row
                    return True
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + row) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            row, self.rows[slot] = self.rows[slot], row
            bucket = self._other(bucket, mark)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.rows[free] = mark, row
                    return True
        return False

    def insert(self, key: bytes, owner: int | None = None, count: int = 1) -> None:
        """Adds a key that is not in the index."""
        if self.free:
            row = self.free.pop()
            self.keys[row], self.owner[row], self.count[row] = key, owner, count
        else:
            row = len(self.keys)
            self.keys.append(key)
            self.owner.append(owner)
            self.count.append(count)
        self.live += 1
        if not self._place(key, row):
            self._resize()

    def _resize(self) -> None:
        kept = [i for i, k in enumerate(self.keys) if k is not None]
        self.keys, self.owner, self.count = [self.keys[i] for i in kept], [self.owner[i] for i in kept], array("q", (self.count[i] for i in kept))
        self.free = []
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._room(buckets)
            if all(self._place(k, i) for i, k in enumerate(self.keys)):
                return

    def delete(self, key: bytes) -> bool:
        """Removes a live key; False if it is not there."""
        slot = self.find(key)
        if slot < 0:
            return False
        row = self.rows[slot]
        self.prints[slot], self.keys[row], self.owner[row] = 0, None, None
        self.free.append(row)
        self.live -= 1
        return True

    def merge(self, key: bytes, owner: int | None, count: int) -> None:
        """Counts a copy.  The entry of an owner that is outranked is deleted and entered anew."""
        slot = self.find(key)
        if slot < 0:
            self.insert(key, owner, count)
            return
        row = self.rows[slot]
        held, total = self.owner[row], self.count[row] + count
        if owner is not None and (held is None or owner > held):
            self.delete(key)
            self.insert(key, owner, total)
        else:
            self.count[row] = total

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        return ((k, self.owner[i], self.count[i]) for i, k in enumerate(self.keys) if k is not None)


_SCHEMA = "digest binary, owner long, copies long"
_ARROW = pa.schema([("digest", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])


def _indexer(most: int | None):
    """Folds digests in an index; one of ``most`` live keys is given out and a new one begun."""

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for key, owner, count in zip(*(batch.column(c).to_pylist() for c in ("digest", "owner", "copies")), strict=True):
                index.merge(key, owner, count)
            if most is not None and index.live >= most:
                yield from _given_out(index)
                index = CuckooIndex()
        yield from _given_out(index)

    return tidy(index_rows)


def _given_out(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    items = index.items()
    while rows := list(islice(items, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def content_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with A-Z lowered; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def digest_index(digests: DataFrame) -> DataFrame:
    """(digest, owner, copies) per distinct digest, from rows of the same columns.

    Each map task folds its copies in an index of its own first, so of a digest that a third of
    all rows share only a few rows per task are shuffled; then one index per shuffle partition.  The
    number of these follows the number of rows, and a map task's index is emptied when it is full, so
    neither grows with the table.
    """
    parts = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // PARTITION_ROWS))
    return digests.mapInArrow(_indexer(FOLD_KEYS), _SCHEMA).repartition(parts, "digest").mapInArrow(_indexer(None), _SCHEMA)


def exact_dedup(docs: DataFrame, digest: str) -> DataFrame:
    """``docs`` with keep_id, group_size and kept; ``digest`` names a column of hex digests.

    Of equal texts the row with the largest doc_id stays.  Rows that repeat a doc_id with the same
    text count each in group_size and, being one document, are kept or dropped alike.  A null doc_id
    never outranks another and is kept only where its whole group is null.  Null text equals empty
    text.  Columns of ``docs`` that have one of the added names are replaced.  An empty table gives
    no rows.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    groups = digest_index(docs.select(F.unhex(digest).alias("digest"), F.col("doc_id").cast("long").alias("owner"), F.lit(1).cast("long").alias("copies")))
    key, owner, size = (column_name(docs, c) for c in ("_digest", "_owner", "_copies"))
    # A lone text needs no partner: only groups travel to the join, where a hot key can be split.
    groups = groups.filter("copies > 1").select(F.lower(F.hex("digest")).alias(key), F.col("owner").alias(owner), F.col("copies").alias(size))
    joined = docs.join(groups, F.col(digest) == F.col(key), "left")
    keep = F.when(F.col(key).isNull(), F.col("doc_id")).otherwise(F.col(owner))
    return joined.select(
        *(F.col(c) for c in docs.columns),
        keep.alias("keep_id"),
        F.coalesce(F.col(size), F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
    )


def dedup_documents(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; texts are read once."""
    digests = materialize(documents.select("doc_id", content_digest(F.col("text")).alias("text_sha256")))
    return exact_dedup(digests, "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
