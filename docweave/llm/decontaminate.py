"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_BYTES, FOLDED, text_slices, tidy, word_hashes, words_of

#: Words in a window; bytes of text in a training shard; bytes of benchmark text in one broadcast;
#: bytes of training text that a task holds while it goes through the parts of a large benchmark.
WINDOW, SHARD_BYTES, PHRASE_BYTES, HELD_BYTES = 8, 1 << 20, 4 << 20, 8 << 20


class WaveletRanks:
    """Wavelet matrix: how often a symbol stands before a place, for arrays of both at once."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        first, place = np.zeros_like(place), place.copy()
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            up = (symbol >> level & 1).astype(bool)
            a, b = ones[first], ones[place]
            first, place = np.where(up, zeros + a, first - a), np.where(up, zeros + b, place - b)
        return place - first


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; each 0 is a separator, smaller than all words and unique.

    As a separator ends every comparison, the rounds are bounded by the longest run of words.
    """
    n = len(symbols)
    value = symbols.astype(np.int64)
    parts = value == 0
    value += int(parts.sum())
    value[parts] = np.arange(int(parts.sum()))
    bits = max(1, int(value.max(initial=0)).bit_length())
    done = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(done):  # as many symbols as fit in one integer are sorted in the first round
        key <<= bits
        key[: n - i] |= value[i:] if i < n else 0
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or done >= n:
            return order
        key = rank * (n + 1)
        key[: n - done] += rank[done:] + 1
        done *= 2


class FMIndex:
    """Backward search and location over words numbered from 1; 0 separates runs of words."""

    def __init__(self, symbols: np.ndarray, every: int = 16):
        n = len(symbols)
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.ranks = WaveletRanks(last)
        self.last = last
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1))])
        # Sampled suffixes: every 16th, and all that follow a separator, so that walks stay within a run.
        kept = (order % every == 0) | (last == 0)
        self.sampled = kept
        self.sample_no = np.cumsum(kept) - 1
        self.samples = order[kept]
        self.n = n

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of the suffixes that begin with each row of ``words``."""
        count, length = words.shape
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        live = np.arange(count)
        for j in reversed(range(length)):
            word = words[live, j]
            known = word < len(self.less) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, word = live[known], word[known]
            low[live] = self.less[word] + self.ranks.rank(word, low[live])
            high[live] = self.less[word] + self.ranks.rank(word, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back to the next sampled one and count the steps."""
        place, steps, open_ = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_ := open_[~self.sampled[place[open_]]]):
            word = self.last[place[open_]]
            place[open_] = self.less[word] + self.ranks.rank(word, place[open_])
            steps[open_] += 1
        return self.samples[self.sample_no[place]] + steps


class Phrases:
    """Windows of a part of the benchmark: words by number, windows by length, their items."""

    def __init__(self, items: list[str], lengths: np.ndarray, hashes: np.ndarray, window: int = WINDOW):
        """``items`` in order of their words, so many of each, and all words' hashes."""
        self.hashes, number = np.unique(hashes, return_inverse=True)
        number = number.astype(np.int32) + 1
        self.items = sorted(set(items))
        place = {i: n for n, i in enumerate(self.items)}
        item_no = np.array([place[i] for i in items], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        size = np.minimum(lengths, window)
        self.by_length = []
        for m in np.unique(size[size > 0]).tolist():
            chosen = np.flatnonzero(size == m)
            which, start = expand(first[chosen], first[chosen] + lengths[chosen] - m + 1)
            rows = np.ascontiguousarray(number[start[:, None] + np.arange(m)])
            _, at, window_no = np.unique(rows.view(f"V{4 * m}").ravel(), return_index=True, return_inverse=True)
            owned = np.unique(np.stack([window_no, item_no[chosen[which]]], axis=1), axis=0)
            self.by_length.append((m, rows[at], np.searchsorted(owned[:, 0], np.arange(len(at) + 1)), owned[:, 1]))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by hash; 0 for words that the benchmark does not have."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        if not hasattr(self, "door"):
            self.door = np.zeros(1 << 20, bool)
            self.door[self.hashes >> np.uint64(44)] = True
        out = np.zeros(len(hashes), np.int32)
        may = np.flatnonzero(self.door[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[may]), len(self.hashes) - 1)
        out[may] = np.where(self.hashes[at] == hashes[may], at + 1, 0)
        return out


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) for all members of the ranges [first, last)."""
    length = last - first
    which = np.repeat(np.arange(len(first)), length)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + first[which]


def search_shard(words: np.ndarray, rows: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit mask over words, rows, item numbers): what of ``phrases`` occurs in a shard's words.

    Only runs of benchmark words that are long enough for the shortest window enter the index; no
    window can lie elsewhere.
    """
    none = np.zeros(0, np.int64)
    hit = np.zeros(len(words), bool)
    if not phrases.by_length or not len(words):
        return hit, none, none
    shortest = phrases.by_length[0][0]
    inside = words > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    length = np.bincount(run[inside], minlength=len(heads))
    kept = np.flatnonzero(length >= shortest)
    if not len(kept):
        return hit, none, none
    # Each run, with a separator after it.
    which, place = expand(heads[kept], heads[kept] + length[kept] + 1)
    ends = np.cumsum(length[kept] + 1) - 1
    symbols = words[np.minimum(place, len(words) - 1)]
    symbols[ends] = 0
    index = FMIndex(symbols)
    found_rows, found_items = [], []
    for m, windows, first, owners in phrases.by_length:
        low, high = index.search(windows)
        window, suffix = expand(low, high)
        if not len(window):
            continue
        at = place[index.locate(suffix)]
        for j in range(m):
            hit[at + j] = True
        # An item may own many windows of a row: distinct (row, window) pairs suffice.
        pairs = np.unique(rows[at] * len(windows) + window)
        row, window = np.divmod(pairs, len(windows))
        occurrence, owner = expand(first[window], first[window + 1])
        found_rows.append(row[occurrence])
        found_items.append(owners[owner])
    if not found_rows:
        return hit, none, none
    return hit, np.concatenate(found_rows), np.concatenate(found_items)


_EMPTY = hashlib.sha256(b"").hexdigest()
_ADDED = [("n_words", pa.int64(), T.LongType()), ("n_hit", pa.int64(), T.LongType()), ("n_items", pa.int64(), T.LongType()), ("items_sha256", pa.string(), T.StringType())]


def _held(slices):
    """Runs of text slices of about ``HELD_BYTES``."""
    held, size = [], 0
    for base, data, offsets in slices:
        held.append((base, data, offsets))
        size += len(data)
        if size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searcher(chunks: list, text: str, cut: bool, window: int):
    """The Arrow function: counts for every row; with ``cut``, hit words are cut from the text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Phrases(*chunks[0].value, window) if len(chunks) == 1 else None

        def parts():
            if only is not None:
                yield only
                return
            for chunk in chunks:  # one part of the benchmark in memory at a time
                yield Phrases(*chunk.value, window)
                chunk.__dict__.pop("_value", None)

        for batch in batches:
            n_words, n_hit, n_items = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            digests = [_EMPTY] * batch.num_rows
            texts: dict[int, str] = {}
            column = batch.column(batch.schema.get_field_index(text))
            for held in _held(text_slices(column, SHARD_BYTES)):
                shards = []
                for _, data, offsets in held:
                    starts, ends, rows = words_of(data, offsets, ALNUM_BYTES)
                    shards.append((starts, ends, rows, word_hashes(data, starts, ends, FOLDED), np.zeros(len(rows), bool)))
                items: dict[int, set[str]] = {}
                for phrases in parts():
                    for (base, _, _), (_, _, rows, hashes, hit) in zip(held, shards, strict=True):
                        mask, at, owner = search_shard(phrases.number(hashes), rows, phrases)
                        hit |= mask
                        for r, o in zip(at.tolist(), owner.tolist(), strict=True):
                            items.setdefault(base + r, set()).add(phrases.items[o])
                for r, found in items.items():
                    n_items[r] = len(found)
                    digests[r] = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
                for (base, data, offsets), (starts, ends, rows, _, hit) in zip(held, shards, strict=True):
                    size = len(offsets) - 1
                    n_words[base : base + size] = np.bincount(rows, minlength=size)
                    n_hit[base : base + size] = np.bincount(rows[hit], minlength=size)
                    if cut and hit.any():
                        raw = data.tobytes()
                        bounds = np.searchsorted(rows, np.arange(size + 1))
                        for r in np.unique(rows[hit]).tolist():
                            a, b = bounds[r], bounds[r + 1]
                            texts[base + r] = _cut(raw, int(offsets[r]), int(offsets[r + 1]), starts[a:b], ends[a:b], hit[a:b])
            columns = list(batch.columns)
            if texts:
                i = batch.schema.get_field_index(text)
                columns[i] = pa.array([texts.get(k, v) for k, v in enumerate(column.to_pylist())], column.type)
            added = [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + added, names=[*batch.schema.names, *(n for n, _, _ in _ADDED)])

    return tidy(search)


def _cut(raw: bytes, first: int, last: int, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without its merged removal spans: from the first to the last word of each run of hits."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], first
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        out.append(raw[at : int(starts[a])])
        at = int(ends[b - 1])
    out.append(raw[at:last])
    return b"".join(out).decode()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words): the hashes of each item's words; items without words are left out."""
    for batch in batches:
        for base, data, offsets in text_slices(batch.column(1)):
            starts, ends, rows = words_of(data, offsets, ALNUM_BYTES)
            hashes, bounds = word_hashes(data, starts, ends, FOLDED), np.searchsorted(rows, np.arange(len(offsets)))
            packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(hashes.tobytes())])
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(offsets) - 1), packed], names=["item", "words"])
            yield out.filter(pa.array(np.diff(bounds) > 0))


def phrase_chunks(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = PHRASE_BYTES) -> list:
    """Broadcasts of the benchmark's words, each of about ``limit`` bytes of item text at most.

    Executors hash the words and deal the items into as many partitions as there are parts; the
    driver passes one part after the other on and keeps none, and windows are made where they are
    searched.  A larger benchmark makes more broadcasts, which a task loads in turn, so no memory
    grows with it.  Items with a null id or a null text have no windows; rows that repeat an id are
    one item.
    """
    spark = benchmark.sparkSession
    known = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = known.mapInArrow(_packed, "item string, words binary").repartition(max(1, -(-size // limit)), "item")
    chunks, items, words, held = [], [], [], 0

    def close():
        lengths = np.array([len(w) // 8 for w in words], np.int64)
        chunks.append(spark.sparkContext.broadcast((list(items), lengths, np.frombuffer(b"".join(words), np.uint64))))

    for row in dealt.toLocalIterator():
        if items and held + len(row.words) > 2 * limit:  # a word takes 8 bytes here, about 6 in a text
            close()
            items, words, held = [], [], 0
        items.append(row.item)
        words.append(bytes(row.words))
        held += len(row.words)
    if items or not chunks:
        close()
    for chunk in chunks:
        chunk.__dict__.pop("_value", None)  # written for the executors; the driver keeps no copy
    return chunks


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", cut: bool = False, min_items: int = 2, window: int = WINDOW, limit: int = PHRASE_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated; no shuffle.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole; words within
    an occurrence are hit.  With ``cut`` the merged spans of hit words are cut from the text.
    Null and empty texts have no words and are clean; very long texts are a shard of their own;
    repeated rows are searched each; columns of ``docs`` that have one of the added names are
    replaced; an empty table gives no rows, an empty benchmark leaves all clean.
    """
    docs = docs.drop(*(n for n, _, _ in _ADDED), "contaminated")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, _, t in _ADDED)])
    found = docs.mapInArrow(_searcher(phrase_chunks(benchmark, limit=limit), text, cut, window), schema)
    return found.withColumn("contaminated", F.col("n_items") >= min_items)
