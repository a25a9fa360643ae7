"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the minimum and the maximum over a document's
shingles, so a signature costs half the hash evaluations of plain MinHash.  Bands of both values
propose buckets; within a bucket, links to its center are checked first, what these leave apart is
compared in blocks.  A sketch of the signature tells which sets need to travel at all; every link is
confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, SPACED_BYTES, _mixer, column_name, discard, materialize, mix64, text_slices, tidy, word_hashes, words_of

#: BANDS bands of PERMUTATIONS permutations each (two values a permutation).  A pair of similarity
#: 0.8 shares no band with probability (1 - 0.8 ** 6) ** 42, below 3 in a million.
BANDS, PERMUTATIONS = 42, 3
#: Members of a bucket that are compared in one task; larger buckets are compared block by block.
BLOCK = 512
#: Agreeing values of two sketches (of 2 * BANDS * PERMUTATIONS) below which the sets are not compared: a
#: pair of similarity 0.8 agrees in 205 on average and falls below with a probability of about 2e-9.  Sets
#: of fewer than SKETCHED shingles are always compared: they are small, and their values vary more.
MIN_AGREE, SKETCHED = 166, 64
#: Largest fixed-size filter of ids that is broadcast, in bits (16 MB).
FILTER_BITS = 1 << 27

_PLACE = _mixer(77, 64) | np.uint64(1)
_XOR = _mixer(91, BANDS * PERMUTATIONS)
_ODD = _mixer(92, BANDS * PERMUTATIONS) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all texts, bounds by text).

    A shingle is ``words`` consecutive words (white space divides them, A-Z count as a-z); a text of
    fewer words, but not none, is one shingle.
    """
    n = len(offsets) - 1
    starts, ends, rows = words_of(data, offsets, SPACED_BYTES)
    h = word_hashes(data, starts, ends, FOLDED)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    m = len(h) - words + 1
    if m > 0:
        value = np.zeros(m, np.uint64)
        for k in range(words):
            value += h[k : k + m] * _PLACE[k]
        inside = rows[:m] == rows[words - 1 :]
        value, owner = mix64(value[inside]), rows[:m][inside]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = np.array([(h[first[r] : first[r + 1]] * _PLACE[32 : 32 + count[r]]).sum(dtype=np.uint64) for r in short], np.uint64)
        value, owner = np.concatenate([value, mix64(whole + _PLACE[63])]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for r in range(n):
        value[bounds[r] : bounds[r + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def _extremes(value: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(permutation, minima, maxima) of the sets that start at ``at``, none of them empty."""
    hashed = np.empty_like(value)
    for p in range(BANDS * PERMUTATIONS):
        np.bitwise_xor(value, _XOR[p], out=hashed)
        np.multiply(hashed, _ODD[p], out=hashed)
        yield p, np.minimum.reduceat(hashed, at), np.maximum.reduceat(hashed, at)


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band keys [texts, BANDS] by min-max hashing; rows of empty sets mean nothing."""
    n = len(bounds) - 1
    full = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((n, BANDS), np.uint64)
    if not len(full):
        return keys
    for p, low, high in _extremes(value, bounds[:-1][full]):
        band = p // PERMUTATIONS
        if p % PERMUTATIONS == 0:
            key = np.full(len(full), band + 1, np.uint64)
        for extreme in (low, high):
            key = mix64(key * _PLACE[40] + extreme)
        keys[full, band] = key
    return keys


def sketches(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[texts, permutations] bytes: the last four bits of each minimum and of each maximum."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, BANDS * PERMUTATIONS), np.uint8)
    if len(full):
        for p, low, high in _extremes(value, bounds[:-1][full]):
            out[full, p] = ((low & np.uint64(15)) << np.uint64(4) | high & np.uint64(15)).astype(np.uint8)
    return out


#: Agreeing halves of two bytes, by their exclusive or.
_HALVES = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Agreeing values of sketches ``x`` and ``y``, row by row."""
    return _HALVES[x ^ y].sum(axis=-1, dtype=np.int64)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * PERMUTATIONS)


_SIGNED = "doc_id long, n long, d1 long, node binary, bands array<long>"


def _digests(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(64 bits, 128 bits) of each set, from sums over its shingles and its size."""
    size = np.diff(bounds).astype(np.uint64)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (value, mix64(value ^ _PLACE[50]))]
    d1, d2 = (mix64(c[bounds[1:]] - c[bounds[:-1]] + size) for c in sums)
    both = np.stack([d1, d2], axis=1).astype(">u8").tobytes()
    return d1.view(np.int64), [both[i : i + 16] for i in range(0, len(both), 16)]


def _signer(words: int, carried: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["doc_id", "n", "d1", "node", "bands", *batch.schema.names[2:]]
            for base, data, offsets in text_slices(batch.column(1)):
                value, bounds = shingle_sets(data, offsets, words)
                n = len(bounds) - 1
                size = np.diff(bounds)
                keys = signatures(value, bounds).view(np.int64)
                d1, node = _digests(value, bounds)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32()), pa.array(keys[size > 0].ravel()))
                extra = [batch.column(2 + k).slice(base, n) for k in range(carried)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, n), pa.array(size.astype(np.int64)), pa.array(d1), pa.array(node, pa.binary()), bands, *extra], names=names)

    return tidy(sign)


def sign_documents(docs: DataFrame, words: int, text: str = "text", version: str | None = None) -> DataFrame:
    """(doc_id, n, d1, node, bands, version): set size, its digests of 64 and 128 bits, band keys.

    ``version`` names a long column of ``docs`` that is passed through.
    """
    columns = [F.col("doc_id").cast("long"), F.col(text)] + ([F.col(version).alias("version")] if version else [])
    return docs.select(*columns).mapInArrow(_signer(words, len(columns) - 2), _SIGNED + (", version long" if version else ""))


# ---- buckets -----------------------------------------------------------------


def bucket_members(able: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, d1, n, center, n_center) of the buckets that hold two or more distinct sets, a row a set.

    center is the bucket's set of the smallest digest: the digest is a hash, so a group of near
    copies has the same center in most of its buckets.  Buckets with the same members are one bucket.
    Least and largest digest, combined in the map tasks, tell the buckets of several sets; a filter of
    fixed size then leaves out most band rows of the others where they are read, so that the rows of
    such buckets are nearly all that the joins shuffle, at every size.
    """
    rows = able.select(F.explode("bands").alias("bucket"), "d1")
    several = rows.groupBy("bucket").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low <> high")
    several = materialize(several.select("bucket"))
    shared, shift = _bitmap(several.select(F.col("bucket").alias("id")), FILTER_BITS, F.col("id"))  # a bucket is a hash

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(2)
            key = bands.flatten().to_numpy(zero_copy_only=False)
            place = key.view(np.uint64) >> np.uint64(shift)
            hit = np.flatnonzero((shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            row = pa.array(np.repeat(np.arange(len(bands)), np.asarray(bands.value_lengths()))[hit])
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), batch.column(0).take(row), batch.column(1).take(row)], names=["bucket", "d1", "n"])

    near = able.select("d1", "n", "bands").mapInArrow(tidy(members_of), "bucket long, d1 long, n long")
    near = materialize(near.join(several, "bucket").distinct())
    kept = near.groupBy("bucket").agg(F.min("d1").alias("center"), F.max("d1").alias("high"), F.count("*").alias("c"), F.sum(F.col("d1").cast("decimal(38,0)")).alias("s"))
    kept = kept.groupBy("center", "high", "c", "s").agg(F.min("bucket").alias("bucket"))
    sizes = classes.select(F.col("d1").alias("center"), F.col("n").alias("n_center"))
    # Written first, so that their true size decides how the join is done.
    buckets = materialize(kept.select("bucket", "center").join(sizes, "center"))
    members = materialize(near.join(buckets, "bucket").distinct())
    discard(several, near, buckets)
    return members


def open_groups(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Comparisons that stars have left: (bucket, i, j, d1, own, component), grouped by (bucket, i, j).

    ``members`` has bucket, d1 and component.  Sets of one component need no comparison, so only
    buckets of several components count.  In these the largest component is the trunk; the others
    are compared with each other and with the trunk, in blocks of ``block`` sets, and the trunk never
    with itself: a member of the trunk is copied once for each block of others.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    stats = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.max("m").alias("top"), F.max_by("component", "m").alias("trunk"))
    stats = stats.filter("k > 1 AND m > 2")  # two members are a star
    others = F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("top")) / block)).cast("int")
    whole = F.col("m") <= block
    stats = materialize(stats.select("bucket", "trunk", whole.alias("whole"), F.when(whole, 1).otherwise(others).alias("others"), F.ceil(F.col("top") / block).cast("int").alias("trunks")))
    dealt = members.join(stats, "bucket")
    in_trunk = ~F.col("whole") & (F.col("component") == F.col("trunk"))
    place = F.xxhash64("d1", "bucket")
    own = F.when(in_trunk, F.col("others") + F.pmod(place, F.col("trunks"))).otherwise(F.pmod(place, F.col("others"))).cast("int")
    last = F.when(in_trunk | F.col("whole"), F.col("others") - 1).otherwise(F.col("others") + F.col("trunks") - 1)
    met = dealt.select("bucket", "d1", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select("bucket", "d1", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _group_partners(m: np.ndarray, own: np.ndarray, components: np.ndarray, marks: np.ndarray, across: bool, percent: int) -> np.ndarray:
    """Members of a group that size and sketch allow a link to a member of another component."""
    order = np.argsort(m, kind="stable")
    m, own, components, marks = m[order], own[order], components[order], marks[order]
    meets = np.zeros(len(m), bool)
    for a in range(len(m) - 1):
        last = int(np.searchsorted(m, m[a] * 100 // percent, "right"))
        rest = np.arange(a + 1, last)
        rest = rest[components[rest] != components[a]]
        if across:
            rest = rest[own[rest] != own[a]]
        if len(rest):
            rest = rest[(m[a] < SKETCHED) | (m[rest] < SKETCHED) | (agreement(marks[a], marks[rest]) >= MIN_AGREE)]
        if len(rest):
            meets[a] = True
            meets[rest] = True
    return order[meets]


_MET = "bucket long, i int, j int, d1 long, own int, component binary"


def partners(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of ``left`` without the members that can have no link in their group, by sketches alone."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)  # all groups but the last are whole
            table = pa.Table.from_batches(held).combine_chunks()
            bounds = _group_bounds(table)
            yield from pick(table.slice(0, bounds[-2]), bounds[:-1])
            held = table.slice(bounds[-2]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from pick(table, _group_bounds(table))

    def pick(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        m, own, i, j = (table[c].to_numpy() for c in ("m", "own", "i", "j"))
        components, marks = np.array(table["component"].to_pylist(), "S16"), _sketch_rows(table["sketch"])
        chosen = [a + _group_partners(m[a:b], own[a:b], components[a:b], marks[a:b], i[a] != j[a], percent) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield from table.drop_columns(["m", "sketch"]).take(pa.array(np.concatenate(chosen))).to_batches()

    rows = left.join(sets.select("d1", "m", "sketch"), "d1").select("bucket", "i", "j", "d1", "own", "component", "m", "sketch")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.mapInArrow(tidy(meet), _MET)


def _group_bounds(table: pa.Table) -> np.ndarray:
    """Starts of the runs of (bucket, i, j), and the end."""
    keys = [table[c].to_numpy() for c in ("bucket", "i", "j")]
    new = np.zeros(len(table) + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        new[1:-1] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _group_links(nodes: list[bytes], own: list[int], components: list[bytes], sets: list[np.ndarray], across: bool, percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs of a group that are linked, as far as no other such pairs connect them already.

    Full sets are compared, so each link holds and a pair may be skipped once it is connected.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    # Numbers of the group's own shingles, so that a small table tells membership.
    distinct, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark = np.zeros(len(distinct), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    found: list[tuple[bytes, bytes]] = []
    owner = np.array(own)[order]
    root = np.unique(np.array([components[k] for k in order], "S16"), return_inverse=True)[1]
    for a in range(len(order) - 1):
        last = int(np.searchsorted(size, size[a] * 100 // percent, "right"))
        if last <= a + 1:
            continue
        rest = np.arange(a + 1, last)
        rest = rest[root[rest] != root[a]]
        if across:
            rest = rest[owner[rest] != owner[a]]
        if not len(rest):
            continue
        mine = flat[bounds[a] : bounds[a + 1]]
        mark[mine] = 1
        if len(rest) == last - a - 1:
            values, at = flat[bounds[a + 1] : bounds[last]], bounds[a + 1 : last] - bounds[a + 1]
        else:
            values = np.concatenate([flat[bounds[k] : bounds[k + 1]] for k in rest])
            at = np.concatenate([[0], np.cumsum(size[rest])[:-1]])
        common = np.add.reduceat(mark[values], at, dtype=np.int64)
        mark[mine] = 0
        both = size[a] + size[rest]
        for k in np.flatnonzero(100 * common >= percent * (both - common)):
            b = int(rest[k])
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                found.append((nodes[order[a]], nodes[order[b]]))
    return found


_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _linker(percent: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, own, components, sets, out = None, [], [], [], [], []

        def close():
            if len(nodes) > 1:
                out.extend(_group_links(nodes, own, components, sets, key[1] != key[2], percent))

        for batch in batches:
            for bucket, i, j, node, mine, component, shingles in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "own", "component", "shingles")), strict=True):
                if key != (bucket, i, j):
                    close()
                    key, nodes, own, components, sets = (bucket, i, j), [], [], [], []
                nodes.append(node)
                own.append(mine)
                components.append(component)
                sets.append(np.frombuffer(shingles, np.uint64))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=_LINK)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=_LINK)

    return tidy(link)


# ---- a filter of fixed size ---------------------------------------------------


def _bitmap(ids: DataFrame, limit: int, spread: Column):
    """(broadcast words, shift): bit spread >>> shift is set for each id (one column, id)."""
    spark = ids.sparkSession
    n = ids.count()
    bits = min(limit, max(1 << 16, 1 << (32 * n - 1).bit_length() if n else 0))
    shift = 64 - (bits - 1).bit_length()
    place = F.shiftrightunsigned(spread, shift)
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b")
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(word).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    return spark.sparkContext.broadcast(table.view(np.uint64)), shift


def filtered(rows: DataFrame, column: str, ids: DataFrame, then, schema, limit: int = FILTER_BITS) -> DataFrame:
    """``then`` (Arrow batch -> batches) on ``rows`` without most of those whose id is not in ``ids``.

    A bitmap of at most ``limit`` bits is broadcast, whatever the number of ids; false hits pass and
    are left to the join that follows.  Filter and function share one Python worker.
    """
    shared, shift = _bitmap(ids, limit, F.xxhash64(F.col("id")))
    place = column_name(rows, "_place")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.schema.get_field_index(place)).to_numpy(zero_copy_only=False)
            hit = (shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            if hit.any():
                yield from then(batch.filter(pa.array(hit)).select([c for c in batch.schema.names if c != place]))

    placed = rows.filter(F.col(column).isNotNull()).withColumn(place, F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), shift))
    return placed.mapInArrow(tidy(keep), schema)


def possibly_in(column: str, ids: DataFrame, limit: int = FILTER_BITS) -> Column:
    """Whether a long ``column`` may be in ``ids`` (one column, id): false only if it is not; null is an id like others.

    The bitmap is that of ``filtered``; only hashes pass Python, so other columns are not copied.
    """
    shared, shift = _bitmap(ids, limit, F.xxhash64(F.col("id")))

    @F.pandas_udf("boolean")
    def hit(place: pd.Series) -> pd.Series:
        p = place.to_numpy()
        return pd.Series((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return hit(F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), shift))


# ---- stars, confirmation and components ---------------------------------------


def full_sets(docs: DataFrame, ids: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(d1, node, m, sketch, shingles): all shingle hashes, sorted, of the texts of ``ids`` and of a few others."""

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_slices(batch.column(1)):
            value, bounds = shingle_sets(data, offsets, words)
            n = len(bounds) - 1
            d1, node = _digests(value, bounds)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(value.tobytes())])
            sketch = pa.array([s.tobytes() for s in sketches(value, bounds)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(node, pa.binary()), pa.array(np.diff(bounds)), sketch, packed], names=["d1", "node", "m", "sketch", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return filtered(rows, "doc_id", ids, sets, "d1 long, node binary, m long, sketch binary, shingles binary")


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, y) of 64-bit digests without those that sketches rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = np.minimum(batch.column(2).to_numpy(), batch.column(3).to_numpy()) < SKETCHED
            near = agreement(_sketch_rows(batch.column(4)), _sketch_rows(batch.column(5))) >= MIN_AGREE
            yield batch.select(["x", "y"]).filter(pa.array(small | near))

    side = lambda k, m, sketch: sets.select(F.col("d1").alias(k), F.col("m").alias(m), F.col("sketch").alias(sketch))
    joined = pairs.join(side("y", "my", "t"), "y").join(side("x", "mx", "s"), "x")
    return joined.select("x", "y", "mx", "my", "s", "t").mapInArrow(tidy(check), "x long, y long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of nodes, from pairs (x, y) of 64-bit digests: those with 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common > 0 and 100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(k: str, node: str, shingles: str) -> DataFrame:
        # Sets that no pair asks for are left out where they are read.
        asked = asked_for(sets, pairs.select(F.col(k).alias("id")).distinct())
        return asked.select(F.col("d1").alias(k), F.col("node").alias(node), F.col("shingles").alias(shingles))

    # The centers first: a hot one meets rows that are still narrow.
    joined = pairs.join(side("y", "b", "t"), "y").join(side("x", "a", "s"), "x").select("a", "b", "s", "t")
    return joined.mapInArrow(tidy(check), "a binary, b binary")


def asked_for(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(d1, node, shingles) of the sets whose 64-bit digests are in ``ids``, and of a few others."""
    return filtered(sets.select("d1", "node", "shingles"), "d1", ids, lambda batch: iter([batch]), "d1 long, node binary, shingles binary")


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(x, y): each set with the center of each of its buckets, once; sizes that rule a link out are left out."""
    apart = members.filter("d1 <> center").filter(100 * F.least("n", "n_center") >= percent * F.greatest("n", "n_center"))
    return apart.select(F.col("d1").alias("x"), F.col("center").alias("y")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest node reachable, for all ids on links, by alternating stars.

    Each round joins every node's neighbours to the least of them; sizes and minima combine in the
    map tasks and every round ends in a table in the shared folder.  Ends when a round changes
    nothing.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    now = state(edges)
    while True:
        # Large star: the larger neighbours of u go to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before the join, so that both its sides are plain tables and a hot node can be split.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: the smaller neighbours of u, and u, go to the least of them.
        large = materialize(large)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = materialize(small)
        discard(edges, large)
        edges = new
        last, now = now, state(edges)
        if last == now:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", block: int = BLOCK, version: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (and ``version``, if named) for every row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``words``-word
    shingles; component_id is the smallest doc_id reachable over links and kept tells whether it is
    the document's own.  What is linked are sets: exact copies are one set from the start, so a group
    of copies that holds a third of all rows costs one member.  Each bucket's sets are first compared
    with its center, which connects most groups in a pass that is linear in members; what a bucket
    then still holds of several components is compared in blocks.  Every comparison is of full sets.

    Null and blank texts have no shingles and are linked with nothing; a null doc_id is a row of its
    own that is never linked but kept; rows that repeat a doc_id are each given out, and each is
    judged by its own text, so another text under a known id joins that text's copies alone; ties of
    doc_id are one id; very long texts are taken whole; other columns play no part; an empty table
    gives no rows.
    """
    signed = materialize(sign_documents(docs, words, text, version))
    able = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # Exact copies are counted in the map tasks; from here on they are one row.
    classes = materialize(able.groupBy("d1", "node", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")))
    members = bucket_members(able, classes)
    # Band keys have done their work; what is kept of each document is narrow.
    banded, signed = signed, materialize(signed.drop("bands", "d1"))
    discard(banded)
    held = materialize(classes.join(members.select("d1").distinct(), "d1", "left_semi").select("d1", "node", F.col("least").alias("id")))
    sets = full_sets(docs, held.select("id"), words, text)
    sets = materialize(sets.join(held.select(F.col("node").alias("held")), F.col("node") == F.col("held"), "left_semi").dropDuplicates(["node"]))
    near = materialize(plausible(star_pairs(members, percent), sets))
    links = materialize(confirm(near, sets, percent).distinct())
    linked = components(links)
    nodes = held.select("d1", "node").join(linked, F.col("node") == F.col("id"), "left").select("d1", "node", F.coalesce("component", "node").alias("component"))
    nodes = materialize(nodes)
    left = materialize(partners(open_groups(members.select("bucket", "d1").join(nodes.select("d1", "component"), "d1"), block), sets, percent))
    wanted = asked_for(sets, left.select(F.col("d1").alias("id")).distinct())
    groups = left.join(wanted, "d1").select("bucket", "i", "j", "node", "own", "component", "shingles")
    groups = groups.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = materialize(groups.mapInArrow(_linker(percent), "a binary, b binary").distinct())
    if not more.isEmpty():
        linked = components(links.unionByName(more))
    # Smallest doc_id of each component; sets without a link form a component of their own.
    named = classes.join(linked, F.col("node") == F.col("id"), "left").select("node", "least", "c", F.col("component"))
    named = materialize(named.filter("c > 1 OR component IS NOT NULL").select("node", "least", F.coalesce("component", "node").alias("component")))
    first = materialize(named.groupBy("component").agg(F.min("least").alias("first")))
    named = materialize(named.join(first, "component").select(F.col("node").alias("node2"), "first"))
    discard(classes, members, held, sets, near, links, nodes, left, more)
    joined = signed.join(named, (F.col("node") == F.col("node2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("first", "doc_id")
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")]
    return joined.select(*out, *([F.col("version").alias(version)] if version else []))
