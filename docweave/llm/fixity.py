"""WARC fixity audit: Merkle trees over records and ordered offset ranges of two replicas.

A volume (a WARC file) holds ``VOLUME_IDS`` slots of records.  Its tree has the records as leaves,
``FANOUT`` of them under a node, and ``FANOUT`` nodes under the root; ``VOLUME_IDS`` volumes form a
shelf, whose digest stands above their roots.  Each node covers an ordered range of offsets: it hashes
the places, lengths and digests of its children, so it vouches for their order and extent too.  Places
count from the node's own start, so a lost record changes the branch above it and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Children of a node (2 ** 5) and slots of a volume by id, as many as two levels of nodes hold.
FANOUT_BITS = 5
FANOUT, VOLUME_IDS = 1 << FANOUT_BITS, 1 << 2 * FANOUT_BITS


def warc_record(url: Column, body: Column) -> Column:
    """A resource record of WARC/1.1: header, empty line, body, two line ends.  Nulls count as empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(id, n_records, n_bytes, digest) of each id: the trees' leaves.

    A leaf of one record has that record's SHA-256.  Rows that repeat an id share a leaf whose
    digest combines counts and sums of their digests, so a hot id is folded in the map tasks.  A
    null id is id -1.
    """
    record = warc_record(F.col(url), F.col(body))
    rows = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("id"), F.octet_length(record).cast("long").alias("b"), F.sha2(record, 256).alias("d"))
    piece = lambda i: F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}")
    folded = rows.groupBy("id").agg(F.count("*").alias("n_records"), F.sum("b").alias("n_bytes"), F.min("d").alias("d"), *map(piece, range(4)))
    many = F.sha2(F.concat_ws(":", F.col("n_records").cast("string"), *(F.col(f"p{i}").cast("string") for i in range(4))), 256)
    return folded.select("id", "n_records", "n_bytes", F.when(F.col("n_records") == 1, F.col("d")).otherwise(many).alias("digest"))


def volume_of(identity: Column) -> Column:
    """Volume of an id; the shift rounds down for negative ids and is exact for all of 64 bits."""
    return F.shiftright(identity, 2 * FANOUT_BITS)


def _ranged(children: Column) -> Column:
    """Children (array of structs with n_bytes, in order) with start and stop: their offsets from the parent's start."""
    stop = lambda i: F.aggregate(F.slice(children, 1, i), F.lit(0).cast("long"), lambda total, c: total + c["n_bytes"])
    return F.transform(children, lambda c, i: F.struct(c.alias("of"), stop(i).alias("start"), (stop(i) + c["n_bytes"]).alias("stop")))


def _digest(ranged: Column, key: str) -> Column:
    """SHA-256 over key, range and digest of the children, in order."""
    line = lambda r: F.concat_ws(":", r["of"][key].cast("string"), r["start"].cast("string"), r["stop"].cast("string"), r["of"]["digest"])
    return F.sha2(F.array_join(F.transform(ranged, line), ","), 256)


def trees(table: DataFrame) -> DataFrame:
    """(shelf, volume, n_bytes, digest, nodes): a row a volume, from leaves.

    nodes: array of structs of (of: node, n_bytes, digest, leaves; start, stop), leaves likewise of
    (of: id, n_records, n_bytes, digest; start, stop).  A volume has at most ``VOLUME_IDS`` leaves,
    whatever the ids and their number, so a row is bounded; both groupings share one exchange.
    """
    placed = table.withColumns({"volume": volume_of(F.col("id")), "node": F.shiftright("id", FANOUT_BITS)}).repartition("volume")
    inner = placed.groupBy("volume", "node").agg(F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("id", "n_records", "n_bytes", "digest"))).alias("c"))
    inner = inner.withColumn("leaves", _ranged(F.col("c"))).select("volume", "node", "n_bytes", _digest(F.col("leaves"), "id").alias("digest"), "leaves")
    grouped = inner.groupBy("volume").agg(F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("node", "n_bytes", "digest", "leaves"))).alias("c"))
    ranged = grouped.withColumn("nodes", _ranged(F.col("c")))
    return ranged.select(F.shiftright("volume", 2 * FANOUT_BITS).alias("shelf"), "volume", "n_bytes", _digest(F.col("nodes"), "node").alias("digest"), "nodes")


def shelves(volumes: DataFrame) -> DataFrame:
    """(shelf, digest): the level above the volumes' roots, ``VOLUME_IDS`` volumes at most each."""
    grouped = volumes.groupBy("shelf").agg(F.array_sort(F.collect_list(F.struct("volume", "n_bytes", "digest"))).alias("c"))
    return grouped.select("shelf", _digest(_ranged(F.col("c")), "volume").alias("digest"))


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    right = b.select(F.col(key).alias("key2"), F.col("digest").alias("digest2"))
    both = a.select(key, "digest").join(right, F.col(key) == F.col("key2"), "full_outer").filter(~F.col("digest").eqNullSafe(F.col("digest2")))
    return both.select(F.coalesce(key, "key2").alias("bad"))


def locate(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, digest, digest2) of the leaves that differ, from the trees of two replicas.

    Shelf digests are compared first, of differing shelves the volumes' roots, of differing volumes
    the nodes and of differing nodes the leaves; equal branches are never descended into.
    """
    bad = materialize(_differing(shelves(mine), shelves(theirs), "shelf"))
    below = [t.join(bad, F.col("shelf") == F.col("bad"), "left_semi") for t in (mine, theirs)]
    bad = materialize(_differing(*below, "volume"))
    nodes = [t.join(bad, F.col("volume") == F.col("bad"), "left_semi").select(F.inline("nodes")).select("of.node", "of.digest", "of.leaves") for t in (mine, theirs)]
    right = nodes[1].select(F.col("node").alias("node2"), F.col("digest").alias("digest2"), F.col("leaves").alias("leaves2"))
    apart = nodes[0].join(right, F.col("node") == F.col("node2"), "full_outer").filter(~F.col("digest").eqNullSafe(F.col("digest2")))
    entries = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(right.schema["leaves2"].dataType)), lambda r: F.struct(r["of"]["id"].alias("key"), r["of"]["digest"].alias("value")))
    pair = apart.select(F.map_from_entries(entries("leaves")).alias("a"), F.map_from_entries(entries("leaves2")).alias("b"))
    each = pair.select(F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))).alias("id"), "a", "b")
    found = each.select("id", F.try_element_at("a", F.col("id")).alias("digest"), F.try_element_at("b", F.col("id")).alias("digest2"))
    return found.filter(~F.col("digest").eqNullSafe(F.col("digest2")))


def audit(pages: DataFrame, replica: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """A row for each id of either replica: volume, offset, n_records, n_bytes, digest, replica_digest, status.

    offset is where the leaf's range begins in its volume.  status is ok, corrupt, missing (from
    ``replica``) or extra (in ``replica`` alone, with null offset and sizes).  Null url or body counts
    as empty; a null id is id -1; rows that repeat an id, the same record or another, are audited as
    one leaf, of which ties are no case; long bodies are hashed whole; other columns, whatever their
    names, play no part; two empty tables give no rows.
    """
    mine, theirs = (materialize(trees(leaves(t, key, url, body))) for t in (pages, replica))
    found = materialize(locate(mine, theirs)).select(F.col("id").alias("bad"), "digest", "digest2")
    rows = mine.select("volume", F.inline("nodes")).select("volume", F.col("start").alias("base"), F.inline("of.leaves"))
    placed = rows.select("of.id", "volume", (F.col("base") + F.col("start")).alias("offset"), "of.n_records", "of.n_bytes", "of.digest")
    faults = found.filter("digest IS NOT NULL").select("bad", "digest2")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("digest2").isNull(), "missing").otherwise("corrupt")
    replicated = F.when(F.col("bad").isNull(), F.col("digest")).otherwise(F.col("digest2"))
    held = placed.join(faults, F.col("id") == F.col("bad"), "left").select(F.col("id").alias("page_id"), "volume", "offset", "n_records", "n_bytes", "digest", replicated.alias("replica_digest"), status.alias("status"))
    none = F.lit(None).cast("long")
    extra = found.filter("digest IS NULL").select(
        F.col("bad").alias("page_id"), volume_of(F.col("bad")).alias("volume"), none.alias("offset"), none.alias("n_records"), none.alias("n_bytes"), "digest", F.col("digest2").alias("replica_digest"), F.lit("extra").alias("status")
    )
    return held.unionByName(extra)


def faulty_replica(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """A second replica with known faults, by the digest of the url: one in 256 bodies altered, one in 256 records lost."""
    mark = F.substring(F.sha2(F.coalesce(F.col(url), F.lit("")), 256), 1, 2)
    altered = F.when(mark == "00", F.concat(F.coalesce(F.col(body), F.lit("")), F.lit("~"))).otherwise(F.col(body))
    return pages.filter(mark != "ff").withColumn(body, altered)
