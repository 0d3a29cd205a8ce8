"""Exact dedup through a minimal perfect hash over the distinct digests of earlier rows.

``Index shards``: the digests of the historical rows are grouped (one row a digest, with the winner's locator and the
group's size), dealt to shards by digest prefix, and every shard gets a minimal perfect hash: a cascade of bit arrays
in which a digest that has a position to itself settles, while those that collide go on to the next array; the rank of
the settled bit is the slot. A slot holds the full 32-byte digest and the winner's locator, so a look-up is decided by
comparing all bytes and never by the hash alone.

``Probe``: incoming rows are grouped by digest before the shuffle. Members of the index are merged into their slot;
nonmembers stay groups of their own. No text is shuffled, and a digest sends one row a map task, however many copies
it has. Shards hold about ``SHARD_ROWS`` distinct digests, and SHA-256 prefixes spread them evenly. Rows meet their
group by a shuffle of digests, or, for digests that a thousandth of all rows share, by a broadcast of those groups.

Defined results: null text counts as empty; texts are equal when they agree after lower-casing A-Z only; of a group
the row with the largest doc_id stays, a null doc_id being smaller than any other; if that doc_id occurs several times
in the group, exactly one of those rows stays; empty tables give empty results; other columns are carried by
``keep_winners`` and never looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.llm.common import ascii_lower, documents, join_whole
from seqmesh.session import materialise, ship

#: Distinct digests a shard is planned for: about 11 MB of slots.
SHARD_ROWS = 200_000
#: Bits of a level for each digest that has not settled yet.
GAMMA = 2.0

_INDEX = "shard int, sizes binary, bits binary, digests binary, ids binary, tags binary, counts binary"
_GROUPS = "digest binary, keep_id long, keep_tag long, group_size long"


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest (rows of four uint64) at a level."""
    with np.errstate(over="ignore"):
        x = np.full(len(words), 0x9E3779B97F4A7C15 * (2 * level + 1) & (2**64 - 1), dtype=np.uint64)
        for k in range(4):
            x = (x ^ words[:, (k + level) % 4]) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: slot(d) is a bijection onto 0..n-1 on the members."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits, self.ranks, before = sizes, bits, [], 0
        for b in bits:
            self.ranks.append(before + np.cumsum(b, dtype=np.int64) - 1)
            before = int(self.ranks[-1][-1]) + 1 if len(b) else before
        self.n = before

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        sizes, bits, left, level = [], [], words, 0
        while len(left):
            size = max(8, math.ceil(GAMMA * len(left)))
            at = _position(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left, level = left[~alone[at]], level + 1
            if level > 200:
                raise ValueError("digests are not distinct")
        return cls(sizes, bits)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level has its bit; a nonmember may get any slot."""
        out = np.full(len(words), -1, dtype=np.int64)
        left = np.arange(len(words))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(left):
                break
            at = _position(words[left], level, size)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return np.array(self.sizes, dtype="<i8").tobytes(), b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        all_sizes, out, at = np.frombuffer(sizes, dtype="<i8").tolist(), [], 0
        for n in all_sizes:
            step = (n + 7) // 8
            out.append(np.unpackbits(np.frombuffer(bits[at : at + step], dtype=np.uint8), count=n).astype(bool))
            at += step
        return cls(all_sizes, out)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)


def _longs(column: pa.ChunkedArray, null: int) -> np.ndarray:
    return np.asarray(column.fill_null(null).to_numpy(), dtype="<i8")


#: A null doc_id within slots; real ids may be any long above it.
_NULL = -(2**63)


def _build(t: pa.Table) -> pa.Table:
    words = _words(t["digest"])
    hashed = PerfectHash.build(words)
    order = np.argsort(hashed.slots(words))
    sizes, bits = hashed.dump()
    row = {"shard": t["shard"][0].as_py(), "sizes": sizes, "bits": bits, "digests": words[order].tobytes()}
    for name, column in (("ids", "keep_id"), ("tags", "keep_tag"), ("counts", "group_size")):
        row[name] = _longs(t[column], _NULL)[order].tobytes()
    return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *((k, pa.binary()) for k in list(row)[1:])]))


def _probe(index: pa.Table, groups: pa.Table) -> pa.Table:
    """The groups of a shard after the incoming ones have been looked up."""
    if index.num_rows:
        row = index.to_pylist()[0]
        hashed = PerfectHash.load(row["sizes"], row["bits"])
        held = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
        ids, tags, counts = (np.frombuffer(row[k], dtype="<i8").copy() for k in ("ids", "tags", "counts"))
    else:
        hashed, held = PerfectHash([], []), np.zeros((0, 4), dtype="<u8")
        ids = tags = counts = np.zeros(0, dtype="<i8")
    out = []
    if groups.num_rows:
        words = _words(groups["digest"])
        new_ids, new_tags, new_counts = (_longs(groups[k], _NULL) for k in ("keep_id", "keep_tag", "group_size"))
        slot = hashed.slots(words)
        member = slot >= 0
        member[member] = (held[slot[member]] == words[member]).all(axis=1)
        at = slot[member]
        counts[at] += new_counts[member]
        wins = (new_ids[member] > ids[at]) | ((new_ids[member] == ids[at]) & (new_tags[member] > tags[at]))
        ids[at[wins]], tags[at[wins]] = new_ids[member][wins], new_tags[member][wins]
        out.append((words[~member], new_ids[~member], new_tags[~member], new_counts[~member]))
    out.append((held, ids, tags, counts))
    words, ids, tags, counts = (np.concatenate([x[k] for x in out]) for k in range(4))
    whole = np.ascontiguousarray(words).tobytes()
    return pa.table(
        {
            "digest": pa.array([whole[i : i + 32] for i in range(0, len(whole), 32)], pa.binary()),
            "keep_id": pa.array(ids, mask=ids == _NULL),
            "keep_tag": pa.array(tags),
            "group_size": pa.array(counts),
        }
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, tag), written once: the tag tells rows with equal doc_id apart and must not change later."""
    rows = documents(docs).select("doc_id", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"))
    return materialise(rows.withColumn("tag", F.monotonically_increasing_id()), "digests")


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "tag")).alias("w"), F.count(F.lit(1)).alias("group_size"))
    prefix = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return best.select((prefix % shards).cast("int").alias("shard"), "digest", F.col("w.doc_id").alias("keep_id"), F.col("w.tag").alias("keep_tag"), "group_size")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the perfect hash, and by slot the digests, winners' locators and group sizes of ``history``."""
    return _grouped(history, shards).groupBy("shard").applyInArrow(_build, _INDEX)


def probe(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, keep_tag, group_size) of all groups after ``incoming`` has been looked up in ``index``."""
    return index.groupBy("shard").cogroup(_grouped(incoming, shards).groupBy("shard")).applyInArrow(_probe, _GROUPS)


def deduplicate(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, tag.

    The corpus counts as two deliveries: rows below the middle of the doc_id range are history and are indexed, the
    rest (and null doc_ids) come in later and are looked up.
    """
    ship(docs.sparkSession)
    rows = digests(docs)
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    early = F.coalesce(F.col("doc_id") < ((low or 0) + (high or 0)) // 2, F.lit(False))
    index = materialise(build_index(rows.where(early), shards), "perfect-hash")
    groups = materialise(probe(index, rows.where(~early), shards).withColumn("often", F.col("group_size")), "groups")
    return join_whole(rows, groups, "digest", n).select(
        "doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "tag"
    )


def keep_winners(docs: DataFrame) -> DataFrame:
    """``docs`` without repeats: of equal texts the row with the largest doc_id, with all its columns.

    Losers are found again by doc_id and digest. Only if a winner's doc_id stands several times with its text, these
    rows are thinned out to one.
    """
    marked = materialise(deduplicate(docs).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same_id")), "winners")
    lost = marked.where(~F.col("kept") & ~F.col("same_id")).select("doc_id", "digest").distinct()
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    # rows are packed, so that no name of theirs can clash with the keys
    packed = docs.select(F.struct("*").alias("row"), digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    left = packed.join(lost, (packed["digest"] == lost["digest"]) & packed["doc_id"].eqNullSafe(lost["doc_id"]), "left_anti")
    if not marked.where(~F.col("kept") & F.col("same_id")).isEmpty():
        left = left.dropDuplicates(["digest", "doc_id"])
    return left.select("row.*")
