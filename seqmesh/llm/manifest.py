"""Merkle manifests of a data set by an associative sparse-forest monoid.

Leaves are ordered by group and doc_id; in each group every ``ARITY`` consecutive nodes (the last run may be shorter)
become their hash until one is left, the group's subroot, and the subroots, in the order of the groups, likewise give
the root. A ``Forest`` holds the nodes that some leaves make up but whose siblings are not all there, keyed by tree,
level and index. Two forests merge by putting their nodes together and replacing each sibling run that has become
complete by its parent; since the number of leaves of each tree is known, so is where the last run ends. Merging is
associative, and what is left of all leaves is the root alone: tasks fold their chunks of leaves into forests, and
``treeReduce`` merges those.

A forest also remembers the nodes that crossed a chunk's edge. These are what a proof needs from outside its own chunk;
chunks end at multiples of ``CHUNK`` leaves, so there is about one such node for each 32,768 documents and some forty
for each task, and they are broadcast for the second pass, in which every chunk proves its own leaves.

Defined results: a null field is hashed as ``-``; groups and doc_ids that are null come first; rows with equal doc_id
stand in the order of their leaves' hashes; a null doc_id is not tampered with; an empty table has no root and no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmesh.operators.order import numbered
from seqmesh.session import materialise, ship

ARITY, CHUNK = 2, 1 << 16
#: Rows of the table of segments (one for each task and each group) up to which it is broadcast.
SEGMENTS = 100_000
#: The tree whose leaves are the subroots.
TOP = -1
_SHA = 32


def digest(parts: list[bytes]) -> bytes:
    """The SHA-256 of digests put together as hex text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def width(leaves: int, level: int) -> int:
    """How many nodes a tree has on a level."""
    return -(-leaves // ARITY**level)


class Forest:
    """Unresolved nodes of the trees: ``open`` by (tree, level, index), ``edge`` what was ever open, ``leaves`` by tree."""

    def __init__(self, leaves: dict[int, int]):
        self.leaves, self.open, self.edge = dict(leaves), {}, {}

    def put(self, node: tuple[int, int, int], value: bytes) -> None:
        """Take up a node and resolve what it completes."""
        self.open[node] = self.edge[node] = value
        while True:
            tree, level, index = node
            wide = width(self.leaves[tree], level)
            if wide == 1:
                if tree == TOP:
                    return
                # the subroot of a group is a leaf of the tree of groups
                value, node = self.open.pop(node), (TOP, 0, tree)
            else:
                first = index - index % ARITY
                run = [(tree, level, k) for k in range(first, min(first + ARITY, wide))]
                if any(k not in self.open for k in run):
                    return
                value, node = digest([self.open.pop(k) for k in run]), (tree, level + 1, index // ARITY)
            self.open[node] = self.edge[node] = value

    def merge(self, other: Forest) -> Forest:
        self.leaves |= other.leaves
        self.edge |= other.edge
        for node, value in other.open.items():
            self.put(node, value)
        return self


def climb(first: int, data: bytes, leaves: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, bytes]]]:
    """(levels, open nodes) of consecutive leaves from index ``first`` on.

    A level is (index of its first node, digests laid end to end) and holds the nodes made of these leaves alone; an
    open node (level, index, digest) is one whose parent is not.
    """
    levels, loose = [(first, data)], []
    while (wide := width(leaves, len(levels) - 1)) > 1:
        level, (first, data) = len(levels) - 1, levels[-1]
        end = first + len(data) // _SHA
        low = -(-first // ARITY) * ARITY
        high = end if end == wide else end - end % ARITY
        high = max(high, low) if low <= end else low

        def node(k: int, data: bytes = data, first: int = first) -> bytes:
            return data[(k - first) * _SHA : (k - first + 1) * _SHA]

        loose += [(level, k, node(k)) for k in (*range(first, min(low, end)), *range(high, end))]
        if low >= high:
            return levels, loose
        made = b"".join([digest([node(i) for i in range(k, min(k + ARITY, high))]) for k in range(low, high, ARITY)])
        levels.append((low // ARITY, made))
    return levels, [*loose, (len(levels) - 1, 0, levels[-1][1])]


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: list[Column]) -> Column:
    """The hash of a row's fields, each with its length in bytes before it, as lower-case hex."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


_CHUNK = "trees array<int>, firsts array<long>, counts array<long>, leaves array<long>, doc_ids array<long>, hashes binary, others binary"


def _chunked(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of _CHUNK from ordered leaves: consecutive ones, of one group or of several small ones."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        t = pa.Table.from_batches(held)
        tree, index, n = (t.column(c).to_numpy() for c in ("tree", "index", "n"))
        cut = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (index[1:] != index[:-1] + 1)])
        lists = [tree[cut].tolist(), index[cut].tolist(), np.diff(cut, append=len(tree)).tolist(), n[cut].tolist(), t.column("doc_id").to_pylist()]
        kinds = [pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 4]
        data = [b"".join(t.column(c).to_pylist()) for c in ("leaf", "other")]
        held, size = [], 0
        return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(lists, kinds, strict=True)), *(pa.array([d], pa.binary()) for d in data)], ["trees", "firsts", "counts", "leaves", "doc_ids", "hashes", "others"])

    for b in batches:
        index = b.column("index").to_numpy()
        at = 0
        for k in [*np.flatnonzero((index > 0) & (index % chunk == 0)).tolist(), len(b)]:
            while at < k:
                part = b.slice(at, min(k - at, chunk - size))
                held.append(part)
                size, at = size + len(part), at + len(part)
                if size >= chunk or at == k < len(b):
                    yield flush()
            if at == k < len(b) and held:
                yield flush()
    if held:
        yield flush()


def _segments(trees: list, firsts: list, counts: list, leaves: list, data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    at = 0
    for tree, first, count, n in zip(trees, firsts, counts, leaves, strict=True):
        yield tree, first, n, data[at * _SHA : (at + count) * _SHA]
        at += count


def _of_chunk(row, groups: int, data: bytes) -> tuple[Forest, list]:
    """A chunk's forest with all of its own nodes in ``edge``, and each segment's levels."""
    found, levels = Forest({TOP: groups, **dict(zip(row["trees"], row["leaves"], strict=True))}), []
    for tree, first, n, part in _segments(row["trees"], row["firsts"], row["counts"], row["leaves"], data):
        own, loose = climb(first, part, n)
        levels.append(own)
        for level, index, value in loose:
            found.put((tree, level, index), value)
    return found, levels


def _folded(groups: int):
    def run(rows: Iterable) -> Iterator[Forest]:
        whole = Forest({TOP: groups})
        for row in rows:
            part, _ = _of_chunk(row, groups, bytes(row["hashes"]))
            part.edge = dict(part.open)
            whole.merge(part)
        yield whole

    return run


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _proved(shared, groups: int):
    """Each chunk's leaves with their proofs, folded anew from the leaf that ``others`` has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = shared.value
        root = edge[TOP, next(k for k in range(64) if width(groups, k) == 1), 0].hex()
        for row in (r for b in batches for r in b.to_pylist()):
            local, levels = _of_chunk(row, groups, row["hashes"])
            local = local.edge
            others, at, out = row["others"], 0, []
            for (tree, first, n, data), own in zip(_segments(row["trees"], row["firsts"], row["counts"], row["leaves"], row["hashes"]), levels, strict=True):
                ways: dict[tuple[int, int, int], tuple] = {}

                def node(t: int, level: int, k: int, tree: int = tree, own: list = own) -> str:
                    if t == tree and level < len(own):
                        start, made = own[level]
                        if 0 <= k - start < len(made) // _SHA:
                            return made[(k - start) * _SHA : (k - start + 1) * _SHA].hex()
                    return (local.get((t, level, k)) or edge[t, level, k]).hex()

                def way(t: int, level: int, k: int, n: int = n, ways: dict = ways, tree: int = tree, node=node) -> tuple:
                    """From a node to the root: for each level the siblings to the left and to the right, as hex text."""
                    found = ways.get((t, level, k))
                    if found is None:
                        wide = width(groups if t == TOP else n, level)
                        if wide == 1:
                            found = () if t == TOP else way(TOP, 0, tree)
                        else:
                            low = k - k % ARITY
                            sides = ["".join([node(t, level, i) for i in r]) for r in (range(low, k), range(k + 1, min(low + ARITY, wide)))]
                            found = ((*sides,), *way(t, level + 1, k // ARITY))
                        if level or t == TOP:
                            ways[t, level, k] = found
                    return found

                subroot = node(TOP, 0, tree)
                for k in range(len(data) // _SHA):
                    path = way(tree, 0, first + k)
                    proof = hashlib.sha256("".join([x + y for x, y in path]).encode()).hexdigest()
                    now = others[(at + k) * _SHA : (at + k + 1) * _SHA].hex()
                    for x, y in path:
                        now = hashlib.sha256((x + now + y).encode()).hexdigest()
                    out.append((data[k * _SHA : (k + 1) * _SHA].hex(), subroot, root, proof, now))
                at += len(data) // _SHA
            for i in range(0, len(out), 8192):
                part = list(zip(*out[i : i + 8192], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][i : i + 8192], pa.int64()), *(pa.array(c, pa.string()) for c in part)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def _placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(tree, index, n, doc_id, leaf, other) of every leaf in order within its task, and the number of groups."""
    order = [F.col("tag"), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = materialise(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "manifest-ordered")
    part = F.shiftright("_at", 33)
    # one row for each task and group: how many leaves the tasks before hold of the group
    held = rows.groupBy(part.alias("part"), "tag").agg(F.count(F.lit(1)).alias("count"), F.min("_at").alias("start"))
    group = Window.partitionBy("tag")
    before = F.coalesce(F.sum("count").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("part", "tag", "start", before.alias("before"), F.sum("count").over(group).alias("n"))
    trees = numbered(held.select("tag").distinct(), ["tag"], "tree")
    segments = materialise(held.join(trees, "tag"), "manifest-segments")
    many, groups = segments.agg(F.count(F.lit(1)), F.max("tree")).first()
    if not many:
        return rows, 0
    small = F.broadcast(segments) if many <= SEGMENTS else segments
    found = rows.withColumn("part", part).join(small, ["part", "tag"])
    placed = found.select(F.col("tree").cast("int").alias("tree"), (F.col("before") + F.col("_at") - F.col("start")).alias("index"), "n", "doc_id", "leaf", "other")
    return placed.sortWithinPartitions("tree", "index"), groups + 1


def manifest(rows: DataFrame, group: str, fields: list[str], changed: dict[str, Column] | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` are hashed in this order. ``changed`` gives other values of some fields; the leaf made of those is what
    is folded with the original siblings, and a row is verified if that gives the root.
    """
    spark = rows.sparkSession
    ship(spark)
    now = [(changed or {}).get(c, F.col(c)) for c in fields]
    # null before any text, and texts in the order of their bytes
    tag = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group)))
    leaves = rows.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), F.unhex(leaf_hash([F.col(c) for c in fields])).alias("leaf"), F.unhex(leaf_hash(now)).alias("other"))
    placed, groups = _placed(materialise(leaves, "manifest-leaves"))
    if not groups:
        return spark.createDataFrame([], _PROVED).withColumn("verified", F.col("folded_root") == F.col("root"))
    chunks = materialise(placed.mapInArrow(functools.partial(_chunked, chunk=chunk), _CHUNK), "manifest-chunks")
    whole = chunks.select("trees", "firsts", "counts", "leaves", "hashes").rdd.mapPartitions(_folded(groups)).treeReduce(Forest.merge)
    shared = spark.sparkContext.broadcast(whole.edge)
    return chunks.mapInArrow(_proved(shared, groups), _PROVED).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The manifest of documents by language, checked against a copy in which one in seven rows has another n_chars."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0
    other = F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars").cast("long") + 1).otherwise(F.col("n_chars").cast("long"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    return manifest(plain, "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": other}, chunk)
