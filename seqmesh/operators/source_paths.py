"""Shortest paths from blocks of sources, where the edges are few enough to be sent to every task.

A task holds the distances of ``SOURCES`` sources to all vertices, a row for each vertex, and all edges by their heads.
A round looks at the vertices that got shorter for some source: each of their neighbours takes the least of its own
row and theirs plus the edge, until no row changes. With ``delta`` a round expands those alone that lie within it of
the least unexpanded distance. So a block costs edges x sources for each hop, not vertices x vertices x sources, and
nothing but its result is written. Sums are 16 bits wide while they fit, which is checked at the end, else 32.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.operators.tiles import INF

#: Sources of a block, neighbours looked at together, bytes of edges that are sent, and bytes of a block's distances.
SOURCES, TOGETHER, EDGE_BYTES, BLOCK_BYTES = 512, 512, 64 << 20, 64 << 20
#: Sums of 16 bits count from here on as unreachable, until they are found to be too short.
INF16 = 16_383


@dataclass(frozen=True)
class Edges:
    """Edges both ways by their heads: those into vertex v are ``first[v]`` to ``first[v + 1]`` of ``tail`` and ``weight``."""

    first: np.ndarray
    tail: np.ndarray
    weight: np.ndarray


def by_head(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> Edges:
    order = np.argsort(dst, kind="stable")
    first = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(dst, minlength=n), out=first[1:])
    return Edges(first, src[order].astype(np.int32), np.minimum(weight[order], INF).astype(np.int32))


def sent(both: DataFrame, n: int, room: int | None = None) -> Broadcast | None:
    """The edges (src, dst, weight) both ways between ordinals below ``n``, broadcast; None if they are more than ``room`` bytes."""
    room = EDGE_BYTES if room is None else room
    if both.count() * 8 > room:
        return None
    held = both.select(F.col("src").cast("int"), F.col("dst").cast("int"), F.col("weight").cast("long").alias("w"))
    t = held.select("src", "dst", F.least("w", F.lit(INF)).cast("int").alias("w")).toArrow()
    return both.sparkSession.sparkContext.broadcast(by_head(n, *(t[c].to_numpy() for c in ("src", "dst", "w"))))


def distances(edges: Edges, low: int, high: int, delta: int | None = None) -> np.ndarray:
    """The distances from sources low..high-1: a row for each vertex, a column for each source, INF without a path."""
    n, heaviest = len(edges.first) - 1, int(edges.weight.max(initial=0))
    if heaviest < INF16:
        d = _settled(edges, n, low, high, delta, np.int16, INF16)
        real = d < INF16
        # nothing was taken for unreachable that is not: the farthest vertex and any edge stay below the bound
        if int(d.max(where=real, initial=0)) + heaviest < INF16:
            return np.where(real, d, np.int32(INF))
    return _settled(edges, n, low, high, delta, np.int32, INF)


def _settled(edges: Edges, n: int, low: int, high: int, delta: int | None, kind: type, inf: int) -> np.ndarray:
    first, tail, weight = edges.first, edges.tail, edges.weight.astype(kind)[:, None]
    d = np.full((n, high - low), inf, dtype=kind)
    d[np.arange(low, high), np.arange(high - low)] = 0
    room = np.empty((TOGETHER, high - low), dtype=kind)
    open_at = np.full(n, inf, dtype=np.int64)  # by vertex: the least distance that has not been expanded
    open_at[low:high] = 0
    while (least := int(open_at.min(initial=inf))) < inf:
        near = open_at < (inf if delta is None else least + delta)
        open_at[near] = inf
        whole = near.all()
        # the heads of edges from what is expanded
        heads = range(n) if whole else np.flatnonzero(np.bincount(np.repeat(np.arange(n), np.diff(first))[near[tail]], minlength=n)).tolist()
        for v in heads:
            a, b = int(first[v]), int(first[v + 1])
            if a == b:
                continue
            own, shorter = d[v], None
            from_, w = tail[a:b], weight[a:b]
            if not whole:
                some = near[from_]
                from_, w = from_[some], w[some]
            for at in range(0, len(from_), TOGETHER):
                part = from_[at : at + TOGETHER]
                sums = room[: len(part)]
                np.take(d, part, axis=0, out=sums, mode="clip")
                np.add(sums, w[at : at + TOGETHER], out=sums)
                best = sums.min(axis=0)
                less = best < own
                if less.any():
                    np.minimum(own, best, out=own)
                    shorter = less if shorter is None else shorter | less
            if shorter is not None:
                open_at[v] = min(int(open_at[v]), int(own.min(where=shorter, initial=inf)))
    return d


def blocks(n: int, cores: int) -> int:
    """Sources of a block for ``n`` vertices, so that all cores have work and a block's distances fit in."""
    return max(1, min(SOURCES, BLOCK_BYTES // (4 * max(n, 1)), max(32, -(-n // cores))))


def strips(known: Broadcast, n: int, height: int, spark) -> DataFrame:
    """(strip, data): ``height`` rows each of the distances from all vertices, as little-endian int32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("strip").to_pylist():
                m = distances(known.value, s * height, min(n, (s + 1) * height))
                data = np.ascontiguousarray(m.T).astype("<i4", copy=False).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data], pa.binary())], ["strip", "data"])

    return _dealt(spark, -(-n // height)).mapInArrow(run, "strip int, data binary")


def _dealt(spark, count: int) -> DataFrame:
    """(strip): 0 .. count - 1, one to a task."""
    return spark.range(0, count, 1, count).select(F.col("id").cast("int").alias("strip"))


def reached(known: Broadcast, n: int, own: int, spark, delta: int | None = None) -> DataFrame:
    """(i, j, d) of the pairs that have a path from an ordinal i below ``own`` to j below ``n``."""
    height = min(blocks(n, spark.sparkContext.defaultParallelism), max(32, -(-own // spark.sparkContext.defaultParallelism)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("strip").to_pylist():
                m = distances(known.value, s * height, min(own, (s + 1) * height), delta).T
                for at in range(0, len(m), 32):
                    part = m[at : at + 32]
                    i, j = np.nonzero(part < INF)
                    yield pa.RecordBatch.from_arrays([pa.array(i + (s * height + at)), pa.array(j), pa.array(part[i, j], pa.int32())], ["i", "j", "d"])

    return _dealt(spark, -(-own // height)).mapInArrow(run, "i long, j long, d int")
