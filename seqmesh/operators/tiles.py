"""Shortest paths on two-dimensional tiles.

The distance matrix is symmetric: it is a table of square tiles (bi, bj, far, data) with bi <= bj, ``side`` x ``side`` numbers
each, compressed; ``far`` is the largest real distance in it, and a tile in which nothing is reachable is no row. Work is
dealt to the processes of a grid: tile (bi, bj) belongs to ``block_owner(bi, bj)``, the tiles of a left factor go to the
owners of their row of the grid and those of a right factor to the owners of their column, so one shuffle brings an owner
exactly the panels that it needs. An owner holds its own tiles, at most ``OWNED`` bytes, and the panel slices of
``AT_ONCE`` middle vertices at a time: panels arrive sorted by the middle index.

The closure goes by halves: the paths within the first half of the vertices, then the panel between the halves, then the
second half with paths through the first, then the panel again, and the first half with paths through the second. A range
of at most ``leaf`` vertices is closed by one task. So a graph of n vertices takes n / leaf closures and four jobs for each
halving, and all that is written adds up to a few times n x n, where one round for each pivot block would write n x n
every time. Nothing that grows with n is broadcast, collected or closed on the driver. Each step is a table in the
shared folder; superseded ones are deleted, and so are the files of a step's shuffle.

Numbers are of one byte where the edges are light, and of two or four where the farthest vertices turn out to be too far
for that (``KINDS``). A middle vertex is looked at for a row only if the row's distance to it and its own least distance
come to less than the row's largest, for no other can make the row shorter: of dense graphs that is few.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmesh.functions.distance import block_owner
from seqmesh.session import discard, materialise, ship

#: Path sums from here on count as unreachable.
INF = 1_000_000_000
#: Vertices to a tile's side, vertices that one task closes at most, and bytes of own tiles that an owner holds.
SIDE, LEAF, OWNED = 512, 2048, 96 << 20
#: Middle vertices that meet an owner's tiles together, columns of a row looked at together, and middle vertices of a row.
AT_ONCE, WIDE, TOGETHER = 1024, 4096, 64
#: How distances are kept, and from where on they count as unreachable until that is found to be too short.
KINDS = (("<u1", 127), ("<i2", 16_383), ("<i4", INF))
_TILE = "bi int, bj int, far int, data binary"
_UNTIL = dict(KINDS)


@dataclass(frozen=True)
class Grid:
    """The processes that tiles are dealt to."""

    rows: int
    cols: int

    @staticmethod
    def of(height: int, width: int, side: int, cores: int, size: int = 4) -> Grid:
        """A grid for ``height`` x ``width`` tiles of ``size`` bytes a number: enough owners for all cores, more where an owner would hold too much."""
        most = max(1, math.isqrt(OWNED // (size * side * side)))
        root = math.isqrt(max(cores, 1) - 1) + 1
        return Grid(*(min(n, max(root, -(-n // most))) for n in (height, width)))


@dataclass
class Tiles:
    """A matrix of ``n`` x ``n`` distances between ordinals, the same both ways, as tiles on and above the diagonal."""

    table: DataFrame
    n: int
    side: int
    kind: str = "<i4"

    @property
    def across(self) -> int:
        return -(-self.n // self.side)

    @property
    def inf(self) -> int:
        """From here on a number means that there is no path."""
        return _UNTIL[self.kind]


def array(data: bytes, side: int, kind: str) -> np.ndarray:
    """A tile's numbers."""
    return np.frombuffer(pa.decompress(data, side * side * np.dtype(kind).itemsize, "zstd"), dtype=kind).reshape(side, side)


def _row(bi: int, bj: int, m: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """The row of a tile whose numbers are below or at the bound, none if nothing is reachable."""
    if (real := m < _UNTIL[kind]).any():
        far = int(m.max(where=real, initial=0))
        data = pa.compress(np.ascontiguousarray(m, dtype=kind), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([far], pa.int32()), pa.array([data], pa.binary())], ["bi", "bj", "far", "data"])


def held(batches: Iterable[pa.RecordBatch], side: int, kind: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bi, bj, numbers) of each row."""
    for batch in batches:
        for bi, bj, data in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("data"), strict=True):
            yield bi, bj, array(data.as_buffer(), side, kind)


def to_tiles(edges: DataFrame, n: int, side: int = SIDE) -> Tiles:
    """The tiles of edges (src, dst, weight) both ways between ordinals below ``n``; the diagonal is 0."""
    ship(edges.sparkSession)
    across, cells, kind = -(-n // side), side * side, "<i4"

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m = -1, None

        def done() -> Iterator[pa.RecordBatch]:
            if m is not None:
                bi, bj = divmod(at, across)
                if bi == bj:
                    np.minimum(m, m.T.copy(), out=m)
                    np.fill_diagonal(m, 0)
                yield from _row(bi, bj, m, kind)

        for b in batches:
            place, d = b.column("place").to_numpy(), b.column("d").to_numpy()
            tile = place // cells
            first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else []
            for i, j in zip(first, [*first[1:], len(tile)], strict=True):
                if int(tile[i]) != at:
                    yield from done()
                    at, m = int(tile[i]), np.full((side, side), INF, dtype=kind)
                np.minimum.at(m.reshape(-1), place[i:j] - at * cells, d[i:j])
        yield from done()

    bi, bj = (F.expr(f"{c} div {side}") for c in ("src", "dst"))
    place = (bi * across + bj) * cells + F.col("src") % side * side + F.col("dst") % side
    once = edges.where("src < dst").select(place.alias("place"), F.least(F.col("weight").cast("long"), F.lit(INF)).cast("int").alias("d"))
    # every tile on the diagonal is there, by an edge from its first vertex to itself
    diagonal = edges.sparkSession.range(across).select((F.col("id") * (across + 1) * cells).alias("place"), F.lit(0).alias("d"))
    # a tile's edges come one after another and are met as they come, however many are parallel
    tile = F.expr(f"place div {cells}")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Tiles(once.unionByName(diagonal).repartition(parts, tile).sortWithinPartitions(tile).mapInArrow(build, _TILE), n, side, kind)


def narrowed(tiles: Tiles, kind: str) -> Tiles:
    """The tiles with numbers of another kind."""
    side, given, until = tiles.side, tiles.kind, min(tiles.inf, _UNTIL[kind])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, m in held(batches, side, given):
            yield from _row(bi, bj, np.where(m < until, m, _UNTIL[kind]).astype(kind), kind)

    return Tiles(tiles.table.mapInArrow(run, _TILE), tiles.n, side, kind)


def _through(into: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """into = min(into, min-plus product of a and b), for numbers at or below their kind's bound."""
    room = np.empty((min(TOGETHER, len(b)), min(WIDE, into.shape[1])), dtype=into.dtype)
    for low in range(0, into.shape[1], WIDE):
        part, right = into[:, low : low + WIDE], b[:, low : low + WIDE]
        right = np.ascontiguousarray(right)
        near = a + right.min(axis=1) < part.max(axis=1)[:, None]
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            middle, own = np.flatnonzero(near[r]), part[r]
            for at in range(0, len(middle), TOGETHER):
                some = middle[at : at + TOGETHER]
                sums = room[: len(some), : len(own)]
                if len(own) == room.shape[1]:
                    np.take(right, some, axis=0, out=sums, mode="clip")
                else:
                    sums = right[some]
                np.add(sums, a[r, some, None], out=sums)
                np.minimum(own, sums.min(axis=0), out=own)


def _relaxed(side: int, kind: str, grid: Grid, cols: tuple[int, int], upper: bool):
    """An owner's tiles with all paths through the panels, which come in order of the middle index."""
    inf = _UNTIL[kind]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        left: dict[tuple[int, int], np.ndarray] = {}
        right: dict[tuple[int, int], np.ndarray] = {}
        middle: list[int] = []
        owner, mine = None, []

        def rows(bi: int) -> np.ndarray:
            if bi not in own:
                own[bi] = np.full((side, len(mine) * side), inf, dtype=kind)
            return own[bi]

        def meet() -> None:
            if left and right:
                at = {k: slice(x * side, (x + 1) * side) for x, k in enumerate(middle)}
                place = {bj: slice(x * side, (x + 1) * side) for x, bj in enumerate(mine)}
                b = np.full((len(middle) * side, len(mine) * side), inf, dtype=kind)
                for (k, bj), m in right.items():
                    b[at[k], place[bj]] = m
                for bi in sorted({bi for bi, _ in left}):
                    first = sum(bj < bi for bj in mine) * side if upper else 0
                    if first < b.shape[1]:
                        a = np.full((side, len(middle) * side), inf, dtype=kind)
                        for k in middle:
                            if (bi, k) in left:
                                a[:, at[k]] = left[bi, k]
                        _through(rows(bi)[:, first:], a, b[:, first:])
            left.clear()
            right.clear()
            middle.clear()

        def done() -> Iterator[pa.RecordBatch]:
            meet()
            for bi, m in own.items():
                np.minimum(m, inf, out=m)
                for x, bj in enumerate(mine):
                    if not upper or bi <= bj:
                        yield from _row(bi, bj, m[:, x * side : (x + 1) * side], kind)
            own.clear()

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("owner", "k", "kind", "bi", "bj", "flip")]
            for o, k, what, bi, bj, flip, data in zip(*lists, batch.column("data"), strict=True):
                if o != owner:
                    yield from done()
                    owner, mine = o, [x for x in range(*cols) if x % grid.cols == o % grid.cols]
                m = array(data.as_buffer(), side, kind)
                m = m.T if flip else m
                if what == 0:
                    x = mine.index(bj) * side
                    rows(bi)[:, x : x + side] = m
                    continue
                if k not in middle:
                    if len(middle) * side >= AT_ONCE:
                        meet()
                    middle.append(k)
                if what == 1:
                    left[bi, k] = m
                else:
                    right[k, bj] = m
        yield from done()

    return run


def _flipped(t: DataFrame) -> DataFrame:
    """Tiles below the diagonal, by those above it."""
    return t.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "data", F.lit(True).alias("flip"))


def _given(t: DataFrame) -> DataFrame:
    return t.select("bi", "bj", "data", F.lit(False).alias("flip"))


def _whole(t: DataFrame) -> DataFrame:
    """The tiles of a symmetric matrix, by those on and above its diagonal."""
    return _given(t).unionByName(_flipped(t.where("bi < bj")))


def relax(into: DataFrame, left: DataFrame, right: DataFrame, cols: tuple[int, int], grid: Grid, side: int, kind: str, upper: bool = False) -> DataFrame:
    """Tiles of min(into, left x right), the product over min and plus, in tile columns ``cols``; with ``upper`` those on and above the diagonal alone."""
    ship(left.sparkSession)

    def row(t: DataFrame, owner: Column, k: Column, what: int) -> DataFrame:
        return t.select(owner.cast("int").alias("owner"), k.alias("k"), F.lit(what).alias("kind"), "bi", "bj", "flip", "data")

    bi, bj = F.col("bi"), F.col("bj")
    over = left.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(grid.cols - 1))))
    down = right.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1))))
    sent = row(over, block_owner(bi, F.col("to"), grid.rows, grid.cols), bj, 1).unionByName(row(down, block_owner(F.col("to"), bj, grid.rows, grid.cols), bi, 2))
    sent = sent.unionByName(row(_given(into), block_owner(bi, bj, grid.rows, grid.cols), F.lit(-1), 0))
    return sent.repartitionById(grid.rows * grid.cols, "owner").sortWithinPartitions("owner", "k", "kind").mapInArrow(_relaxed(side, kind, grid, cols, upper), _TILE)


def _closed(m: np.ndarray, inf: int, side: int) -> None:
    """Close a symmetric matrix, a block of ``side`` middle vertices after another."""
    for low in range(0, len(m), side):
        inner = slice(low, low + side)
        pivot = m[inner, inner].copy()
        for q in range(len(pivot)):
            np.minimum(pivot, pivot[:, q, None] + pivot[q], out=pivot)
        panel = m[inner].copy()
        _through(panel, pivot, m[inner])
        _through(m, np.ascontiguousarray(panel.T), panel)
    np.minimum(m, inf, out=m)


def _leaf(low: int, high: int, side: int, kind: str):
    """All tiles of a small range closed in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.full(((high - low) * side,) * 2, _UNTIL[kind], dtype=kind)

        def part(bi: int, bj: int) -> tuple[slice, slice]:
            return tuple(slice((b - low) * side, (b - low + 1) * side) for b in (bi, bj))

        some = False
        for bi, bj, given in held(batches, side, kind):
            m[part(bi, bj)], m[part(bj, bi)] = given, given.T
            some = True
        if some:
            _closed(m, _UNTIL[kind], min(side, 128))
            for i in range(low, high):
                for j in range(i, high):
                    yield from _row(i, j, m[part(i, j)], kind)

    return run


def close(tiles: Tiles, leaf: int = LEAF) -> Tiles:
    """The tiles of all shortest paths, of the narrowest kind that holds them."""
    ship(tiles.table.sparkSession)
    given = Tiles(materialise(tiles.table, "tiles"), tiles.n, tiles.side, tiles.kind)
    heaviest = given.table.agg(F.coalesce(F.max("far"), F.lit(0))).first()[0]
    for kind, inf in KINDS:
        if kind != given.kind and 3 * heaviest >= inf:
            continue
        now = given if kind == given.kind else narrowed(given, kind)
        found = _close(now, leaf)
        far = found.table.agg(F.coalesce(F.max("far"), F.lit(0))).first()[0]
        # nothing was taken for unreachable that is not: the farthest vertex and any edge stay below the bound
        if kind == given.kind or far + heaviest < inf:
            discard(given.table)
            return found
        discard(found.table)
    raise AssertionError("the given kind is the last")


def _close(tiles: Tiles, leaf: int) -> Tiles:
    spark = tiles.table.sparkSession
    cores, side, kind = spark.sparkContext.defaultParallelism, tiles.side, tiles.kind
    size = np.dtype(kind).itemsize
    # halved once at least, so that more than one task has work
    most = max(1, min(leaf // side, -(-tiles.across // 2)))

    def cut(t: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
        return t.where(F.col("bi").between(rows[0], rows[1] - 1) & F.col("bj").between(cols[0], cols[1] - 1))

    def grid(rows: tuple[int, int], cols: tuple[int, int]) -> Grid:
        return Grid.of(rows[1] - rows[0], cols[1] - cols[0], side, cores, size)

    def closure(given: DataFrame, low: int, high: int) -> DataFrame:
        """The closed tiles of vertices low..high-1 (in tiles) from a table that holds theirs, which is deleted."""
        if high - low <= most:
            out = materialise(given.repartition(1).mapInArrow(_leaf(low, high, side, kind), _TILE), "tiles")
            discard(given)
            return out
        middle = (low + high) // 2
        one, two = (low, middle), (middle, high)
        a = closure(materialise(cut(given, one, one), "tiles"), *one)
        # the panel between the halves, behind the first one's closure
        panel = materialise(relax(cut(given, one, two), _whole(a), _given(cut(given, one, two)), two, grid(one, two), side, kind), "tiles")
        d = closure(materialise(relax(cut(given, two, two), _flipped(panel), _given(panel), two, grid(two, two), side, kind, True), "tiles"), *two)
        discard(given)
        ends = materialise(relax(panel, _given(panel), _whole(d), two, grid(one, two), side, kind), "tiles")
        discard(panel)
        first = materialise(relax(a, _given(ends), _flipped(ends), one, grid(one, one), side, kind, True), "tiles")
        discard(a)
        out = materialise(first.unionByName(ends).unionByName(d), "tiles")
        for p in (first, ends, d):
            discard(p)
        return out

    start = tiles.table if kind == "<i4" and hasattr(tiles.table, "_seqmesh_path") else materialise(tiles.table, "tiles")
    return Tiles(closure(start, 0, tiles.across), tiles.n, side, kind)


def to_long(tiles: Tiles) -> DataFrame:
    """(i, j, d) of all ordered pairs; d is null where there is no path."""
    n, side, inf, kind, spark = tiles.n, tiles.side, tiles.inf, tiles.kind, tiles.table.sparkSession

    def long(bi: int, bj: int, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        high, wide = (min(side, n - b * side) for b in (bi, bj))
        m = m[:high, :wide]
        for at in range(0, high, 256):
            d = m[at : at + 256].ravel()
            i = np.repeat(np.arange(at, at + len(d) // wide, dtype=np.int64) + bi * side, wide)
            j = np.tile(np.arange(wide, dtype=np.int64) + bj * side, len(d) // wide)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d.astype(np.int32), mask=d >= inf)], ["i", "j", "d"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.full((side, side), inf, dtype=kind)
        for batch in batches:
            for bi, bj, data in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("data"), strict=True):
                m = array(data.as_buffer(), side, kind) if data.is_valid else none
                yield from long(bi, bj, m)
                if bi < bj:
                    yield from long(bj, bi, m.T)

    # tiles that are no rows, by their places alone, so that the others stay where they are
    every = spark.range(tiles.across**2).select(F.expr(f"cast(id div {tiles.across} as int)").alias("bi"), (F.col("id") % tiles.across).cast("int").alias("bj")).where("bi <= bj")
    missing = every.join(tiles.table.select("bi", "bj"), ["bi", "bj"], "left_anti").withColumn("data", F.lit(None).cast("binary"))
    return tiles.table.select("bi", "bj", "data").unionByName(missing).mapInArrow(rows, "i long, j long, d int")
