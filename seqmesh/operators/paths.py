"""All-pairs shortest paths.

``relational``: min-plus squaring, a join on the middle vertex and a minimum, until nothing gets shorter; any vertex
ids, rows only for reachable pairs. It suits sparse graphs with small components.

``strips``: Floyd-Warshall over row strips of the dense matrix, each a row (strip, data) of int32 bytes. For each pivot
strip the strip is closed by a task, broadcast, and all strips are relaxed where they lie, without a shuffle. The
strip height keeps a pivot strip within ``PIVOT_BYTES``, so what is broadcast does not grow with the graph. Each
round's matrix is written to the shared folder, which cuts the lineage and lets the next pivot be read alone.

``sources``: blocks of sources, each closed by one task with all edges at hand (see ``source_paths``); where the edges
are few enough to be broadcast, that is what ``auto`` takes, for it costs edges x vertices a hop and writes its result alone.

``tiles``: two-dimensional tiles closed by halves (see ``tiles``), for graphs whose pivot strips would be thin.

``sparse``: components first, and no table of all pairs (see ``sparse_paths``); unreachable pairs are added at the end.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.operators import products, source_paths, tiles
from seqmesh.operators.graph import on_ordinals, usable
from seqmesh.operators.sparse_paths import reachable
from seqmesh.operators.strip_medoids import Strips, of_tiles
from seqmesh.operators.tiles import INF
from seqmesh.session import discard, materialise, ship

PIVOT_BYTES, STRIP = 64 << 20, 512
#: Vertices up to which ``auto`` squares relationally, and beyond which it works on tiles.
RELATIONAL, TILED = 64, 32_768
#: Sums up to which a product is a join, and blocks of its result up to which it is worked out on them.
PRODUCTS, BLOCKS = 10_000_000, 100_000


def min_plus(x: DataFrame, y: DataFrame) -> DataFrame:
    """The min-plus product of two distance tables (i, j, d): over k the least x(i,k) + y(k,j), below INF.

    It is a join while there are at most ``PRODUCTS`` sums; of more, blocks of the result are worked out where ids are not
    too far apart for that (see ``products``).
    """
    per = [t.where("d IS NOT NULL").groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(e).alias("low"), F.max(e).alias("high"), F.min("d").alias("d")) for t, k, e in ((x, "j", "i"), (y, "i", "j"))]
    ends = [F.min("a.low"), F.max("a.high"), F.min("b.low"), F.max("b.high")]
    sums, *span, least = per[0].alias("a").join(per[1].alias("b"), F.col("a.k") == F.col("b.k")).agg(F.sum(F.col("a.n").cast("decimal(38,0)") * F.col("b.n")), *ends, F.min(F.least("a.d", "b.d"))).first()
    if sums is None or sums <= PRODUCTS or least < 0:
        return _joined(x, y)
    rows, cols = span[:2], span[2:]
    blocks = math.prod(-(-(high - low + 1) // products.SIDE) for low, high in (rows, cols))
    if blocks > BLOCKS:
        return _joined(x, y)
    within = [t.where(F.col(e).between(*r)) for t, e, r in ((x, "i", rows), (y, "j", cols))]
    return products.by_blocks(*within, tuple(rows), tuple(cols))


def _joined(x: DataFrame, y: DataFrame) -> DataFrame:
    joined = x.alias("x").join(y.alias("y"), F.col("x.j") == F.col("y.i"))
    through = joined.select(F.col("x.i").alias("i"), F.col("y.j").alias("j"), (F.col("x.d").cast("long") + F.col("y.d")).alias("d"))
    return through.where(F.col("d") < INF).groupBy("i", "j").agg(F.min("d").cast("int").alias("d"))


def _closed(p: np.ndarray) -> np.ndarray:
    for q in range(len(p)):
        np.minimum(p, p[:, q, None] + p[q], out=p)
    return p


def _relax(rows: np.ndarray, pivot: np.ndarray, first: int) -> np.ndarray:
    """Rows with paths through the pivot strip's vertices, whose own closure stands in ``pivot``."""
    cols = slice(first, first + len(pivot))
    inner = pivot[:, cols]
    via = rows[:, cols].copy()
    for q in range(len(pivot)):
        np.minimum(via, rows[:, first + q, None] + inner[q], out=via)
    room = np.empty_like(rows)
    for q in range(len(pivot)):
        np.add(via[:, q, None], pivot[q], out=room)
        np.minimum(rows, room, out=rows)
    return np.minimum(rows, INF, out=rows)


def _pivot(data: bytes, n: int, first: int) -> np.ndarray:
    p = np.frombuffer(data, dtype="<i4").reshape(-1, n).copy()
    cols = slice(first, first + len(p))
    block = _closed(p[:, cols].copy())
    out = p.copy()
    for q in range(len(p)):
        np.minimum(out, block[:, q, None] + p[q], out=out)
    out[:, cols] = block
    return np.minimum(out, INF)


def _pivots(batches: Iterator[pd.DataFrame], n: int, first: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"data": [_pivot(d, n, first).tobytes() for d in b["data"]]})


def to_strips(edges: DataFrame, n: int, height: int) -> DataFrame:
    """(strip, data) of the initial matrix of edges both ways; strips without an edge are there too."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = key[0] * height
        m = np.full((min(height, n - first), n), INF, dtype="<i4")
        rows = rows[rows["j"] >= 0].sort_values("d", ascending=False)
        m[rows["i"].to_numpy() - first, rows["j"].to_numpy()] = rows["d"].to_numpy()
        at = np.arange(len(m))
        m[at, first + at] = 0
        return pd.DataFrame({"strip": [key[0]], "data": [m.tobytes()]})

    spark = edges.sparkSession
    count = -(-n // height)
    every = spark.range(count).select((F.col("id") * height).alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).alias("d"))
    known = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("d")).unionByName(every)
    keyed = known.withColumn("strip", F.floor(F.col("i") / height).cast("int"))
    return keyed.groupBy("strip").applyInPandas(build, "strip int, data binary")


def close_strips(strips: DataFrame, n: int, height: int) -> DataFrame:
    """The strips after every vertex has been a pivot."""
    spark, count = strips.sparkSession, -(-n // height)
    now = materialise(strips.repartition(min(count, spark.sparkContext.defaultParallelism), "strip"), "strips")
    for k in range(count):
        # closed by a task; what comes to the driver, to be sent out, is one strip
        closed = now.where(F.col("strip") == k).mapInPandas(functools.partial(_pivots, n=n, first=k * height), "data binary").collect()[0][0]
        shared = spark.sparkContext.broadcast(np.frombuffer(closed, dtype="<i4").reshape(-1, n))

        def step(batches: Iterator[pd.DataFrame], shared=shared, k=k) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for s, d in zip(b["strip"], b["data"], strict=True):
                    rows = np.frombuffer(d, dtype="<i4").reshape(-1, n).copy()
                    out.append((shared.value if s == k else _relax(rows, shared.value, k * height)).tobytes())
                yield pd.DataFrame({"strip": b["strip"], "data": out})

        before, now = now, materialise(now.mapInPandas(step, "strip int, data binary"), "strips")
        discard(before)
        shared.destroy()
    return now


def to_long(strips: DataFrame, n: int, height: int) -> DataFrame:
    """(i, j, d) of all ordered pairs; d is null where there is no path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, d in zip(b["strip"], b["data"], strict=True):
                m = np.frombuffer(d, dtype="<i4").reshape(-1, n)
                for at in range(0, len(m), 64):
                    part = m[at : at + 64]
                    i = np.repeat(np.arange(len(part), dtype=np.int64) + s * height + at, n)
                    yield pd.DataFrame({"i": i, "j": np.tile(np.arange(n, dtype=np.int64), len(part)), "d": part.ravel()})

    long = strips.mapInPandas(rows, "i long, j long, d int")
    return long.withColumn("d", F.when(F.col("d") < INF, F.col("d")))


def _relational(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    diagonal = vertices.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(0).alias("d"))
    direct = edges.where(F.col("weight") < INF).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("d"))
    now, before = materialise(diagonal.unionByName(direct).groupBy("i", "j").agg(F.min("d").alias("d")), "paths"), None
    while (mark := now.agg(F.count(F.lit(1)), F.sum(F.col("d").cast("decimal(38,0)"))).first()) != before:
        last, before, now = now, mark, materialise(_joined(now, now), "paths")
        discard(last)
    return _all_pairs(vertices, now)


def _all_pairs(vertices: DataFrame, known: DataFrame) -> DataFrame:
    """(i, j, d) of all ordered pairs, d null where ``known`` (i, j, d) has none: n x n rows by nature."""
    ends = vertices.select("idx")
    whole = ends.withColumnRenamed("idx", "i").join(ends.withColumnRenamed("idx", "j"), F.lit(True))
    return whole.join(known, ["i", "j"], "left").select("i", "j", "d")


def _measured(vertices: DataFrame) -> tuple[int, bool]:
    """(number of vertices, whether they are 0..n-1)."""
    n, low, high = vertices.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx")).first()
    return n, n == 0 or low == 0 and high == n - 1


def shortest_paths(vertices: DataFrame, edges: DataFrame, strategy: str = "auto", zero_weight: str = "absent", strip: int = STRIP, side: int = tiles.SIDE, leaf: int = tiles.LEAF) -> DataFrame:
    """(i, j, d) for all ordered pairs of ``vertices`` (idx), d null without a path.

    ``edges`` (src, dst, weight) are undirected, one for each pair (see ``last_wins``). Loops are ignored, weight 0 is
    no edge unless ``zero_weight='edge'``, negative weights are an error. ``strips`` and ``tiles`` work on ordinals:
    vertices that are not 0..n-1 are numbered for it, and pairs get their ids back.
    """
    spark = vertices.sparkSession
    ship(spark)
    both = usable(edges, zero_weight)
    n, dense = _measured(vertices)
    if n == 0:
        return spark.createDataFrame([], "i long, j long, d int")
    if strategy == "sparse":
        return _all_pairs(vertices, reachable(vertices, edges, zero_weight))
    if strategy == "relational" or strategy == "auto" and n <= RELATIONAL:
        return _relational(vertices, both)
    names = None
    if not dense:
        both, names = on_ordinals(vertices, both)
    closed = _from_sources(both, n) if strategy in ("auto", "sources") else None
    if closed is not None:
        found = to_long(*closed)
    elif strategy == "tiles" or n > TILED and strategy != "strips":
        found = tiles.to_long(tiles.close(tiles.to_tiles(both, n, side), leaf))
    else:
        found = to_long(*_closed_strips(both, n, strip))
    if names is None:
        return found
    i, j = (names.withColumnsRenamed({"idx": f"{x}_id", "at": x}) for x in "ij")
    return found.join(i, "i").join(j, "j").select(F.col("i_id").alias("i"), F.col("j_id").alias("j"), "d")


def path_strips(vertices: DataFrame, edges: DataFrame, zero_weight: str = "absent") -> Strips:
    """The distances of ``shortest_paths`` as binary row strips, a written table."""
    spark = vertices.sparkSession
    ship(spark)
    n, dense = _measured(vertices)
    if n == 0:
        return Strips(spark.createDataFrame([], "strip int, data binary"), 0, 1)
    both, names = usable(edges, zero_weight), None
    if not dense:
        both, names = on_ordinals(vertices, both)
    closed = _from_sources(both, n)
    if closed is None and n > TILED:
        return of_tiles(tiles.close(tiles.to_tiles(both, n)), names)
    table, n, height = closed or _closed_strips(both, n, STRIP)
    return Strips(table, n, height, names)


def _from_sources(both: DataFrame, n: int) -> tuple[DataFrame, int, int] | None:
    """The closed strips from blocks of sources, a written table; None if the edges are too many to be broadcast."""
    known = source_paths.sent(both, n)
    if known is None:
        return None
    spark = both.sparkSession
    height = source_paths.blocks(n, spark.sparkContext.defaultParallelism)
    written = materialise(source_paths.strips(known, n, height, spark), "strips")
    known.destroy()
    return written, n, height


def _closed_strips(both: DataFrame, n: int, strip: int) -> tuple[DataFrame, int, int]:
    height = max(1, min(strip, PIVOT_BYTES // (4 * n)))
    height = min(height, max(32, -(-n // both.sparkSession.sparkContext.defaultParallelism)))
    return close_strips(to_strips(both, n, height), n, height), n, height


def connected(distances: DataFrame) -> bool:
    """Whether every pair has a path."""
    return distances.where("d IS NULL").isEmpty()
