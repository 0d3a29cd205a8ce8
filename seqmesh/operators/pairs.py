"""All pairs of a sequence set by Hamming distance, and the graph of those below a threshold.

A small threshold needs no look at all pairs: cut into as many segments as the threshold, two sequences below it agree
in one segment at least, so they meet in an equi-join on segments, and the distance is taken of those that meet alone.
How many would meet is counted first, exactly; where that is no small part of all pairs, all pairs it is.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seqmesh.functions.distance import PLANE, code_planes, hamming, plane_count, plane_distance, planes
from seqmesh.session import materialise, ship

#: A segment join is taken if no more than one in this many of all pairs would meet.
WORTH = 4
#: Sequences with one segment in common that meet in one place; larger groups are dealt to pairs of blocks.
CROWD, ARRAY = 4096, 8
#: Bytes of sequences up to which one side is broadcast; beyond, both sides are dealt to pairs of blocks.
BROADCAST_BYTES = 32 << 20
#: Sequences of a block, about, and pairs of them that are made at once.
BLOCK, PAIRS = 32_768, 1 << 18
#: Neighbouring sequences of the broadcast side that are met together, about: pairs come as runs of one i with the same j
#: again and again, which files hold in little room.
CHUNK = 1024
#: Different characters up to which sequences of any alphabet are compared by the bits of their codes.
LETTERS = 4096


def sequence_length(seqs: DataFrame) -> tuple[int, int]:
    """(number, common length) of the sequences; an error if lengths differ."""
    n, low, high = seqs.agg(F.count(F.lit(1)), F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if n and low != high:
        raise ValueError(f"sequences of unequal length: {low} to {high}")
    return n, high or 0


def pairwise_hamming(seqs: DataFrame, alphabet: str | None = "ACGT", below: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, join: str = "auto") -> DataFrame:
    """(i, j, d) for all i < j of ``seqs`` (idx, seq), or only those with d < ``below``.

    The distance is a population count within generated code. ``None`` is any alphabet: its letters are looked up first;
    characters are compared one by one only where there are more than ``LETTERS``. The filter sits on the join, so pairs that fail it are never rows. ``join`` is 'pairs',
    'segments' (needs ``below``), or 'auto', which takes segments if few enough pairs have one in common.
    """
    if join not in ("auto", "pairs", "segments") or join == "segments" and below is None:
        raise ValueError("join is 'auto', 'pairs', or with a threshold 'segments'")
    n, length = sequence_length(seqs)
    value, distance, bits = _coded(seqs, length, alphabet)
    keyed = seqs.select("idx", value.alias("v"))
    upper = F.col("a.idx") < F.col("b.idx")
    if below is not None and below <= 0:
        return seqs.sparkSession.createDataFrame([], "i long, j long, d int")
    if join == "segments" and below <= length or join == "auto" and _worth(seqs, n, length, alphabet, below):
        crowd = materialise(_crowds(seqs, length, below).where(F.col("size") > CROWD), "crowds")
        if bits and keyed.schema["idx"].dataType == LongType() and not crowd.isEmpty():
            return _by_segment_planes(seqs, value, length, below, bits, crowd)
        joined = _by_segments(seqs, value, length, below, distance, crowd)
    elif n * max(length, 1) <= broadcast_bytes:
        spread = keyed.repartition(max(1, min(n // 64, 4 * keyed.sparkSession.sparkContext.defaultParallelism)), "idx")
        joined = _by_chunks(spread, keyed, upper, -(-n // CHUNK))
    else:
        # buckets enough for all cores
        cores = keyed.sparkSession.sparkContext.defaultParallelism
        if bits and keyed.schema["idx"].dataType == LongType():
            return _by_planes(keyed, below, length, bits, max(-(-n // BLOCK), math.isqrt(8 * cores) + 1))
        joined = _by_blocks(keyed, upper, max(math.ceil(n * length / broadcast_bytes) + 1, math.isqrt(4 * cores) + 1))
    pairs = joined.select(F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), distance.alias("d"))
    return pairs if below is None else pairs.where(F.col("d") < below)


def _coded(seqs: DataFrame, length: int, alphabet: str | None) -> tuple[Column, Column, int]:
    """(what is kept of a sequence, the distance of a.v and b.v, bit planes for every ``PLANE`` characters or 0 for none)."""
    a, b, seq = F.col("a.v"), F.col("b.v"), F.col("seq")
    if not length:
        return seq, F.when(a.isNotNull() & b.isNotNull(), F.lit(0)), 0
    if alphabet is not None:
        return planes(seq, length, alphabet), plane_distance(a, b, length), 2
    found = seqs.select(F.explode(F.split("seq", "")).alias("c")).where("c <> ''").distinct().limit(LETTERS + 1).collect()
    if len(found) > LETTERS:
        return seq, hamming(a, b), 0
    letters = "".join(sorted(r.c for r in found))
    return code_planes(seq, length, letters), plane_distance(a, b, length, plane_count(letters)), plane_count(letters)


def _by_chunks(spread: DataFrame, keyed: DataFrame, upper: Column, chunks: int) -> DataFrame:
    """Every row meets the broadcast rows chunk by chunk, in ranges of idx, so that nearly every run has a whole chunk's j.

    Ids with gaps make chunks of unequal sizes, which changes nothing but the order of pairs.
    """
    if chunks <= 1:
        return spread.alias("a").join(F.broadcast(keyed).alias("b"), upper)
    low, high = (float(x) for x in keyed.agg(F.min("idx"), F.max("idx")).first())
    chunk = F.least(F.floor((F.col("idx").cast("double") - low) / (high - low + 1) * chunks).cast("int"), F.lit(chunks - 1))
    every = spread.withColumn("chunk", F.explode(F.sequence(chunk, F.lit(chunks - 1)))).sortWithinPartitions("chunk", "idx")
    # true of every row, and not known to be before it runs: the optimiser takes a sort for idle that only a join is above
    every = every.where(F.monotonically_increasing_id() >= 0)
    held = F.broadcast(keyed.withColumn("chunk", chunk))
    return every.alias("a").join(held.alias("b"), (F.col("a.chunk") == F.col("b.chunk")) & upper)


def _worth(seqs: DataFrame, n: int, length: int, alphabet: str | None, below: int | None) -> bool:
    """Whether few enough pairs have a segment in common; short segments are not even counted."""
    if below is None or not 0 < below <= length:
        return False
    letters = len(alphabet) if alphabet else 4
    if n < 1000 or below >= WORTH * letters ** (length // below):
        return False
    return segment_candidates(seqs, below, length) * WORTH <= n * (n - 1) // 2


def _by_blocks(keyed: DataFrame, upper: Column, blocks: int) -> DataFrame:
    """Each pair of sequences meets in the one bucket of its two blocks; a sequence is sent to ``blocks`` buckets."""
    own = F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = keyed.withColumn("bi", own).withColumn("bj", every)
    right = keyed.withColumn("bj", own).withColumn("bi", every)
    return left.alias("a").join(right.alias("b"), (F.col("a.bi") == F.col("b.bi")) & (F.col("a.bj") == F.col("b.bj")) & upper)


def _compared(left: tuple, right: tuple, same: bool, below: int | None, bits: int, kept=None) -> Iterator[pa.RecordBatch]:
    """(i, j, d) of two blocks, each (ids, words of bit planes, whether they are known); of one with itself if ``same``.

    ``kept`` tells from the places that differ, a word for each ``PLANE`` characters, which pairs below the threshold stay.
    """
    (a, v, known_a), (b, w, known_b) = left, right
    # planes that no sequence has a bit in are no matter
    groups = [[k for k in range(g, g + bits) if v[k].any() or w[k].any()] for g in range(0, len(v), bits)]
    kind = np.uint8 if max(len(groups) * PLANE, below or 0) < 256 else np.int32
    high, all_known = max(1, PAIRS // max(len(b), 1)), bool(known_a.all() and known_b.all())
    for at in range(0, len(a), high):
        rows = slice(at, at + high)
        i, d = a[rows], np.zeros((len(a[rows]), len(b)), dtype=kind)
        for group in groups:
            if group:
                d += np.bitwise_count(functools.reduce(np.bitwise_or, (v[k][rows, None] ^ w[k] for k in group)))
        if below is None and not same:
            i, j = np.broadcast_arrays(i[:, None], b)
            known = np.broadcast_to(True, d.shape) if all_known else known_a[rows, None] & known_b
        else:
            take = i[:, None] < b if same else None
            if below is not None:
                near = d < below
                if not all_known:
                    near &= known_a[rows, None] & known_b
                take = near if take is None else near & take
            x, y = np.divmod(np.flatnonzero(take), max(len(b), 1))
            if kept is not None and len(x):
                differ = [functools.reduce(np.bitwise_or, [v[k][rows][x] ^ w[k][y] for k in group], np.zeros(len(x), dtype=np.int64)) for group in groups]
                real = kept(differ)
                x, y = x[real], y[real]
            i, j, d, known = i[x], b[y], d[x, y], known_a[rows][x] & known_b[y]
        # of two blocks either may hold the smaller one
        low, top = np.minimum(i, j), np.maximum(i, j)
        yield pa.RecordBatch.from_arrays([pa.array(low.ravel()), pa.array(top.ravel()), pa.array(d.ravel().astype(np.int32), mask=None if known.all() else ~known.ravel())], ["i", "j", "d"])


def _in_buckets(batches: Iterable[pa.RecordBatch], names: list[str], words: int, met) -> Iterator[pa.RecordBatch]:
    """What ``met`` makes of each bucket's two sides; rows come in the order of the columns ``names``, which tell buckets, and side."""
    bucket, sides = None, ([], [])

    def whole(parts: list[tuple]) -> tuple:
        idx = np.concatenate([p[0] for p in parts])
        order = np.argsort(idx, kind="stable")
        return idx[order], [np.concatenate([p[1][k] for p in parts])[order] for k in range(words)], np.concatenate([p[2] for p in parts])[order]

    def done() -> Iterator[pa.RecordBatch]:
        if sides[0]:
            left = whole(sides[0])
            yield from met(bucket, left, whole(sides[1]) if sides[1] else None)
        for x in sides:
            x.clear()

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in [*names, "side"]], axis=1)
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
        idx, known = batch.column("idx").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False)
        values = [batch.column(f"w{k}").to_numpy() for k in range(words)]
        for x, y in zip(cut, [*cut[1:], len(key)], strict=True):
            if (own := tuple(key[x, :-1].tolist())) != bucket:
                yield from done()
                bucket = own
            sides[int(key[x, -1])].append((idx[x:y].copy(), [w[x:y].copy() for w in values], known[x:y].copy()))
    yield from done()


def _by_planes(keyed: DataFrame, below: int | None, length: int, bits: int, blocks: int) -> DataFrame:
    """The same for bit planes: a bucket holds two blocks as arrays, whatever else is in its task, and compares them.

    A block meets each other block once, so a sequence is sent to ``blocks`` buckets and a pair is looked at in one alone.
    """
    ship(keyed.sparkSession)
    words = -(-length // PLANE) * bits

    def met(bucket: tuple, left: tuple, right: tuple | None) -> Iterable[pa.RecordBatch]:
        same = bucket[0] // blocks == bucket[0] % blocks
        return _compared(left, left if same else right, same, below, bits) if same or right else ()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_buckets(batches, ["bucket"], words, met)

    own, other = F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int"), F.col("other")
    held = keyed.where("idx IS NOT NULL").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    bucket, side = (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("bucket"), (F.col("own") > other).cast("int").alias("side")
    value = [F.col("v")[k] for k in range(words)]
    known = functools.reduce(operator.and_, [x.isNotNull() for x in value])
    rows = held.select(bucket, side, "idx", known.alias("known"), *[F.coalesce(x, F.lit(0).cast("long")).alias(f"w{k}") for k, x in enumerate(value)])
    # buckets in the order of their numbers, so that each task has as many as any other
    number = F.expr(f"bucket div {blocks}") * blocks - F.expr(f"(bucket div {blocks}) * (bucket div {blocks} + 1) div 2") + F.col("bucket") % blocks
    dealt = rows.repartitionById(blocks * (blocks + 1) // 2, number.cast("int")).sortWithinPartitions("bucket", "side")
    return dealt.mapInArrow(run, "i long, j long, d int")


def segments(seq: Column, length: int, below: int) -> list[Column]:
    """``below`` segments, of lengths as equal as can be; sequences that differ in fewer places agree in one of them."""
    edge = [k * length // below for k in range(below + 1)]
    return [F.substring(seq, a + 1, b - a) for a, b in itertools.pairwise(edge)]


def _segmented(seqs: DataFrame, length: int, below: int) -> DataFrame:
    """All columns and (at, key): a row for each segment of each sequence."""
    return seqs.select("*", F.posexplode(F.array(*segments(F.col("seq"), length, below))).alias("at", "key"))


def _crowds(seqs: DataFrame, length: int, below: int) -> DataFrame:
    """(at, key, size) of each group of sequences that have a segment in common."""
    return _segmented(seqs, length, below).groupBy("at", "key").agg(F.count(F.lit(1)).alias("size"))


def segment_candidates(seqs: DataFrame, below: int, length: int | None = None) -> int:
    """How many pairs the segment join compares; a pair counts once for each segment it has in common."""
    length = sequence_length(seqs)[1] if length is None else length
    pairs = F.col("size").cast("decimal(38,0)") * (F.col("size") - 1) / 2
    return int(_crowds(seqs, length, below).agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0])


def _by_segments(seqs: DataFrame, value: Column, length: int, below: int, distance: Column, crowd: DataFrame) -> DataFrame:
    """Each pair below the threshold, once: where its first common segment is."""
    rows = _segmented(seqs.select("idx", "seq", value.alias("v")), length, below)
    crowd = crowd.select("at", "key", F.ceil(F.col("size") / CROWD).cast("int").alias("blocks"))
    # fewer than one crowd for each CROWD rows of ``rows``
    held = rows.join(F.broadcast(crowd) if crowd.count() <= 100_000 else crowd, ["at", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = held.withColumn("bi", own).withColumn("bj", every).alias("a")
    b = held.withColumn("bj", own).withColumn("bi", every).alias("b")
    meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("at", "key", "bi", "bj")]
    same = F.zip_with(*(F.array(*segments(F.col(f"{x}.seq"), length, below)) for x in "ab"), lambda x, y: x == y)
    first = F.array_position(same, True) == F.col("a.at") + 1
    # the distance comes first, for few pairs pass it, and which segment they meet in takes far longer to tell
    return a.join(b, functools.reduce(operator.and_, meet) & (F.col("a.idx") < F.col("b.idx")) & (distance < below) & first)


def _places(length: int, below: int) -> list[list[int]]:
    """For each segment the bits of its characters in each word of ``PLANE``; a word's first character is its highest bit."""
    out = []
    for a, b in itertools.pairwise(k * length // below for k in range(below + 1)):
        out.append([sum(1 << (min(g + PLANE, length) - 1 - c) for c in range(max(a, g), min(b, g + PLANE))) for g in range(0, length, PLANE)])
    return out


def _by_segment_planes(seqs: DataFrame, value: Column, length: int, below: int, bits: int, crowd: DataFrame) -> DataFrame:
    """The segment join for bit planes and crowds: those that have a segment in common are compared as arrays, block by block.

    A crowd is dealt to blocks of ``ARRAY`` times ``CROWD``, for pairs are no rows until they pass the threshold.
    """
    ship(seqs.sparkSession)
    words, places = -(-length // PLANE) * bits, _places(length, below)
    cores = seqs.sparkSession.sparkContext.defaultParallelism
    crowd = crowd.where(F.col("size") > ARRAY * CROWD).select("at", "key", F.ceil(F.col("size") / (ARRAY * CROWD)).cast("int").alias("blocks"))
    rows = _segmented(seqs.where("idx IS NOT NULL").select("idx", "seq", value.alias("v")), length, below).where("key IS NOT NULL")
    # few, for each has that many rows of ``rows``
    held = rows.join(F.broadcast(crowd) if crowd.count() <= 100_000 else crowd, ["at", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"), F.col("other")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = functools.reduce(operator.and_, [F.col("v")[k].isNotNull() for k in range(words)])
    planes = [F.coalesce(F.col("v")[k], F.lit(0).cast("long")).alias(f"w{k}") for k in range(words)]
    dealt = held.select("at", F.xxhash64("key").alias("hash"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > other).cast("int").alias("side"), "idx", known.alias("known"), *planes)
    names = ["at", "hash", "low", "high"]
    parts = max(4 * cores, seqs.count() * below // 200_000)

    def met(bucket: tuple, left: tuple, right: tuple | None) -> Iterable[pa.RecordBatch]:
        at, _, low, high = bucket

        def first(differ: list[np.ndarray]) -> np.ndarray:
            equal = lambda k: functools.reduce(operator.and_, [(d & p) == 0 for d, p in zip(differ, places[k], strict=True)])
            return functools.reduce(operator.and_, [~equal(k) for k in range(at)], equal(at))  # two segments may have one hash

        return _compared(left, left if low == high else right, low == high, below, bits, first) if low == high or right else ()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_buckets(batches, names, words, met)

    return dealt.repartition(parts, *names).sortWithinPartitions(*names, "side").mapInArrow(run, "i long, j long, d int")


def threshold_graph(seqs: DataFrame, epsilon: int = 70, alphabet: str | None = "ACGT", join: str = "auto") -> DataFrame:
    """Edges (src, dst, weight) of all pairs with distance strictly below ``epsilon``; src < dst."""
    pairs = pairwise_hamming(seqs, alphabet, epsilon, join=join)
    return pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("weight"))
