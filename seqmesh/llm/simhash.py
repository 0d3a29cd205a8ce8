"""SimHash near-dedup with anchor points from covering codes.

Fingerprint: 64 bits by majority over the XXH64 (seed 42) of every four-word shingle.

Which pairs meet: the 64 positions are cut into pieces, and a window is a choice of pieces, made so that of any two
fingerprints at most ``THRESHOLD`` bits apart some window sees at most one differing bit (pigeonhole). On a window of
w bits the anchors are the words of a covering code of radius one: the perfect [15,11] Hamming code on the first 15
bits and all words on the other w-15. A fingerprint is at home at its nearest anchor, at most one bit away, and is
replicated to every anchor within covering radius plus the window's threshold, two bits; so it meets, at the home
anchor of each partner, that partner. Candidates are compared on all 64 bits, hence the result is exact.

Scale: entries a fingerprint and expected comparisons for N distinct fingerprints follow from the plan, which is
chosen by N: three windows of 21-22 bits up to 2^26, ten of 25-26 bits up to 2^30, twenty of 32 and thirty-five of
36-37 bits beyond. Equal fingerprints are collapsed first, so copies cost one entry. Anchors with more than ``CAP``
entries are cut into blocks, and each pair of blocks becomes a bucket of its own; no bucket outgrows a task. A task
sends on a spanning forest of the links it finds, never all pairs of a group.

Four bits are a narrow radius for texts of ordinary length: of pairs whose five-word shingles have a Jaccard similarity
of 0.8, most differ in more. Given ``jaccard``, ``near_duplicates`` and ``keep_first`` link those as well: min-hashes of
the sets of ``WORDS``-word shingles, in bands of ``ROWS``, name the candidates (a pair at the very threshold is missed
with a chance of at most ``MISS``), and each candidate is confirmed by the exact similarity of the two sets. Texts with
the same set count as one. Of a band's bucket only pairs that may still join two components are compared, see
``similar``. They are compared by sketch where they meet, the low bytes of their min-hashes; pairs that agree in so many
places as one at the threshold would (again but for a chance of ``MISS``) are confirmed there, and links are written, no pairs.

Defined results: null and empty texts (and texts of white space) have fingerprint zero and are linked like any other;
texts of one to three words have one shingle; component_id is the smallest doc_id reachable, null only where all
doc_ids of the component are null; repeated rows come out as often as they came in; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.llm.common import documents, join_whole, slices, texts
from seqmesh.llm.components import connected_components, forest
from seqmesh.session import discard, materialise, ship

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Words of a shingle of the Jaccard similarity, min-hashes of a band, and the chance to miss a pair at the threshold.
WORDS, ROWS, MISS = 5, 4, 3e-5
#: Entries of an anchor beyond which it is cut into blocks.
CAP = 1 << 18
#: Buckets up to this size are compared many at a time, larger ones by breadth-first search.
SMALL = 512
#: Candidate pairs compared at a time, by fingerprint and by sketch.
CHUNK, PAIRS = 1 << 21, 1 << 18
#: Members of a band's bucket, and hashes of their sets, that meet in one place; more are dealt to pairs of blocks.
BLOCK, HASHES = 8192, 4 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    starts = itertools.chain((0,), (e + 1 for e in ends))
    digest, counts, pairs = xxhash.xxh64_intdigest, np.zeros((8, 256), dtype=np.int64), zip(starts, ends[k - 1 :])
    while len(h := np.fromiter((digest(line[a:b], SEED) for a, b in itertools.islice(pairs, 1 << 16)), dtype=">u8")):
        at = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(2 * (counts @ _BITS).ravel() > n).tobytes(), "big")


def shingle_set(text: str, shingle: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = itertools.chain((0,), (e + 1 for e in ends))
    stops = ends[min(shingle, len(words)) - 1 :]
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(stops)))


def band_number(jaccard: float) -> int:
    """So many bands that sets as similar as ``jaccard`` share one but for a chance of ``MISS``."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(jaccard**ROWS)))) if jaccard < 1 else 1


def agreement(jaccard: float) -> int:
    """In how many min-hashes sets as similar as ``jaccard`` agree at least, but for a chance of ``MISS``."""
    n, below = band_number(jaccard) * ROWS, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * jaccard**k * (1 - jaccard) ** (n - k)
        if below > MISS:
            return k
    return n


def bands(found: np.ndarray, jaccard: float) -> tuple[np.ndarray, bytes]:
    """(band keys, sketch) of a set that isn't empty."""
    n = band_number(jaccard)
    odd = np.random.default_rng(7).integers(0, 1 << 63, n * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(n * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(found), 1 << 12):
        np.minimum(least, np.multiply.outer(odd, found[i : i + (1 << 12)]).min(axis=1), out=least)
    key = np.arange(1, n + 1, dtype=np.uint64)
    for column in least.reshape(n, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key, least.astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets, not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        got = np.array([fingerprint(x) for x in texts(b)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, its 64 bits as a signed long."""
    ship(docs.sparkSession)
    return documents(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


_SKETCH = "doc_id long, fp long, key long, whole long, n long, bands array<long>, sketch binary"


def _sketches(jaccard: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = texts(b)
            sets = [shingle_set(x) for x in rows]
            fps = np.array([fingerprint(x) for x in rows], dtype=np.uint64)
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64)
            made = [bands(x, jaccard) if len(x) else (np.zeros(0, np.uint64), b"") for x in sets]
            keys, sketches = pa.array([k.view(np.int64) for k, _ in made], pa.list_(pa.int64())), pa.array([x for _, x in made], pa.binary())
            columns = [pa.array(fps.view(np.int64)), b.column("key"), pa.array(whole.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), keys, sketches]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "fp", "key", "whole", "n", "bands", "sketch"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("key", F.xxhash64("text"))


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([shingle_set(x).tobytes() for x in texts(b)], pa.binary())], ["key", "found"])


def _confirm(jaccard: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("x"), b.column("y"), strict=True)
            near = pa.array([similarity(*(np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in p)) >= jaccard for p in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], ["a", "b"])

    return run


_PAIR = "a long, b long, a_key long, b_key long"


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), dtype=np.uint8).reshape(len(column), -1)


def _alike(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = pa.array((_sketch_rows(b.column("x")) == _sketch_rows(b.column("y"))).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(near) for c in ("a", "b", "a_key", "b_key")], ["a", "b", "a_key", "b_key"])

    return run


def _needed_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found): the sets of the texts with these keys, a written table."""
    found = _keyed(docs).join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", "text").mapInArrow(_sets, "key long, found binary")
    return materialise(found, "shingles")


def _confirmed(docs: DataFrame, pairs: DataFrame, one: DataFrame, jaccard: float) -> DataFrame:
    """(a, b) of the candidate pairs (a, b, a_key, b_key) whose sets are at least as similar as ``jaccard``: first by sketch, then by the sets."""
    x, y = (one.select(F.col("key").alias(f"{i}_key"), F.col("sketch").alias(c)) for i, c in ("ax", "by"))
    near = materialise(pairs.join(x, "a_key").join(y, "b_key").select("a", "b", "a_key", "b_key", "x", "y").mapInArrow(_alike(agreement(jaccard)), _PAIR), "alike")
    needed = near.select(F.col("a_key").alias("key")).union(near.select("b_key")).distinct()
    found = _needed_sets(docs, needed)
    x, y = (found.select(F.col("key").alias(f"{i}_key"), F.col("found").alias(c)) for i, c in ("ax", "by"))
    sure = materialise(near.join(x, "a_key").join(y, "b_key").select("a", "b", "x", "y").mapInArrow(_confirm(jaccard), "a long, b long"), "similar")
    for gone in (near, found):
        discard(gone)
    return sure


def alike_within(bucket: np.ndarray, band: np.ndarray, own: np.ndarray, split: np.ndarray, root: np.ndarray, fp: np.ndarray, n: np.ndarray, sketch: np.ndarray, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): places of the pairs within a bucket that may be as similar as ``jaccard`` and have not the same root.

    Rows come by bucket and ``n``; in a bucket that is ``split`` only pairs of different blocks ``own`` are looked at. A
    pair belongs to the bucket of the first band (number ``band``) that it shares.
    """
    none, least = np.zeros(0, dtype=np.int64), agreement(jaccard)
    place = bucket.astype(np.int64) << 40
    end = np.searchsorted(place + n, place + np.floor(n / jaccard + 1e-9).astype(np.int64), "right")
    count = end - np.arange(len(n)) - 1
    total = np.cumsum(count)
    edges = [0, *(np.flatnonzero(np.diff(total // PAIRS)) + 1).tolist(), len(n)]
    found = [(none, none)]
    for i, j in itertools.pairwise(edges):
        c = count[i:j]
        x = np.repeat(np.arange(i, j), c)
        y = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + x + 1
        open_ = (root[x] != root[y]) & (fp[x] != fp[y]) & (~split[x] | (own[x] != own[y]))
        x, y = x[open_], y[open_]
        same = sketch[x] == sketch[y]
        near = same.sum(axis=1) >= least
        x, y, same = x[near], y[near], same[near]
        first = same.reshape(len(x), sketch.shape[1] // ROWS, ROWS).all(axis=2).argmax(axis=1) == band[x]
        found.append((x[first], y[first]))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


_BUCKET = ("band", "bi", "bj")
_MEMBER = "band long, k int, bi int, bj int, own int, root long, fp long, key long, n long, sketch binary"


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, bucket of each, whether it is split) of whole buckets, which come one after another; what a batch leaves open waits for the next."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if not len(b):
                continue
            held.append(b)
            if all(held[0].column(c)[0] == b.column(c)[len(b) - 1] for c in _BUCKET):
                continue
        if not held:
            return
        t = pa.Table.from_batches(held)
        key = np.stack([t.column(c).to_numpy() for c in _BUCKET], axis=1)
        bucket = np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        done = int(np.searchsorted(bucket, bucket[-1])) if b is not None else len(key)
        held = t.slice(done).to_batches() if b is not None else []
        if done:
            yield t.slice(0, done).combine_chunks(), bucket[:done], key[:done, 1] != key[:done, 2]


def _alike_pairs(part: pa.Table, bucket: np.ndarray, split: np.ndarray, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    band, own, root, fp, n = (part.column(c).to_numpy() for c in ("k", "own", "root", "fp", "n"))
    return alike_within(bucket, band, own, split, root, fp, n, _sketch_rows(part.column("sketch").combine_chunks()), jaccard)


def _members(jaccard: float):
    """The members that have a pair to be confirmed in their bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bucket, split in _buckets(batches):
            some = np.unique(np.concatenate(_alike_pairs(part, bucket, split, jaccard)))
            if len(some):
                yield from part.take(pa.array(some)).combine_chunks().to_batches()

    return run


def _linked(jaccard: float):
    """(a, b): of the pairs that are similar enough so many that all of them are connected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bucket, split in _buckets(batches):
            root, fp, column = part.column("root").to_numpy(), part.column("fp").to_numpy(), part.column("found").combine_chunks()
            up: dict[int, int] = {}

            def top(r: int, up: dict = up) -> int:
                while (s := up.get(r, r)) != r:
                    up[r] = r = up.get(s, s)
                return r

            found = []
            for x, y in zip(*(c.tolist() for c in _alike_pairs(part, bucket, split, jaccard)), strict=True):
                a, b = top(int(root[x])), top(int(root[y]))
                if a != b and similarity(*(np.frombuffer(column[k].as_buffer(), dtype=np.uint64) for k in (x, y))) >= jaccard:
                    up[a] = b
                    found.append((fp[x], fp[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def similar(docs: DataFrame, rows: DataFrame, near: DataFrame, jaccard: float) -> DataFrame:
    """(node, root): components of ``near`` and of the texts whose sets of shingles are equal or at least as similar as ``jaccard``.

    A band's bucket is a group of any size, so its pairs are not written out. First every member meets the bucket's
    head. In a bucket of near copies that links all; what is left are pairs across components. Members of buckets that
    hold more than one component are dealt to blocks of ``BLOCK`` and compared by sketch there, in the order of their
    sizes, for only sizes within the threshold of each other can meet it.
    """
    some = rows.where("n > 0")
    firsts = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    one = materialise(some.groupBy("whole").agg(F.min("fp").alias("fp"), F.min("key").alias("key"), *firsts), "sets")
    same = some.select("whole", F.col("fp").alias("a")).distinct().join(one.select("whole", F.col("fp").alias("b")), "whole").where("a != b").select("a", "b")
    member = F.struct("key", "fp", "n")
    bands = one.select(F.posexplode("bands").alias("k", "band"), member.alias("y"))
    heads = bands.groupBy("band").agg(F.min("y").alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "x")
    buckets = materialise(bands.join(heads, "band").where("y.key != x.key"), "buckets")
    # texts with the same fingerprint are linked as it is; sizes further apart than the threshold can't reach it
    may = (F.col("x.fp") != F.col("y.fp")) & (F.least("x.n", "y.n") >= F.lit(jaccard) * F.greatest("x.n", "y.n"))
    ends = [F.col(f"{c}.{f}").alias(n) for c, f, n in (("x", "fp", "a"), ("y", "fp", "b"), ("x", "key", "a_key"), ("y", "key", "b_key"))]
    candidates = materialise(buckets.where(may).select(*ends).distinct(), "candidates")
    first = _confirmed(docs, candidates, one, jaccard)
    discard(candidates)
    roots = materialise(connected_components(near.union(same).union(first)), "roots")
    all_ = buckets.select("band", "k", "y").union(buckets.select("band", "k", F.col("x").alias("y")).distinct()).withColumn("node", F.col("y.fp"))
    named = materialise(all_.join(roots, "node", "left").select("band", "k", "y", F.coalesce("root", "node").alias("root")), "named")
    discard(buckets)
    kinds = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("y.n").alias("hashes"))
    cuts = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.col("hashes") / F.lit(HASHES))).cast("int").alias("cuts")
    mixed = named.join(kinds.where("low != high").select("band", cuts), "band").select("band", "k", "cuts", "y.key", "y.fp", "y.n", "root")
    own = F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int")
    each = mixed.join(one.select("key", "sketch"), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = each.select("band", "k", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "root", "fp", "key", "n", "sketch")
    order = [*_BUCKET, "n", "key"]
    members = materialise(dealt.repartition(*_BUCKET).sortWithinPartitions(*order).mapInArrow(_members(jaccard), _MEMBER), "members")
    discard(named)
    if members.isEmpty():
        return roots
    sets = _needed_sets(docs, members.select("key").distinct())
    held = members.join(sets, "key").repartition(*_BUCKET).sortWithinPartitions(*order)
    rest = materialise(held.mapInArrow(_linked(jaccard), "a long, b long"), "similar")
    for gone in (members, sets):
        discard(gone)
    return roots if rest.isEmpty() else connected_components(rest.union(roots))


def windows(n: int) -> list[list[int]]:
    """The bit positions of each window for n distinct fingerprints; see the module's notes."""
    pieces, choose = (3, 1) if n <= 1 << 26 else (5, 2) if n <= 1 << 30 else (6, 3) if n <= 1 << 34 else (7, 4)
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    return [[b for p in chosen for b in range(cuts[p], cuts[p + 1])] for chosen in itertools.combinations(range(pieces), choose)]


def _take(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits, in order, as the low bits of a number; runs of neighbours are moved at once."""
    out, done = np.zeros(len(fps), dtype=np.uint64), 0
    for _, run in itertools.groupby(enumerate(bits), lambda x: x[1] - x[0]):
        at = [b for _, b in run]
        out |= ((fps >> np.uint64(at[0])) & np.uint64((1 << len(at)) - 1)) << np.uint64(done)
        done += len(at)
    return out


def _hamming15() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word its nearest code word, and the seven code words two bits away (itself where there is none)."""
    word = np.arange(1 << 15)
    syndrome = np.zeros_like(word)
    for i in range(15):
        syndrome ^= ((word >> i) & 1) * (i + 1)
    flip = lambda i: np.where(i > 0, 1 << np.maximum(i - 1, 0), 0)
    pairs = np.stack([np.array([i for i in range(1, 16) if i < i ^ s] if s else [0] * 7) for s in range(16)])
    near = word ^ flip(syndrome)
    i = pairs[syndrome]
    far = np.where(syndrome[:, None] > 0, word[:, None] ^ flip(i) ^ flip(i ^ syndrome[:, None]), near[:, None])
    return near, far


_CODE: list[tuple[np.ndarray, np.ndarray]] = []


def entries(fps: np.ndarray, plan: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, at home) of uint64 fingerprints: the home anchor, and every anchor within two bits, once each."""
    if not _CODE:
        _CODE.append(_hamming15())
    near, far = _CODE[0]
    anchors, owners, home = [], [], []
    for k, bits in enumerate(plan):
        window = _take(fps, bits)
        low, high = (window & np.uint64(0x7FFF)).astype(np.int64), (window >> np.uint64(15)).astype(np.int64)
        base = np.int64(k) << 40
        own = base | high << 15 | near[low]
        others = [base | high << 15 | far[low, j] for j in range(7)]
        others += [base | (high ^ (1 << j)) << 15 | near[low] for j in range(len(bits) - 15)]
        keep = near[low] != low  # a code word has no other one within two bits
        anchors += [own, *(x[keep] for x in others[:7]), *others[7:]]
        owners += [fps, *[fps[keep]] * 7, *[fps] * (len(others) - 7)]
        home += [np.ones(len(fps), bool), np.zeros(7 * int(keep.sum()) + len(fps) * (len(others) - 7), bool)]
    return np.concatenate(anchors), np.concatenate(owners), np.concatenate(home)


def _search(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within one large bucket. Who has been reached is not compared again."""
    a, b, left = [], [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = np.bitwise_count(left ^ x) <= threshold
            if hit.any():
                got = left[hit]
                a.append(np.full(len(got), x))
                b.append(got)
                front.extend(got)
                left = left[~hit]
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def compare(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the buckets of entries sorted by anchor."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(anchor)])
    found = []
    for f, s in zip(first[size > SMALL], size[size > SMALL], strict=True):
        found.append(_search(np.unique(fps[f : f + s]), threshold))
    start, count = np.repeat(first, size), np.repeat(size, size)
    homes = np.flatnonzero(home & (count <= SMALL) & (count > 1))
    total = np.cumsum(count[homes])
    edges = [0, *(np.flatnonzero(np.diff(total // CHUNK)) + 1).tolist(), len(homes)]
    for i, j in itertools.pairwise(edges):
        h = homes[i:j]
        n = count[h]
        who = np.repeat(h, n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[h], n)
        x = fps[who] ^ fps[other]
        hit = (x != 0) & (np.bitwise_count(x) <= threshold)
        found.append(forest(fps[who[hit]], fps[other[hit]]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(*(np.concatenate([x[k] for x in found]) for k in (0, 1)))


def _expand(plan: list[list[int]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), 8192):
                anchor, owner, home = entries(fps[i : i + 8192], plan)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(owner.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    return run


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole and one after another; what a batch leaves open waits for the next."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            key = np.stack([b.column(k).to_numpy() for k in ("anchor", "bi", "bj")], axis=1)
            held.append((key, b.column("fp").to_numpy().view(np.uint64), b.column("home").to_numpy(zero_copy_only=False)))
            if len(key) == 0 or (key[-1] == held[0][0][0]).all():
                continue
        if not held:
            return
        key, fps, home = (np.concatenate([x[k] for x in held]) for k in range(3))
        bucket = np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, int)
        done = int(np.searchsorted(bucket, bucket[-1])) if b is not None else len(key)
        held = [(key[done:], fps[done:], home[done:])] if b is not None else []
        a, c = compare(bucket[:done], fps[:done], home[:done])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["a", "b"])
        if b is None:
            return


def links(classes: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of ``classes`` (fp, n of them) that are connected."""
    plan = windows(n)
    all_entries = classes.select("fp").mapInArrow(_expand(plan), "anchor long, fp long, home boolean")
    if n > CAP:  # an anchor has no more entries than there are fingerprints
        cuts = F.ceil(F.col("count") / F.lit(CAP // 2)).cast("int").alias("cuts")
        hot = all_entries.groupBy("anchor").count().where(F.col("count") > CAP).select("anchor", cuts)
        cut = all_entries.join(hot, "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        each = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        low = F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")
        dealt = each.select("anchor", *low, "fp", "home")
    else:
        dealt = all_entries.select("anchor", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "fp", "home")
    return dealt.repartition("anchor", "bi", "bj").sortWithinPartitions("anchor", "bi", "bj").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, jaccard: float | None = None) -> DataFrame:
    """A row for each document: doc_id, fp, component_id. With ``jaccard``, texts that similar are linked beside those few bits apart."""
    ship(docs.sparkSession)
    rows = materialise(fingerprints(docs) if jaccard is None else _keyed(docs).mapInArrow(_sketches(jaccard), _SKETCH), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("often"))
    n, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("often"), F.lit(0))).first()
    near = links(classes, n)
    roots = connected_components(near) if jaccard is None else similar(docs, rows, near, jaccard)
    named = roots.join(classes.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    moved = named.join(least, "root").select(F.col("node").alias("fp"), "least")
    whole = materialise(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "often"), "classes")
    return join_whole(rows.select("doc_id", "fp"), whole, "fp", total).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, jaccard: float | None = None) -> DataFrame:
    """``docs`` with one document of each component: the one whose doc_id is the component's id.

    Rows without a doc_id stay, for nothing tells them apart; of rows that repeat a doc_id, those of the component's
    id stay together. A doc_id that stands with several texts goes only if none of them is its component's first.
    """
    rows = materialise(near_duplicates(docs, jaccard).select("doc_id", "component_id"), "components")
    first = rows.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"))
    lost = first.where("first = 0").select("doc_id")
    return docs.join(lost, docs["doc_id"].cast("long") == lost["doc_id"], "left_anti")
