"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answers.

1. Every document is cut into passages of ``PASSAGE`` words; a hashed word's document frequency is the number of
   passages it is in, counted over the whole corpus.
2. A randomised SVD of the TF-IDF passages: random directions go through A'A on the executors (range finder), are
   made orthonormal on the driver, and the Gram matrix of the passages along them is diagonalised. Both passes take every
   passage of the corpus and of the benchmark. Latent coordinates are divided by their singular values, else the few
   directions that tell languages apart drown the rest.
3. Search: the latent vectors of all windows (two passages, half overlapping) of all documents meet those of the
   benchmark's items by cosine; nothing else of a document is kept.
4. Where the words around an item outweigh it, the cosine is low, so an index of the items' rarest words looks as well.
   A leak has ``LIKELY`` of the item's n words in common with the text, so it misses at most the rest, and any choice
   of that many words and ``HITS`` more has at least ``HITS`` in the text. The rarest are chosen, and every window with
   that many of them around it is a candidate: of all windows that the next step would accept, none is left out.
5. Each candidate is checked word by word: the longest common subsequence of the item and the text around the window,
   as a share of the item. An item is leaked if the share reaches ``SURE``, or ``LIKELY`` while the item's answer, its
   last sentence, follows whole and in order within that text.

Items of fewer than ``SHORTEST`` words leave the LCS too little to go by: they are leaked where their words stand one
after another, which the index of rarest words finds too; their cosine is null.

Scale: the corpus is read once to hash its words, which are written, two bytes each, and once for each block of ``ITEMS``
benchmark items, all in full parallel and without a shuffle of texts. Frequencies and the two passes of the fit read the
hashed words alone. What is gathered is one row a hashed word, and ``DIMENSIONS`` x ``RANK`` numbers, added up on the
executors from a task for each ``SHARE`` words, as many as there are cores at most. Benchmark items are broadcast block by
block.

Defined results: null texts count as empty and leak nothing; items without words are not searched; repeated documents
are reported as often as they come, repeated items each by its item_id; without documents or items the result is empty.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmesh.llm.common import documents, give_back, slices, texts
from seqmesh.session import discard, materialise, ship

PASSAGE, DIMENSIONS, RANK = 16, 1 << 15, 256
#: Words of a task that adds up products, at least: its sums, of 32 MB, are shuffled.
SHARE = 5_000_000
#: Passages that are added up at a time.
PIECE = 1 << 14
COSINE, SURE, LIKELY, SHORTEST, ITEMS = 0.5, 0.8, 0.6, 8, 20_000
#: How many of an item's rarest words must be around a window that the word index takes for a candidate.
HITS = 4
_CHUNK = 512
#: Bytes of text that a worker searches at a time.
_SLICE = 1 << 20
_CLEAN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words of letters and digits; ASCII marks separate."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def hashed(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found)) & np.uint32(DIMENSIONS - 1)


def blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every passage, texts laid end to end; a text without words has none."""
    n = -(-sizes // PASSAGE)
    text = np.repeat(np.arange(len(sizes)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(sizes) - sizes)[text] + within * PASSAGE, text


def _read(rows: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    lists = [words(x) for x in rows]
    sizes = np.array([len(w) for w in lists], dtype=np.int64)
    return lists, sizes, hashed([w for x in lists for w in x]).astype(np.int64)


def frequencies(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """In how many passages each hashed word is."""
    owner = np.zeros(len(ids), dtype=np.int64)
    owner[start[1:]] = 1
    key = np.sort(np.cumsum(owner) * DIMENSIONS + ids)
    return np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % DIMENSIONS, minlength=DIMENSIONS) if len(key) else np.zeros(DIMENSIONS, dtype=np.int64)


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``PIECE`` passages: their hashed words end to end, two bytes each, and how many each passage has."""
    for b in slices(batches, _SLICE):
        _, sizes, ids = _read(texts(b))
        start, _ = blocks(sizes)
        edge = np.r_[start, len(ids)].astype(np.int64)
        for i in range(0, len(start), PIECE):
            e = edge[i : i + PIECE + 1]
            row = ids[e[0] : e[-1]].astype("<u2").tobytes(), np.diff(e).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["ids", "sizes"])


_HASHED = "ids binary, sizes binary"


def _passages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed words, words of each passage) of each row that ``_hashes`` made."""
    for b in batches:
        for ids, sizes in zip(b.column("ids"), b.column("sizes"), strict=True):
            yield np.frombuffer(ids.as_buffer(), dtype="<u2").astype(np.int64), np.frombuffer(sizes.as_buffer(), dtype=np.uint8).astype(np.int64)
    give_back()


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, passages, n = np.zeros(DIMENSIONS, dtype=np.int64), 0, 0
    for ids, size in _passages(batches):
        total += frequencies(ids, np.cumsum(size) - size)
        passages, n = passages + len(size), n + len(ids)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, DIMENSIONS, DIMENSIONS + 1]), pa.array(np.r_[total[at], passages, n])], ["word", "n"])


def inverse_frequencies(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """(IDF by hashed word, number of words) over all documents; at most DIMENSIONS + 2 rows reach the driver."""
    rows = hashes.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(DIMENSIONS + 2)
    for r in rows:
        n[r.word] = r.n
    return np.log((1 + n[-2]) / (1 + n[:-2])).astype(np.float32) + np.float32(0.01), int(n[-1])


def sums(rows: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of ``rows[at[start : start + size]]`` for each run; runs have one to ``PASSAGE`` places."""
    order = np.argsort(-size, kind="stable")
    out, room = np.empty((len(start), rows.shape[1]), dtype=rows.dtype), np.empty((_CHUNK, rows.shape[1]), dtype=rows.dtype)
    for i in range(0, len(order), _CHUNK):
        these = order[i : i + _CHUNK]
        first, n = start[these], size[these]
        total = np.take(rows, at[first], axis=0)
        for k in range(1, int(n[0])):  # the longest come first
            m = int(np.searchsorted(-n, -k))
            np.take(rows, at[first[:m] + k], axis=0, out=room[:m], mode="clip")
            total[:m] += room[:m]
        out[these] = total
    return out


def long_sums(rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for runs of any length that lie end to end: sums of up to ``PASSAGE`` places, then of such sums."""
    n = -(-size // PASSAGE)
    head = np.cumsum(n) - n
    within = np.arange(n.sum()) - np.repeat(head, n)
    first = np.repeat(np.cumsum(size) - size, n) + within * PASSAGE
    part = sums(rows, at, first, np.minimum(np.repeat(size, n) - within * PASSAGE, PASSAGE))
    out, more = part[head].astype(np.float32, copy=False), n > 1
    if more.any():
        rest = part[np.repeat(more, n)].astype(np.float32, copy=False)
        out[more] = long_sums(rest, np.arange(len(rest)), n[more])
    return out


#: What is added up in 16 bits stays within these, so that sums of ``PASSAGE`` do as well.
MOST = (1 << 15) // PASSAGE - 1


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.float32]:
    """(``x`` in whole steps, their size); what is in ``x`` is lost."""
    step = np.float32(max(x.max(initial=0), -x.min(initial=0), 1e-30) / MOST)
    x /= step
    return np.rint(x, out=x).astype(np.int16), step


def along(ids: np.ndarray, size: np.ndarray, idf: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(IDF-weighted passages times directions, their lengths as vectors); ``q`` has the IDF in its rows."""
    start = np.cumsum(size) - size
    return sums(q, ids, start, size), np.sqrt(np.add.reduceat(idf[ids] ** 2, start))


def gram(ids: np.ndarray, size: np.ndarray, idf: np.ndarray, q: np.ndarray, step: np.float32, into: np.ndarray) -> None:
    """Add A'A of these passages, each of length one, times directions to ``into``, whose rows lack the IDF.

    ``q`` is the directions times the IDF, ``rounded`` in steps. What the range finder needs is some mix of all passages,
    so theirs is rounded as well, which halves the memory that is gone through.
    """
    x, length = along(ids, size, idf, q)
    mix, own = rounded(x * (step / (length * length))[:, None])
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    part = ids[order]
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    whole = long_sums(mix, np.repeat(np.arange(len(size)), size)[order], np.diff(np.r_[edge, len(part)]))
    whole *= own
    into[part[edge]] += whole


def directions() -> np.ndarray:
    """The random directions; every worker makes them from the seed."""
    return np.random.default_rng(3).standard_normal((DIMENSIONS, RANK), dtype=np.float32)


def _spread(idf):
    """Hashed words to A'A times random directions, in strips that can be added up apart; only rows of words that were met are sent."""
    strip = DIMENSIONS // 16

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out = directions(), np.zeros((DIMENSIONS, RANK), dtype=np.float32)
        q *= idf.value[:, None]
        q, step = rounded(q)
        for ids, size in _passages(batches):
            gram(ids, size, idf.value, q, step, out)
        out *= idf.value[:, None]
        for k in range(16):
            rows = out[k * strip : (k + 1) * strip]
            at = np.flatnonzero(rows.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([rows[at].tobytes()], pa.binary())], ["strip", "rows", "data"])
        del q, out, rows
        give_back()

    return run


def _crossed(shared, idf):
    """Hashed words to the Gram matrix of their passages along directions, in steps, in strips as well."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((RANK, RANK))
        for ids, size in _passages(batches):
            x, length = along(ids, size, idf.value, shared.value)
            x = x * (1 / length)[:, None]
            for i in range(0, len(x), 1024):
                total += x[i : i + 1024].T @ x[i : i + 1024]
            del x, length
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in np.split(total, 16)], pa.binary())], ["strip", "data"])

    return run


def _total(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer()) for x in t["data"])
    return pa.table({"strip": t["strip"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def _added(t: pa.Table) -> pa.Table:
    total = np.zeros((DIMENSIONS // 16, RANK), dtype=np.float32)
    for at, data in zip(t["rows"], t["data"], strict=True):
        total[np.frombuffer(at.as_buffer(), dtype=np.int32)] += np.frombuffer(data.as_buffer(), dtype=np.float32).reshape(-1, RANK)
    return pa.table({"strip": t["strip"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def _times(z: np.ndarray, m: np.ndarray) -> None:
    """z @ m in place of z, some rows at a time."""
    for i in range(0, len(z), 1024):
        z[i : i + 1024] = z[i : i + 1024] @ m


def orthonormal(z: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of z, in its place, by the Gram matrix's eigenvectors, twice for accuracy.

    Where z has fewer independent columns than columns, the rest are zero.
    """
    for _ in range(2):
        value, vector = np.linalg.eigh((z.T @ z).astype(np.float64))
        real = value > 1e-7 * max(value.max(), 1e-12)
        _times(z, (vector * np.where(real, 1 / np.sqrt(np.where(real, value, 1)), 0)).astype(np.float32))
    return z


def latent_basis(hashes: DataFrame, benchmark: DataFrame, idf: np.ndarray, n: int) -> np.ndarray:
    """Word by latent coordinate: IDF times right singular vectors over singular values; a last row of zeros is no word.

    ``hashes`` has the ``n`` hashed words of all documents.
    """
    spark = hashes.sparkSession
    items = benchmark.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_hashes, _HASHED)
    every = hashes.unionByName(items).coalesce(min(spark.sparkContext.defaultParallelism, 1 + n // SHARE))
    kept = spark.sparkContext.broadcast(idf)
    spread = every.mapInArrow(_spread(kept), "strip int, rows binary, data binary")
    added = materialise(spread.groupBy("strip").applyInArrow(_added, "strip int, data binary"), "products")
    z = np.zeros((DIMENSIONS + 1, RANK), dtype=np.float32)
    for i in range(16):  # a strip at a time, so that the driver never holds the whole twice
        r = added.where(F.col("strip") == i).first()
        if r is not None:
            z[i * (DIMENSIONS // 16) : (i + 1) * (DIMENSIONS // 16)] = np.frombuffer(r.data, dtype=np.float32).reshape(-1, RANK)
    discard(added)
    q = orthonormal(z[:-1])
    q *= idf[:, None]
    whole, step = rounded(q)
    shared = spark.sparkContext.broadcast(whole)
    # the directions are what they were rounded to
    np.multiply(whole, step, out=q)
    del whole
    crossed = every.mapInArrow(_crossed(shared, kept), "strip int, data binary").groupBy("strip").applyInArrow(_total, "strip int, data binary").collect()
    shared.destroy()
    small = np.zeros((RANK, RANK))
    for r in crossed:
        np.split(small, 16)[r.strip][:] = np.frombuffer(r.data).reshape(-1, RANK)
    value, vector = np.linalg.eigh((small + small.T) / 2 * float(step) ** 2)
    sigma = np.sqrt(np.maximum(value, 1e-6 * max(value.max(), 1e-12)))
    _times(q, (vector / sigma).astype(np.float32))
    return z


def window_vectors(ids: np.ndarray, sizes: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit latent vectors, first word within the text, text) of all windows of two passages; a text of one passage is one."""
    start, text = blocks(sizes)
    v = sums(basis, ids, start, np.diff(start, append=len(ids)))
    both = text[1:] == text[:-1]
    last = np.r_[~both, True][: len(v)] & np.r_[False, both][: len(v)]  # covered by the window before
    v[:-1][both] += v[1:][both]
    v = v[~last]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v, (start - (np.cumsum(sizes) - sizes)[text])[~last], text[~last]


class Items:
    """A block of benchmark items, ready to be searched: latent vectors of windows over each whole item, and its rarest words."""

    def __init__(self, rows: list[tuple[int, str]], basis: np.ndarray, idf: np.ndarray | None = None):
        rows = [(i, x) for i, x in rows if words(x or "")]
        self.ids = [i for i, _ in rows]
        self.words, sizes, ids = _read([x for _, x in rows])
        self.answers = [words(re.split(r"[.?!\n]+", x.strip().rstrip(".?!"))[-1]) for _, x in rows]
        edges, vectors, of, width = np.r_[0, np.cumsum(sizes)], [], [], 2 * PASSAGE
        for k, n in enumerate(sizes.tolist()):
            count = 1 + max(0, -(-(n - width) // PASSAGE)) if n >= SHORTEST else 0
            for j in range(count):  # from end to end, so that all of them are full
                at = int(edges[k]) + (round(j * (n - width) / (count - 1)) if count > 1 else 0)
                vectors.append(basis[ids[at : min(at + width, int(edges[k + 1]))]].sum(axis=0))
                of.append(k)
        v = np.array(vectors, dtype=np.float32).reshape(-1, RANK)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        self.vectors, self.of = np.ascontiguousarray(v.T), np.array(of, dtype=np.int64)
        self.masks = []
        for w in self.words:
            mask: dict[bytes, int] = {}
            for k, x in enumerate(w):
                mask[x] = mask.get(x, 0) | 1 << k
            self.masks.append(mask)
        self.counts = [{x: m.bit_count() for x, m in mask.items()} for mask in self.masks]
        self.need = [math.ceil(LIKELY * len(w) - 1e-9) for w in self.words]
        self.rare: dict[bytes, list[int]] = {}
        weight = np.zeros(DIMENSIONS) if idf is None else idf
        for k, w in enumerate(self.words):
            order = sorted(zip((-weight[hashed(w)]).tolist(), w, strict=True))
            for x in {x for _, x in order[: len(w) - self.need[k] + HITS if len(w) >= SHORTEST else 1]}:
                self.rare.setdefault(x, []).append(k)
        self.near = np.zeros(DIMENSIONS, dtype=bool)
        self.near[hashed(list(self.rare))] = True

    def share(self, k: int, span: list[bytes]) -> float:
        """The longest common subsequence of item k and the span, as a share of the item; bits of a long hold a row."""
        n, get = len(self.words[k]), self.masks[k].get
        full = row = (1 << n) - 1
        for w in span:
            if m := get(w):
                x = row & m
                row = ((row + x) | (row - x)) & full
        return (n - row.bit_count()) / n

    def covered(self, k: int, span: list[bytes]) -> bool:
        """Whether the words that item k and the span share are enough of the item; if not, their subsequence isn't either."""
        counts = self.counts[k]
        return sum(map(counts.__getitem__, counts.keys() & span)) >= self.need[k]

    def leaked(self, k: int, span: list[bytes]) -> tuple[bool, float, bool]:
        share = self.share(k, span)
        if share < LIKELY:
            return False, share, False
        rest = iter(span)
        answer = all(w in rest for w in self.answers[k])
        return share >= SURE or answer, share, answer

    def search(self, rows: list[str], basis: np.ndarray) -> list[dict[int, tuple[float, float | None, bool]]]:
        """For each text the leaked items: (share, cosine, answer found). ``basis`` has a row for each hashed word and one of zeros."""
        lists, sizes, ids = _read(rows)
        out: list[dict[int, tuple[float, float | None, bool]]] = [{} for _ in rows]
        if not len(ids) or not self.ids:
            return out
        v, first, text = window_vectors(ids, sizes, basis)
        for i in range(0, len(v), _CHUNK):
            cosine = v[i : i + _CHUNK] @ self.vectors
            at, which = np.nonzero(cosine >= COSINE)
            done = set()
            for w, q in zip((at + i).tolist(), which.tolist(), strict=True):
                k, t = int(self.of[q]), int(text[w])
                if (w, k) in done or k in out[t]:
                    continue
                done.add((w, k))
                n, f, has = len(self.words[k]), int(first[w]), self.masks[k].__contains__
                # a leak has LIKELY of the item within the span, and half of that where span and window meet best
                if sum(map(has, lists[t][f : f + 2 * PASSAGE])) < LIKELY / 2 * min(n, 2 * PASSAGE):
                    continue
                span = lists[t][max(0, f - n) : f + 2 * PASSAGE + n]
                yes, share, answer = self.leaked(k, span) if self.covered(k, span) else (False, 0.0, False)
                if yes:
                    out[t][k] = (share, float(cosine[w - i, q]), answer)
        begin = np.searchsorted(text, np.arange(len(rows) + 1)).tolist()
        edge, near = np.r_[0, np.cumsum(sizes)], np.flatnonzero(self.near[ids])
        among = np.searchsorted(near, edge).tolist()
        for t, found in enumerate(lists):
            places = (near[among[t] : among[t + 1]] - edge[t]).tolist()
            for k, f, share, answer in self.by_words(found, places, out[t]):
                w = min(begin[t] + f // PASSAGE, begin[t + 1] - 1)
                long = len(self.words[k]) >= SHORTEST
                out[t][k] = (share, float((v[w] @ self.vectors[:, self.of == k]).max()) if long else None, answer)
        return out

    def by_words(self, found: list[bytes], places: list[int], known: Iterable[int]) -> Iterator[tuple[int, int, float, bool]]:
        """(item, first word of the window, share, answer found) of every leaked item of a text but the known ones.

        ``places`` are those of words that have the hash of a rare one.
        """
        hits: dict[int, list[int]] = {}
        get = self.rare.get
        for p in places:
            if ks := get(found[p]):
                for k in ks:
                    hits.setdefault(k, []).append(p)
        known = set(known)
        for k, at in hits.items():
            if (n := len(self.words[k])) < SHORTEST:
                ahead = self.words[k].index(found[at[0]])  # the rarest word's first place in the item
                f = next((p - ahead for p in at if p >= ahead and found[p - ahead : p - ahead + n] == self.words[k]), None)
                if f is not None:
                    yield k, f, 1.0, True
            elif k not in known and len(at) >= HITS and (got := self._around(k, at, found)):
                yield k, *got

    def _around(self, k: int, at: list[int], found: list[bytes]) -> tuple[int, float, bool] | None:
        """The first window that has HITS of the places ``at`` in its span and holds a leak of item k."""
        n, following = len(self.words[k]), 0
        for a, b in zip(at, at[HITS - 1 :], strict=False):
            first = max(following, b - 2 * PASSAGE - n + 1)
            for f in range(-(-first // PASSAGE) * PASSAGE, min(a + n, len(found) - 1) + 1, PASSAGE):
                following = f + PASSAGE
                span = found[max(0, f - n) : f + 2 * PASSAGE + n]
                if self.covered(k, span):
                    yes, share, answer = self.leaked(k, span)
                    if yes:
                        return f, share, answer
        return None


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks that the driver and every executor can hold."""
    held: list[tuple[int, str]] = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) >= ITEMS:
            yield held
            held = []
    if held:
        yield held


def _searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """(items, basis), broadcast, for each block of the benchmark. The basis is fitted once, beside all blocks."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    basis = None
    for rows in _blocks(benchmark):
        if basis is None:
            hashes = materialise(documents(docs).select("text").mapInArrow(_hashes, _HASHED), "hashes")
            idf, n = inverse_frequencies(hashes)
            basis = latent_basis(hashes, benchmark, idf, n)
            discard(hashes)
            give_back()
            shared = spark.sparkContext.broadcast(basis)
        yield spark.sparkContext.broadcast(Items(rows, basis, idf)), shared


_OUT = "doc_id long, item_id long, lcs_share double, cosine double, answer_found boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each leak: doc_id, item_id, lcs_share, cosine, answer_found."""
    found = docs.sparkSession.createDataFrame([], _OUT)
    for items, basis in _searchers(docs, benchmark):

        def run(batches: Iterable[pa.RecordBatch], items=items, basis=basis) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, _SLICE):
                hits = items.value.search(texts(b), basis.value)
                rows = [{"doc_id": d, "item_id": items.value.ids[k], "lcs_share": s, "cosine": c, "answer_found": a} for d, h in zip(b.column("doc_id").to_pylist(), hits, strict=True) for k, (s, c, a) in sorted(h.items())]
                kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("lcs_share", pa.float64()), ("cosine", pa.float64()), ("answer_found", pa.bool_())])
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

        found = found.unionByName(documents(docs).mapInArrow(run, _OUT))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a leak, with all their columns; each row is judged by its own text."""
    kept = docs
    for items, basis in _searchers(docs, benchmark):

        def run(batches: Iterable[pa.RecordBatch], items=items, basis=basis) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, _SLICE):
                yield b.filter(pa.array([not h for h in items.value.search(texts(b), basis.value)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
