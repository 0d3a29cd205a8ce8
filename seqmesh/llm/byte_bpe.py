"""BPE encoding and decoding by segment trees over the ranks of adjacent pairs.

A pre-token's bytes are the leaves' symbols. Leaf i of the tree holds (rank of the pair at i, i), inner nodes hold the
smaller child, so the root is the leftmost pair of lowest rank. A merge writes three leaves (the pair itself, the one
before, and the one that vanishes) and repairs their paths to the root; it ends when the root holds no pair. Short
pre-tokens are merged many at a time, one tree a column of a numpy array; long ones one at a time.

Vocabularies are the JSON files of byte-level tokenizers (a ``BPE`` model under a ``ByteLevel`` pre-tokenizer without
normaliser). Special strings inside texts become their special ids, as the tokenizers library does by default.

Defined results: null texts count as empty; an empty text has no ids and decodes to the empty text; repeated rows come
out as often as they came in; lone surrogates can't stand in a table of strings. Pre-tokens that a worker has met are
kept up to ``CACHE`` entries and then forgotten, which changes no result.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqmesh.llm.common import documents, slices, state, texts
from seqmesh.session import ship

#: Pre-tokens a worker remembers.
CACHE = 400_000
#: Bytes up to which pre-tokens are merged many at a time.
SHORT = 64

# The pattern of the public byte-level pre-tokenizer, and the same for texts within Latin-1 (letters, numbers, white space spelt out).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾", r" \t\n\v\f\r\x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE vocabulary, from the bytes of its JSON file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE vocabularies without normaliser or prefix space are supported")
        letters, vocab = byte_letters(), model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or stand alone are not supported")
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab["".join(m)] for m in merges], dtype=np.int64)
        self.pairs = {k: r for r, k in reversed(list(enumerate(key.tolist())))}
        self.first_list, self.merged_list = self.first.tolist(), self.merged.tolist()
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.wide, self.latin = regex.compile(PATTERN), re.compile(LATIN)

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens in order; special strings are entries of their own."""
        try:
            text.encode("latin-1")
            find = self.latin.findall
        except UnicodeEncodeError:
            find = self.wide.findall
        if self.split is None or not any(s in text for s in self.specials):
            return find(text)
        return [p for k, part in enumerate(self.split.split(text)) for p in ([part] if k % 2 else find(part))]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is no merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


#: The rank of a pair that can't be merged.
NONE = 1 << 40


def merge_long(symbols: list[int], v: Vocabulary) -> list[int]:
    """All merges of one sequence through one segment tree."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 1).bit_length()
    ends = [(NONE, n)]
    find, size = v.pairs.get, v.size
    tree = [(NONE, n)] * width + [(find(symbols[i] * size + symbols[i + 1], NONE), i) for i in range(n - 1)] + ends * (width - n + 1)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        at = width + i
        tree[at] = (rank, i)
        at >>= 1
        while at:
            least = min(tree[2 * at], tree[2 * at + 1])
            if least == tree[at]:
                break
            tree[at] = least
            at >>= 1

    while tree[1][0] < NONE:
        rank, i = tree[1]
        j = after[i]
        k = after[j]
        symbols[i], symbols[j], after[i] = v.merged_list[rank], -1, k
        put(j, NONE)
        if k < n:
            before[k] = i
            put(i, find(symbols[i] * size + symbols[k], NONE))
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            put(h, find(symbols[h] * size + symbols[i], NONE))
    return [s for s in symbols if s >= 0]


def merge_short(rows: np.ndarray, lengths: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All merges of many sequences (columns of ``rows``), a segment tree each: symbols in place, and which survive."""
    width, n = rows.shape
    depth = width.bit_length() - 1
    symbols = np.vstack([rows, np.zeros((1, n), dtype=np.int64)])  # the last row takes writes past the end
    alive = np.arange(width)[:, None] < lengths
    at = np.arange(width)[:, None]
    rank = np.full((width, n), NONE, dtype=np.int64)
    ok = at[:-1] < lengths - 1
    rank[:-1][ok] = v.rank(symbols[:-2][ok], symbols[1:-1][ok])
    tree = np.empty((2 * width, n), dtype=np.int64)
    tree[width:] = rank << 8 | at
    for i in range(width - 1, 0, -1):
        np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])
    after = np.minimum(np.repeat(at + 1, n, 1), lengths)
    after = np.vstack([after, lengths[None]])
    before = np.repeat(np.arange(-1, width)[:, None], n, 1)
    cols = np.flatnonzero(tree[1] >> 8 < NONE)
    while len(cols):
        top = tree[1, cols]
        i, end = top & 255, lengths[cols]
        j = after[i, cols]
        k = after[j, cols]
        symbols[i, cols] = new = v.merged[top >> 8]
        alive[j, cols] = False
        after[i, cols] = k
        before[np.where(k < end, k, width), cols] = i
        h = before[i, cols]
        right = np.where(k < end, v.rank(new, symbols[np.minimum(k, width), cols]), NONE)
        left = np.where(h >= 0, v.rank(symbols[np.maximum(h, 0), cols], new), NONE)
        leaves = np.stack([i, j, np.where(h >= 0, h, i)])
        tree[leaves + width, cols] = np.stack([right, np.full(len(cols), NONE), np.where(h >= 0, left, right)]) << 8 | leaves
        leaves = leaves + width
        for _ in range(depth):
            leaves >>= 1
            tree[leaves, cols] = np.minimum(tree[2 * leaves, cols], tree[2 * leaves + 1, cols])
        cols = cols[tree[1, cols] >> 8 < NONE]
    return symbols[:-1], alive


def encode_many(words: list[str], v: Vocabulary) -> list[list[int]]:
    """The ids of each pre-token."""
    raw = [w.encode() for w in words]
    out: list[list[int]] = [[] for _ in raw]
    size = np.array([len(r) for r in raw])
    for low, high in ((0, 8), (8, 16), (16, 32), (32, SHORT)):
        group = np.flatnonzero((size > low) & (size <= high))
        for at in range(0, len(group), 16384):
            part = group[at : at + 16384]
            flat = np.frombuffer(b"".join(raw[g].ljust(high, b"\0") for g in part), dtype=np.uint8).reshape(-1, high)
            symbols, alive = merge_short(v.first[flat.T], size[part], v)
            kept, ends = symbols.T[alive.T].tolist(), np.cumsum(alive.sum(axis=0)).tolist()
            for g, i, j in zip(part.tolist(), [0, *ends], ends, strict=False):
                out[g] = kept[i:j]
    for g in np.flatnonzero(size > SHORT).tolist():
        out[g] = merge_long([v.first_list[b] for b in raw[g]], v)
    for g, w in enumerate(words):
        if w in v.specials:
            out[g] = [v.specials[w]]
    return out


class Memo(dict):
    """What has been worked out for pre-tokens, filled many at a time and emptied when it is full."""

    def __init__(self, solve: Callable[[list[str]], list]):
        self.solve = solve

    def ready(self, lists: list[list[str]]) -> None:
        new = set().union(*lists).difference(self)
        if len(self) + len(new) > CACHE:
            self.clear()
            new = set().union(*lists)
        words = list(new)
        self.update(zip(words, self.solve(words), strict=True))


class Shared:
    """A vocabulary file's bytes on all executors. Such files are a few MB, whatever the corpus."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.held = spark.sparkContext.broadcast(f.read())
        self.id = (path, uuid.uuid4().hex)

    @property
    def value(self) -> bytes:
        return self.held.value


def _solve(v: Vocabulary) -> Callable[[list[str]], list]:
    def solve(words: list[str]) -> list[tuple[int, str, bytes]]:
        return [(len(ids), ",".join(map(str, ids)), b"".join([v.bytes[i] for i in ids])) for ids in encode_many(words, v)]

    return solve


def memo(name: str, shared: Shared, solve: Callable[[Vocabulary], Callable[[list[str]], list]]) -> tuple[Vocabulary, Memo]:
    """The tables of a broadcast vocabulary file and what has been worked out with them, kept by the worker."""

    def make() -> tuple[Vocabulary, Memo]:
        v = Vocabulary(shared.value)
        return v, Memo(solve(v))

    return state((name, shared.id), make)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = memo("digests", shared, _solve)
        for b in slices(batches, 2 << 20):
            lists = [v.pretokens(x) for x in texts(b)]
            known.ready(lists)
            counts, ids, decoded = [], [], []
            for words in lists:
                got = [known[w] for w in words]
                counts.append(sum(g[0] for g in got))
                ids.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
                text = b"".join([g[2] for g in got]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids themselves, an array of int for each document."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = memo("ids", shared, lambda v: lambda words: encode_many(words, v))
        for b in slices(batches, 2 << 20):
            lists = [v.pretokens(x) for x in texts(b)]
            known.ready(lists)
            ids = pa.array([[i for w in words for i in known[w]] for words in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, ids outside the vocabulary an error."""
    spark = ids.sparkSession
    ship(spark)
    shared = Shared(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = state(("decode", shared.id), lambda: Vocabulary(shared.value))
        for b in batches:
            out = [b"".join([v.bytes[i] for i in row or ()]).decode("utf-8", "replace") for row in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
