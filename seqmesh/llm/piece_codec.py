"""SentencePiece encoding and decoding by vectorised merge rounds, for BPE models with byte fallback.

The distinct pre-tokens of a slice (see ``token_counts``: no merge crosses a cut before a run of U+2581) are laid end to
end in flat arrays: the symbol, the pair rank to its right, the word, and the place of its first character. In each
round a segmented minimum finds every word's lowest pair rank, the leftmost pairs of that rank that do not overlap are
merged in all words at once, and the arrays are compacted; words that hold no pair leave the arrays. Where a merge
makes a pair whose rank is no higher, the word's round ends with it, so the result is that of merging one by one.
A symbol outside the vocabulary becomes the byte pieces of its character.

Decoding looks up the bytes of each id, drops the space that encoding put in front, and reads the whole as UTF-8; each
byte that belongs to no character becomes U+FFFD, as in the library.

Defined results: null texts count as empty and have the end id alone; an empty text decodes to the empty text; repeated
rows come out as often as they came in; special strings inside texts are plain text, U+2581 decodes to a space; null
ids decode to the empty text, ids outside the model are an error. Models with another normaliser are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqmesh.llm.byte_bpe import Memo, Shared
from seqmesh.llm.common import documents, slices, state, texts
from seqmesh.llm.token_counts import _NONE, MARK, PieceModel, pretokens
from seqmesh.session import ship

#: Characters of distinct pre-tokens in the arrays at a time, if one alone has no more.
BATCH = 400_000
_MARK = MARK.encode()


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("seqmesh-each-byte", _each_byte)


class PieceCodec(PieceModel):
    """The merge tables of a model with its ids, from the bytes of its file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        super().__init__(data)
        m = pb.ModelProto()
        m.ParseFromString(data)
        self.n_pieces = len(m.pieces)
        self.end = m.trainer_spec.eos_id
        if self.end < 0:
            raise ValueError("the model has no end id")
        #: the id of each symbol, -1 for those that fall back to bytes
        self.id = np.full(self.size, -1, dtype=np.int64)
        #: the bytes of each id; a piece's marks are spaces, control ids have none
        self.text: list[bytes] = []
        #: ids whose piece starts with the mark, ids without text, and the ids of the bytes
        self.marked, self.silent, at = set(), set(), {}
        symbol = 5  # as the tables number the pieces: in their order behind the classes of unknown characters
        for i, p in enumerate(m.pieces):
            if p.type == 1:
                self.id[symbol] = i
                symbol += 1
            if p.type == 6:
                at[int(p.piece[1:-1], 16)] = i
            if p.piece.startswith(MARK):
                self.marked.add(i)
            if p.type == 3:
                self.silent.add(i)
            self.text.append(bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" if p.type == 3 else m.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.encode().replace(_MARK, b" "))
        if len(at) != 256:
            raise ValueError("the model lacks pieces for some bytes")
        self.byte = np.array([at[b] for b in range(256)], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each escaped pre-token."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        # words of like length together, so that a long one does not hold up many
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // BATCH)) + 1):
            if len(part):
                ids, many = self._ids([words[k] for k in part])
                for k, x in zip(part.tolist(), np.split(ids, np.cumsum(many)[:-1]), strict=True):
                    out[k] = x
        return out

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, how many each has)."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        word, place, symbol = self._merged(points, np.array([len(w) for w in words]))
        piece = self.id[symbol]
        lost = piece < 0
        many = np.ones(len(piece), dtype=np.int64)
        # a symbol that is no piece is one character
        wide = points[place[lost]]
        many[lost] = 1 + (wide > 0x7F) + (wide > 0x7FF) + (wide > 0xFFFF)
        ids = np.repeat(piece, many)
        raw = wide.astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[np.repeat(lost, many)] = self.byte[np.frombuffer(raw, dtype=np.uint8)]
        return ids, np.bincount(word, weights=many, minlength=len(words)).astype(np.int64)

    def _merged(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, symbol) of what is left when no word holds a pair, in order of place."""
        s, place = self.char[points], np.arange(len(points))
        word = np.repeat(np.arange(len(size)), size)
        rank, into = np.full(len(s), _NONE), np.zeros(len(s), dtype=np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], into[inner] = self.rank(s[inner], s[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(s):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(start, append=len(s))
            low = np.minimum.reduceat(rank, start)
            if (over := low >= _NONE).any():
                out = np.repeat(over, length)
                done.append((word[out], place[out], s[out]))
                s, word, place, rank, into = (x[~out] for x in (s, word, place, rank, into))
                low, length = low[~over], length[~over]
                if not len(s):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # of pairs that overlap every other one, from the left
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            new = into[at]
            if len(at) > len(low):
                at, new = self._prefix(s, word, at, new, word[at], rank[at])
            s[at] = new
            keep = np.ones(len(s), dtype=bool)
            keep[at + 1] = False
            s, word, place, rank, into = (x[keep] for x in (s, word, place, rank, into))
            at = at - np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                same = np.zeros(len(p), dtype=bool)
                inside = p + 1 < len(s)
                same[inside] = word[p[inside]] == word[p[inside] + 1]
                q = p[same]
                rank[p[~same]] = _NONE
                rank[q], into[q] = self.rank(s[q], s[q + 1])
        word, place, s = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, dtype=np.int64),) * 3
        order = np.argsort(place, kind="stable")
        return word[order], place[order], s[order]

    def encode(self, text: str) -> list[int]:
        """The ids of a text with the end id."""
        words = pretokens(text)
        return [*(np.concatenate(self.encode_words(words)).tolist() if words else []), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        if any(not 0 <= i < self.n_pieces for i in ids):
            raise ValueError("an id outside the model")
        # bytes on either side of a control id are no character together
        runs = [b"".join([self.text[i] for i in run]) for quiet, run in itertools.groupby(ids, self.silent.__contains__) if not quiet]
        text = "".join([x.decode("utf-8", "seqmesh-each-byte") for x in runs])
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first in self.marked else text


def _solve(model: PieceCodec) -> Callable[[list[str]], list]:
    def solve(words: list[str]) -> list[tuple[int, str, bytes]]:
        lists = [x.tolist() for x in model.encode_words(words)]
        return [(len(x), " ".join(map(str, x)), b"".join([model.text[i] for i in x])) for x in lists]

    return solve


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens (with the end id), ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> tuple[PieceCodec, Memo]:
            model = PieceCodec(shared.value)
            return model, Memo(_solve(model))

        model, known = state(("piece digests", shared.id), make)
        for b in slices(batches, 2 << 20):
            lists = [pretokens(x) for x in texts(b)]
            known.ready(lists)
            counts, ids, decoded = [], [], []
            for words in lists:
                got = [known[w] for w in words]
                counts.append(sum(g[0] for g in got) + 1)
                ids.append(hashlib.sha256(" ".join([*(g[1] for g in got), str(model.end)]).encode()).hexdigest())
                # a pre-token starts with the mark, so the text's first byte is the space that encoding put there
                text = b"".join([g[2] for g in got])[1:].decode("utf-8", "seqmesh-each-byte")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids themselves with the end id, an array of int for each document."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> tuple[PieceCodec, Memo]:
            model = PieceCodec(shared.value)
            return model, Memo(model.encode_words)

        model, known = state(("piece ids", shared.id), make)
        for b in slices(batches, 2 << 20):
            lists = [pretokens(x) for x in texts(b)]
            known.ready(lists)
            ids = [np.concatenate([*(known[w] for w in words), [model.end]]) for words in lists]
            edge = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    spark = ids.sparkSession
    ship(spark)
    shared = Shared(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state(("piece decode", shared.id), lambda: PieceCodec(shared.value))
        for b in batches:
            out = [model.decode(row or []) for row in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
