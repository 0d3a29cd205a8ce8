"""Token counts by rank-synchronous merging of ragged arrays, for SentencePiece BPE models with byte fallback.

A text is escaped (a space becomes U+2581, one more is put in front) and cut before every run of that mark: no piece
of a supported model holds the mark behind another character, so no merge crosses a cut. The distinct pre-tokens of a
slice become one ragged array of symbols. In each round every sequence merges its pairs of lowest rank, from the left
without overlap, all sequences at once; sequences without a pair drop out, and what survives is counted. A symbol
outside the vocabulary counts as many tokens as it has UTF-8 bytes. Merging one after another would look at a new pair
before the next old one if the new one's rank is no higher; where that is so, a sequence's round ends with that merge,
so the result is that of merging one by one. A sequence takes about as many rounds as ranks are met in it.

Defined results: null texts count as empty and have no tokens; repeated rows come out as often as they came in;
special strings inside texts are plain text, as in the library; models with another normaliser are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.llm.byte_bpe import Memo, Shared
from seqmesh.llm.common import documents, slices, state, texts
from seqmesh.session import ship

MARK = "▁"
#: Characters of distinct pre-tokens merged at a time, if one alone has no more.
BATCH = 400_000
_NONE = 1 << 30
_CUT = re.compile(f"{MARK}+[^{MARK}]*")


class PieceModel:
    """Tables of a SentencePiece BPE model, from the bytes of its file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normaliser are supported")
        if any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        score = {p.piece: p.score for p in m.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError("models whose pieces hold a space behind another character are not supported")
        self._tables(score)

    def _tables(self, score: dict[str, float]) -> None:
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        # ids 1-4 are characters outside the vocabulary by their number of bytes; the rest are strings that can be a symbol
        ids = {p: i + 5 for i, p in enumerate(score)}
        for p in score:
            for c in p:
                ids.setdefault(c, len(ids) + 5)
        self.size = len(ids) + 5
        self.cost = np.ones(self.size, dtype=np.int64)
        self.cost[1:5] = 1, 2, 3, 4
        for c, i in ids.items():
            if c not in score:
                self.cost[i] = len(c.encode())
        point = np.arange(0x110000)
        self.char = (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)).astype(np.int64)
        for c, i in ids.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        table = {ids[p[:k]] * self.size + ids[p[k:]]: (order[s], ids[p]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.keys = np.array(sorted(table), dtype=np.int64)
        self.ranks = np.array([table[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.into = np.array([table[k][1] for k in self.keys.tolist()], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (``_NONE`` without a merge) and the merged symbol of each pair."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.into[at]

    def _codes(self, words: list[str]) -> np.ndarray:
        return self.char[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]

    def _rounds(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, merged all together; words are not empty."""
        s, size = self._codes(words), np.array([len(w) for w in words])
        count, who = np.zeros(len(words), dtype=np.int64), np.arange(len(words))
        seq = np.repeat(who, size)
        rank, into = np.full(len(s), _NONE), np.zeros(len(s), dtype=np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], into[inner] = self.rank(s[inner], s[inner + 1])
        while len(s):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(start, append=len(s))
            low = np.minimum.reduceat(rank, start)
            over = low >= _NONE
            if over.any():
                done = np.repeat(over, length)
                count += np.bincount(seq[done], weights=self.cost[s[done]], minlength=len(words)).astype(np.int64)
                s, seq, rank, into = s[~done], seq[~done], rank[~done], into[~done]
                low, length = low[~over], length[~over]
                if not len(s):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            # pairs that overlap: every other one, from the left
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            new, own = into[at], seq[at]
            if len(at) > len(low):  # more than one merge in a sequence
                at, new = self._prefix(s, seq, at, new, own, rank[at])
            s[at] = new
            keep = np.ones(len(s), dtype=bool)
            keep[at + 1] = False
            s, seq, rank, into = s[keep], seq[keep], rank[keep], into[keep]
            at = at - np.arange(len(at))  # one symbol has gone for each merge before
            for p in (at, at[at > 0] - 1):
                last = p + 1 >= len(s)
                same = np.zeros(len(p), dtype=bool)
                same[~last] = seq[p[~last]] == seq[p[~last] + 1]
                q = p[same]
                rank[p[~same]] = _NONE
                rank[q], into[q] = self.rank(s[q], s[q + 1])
        return count

    def _prefix(self, s: np.ndarray, seq: np.ndarray, at: np.ndarray, new: np.ndarray, own: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of each sequence up to the first that makes a pair whose rank is no higher."""
        far = np.minimum(at + 2, len(s) - 1)
        right = np.where((at + 2 < len(s)) & (seq[far] == own), self.rank(new, s[far])[0], _NONE)
        near = np.maximum(at - 1, 0)
        merged = np.zeros(len(at), dtype=bool)  # the symbol before is what the merge before made
        merged[1:] = (at[1:] == at[:-1] + 2) & (own[1:] == own[:-1])
        before = np.where(merged, np.r_[0, new[:-1]], s[near])
        left = np.where((at > 0) & (seq[near] == own), self.rank(before, new)[0], _NONE)
        early = np.minimum(left, right) <= rank
        if not early.any():
            return at, new
        earlier = np.cumsum(early) - early
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        go = earlier == np.repeat(earlier[first], np.diff(first, append=len(own)))
        return at[go], new[go]

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each escaped pre-token."""
        out = np.zeros(len(words), dtype=np.int64)
        some = np.array([k for k, w in enumerate(words) if w], dtype=np.int64)
        # words of like length together, so that a long one does not hold up many
        size = np.array([len(words[k]) for k in some], dtype=np.int64)
        some, size = some[np.argsort(size, kind="stable")], np.sort(size)
        batch = np.cumsum(size) // BATCH
        for part in np.split(some, np.flatnonzero(np.diff(batch)) + 1):
            if len(part):
                out[part] = self._rounds([words[k] for k in part])
        return out.tolist()


def pretokens(text: str) -> list[str]:
    return _CUT.findall(MARK + text.replace(" ", MARK)) if text else []


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = state(("pieces", shared.id), lambda: Memo(PieceModel(shared.value).counts))
        for b in slices(batches, 2 << 20):
            rows = texts(b)
            lists = [pretokens(x) for x in rows]
            known.ready(lists)
            counts = pa.array([sum(map(known.__getitem__, words)) for words in lists], pa.int64())
            size = pa.array([len(x.encode()) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, counts], ["doc_id", "n_bytes", "n_tokens"])

    found = documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
