"""Token-id shards compressed by a Re-Pair grammar, with random access.

Documents are dealt to ranges of ascending doc_id and encoded there by the tokenizers library (each distinct pre-token
once a worker; a byte-level pre-token is encoded alike on its own). Texts within Latin-1 are cut into pre-tokens and
looked up many at a time (``latin_words``), others one by one. An end id follows each document. Every
``SHARD_IDS`` ids make a shard, a shard is compressed on its own, and its image is one row of a table in the shared
folder, so a lost executor costs the shards it was writing.

Re-Pair: the most frequent pair of neighbouring ids is replaced by a nonterminal, again and again, until no pair of the
shard's sequence occurs twice. Places are linked, so a replacement touches only its neighbours; pairs that tie and share
no symbol are replaced together, and shards of a task in the same steps. Rules that only one rule uses are written out
there.

Image (little-endian): ``RPR2``, then eight longs: documents, ids, rules, symbols, first nonterminal, null doc_ids,
symbols of all rules, and a spare; doc_ids (long); the documents' lengths (u32); for each rule its number of symbols
and its expansion length (u32); the rules' symbols (u32); the sequence (u32); and for every ``STEP``-th symbol the ids
before it (long). A reader finds an id by the documents' lengths, goes to the last step before it and expands only the
symbols that it needs.

Defined results: null texts count as empty, an empty text is stored as the end id alone; null doc_ids come first; rows
with equal doc_id follow one another in the order of their texts; empty tables give no shards and no rows.
"""

from __future__ import annotations

import heapq
import itertools
import operator
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmesh.llm.byte_bpe import Shared, Vocabulary, byte_letters
from seqmesh.llm.common import documents, slices, state, texts
from seqmesh.llm.latin_words import Words, ranges
from seqmesh.session import ship

SHARD_IDS, STEP = 1 << 20, 1024
#: Shards that are compressed in the same steps, each on its own: about 35 MB of memory a shard.
TOGETHER = 8
#: Pre-tokens of a generation that a worker remembers, about 200 bytes each; twice as many of Latin-1 texts, about 60 each.
KNOWN = 800_000
_SHARD = "part int, seq int, before long, n_ids long, image binary"


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


class _Occurrences:
    """Sequences as linked places, and their pairs that were met twice or more: how often they still are, and where.

    A pair holds the younger of its two symbols from the moment that symbol is made, so all of its places are known
    then and only grow fewer; a place counts for a pair while ``pair`` says so. Sequences share the arrays and the names
    of new symbols, but no pair. (The names break ties between pairs that touch, so a grammar may depend on its company.)
    """

    def __init__(self, sequences: list[np.ndarray], first: int):
        self.ends = np.cumsum([len(x) for x in sequences])
        n = int(self.ends[-1])
        self.n, self.made = n, first
        self.deep = n.bit_length()
        #: by place, and one more that stands before and behind every sequence
        self.symbol = np.concatenate([*sequences, [np.iinfo(np.int32).max]]).astype(np.int32)
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        some = np.diff(self.ends, prepend=0) > 0
        self.after[self.ends[some] - 1] = self.before[np.r_[0, self.ends[:-1]][some]] = n
        #: by place: the pair that begins there, 0 for none and for pairs that occur once, -1 where a symbol has gone
        self.pair = np.zeros(n + 1, dtype=np.int32)
        # a replacement makes at most two new neighbourhoods, and there are fewer than n replacements
        self.where, self.held, self.pairs, most = np.empty(3 * n, dtype=np.int32), 0, 1, 2 + 3 * n // 2
        #: by pair: where its places begin, how many they were, how many they are, and its place among those looked at
        self.start, self.size, self.count, self.slot = (np.zeros(most, dtype=np.int32) for _ in range(4))
        #: by pair: its sequence, and whether its two symbols are the same
        self.home, self.twin = np.zeros(most, dtype=np.int16), np.zeros(most, dtype=bool)

    def begin(self, low: int, ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Take up the pairs of one sequence, which begins at ``low``, as they are: (pairs met more than once, how often)."""
        wide, at = max(first - 1, 1).bit_length(), np.arange(low, low + len(ids) - 1)
        key = ids[:-1].astype(np.int64)
        key <<= wide
        key |= ids[1:]
        if 2 * wide + self.deep < 64:  # sorting numbers is faster than sorting their places
            key <<= self.deep
            key |= at
            key.sort()
            return self._take_up(key)
        order = np.argsort(key, kind="stable")
        return self._take_up(np.cumsum(np.diff(key[order], prepend=-1) != 0) << self.deep | at[order])

    def _take_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take up pairs from the places where they begin, under the pair's key and in order."""
        key = found >> self.deep
        same = np.zeros(len(key) + 1, dtype=bool)
        np.equal(key[1:], key[:-1], out=same[1:-1])
        often = np.flatnonzero(same[1:] | same[:-1])
        at, first = found.take(often) & ((1 << self.deep) - 1), np.flatnonzero(~same.take(often))
        size = np.diff(first, append=len(at))
        new = np.arange(self.pairs, self.pairs + len(size))
        self.pair[at] = np.repeat(new, size)
        self.where[self.held : self.held + len(at)] = at
        part, one = slice(self.pairs, self.pairs + len(size)), at[first]
        self.start[part], self.size[part], self.count[part] = self.held + first, size, size
        self.home[part] = np.searchsorted(self.ends, one, "right")
        self.twin[part] = self.symbol.take(one) == self.symbol.take(self.after.take(one))
        self.held, self.pairs = self.held + len(at), self.pairs + len(size)
        return new, size

    def places(self, pairs: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, those of the symbols behind, whose they are as an index into ``pairs``, how many each has).

        They come from the left and without overlap.
        """
        size = self.size.take(pairs)
        at = self.where.take(ranges(self.start.take(pairs), size)).astype(np.intp)
        who = np.repeat(np.arange(len(pairs)), size)
        if (often < size).any():
            now = self.pair.take(at) == np.repeat(pairs, size)
            at, who = at.compress(now), who.compress(now)
        behind = self.after.take(at).astype(np.intp)
        if self.twin[pairs].any():
            joined = (behind[:-1] == at[1:]) & (who[:-1] == who[1:])
            if joined.any():  # runs of one symbol: every other place
                run = np.flatnonzero(np.r_[True, ~joined])
                odd = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) & 1
                at, behind, who = at[odd == 0], behind[odd == 0], who[odd == 0]
                often = np.bincount(who, minlength=len(pairs))
        return at, behind, who, often

    def waiting(self, pairs: np.ndarray, behind: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Which of the pairs have to wait, so that no two of the others share a symbol of a sequence."""
        wait = np.zeros(len(pairs), dtype=bool)
        if len(pairs) > 1:
            self.slot[pairs] = np.arange(1, len(pairs) + 1)
            other = self.slot.take(self.pair.take(behind))
            self.slot[pairs] = 0
            meet = np.flatnonzero(other)
            x, y = who.take(meet), other.take(meet) - 1
            # in the order of a hash, so that a long repeat is halved again and again instead of growing by one symbol
            turn = pairs * 0x9E3779B1 & 0xFFFFFFFF
            meet = x != y
            x, y = x[meet], y[meet]
            wait[np.where(turn[x] > turn[y], x, y)] = True
        return wait

    def replace(self, at: np.ndarray, gone: np.ndarray, who: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Put ``n`` new symbols in the place of the pairs at ``at``, and take up what they make: (pairs, how often)."""
        made = self.made
        following = self.after.take(gone).astype(np.intp)
        self.symbol[at] = made + who
        self.after[at] = following
        self.before[following] = at
        left = self.before.take(at).astype(np.intp)
        beside = self.symbol.take(left)
        old = np.flatnonzero(beside < made)
        left, beside = left.take(old), beside.take(old)
        np.subtract.at(self.count, np.concatenate([self.pair.take(gone), self.pair.take(left)]).astype(np.intp), np.int32(1))
        self.pair[gone], self.pair[at], self.pair[left] = -1, 0, 0
        self.made = made + n
        # a pair of the new symbol and what follows, or of what stands before it and the new symbol
        wide, behind, left_who = self.made.bit_length(), self.symbol.take(following), who.take(old) + n
        inner = following < self.n
        if not inner.all():
            at, who, behind = at.compress(inner), who.compress(inner), behind.compress(inner)
        at, new, other = np.concatenate([at, left]), np.concatenate([who, left_who]), np.concatenate([behind, beside])
        if (2 * n).bit_length() + wide + self.deep < 64:
            new <<= wide
            new |= other
            new <<= self.deep
            new |= at
            new.sort()
            return self._take_up(new)
        order = np.lexsort((at, other, new))
        key = new[order] << wide | other[order]
        return self._take_up(np.cumsum(np.diff(key, prepend=-1) != 0) << self.deep | at[order])


def repair_together(sequences: list[np.ndarray], first: int) -> list[tuple[np.ndarray, np.ndarray, list[int], np.ndarray]]:
    """Re-Pair to its end, of each sequence on its own: (rules as rows of two symbols, their expansion lengths, how many
    each step made, sequence). No pair of a sequence occurs twice without overlap.

    A sequence's pairs wait by how often they were last known to occur; the fullest are looked at first. Of those that
    tie, all that share no symbol are replaced at once, which is what replacing them one after another gives. A step is
    taken for all sequences at once, of each its own fullest pairs, for a step's cost hardly depends on its size.
    """
    if any(len(x) and int(x.max()) >= first for x in sequences):
        raise ValueError("ids must be below the first nonterminal")
    if not sum(map(len, sequences)):
        return [(np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64), [], x.astype(np.int32)) for x in sequences]
    found, n = _Occurrences(sequences, first), len(sequences)
    levels: list[dict[int, list[np.ndarray]]] = [{} for _ in sequences]
    heaps: list[list[int]] = [[] for _ in sequences]
    deep, wide = found.deep, len(found.count).bit_length()

    def later(pairs: np.ndarray, often: np.ndarray) -> None:
        more = often > 1
        pairs, often = pairs.compress(more), often.compress(more)
        # by sequence, then how often, then the pair: ids fit in memory, so these are fewer than 64 bits
        key = np.sort((found.home.take(pairs).astype(np.int64) << deep | often) << wide | pairs)
        pairs = key & ((1 << wide) - 1)
        key >>= wide
        cut = _firsts(key)
        for k, i, j in zip(key.take(cut).tolist(), cut.tolist(), [*cut[1:].tolist(), len(key)], strict=False):
            at, level = levels[k >> deep], k & ((1 << deep) - 1)
            if level not in at:
                at[level] = []
                heapq.heappush(heaps[k >> deep], -level)
            at[level].append(pairs[i:j])

    for low, ids in zip(found.ends.tolist(), sequences, strict=True):
        later(*found.begin(low - len(ids), ids, first))
    rules, homes, level, left, idle = [np.zeros((0, 2), dtype=np.int32)], [np.zeros(0, dtype=np.int16)], np.zeros(n, dtype=np.int32), [], range(n)
    while True:
        for k in idle:
            if heaps[k]:
                level[k] = -heapq.heappop(heaps[k])
                left += levels[k].pop(int(level[k]))
        if not left:
            break
        pairs = np.concatenate(left)
        often, least = found.count.take(pairs), level.take(found.home.take(pairs))
        if (few := often < least).any():
            later(pairs[few], often[few])
            pairs, often, least = pairs[~few], often[~few], least[~few]
        at, gone, who, often = found.places(pairs, often)
        few = often < least
        wait = few | found.waiting(pairs, gone, who)
        left = []
        if wait.any():
            later(pairs[few], often[few])
            left = [pairs[wait & ~few]]
            pairs, now = pairs[~wait], np.flatnonzero(~wait.take(who))
            at, gone, who = at.take(now), gone.take(now), (np.cumsum(~wait) - 1).take(who.take(now))
        if len(pairs):
            some = _firsts(who)
            rules.append(np.stack([found.symbol[at[some]], found.symbol[gone[some]]], axis=1))
            homes.append(found.home[pairs])
            new = found.replace(at, gone, who, len(pairs))
            found.count[pairs] = 0
            later(*new)
        busy = np.bincount(found.home[left[0]], minlength=n) if left else np.zeros(n, dtype=np.int64)
        idle = np.flatnonzero(busy == 0).tolist()
        if left and not len(left[0]):
            left = []
    return _apart(found, np.concatenate(rules), homes, first)


def _apart(found: _Occurrences, rules: np.ndarray, homes: list[np.ndarray], first: int) -> list[tuple[np.ndarray, np.ndarray, list[int], np.ndarray]]:
    """What was found for each sequence, with names of its own for its symbols."""
    home, size, made = np.concatenate(homes), np.ones(found.made, dtype=np.int64), first
    for step in homes:  # a step's rules are made of earlier symbols
        part = slice(made - first, made - first + len(step))
        size[made : made + len(step)] = size[rules[part]].sum(axis=1)
        made += len(step)
    mine = [np.flatnonzero(home == k) for k in range(len(found.ends))]
    name = np.arange(found.made, dtype=np.int32)
    for own in mine:
        name[first + own] = first + np.arange(len(own), dtype=np.int32)
    step, out, low = np.repeat(np.arange(len(homes)), [len(x) for x in homes]), [], 0
    for own, high in zip(mine, found.ends.tolist(), strict=True):
        counts = np.bincount(step[own], minlength=len(homes))
        seq = name[found.symbol[low:high][found.pair[low:high] >= 0]]
        out.append((name[rules[own]], size[first + own], counts[counts > 0].tolist(), seq))
        low = high
    return out


def repair(ids: np.ndarray, first: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Re-Pair of one sequence: (rules as rows of two symbols, in steps, sequence)."""
    rules, _, counts, seq = repair_together([ids], first)[0]
    return np.split(rules, np.cumsum(counts)[:-1]) if counts else [], seq


def grammar(ids: np.ndarray, first: int, made: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules' symbols laid end to end, symbols of each rule, expansion lengths, sequence) of uint32 ids below ``first``.

    A rule that only one other rule uses is written out there, so every rule is used twice or more. ``made`` is what
    ``repair_together`` gave for these ids, if it was asked.
    """
    rules, size, _, seq = made or repair_together([ids], first)[0]
    once = np.bincount(np.concatenate([rules.ravel(), seq]), minlength=first + len(rules)) < 2
    once[:first] = False
    kept = np.flatnonzero(~once[first:])
    flat, rule = rules[kept].ravel(), np.repeat(np.arange(len(kept)), 2)
    while (inner := once[flat]).any():
        at = np.cumsum(1 + inner) - 1 - inner
        below = rules[flat[inner] - first]
        flat, rule = np.repeat(flat, 1 + inner), np.repeat(rule, 1 + inner)
        flat[at[inner]], flat[at[inner] + 1] = below.T
    name = (np.cumsum(~once) - 1).astype(np.uint32)
    return name[flat], np.bincount(rule, minlength=len(kept)).astype(np.uint32), size[kept].astype(np.uint32), name[seq]


class Shard:
    """A reader of one image."""

    def __init__(self, image: bytes):
        if image[:4] != b"RPR2":
            raise ValueError("not a token shard")
        docs, self.n_ids, rules, symbols, self.first, self.nulls, written = np.frombuffer(image, "<i8", 8, 4)[:7].tolist()
        at = 68

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(image, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids, self.lengths = take("<i8", docs), take("<u4", docs).astype(np.int64)
        self.counts, self.sizes, self.bodies = take("<u4", rules).astype(np.int64), take("<u4", rules).astype(np.int64), take("<u4", written)
        self.seq, self.steps = take("<u4", symbols), take("<i8", (symbols + STEP - 1) // STEP)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.begin = np.cumsum(self.counts) - self.counts
        before = np.cumsum(self._size(self.bodies)) - self._size(self.bodies)
        #: all rules' ids end to end, when they have been asked for
        self.written: np.ndarray | None = None
        #: ids between a rule's first id and those of each symbol of its body
        self.inside = before - np.repeat(before[self.begin], self.counts) if rules else before

    def _size(self, seq: np.ndarray) -> np.ndarray:
        """The ids that each symbol stands for."""
        out, rule = np.ones(len(seq), dtype=np.int64), seq >= self.first
        out[rule] = self.sizes[seq[rule].astype(np.int64) - self.first]
        return out

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of a run of symbols."""
        size = self._size(seq)
        if self.sizes.sum() <= size.sum():  # much is asked for: write every rule out once, and then copy
            if self.written is None:
                self.written = self._down(self.bodies, self._size(self.bodies))
                self.begins = np.cumsum(self.sizes) - self.sizes
            rule = np.flatnonzero(seq >= self.first)
            source, start = np.concatenate([self.written, seq]), np.arange(len(self.written), len(self.written) + len(seq))
            start[rule] = self.begins.take(seq.take(rule).astype(np.int64) - self.first)
            return source.take(ranges(start, size))
        return self._down(seq, size)

    def _down(self, seq: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of symbols that stand for ``size`` ids: each is put where it belongs, rule by rule downwards."""
        out, at = np.empty(int(size.sum()), dtype=np.uint32), np.cumsum(size) - size
        while len(seq):
            rule = seq >= self.first
            out[at[~rule]] = seq[~rule]
            k = seq[rule].astype(np.int64) - self.first
            body = ranges(self.begin[k], self.counts[k])
            seq, at = self.bodies[body], np.repeat(at[rule], self.counts[k]) + self.inside[body]
        return out

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start..start+n-1 of the shard, without expanding the rest."""
        if n <= 0 or start >= self.n_ids:
            return np.zeros(0, dtype=np.uint32)
        low = int(np.searchsorted(self.steps, start, "right")) - 1
        high = int(np.searchsorted(self.steps, start + n, "left"))
        skip = start - int(self.steps[low])
        return self.expand(self.seq[low * STEP : high * STEP])[skip : skip + n]

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, with the end id."""
        return self.read(int(self.starts[k]), int(self.lengths[k]))


def image(doc_ids: list, lengths: list[int], ids: np.ndarray, first: int, made: tuple | None = None) -> bytes:
    """A shard's image of these documents; ids must be below ``first``. ``made`` as in ``grammar``."""
    bodies, counts, sizes, seq = grammar(ids, first, made)
    size = np.ones(len(seq), dtype=np.int64)
    size[seq >= first] = sizes[seq[seq >= first].astype(np.int64) - first]
    before = np.cumsum(size) - size
    nulls = sum(d is None for d in doc_ids)  # they come first
    head = np.array([len(doc_ids), len(ids), len(counts), len(seq), first, nulls, len(bodies), 0], dtype="<i8")
    lists = (head, np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array(lengths, dtype="<u4"), counts.astype("<u4"), sizes.astype("<u4"), bodies.astype("<u4"), seq.astype("<u4"), before[::STEP].astype("<i8"))
    made = b"RPR2" + b"".join(x.tobytes() for x in lists)
    held = Shard(made)
    if not np.array_equal(held.expand(held.seq), ids):
        raise AssertionError("the grammar does not expand to the ids of its shard")
    return made


_ID = operator.attrgetter("id")
_LATIN = re.compile("[\0-\xff]*").fullmatch
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("shards are written from little-endian u32 arrays")


class Known(dict):
    """The ids of pre-tokens as bytes, by the library's model, worked out when first met.

    Two generations: when the younger one is full it becomes the older one, whose entries come back as they are met.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.vocabulary = v = Vocabulary(data)
        self.tokenize, self.older = Tokenizer.from_str(data.decode()).model.tokenize, {}
        self.letters = {b: ord(c) for c, b in byte_letters().items()}
        self.space = chr(self.letters[32])
        self.words = Words(self.solve, 2 * KNOWN)
        self.special = {w: np.array([i], dtype="<u4").tobytes() for w, i in v.specials.items()}

    def solve(self, word: str) -> bytes:
        # printable ASCII but the space stands for itself
        plain = word.isascii() and word.isprintable()
        letters = word.replace(" ", self.space) if plain else word.encode().decode("latin-1").translate(self.letters)
        return array("I", map(_ID, self.tokenize(letters))).tobytes()

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self.older.pop(word, None) or self.special.get(word) or self.solve(word)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: those within Latin-1 and without special strings together, the others one by one."""
        alike = [not any(s in x for s in self.special) and (x.isascii() or _LATIN(x) is not None) for x in texts]
        found = iter(self.words.encode([x for x, k in zip(texts, alike, strict=True) if k]))
        get = self.__getitem__
        return [next(found) if k else b"".join(map(get, self.vocabulary.pretokens(x))) for x, k in zip(texts, alike, strict=True)]

    def trim(self) -> None:
        if len(self) > KNOWN:
            self.older = dict(self)
            self.clear()


def _write(shared: Shared, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = state(("shards", shared.id), lambda: Known(shared.value))
        v = known.vocabulary
        part, tail, first = TaskContext.get().partitionId(), np.array([end], dtype="<u4").tobytes(), max(v.size, end + 1)
        ids, lengths, held, size, seq, before, shards = [], [], [], 0, 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, before, shards
            found = repair_together([x for _, _, x in shards], first)
            for k, (docs, sizes, x) in enumerate(shards):
                data = image(docs, sizes, x, first, found[k])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(x)]), pa.array([data], pa.binary())], ["part", "seq", "before", "n_ids", "image"])
                seq, before = seq + 1, before + len(x)
            shards = []

        def close() -> None:
            nonlocal ids, lengths, held, size
            shards.append((ids, lengths, np.frombuffer(b"".join(held), dtype="<u4")))
            ids, lengths, held, size = [], [], [], 0

        for b in slices(batches, 2 << 20):
            known.trim()
            for doc, data in zip(b.column("doc_id").to_pylist(), known.encode(texts(b)), strict=True):
                data += tail
                ids.append(doc)
                lengths.append(len(data) // 4)
                held.append(data)
                size += len(data) // 4
                if size >= SHARD_IDS:
                    close()
                    if sum(len(x) for _, _, x in shards) >= TOGETHER * SHARD_IDS:
                        yield from flush()
        if ids:
            close()
        yield from flush()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Encode ``docs`` and write their shards, in ascending doc_id order over (part, seq), as a table at ``path``."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, tokenizer)
    rows = documents(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # where the ranges end comes from the ids alone, so that texts are read once
    ends = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    part = _steps("doc_id", sorted(set(ends or [])))
    dealt = rows.repartitionById(parts, part)
    dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_write(shared, end), _SHARD).write.option("compression", "zstd").parquet(path)


def _steps(column: str, ends: list[int]) -> Column:
    """How many of the ascending ``ends`` lie below the column, 0 for null, by bisection."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) > ends[middle], within(middle + 1, high)).otherwise(within(low, middle))

    return within(0, len(ends))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, before, data in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("image").to_pylist(), strict=True):
            s = Shard(data)
            ids = s.read(0, s.n_ids).astype("<u4").tobytes()
            edge = np.r_[0, np.cumsum(s.lengths)].tolist()
            crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in itertools.pairwise(edge)]
            doc = pa.array(s.doc_ids, mask=np.arange(len(s.doc_ids)) < s.nulls)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(doc), pa.int32()), doc, pa.array(before + s.starts), pa.array(s.lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ship(spark)
    shards = spark.read.parquet(path)
    # one row a part, and there are no more parts than shuffle partitions
    sizes = sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = itertools.accumulate((n for _, n in sizes), initial=0)
    base = spark.createDataFrame([(p, o) for (p, _), o in zip(sizes, before)], "part int, base long")  # noqa: B905
    found = shards.select("part", "before", "image").mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
