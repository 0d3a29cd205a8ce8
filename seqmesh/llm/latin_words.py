"""Byte-level pre-tokens of Latin-1 texts: cut, looked up and laid end to end many at a time.

Characters have one of four kinds (letter, number, white space, other), and where a pre-token begins follows from the
kinds of neighbours and from contractions, so all texts of a batch are cut by comparing whole arrays. A pre-token of up
to 15 characters is its own key, two numbers of 64 bits that hold its characters and its length; keys are found in an
open-addressed table, all of a batch in the same probe. Longer ones are found in a dict.

What a worker has met is kept up to ``most`` pre-tokens, or 16 times as many ids, and then forgotten, which changes no
result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from seqmesh.llm.byte_bpe import _L, _N, _S

_OTHER, _LETTER, _NUMBER, _WHITE = range(4)
_KINDS = np.array([next((k for k, p in ((_LETTER, _L), (_NUMBER, _N), (_WHITE, _S)) if re.match(f"[{p}]", chr(c))), _OTHER) for c in range(256)], dtype=np.uint8)
_SPACE, _QUOTE, _LONGEST = 32, 39, 15
#: Words that are looked up at a time, of a text however long.
BLOCK = 1 << 19
#: By length: the bits of a word's first eight characters, and of the next seven.
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_LONGEST + 1)], dtype=np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_LONGEST + 1)], dtype=np.uint64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``size`` numbers each, one range after another."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end (Latin-1), of which text k is ``edges[k]`` to ``edges[k + 1]``."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind, space, begin = _KINDS[data], data == _SPACE, np.zeros(n + 3, dtype=bool)
    begin[edges] = True
    white = kind == _WHITE
    cut = begin[:n].copy()
    # kinds change, and no space stands before; of white space before something else, the last character
    cut[1:] |= (kind[1:] != kind[:-1]) & ~space[:-1]
    cut[:-1] |= white[:-1] & ~white[1:] & ~begin[1:n]
    quote = np.flatnonzero(data == _QUOTE)
    if len(quote):
        before = np.maximum(quote - 1, 0)
        quote = quote[begin[quote] | (kind[before] != _OTHER) & ~space[before]]
        following = np.append(data, np.zeros(2, dtype=np.uint8))
        x, y = following[quote + 1], following[quote + 2]
        inside, both = ~begin[quote + 1], ~begin[quote + 1] & ~begin[quote + 2]
        one = inside & np.isin(x, list(b"stmd"))
        two = both & ((np.isin(x, list(b"rv")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
        held = np.append(cut, [True, True, True])
        held[quote[one | two] + 1] = False
        held[quote[one] + 2] = held[quote[two] + 3] = True
        cut = held[:n]
    return np.flatnonzero(cut)


class Words:
    """The ids of pre-tokens; ``solve`` works out those of one that is new, as bytes of u32."""

    def __init__(self, solve: Callable[[str], bytes], most: int):
        self.solve, self.most = solve, most
        self.clear()

    def clear(self) -> None:
        self.slots, self.pool, self.long = np.zeros(1 << 18, dtype=np.int32), np.zeros(1 << 18, dtype=np.uint32), {}
        #: entry 0 stands for nothing: no key is 0, for it holds the length
        self.entries, self.held, room = 1, 0, 1 << 16
        self.low, self.high = np.zeros(room, dtype=np.uint64), np.zeros(room, dtype=np.uint64)
        self.start, self.count = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int32)

    def _room(self, name: str, n: int) -> None:
        """Let an array hold ``n`` numbers; it doubles, so that what it holds is seldom copied."""
        old = getattr(self, name)
        if n > len(old):
            new = np.zeros(1 << n.bit_length(), dtype=old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 where there is none."""
        slot = self._slot(low, high)
        found = self.slots.take(slot)
        ask = np.flatnonzero((found > 0) & ((self.low.take(found) != low) | (self.high.take(found) != high)))
        while len(ask):  # another key stands there: look behind it
            slot[ask] = at = (slot[ask] + 1) & (len(self.slots) - 1)
            found[ask] = entry = self.slots.take(at)
            ask = ask[(entry > 0) & ((self.low.take(entry) != low[ask]) | (self.high.take(entry) != high[ask]))]
        return found

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slot(self.low[entries], self.high[entries])
        while len(entries):
            free = self.slots.take(slot) == 0
            self.slots[slot[free]] = entries[free]
            rest = self.slots.take(slot) != entries
            entries, slot = entries[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    def _add(self, words: list[str], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Take up new words: their entries. Those with key 0 are long ones and stand in no slot."""
        found = [self.solve(w) for w in words]
        ids, count = np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
        n, part, held = self.entries + len(words), slice(self.entries, self.entries + len(words)), self.held + len(ids)
        for name in ("low", "high", "start", "count"):
            self._room(name, n)
        self._room("pool", held)
        self.pool[self.held : held] = ids
        self.start[part], self.count[part] = self.held + np.cumsum(count) - count, count
        self.low[part], self.high[part] = low, high
        entries, self.entries, self.held = np.arange(self.entries, n), n, held
        if 2 * n > len(self.slots):
            self.slots = np.zeros(2 << (2 * n).bit_length(), dtype=np.int32)
            self._place(np.flatnonzero(self.high[:n]))
        else:
            self._place(entries[high > 0])
        return entries

    def _encode(self, whole: str, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of the words at ``start``, end to end, and how many each has."""
        long, short = np.flatnonzero(size > _LONGEST), np.minimum(size, _LONGEST)
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        low = eight[start] & _LOW.take(short)
        high = eight[start + 8] & _HIGH.take(short) | short.astype(np.uint64) << np.uint64(56)
        low[long] = high[long] = 0
        if self.entries > self.most or self.held > 16 * self.most:
            self.clear()
        entry = self._find(low, high)
        new = np.flatnonzero((entry == 0) & (high > 0))
        if len(new):
            place: dict[str, int] = {}
            which = [place.setdefault(whole[i:j], len(place)) for i, j in zip(start[new].tolist(), (start[new] + size[new]).tolist(), strict=True)]
            first = np.empty(len(place), dtype=np.int64)
            first[which[::-1]] = new[::-1]
            entry[new] = self._add(list(place), low[first], high[first])[which]
        if len(long):
            words = [whole[i:j] for i, j in zip(start[long].tolist(), (start[long] + size[long]).tolist(), strict=True)]
            fresh = list(dict.fromkeys(w for w in words if w not in self.long))
            if fresh:
                none = np.zeros(len(fresh), dtype=np.uint64)
                self.long.update(zip(fresh, self._add(fresh, none, none).tolist(), strict=True))
            entry[long] = [self.long[w] for w in words]
        count = self.count.take(entry).astype(np.int64)
        return self.pool.take(ranges(self.start.take(entry), count)).tobytes(), count

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text (Latin-1, without special strings), as bytes of u32."""
        whole = "".join(texts)
        edges = np.cumsum([0, *map(len, texts)])
        raw = np.frombuffer(whole.encode("latin-1") + bytes(16), dtype=np.uint8)
        start = cuts(raw[:-16], edges)
        if not len(start):
            return [b""] * len(texts)
        size = np.diff(start, append=len(whole))
        found = [self._encode(whole, raw, start[i : i + BLOCK], size[i : i + BLOCK]) for i in range(0, len(start), BLOCK)]
        ids, count = b"".join([x for x, _ in found]), np.concatenate([x for _, x in found])
        ends = 4 * np.append(0, np.cumsum(count))[np.searchsorted(start, edges)]
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
