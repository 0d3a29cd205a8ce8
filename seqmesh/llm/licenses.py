"""License scans by ordered signature rules.

A rule is a regular expression over the words of a text (lower-cased, joined by single spaces), with a label, a
priority and keywords, one of which every match holds at the start of a word. One multi-pattern pass over the words
finds the keywords; only rules whose keywords are there are run. Detections that lie within a detection of higher priority (or of equal
priority and greater length) are suppressed; what is left gives the labels. Base phrases are exact word sequences and
are never suppressed.

The rules are the hand-written signatures of ``license_rules``, about two hundred, and, for names with versions, the
license families below with their spellings written out.

Defined results: null texts count as empty; texts without words have zero counts, null positions, empty labels and
score 0; repeated rows come out as often as they came in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqmesh.llm.common import documents, slices, state, texts
from seqmesh.llm.license_rules import SIGNATURES
from seqmesh.session import ship

#: Phrase and label; each place where the words stand consecutively counts.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Letters of ASCII that are no part of a word become spaces.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    pattern: str
    label: str
    priority: int
    keywords: tuple[str, ...]
    weight: float


# Families: label stem, spellings of the name, versions ("" for none), and a keyword that every spelling holds.
_VERSIONED = [
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl", "gpl"), ("1", "2", "3"), ("gpl", "general")),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "gnu lgpl", "lgpl"), ("2", "2 1", "3"), ("lgpl", "lesser", "library")),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl", "agpl"), ("1", "3"), ("agpl", "affero")),
    ("gfdl", ("gnu free documentation licen[sc]e", "gfdl"), ("1 1", "1 2", "1 3"), ("gfdl", "documentation")),
    ("apache", ("apache software licen[sc]e", "apache licen[sc]e"), ("1", "1 1", "2", "2 0"), ("apache",)),
    ("mpl", ("mozilla public licen[sc]e", "mpl"), ("1", "1 1", "2", "2 0"), ("mozilla", "mpl")),
    ("epl", ("eclipse public licen[sc]e",), ("1", "1 0", "2", "2 0"), ("eclipse",)),
    ("cpl", ("common public licen[sc]e",), ("0 5", "1 0"), ("common",)),
    ("cddl", ("common development and distribution licen[sc]e", "cddl"), ("1 0", "1 1"), ("cddl", "distribution")),
    ("eupl", ("european union public licen[sc]e", "eupl"), ("1 0", "1 1", "1 2"), ("eupl", "european")),
    ("osl", ("open software licen[sc]e",), ("1 0", "2 0", "2 1", "3 0"), ("software",)),
    ("afl", ("academic free licen[sc]e",), ("1 2", "2 0", "2 1", "3 0"), ("academic",)),
    ("artistic", ("artistic licen[sc]e", "perl artistic licen[sc]e"), ("1 0", "2 0"), ("artistic",)),
    ("bsl", ("boost software licen[sc]e",), ("1 0",), ("boost",)),
    ("ms-pl", ("microsoft public licen[sc]e",), ("",), ("microsoft",)),
    ("ms-rl", ("microsoft reciprocal licen[sc]e",), ("",), ("reciprocal",)),
    ("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), ("",), ("zlib",)),
    ("isc", ("isc licen[sc]e",), ("",), ("isc",)),
    ("wtfpl", ("do what the fuck you want to public licen[sc]e", "wtfpl"), ("", "2"), ("wtfpl", "fuck")),
    ("unlicense", ("the unlicense",), ("",), ("unlicense",)),
    ("odbl", ("open database licen[sc]e", "odbl"), ("1 0",), ("odbl", "database")),
    ("odc-by", ("open data commons attribution licen[sc]e",), ("1 0",), ("commons",)),
    ("pddl", ("public domain dedication and licen[sc]e",), ("1 0",), ("dedication",)),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("1 0", "1 1"), ("font",)),
    ("psf", ("python software foundation licen[sc]e",), ("2",), ("python",)),
    ("php", ("php licen[sc]e",), ("3 0", "3 01"), ("php",)),
    ("ruby", ("ruby licen[sc]e",), ("",), ("ruby",)),
    ("cecill", ("cecill licen[sc]e", "cecill free software licen[sc]e"), ("1 0", "2 0", "2 1"), ("cecill",)),
    ("ecl", ("educational community licen[sc]e",), ("1 0", "2 0"), ("educational",)),
    ("upl", ("universal permissive licen[sc]e",), ("1 0",), ("permissive",)),
    ("bsd", ("bsd licen[sc]e", "bsd style licen[sc]e"), ("",), ("bsd",)),
    ("mit", ("mit licen[sc]e", "mit x11 licen[sc]e", "x11 licen[sc]e"), ("",), ("mit", "x11")),
    ("cc0", ("cc0", "creative commons zero"), ("", "1 0"), ("cc0", "zero")),
    ("cpal", ("common public attribution licen[sc]e",), ("1 0",), ("attribution",)),
    ("rpl", ("reciprocal public licen[sc]e",), ("1 1", "1 5"), ("reciprocal",)),
    ("sspl", ("server side public licen[sc]e", "sspl"), ("1",), ("sspl", "server")),
    ("busl", ("business source licen[sc]e",), ("1 1",), ("business",)),
    ("qpl", ("q public licen[sc]e",), ("1 0",), ("q public",)),
]

# Creative Commons terms: spelling of the terms and label.
_CC_TERMS = [
    ("by", "attribution", "cc-by"),
    ("by sa", "attribution share ?alike", "cc-by-sa"),
    ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?", "cc-by-nd"),
    ("by nc", "attribution non ?commercial", "cc-by-nc"),
    ("by nc sa", "attribution non ?commercial share ?alike", "cc-by-nc-sa"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "cc-by-nc-nd"),
]

def signatures() -> list[Rule]:
    """The hand-written signatures."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, weight, pattern = line.split(" ", 3)
        out.append(Rule(re.sub(r"<([a-z0-9]+)>", r"\1", pattern), label, int(priority), tuple(re.findall(r"<([a-z0-9]+)>", pattern)), float(weight)))
    return out


def rules() -> list[Rule]:
    """All rules, families written out, in falling priority; of equal priority the earlier written comes first."""
    out = signatures()
    for stem, names, versions, keys in _VERSIONED:
        for k, name in enumerate(names):
            short = " " not in name
            for v in versions:  # glued or apart, as in "gplv3", "gpl 3 0" or "gpl version 3"
                if v:
                    tail = "-".join([stem, v.removesuffix(" 0").replace(" ", ".")])
                    out.append(Rule(rf"{name} ?(?:v|version |v )?{v}", tail, 70 + len(v), keys, 0.9))
                    out.append(Rule(rf"version {v} of the {name}", tail, 72 + len(v), keys, 0.9))
            if not short:
                out.append(Rule(name, stem, 50 - k, keys, 0.7))
            out.append(Rule(rf"(?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of the )?{name}", stem, 55 - k, keys, 0.85))
    for term, words, label in _CC_TERMS:
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append(Rule(rf"cc {term} {version}", f"{label}-{version.removesuffix(' 0').replace(' ', '.')}", 75 + len(term), ("cc",), 0.95))
            out.append(Rule(rf"creative commons {words} (?:v|version )?{version}", f"{label}-{version.removesuffix(' 0').replace(' ', '.')}", 75 + len(term), ("creative",), 0.95))
        out.append(Rule(rf"creative commons {words}", label, 60 + len(term), ("creative",), 0.8))
        out.append(Rule(rf"(?:licen[sc]ed|released|available|shared) under (?:a |the )?cc {term}", label, 60 + len(term), ("cc",), 0.85))
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    """The rules compiled, and the keyword automaton that says which of them to run."""

    def __init__(self, given: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if given is None else given
        self.compiled = [re.compile(rf"(?<= )(?:{r.pattern})(?= )".encode()) for r in self.rules]
        by: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            for w in r.keywords:
                by.setdefault(w, []).append(k)
        if "" in by or not all(r.keywords for r in self.rules):
            raise ValueError("a rule without a keyword would never be run")
        self.automaton = ahocorasick.Automaton()
        for w, ks in by.items():
            self.automaton.add_word(f" {w}", ks)
        self.automaton.make_automaton()

    def detections(self, line: bytes, gated: bool = True) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) by start, after suppression; ``line`` is the words between single spaces, with one at either end.

        Not ``gated``, every rule is run; what is found is the same.
        """
        if gated:
            run = set()
            for _, ks in self.automaton.iter(line.decode("latin-1")):
                run.update(ks)
        else:
            run = set(range(len(self.rules)))
        found = [(m.start(), m.end(), k) for k in run for m in self.compiled[k].finditer(line)]
        found.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[2], d[0]))
        reach = Reach([s for s, _, _ in found])
        kept: list[tuple[int, int, int]] = []
        for s, e, k in found:  # kept ones are stronger: a detection within one of them goes
            if reach.of(s) < e:
                kept.append((s, e, k))
                reach.put(s, e)
        return [(s, e, self.rules[k]) for s, e, k in sorted(kept)]


class Reach:
    """The furthest end of all intervals that start at or before a place, in logarithmic time for each step."""

    def __init__(self, starts: list[int]):
        self.at = {s: k + 1 for k, s in enumerate(sorted(set(starts)))}
        self.most = [-1] * (len(self.at) + 1)

    def put(self, start: int, end: int) -> None:
        k = self.at[start]
        while k < len(self.most):
            if self.most[k] < end:
                self.most[k] = end
            k += k & -k

    def of(self, start: int) -> int:
        k, found = self.at[start], -1
        while k:
            if self.most[k] > found:
                found = self.most[k]
            k &= k - 1
        return found


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORDS).split()


def scan(text: str, scanner: Scanner) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of a text."""
    found = words(text)
    line = b" " + b" ".join(found) + b" "
    places, base = [], set()
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at = line.find(needle)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = line.find(needle, at + 1)
    kept = scanner.detections(line)
    weight = dict.fromkeys(base, 1.0)
    for _, _, r in kept:
        weight[r.label] = max(weight.get(r.label, 0.0), r.weight)
    miss = 1.0
    for label in sorted(weight):
        miss *= 1.0 - weight[label]
    if not places and not kept:
        return len(found), 0, None, None, "", "", 0.0, []
    # a word's number is how many spaces stand before the one that precedes it
    space = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    start = np.searchsorted(space, [min(places), max(places)]).tolist() if places else [None, None]
    first = np.searchsorted(space, [s - 1 for s, _, _ in kept]).tolist()
    last = np.searchsorted(space, [e for _, e, _ in kept]).tolist()
    spans = [(a, b, r.label) for a, b, (_, _, r) in zip(first, last, kept, strict=True)]
    return len(found), len(places), *start, ",".join(sorted(base)), ",".join(sorted(weight)), 1.0 - miss, spans


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string>>"


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = state(("licenses",), Scanner)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for b in slices(batches):
        rows = [scan(x, scanner) for x in texts(b)]
        columns = [[r[k] for r in rows] for k in range(8)]
        columns[7] = [[{"first": s, "end": e, "label": label} for s, e, label in x] for x in columns[7]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and places of base phrases, labels, score, and the detections as word spans."""
    ship(docs.sparkSession)
    return documents(docs).mapInArrow(_run, _OUT)
