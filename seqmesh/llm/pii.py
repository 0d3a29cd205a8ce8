"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base kinds (e-mail, IP, card, phone) are fixed patterns with checks; their spans always stay. The method adds more:
high-recall generators propose spans of looser formats, which may overlap each other and the base; boosted trees score
each proposal by its format and by the text before it; a proposal is redacted when its calibrated probability reaches
the threshold of its kind and no base span and no better proposal overlaps it.

Training: a fixed, seeded set of ``TRAIN`` synthetic sentences in four languages with a known answer goes through the
same expressions that read the corpus, one row a sentence comes to the driver, and least-squares trees on the logistic
loss are grown there, for each kind its own. What the trees see of the context is whether it holds each of ``GRAMS`` character sequences; these
are chosen by what they tell about the answer, each cue phrase counting once, and one more for each phrase. Sentences are
scored by trees that have not met them (three folds), half of them by trees that have not met their cue phrase either;
these scores calibrate the probability (Platt scaling) and set for each kind the lowest threshold at which
``PRECISION`` of what is accepted is right. Then the trees are grown on all sentences. The trees become CASE expressions, so the corpus meets no Python.

Positions: the pattern's matches and the text between them alternate, so a span's place is a running sum of their
lengths, in code points. Patterns are written so that Java's matcher neither recurses nor starts again within a run:
possessive loops, and a look-behind where a start inside a run can't succeed if the run's start has failed. Spans are
made by blocks of ``BLOCK`` and overlaps are found in one sweep each way over sorted spans, so that a text of very many spans
takes time in proportion; only proposals that hang together by overlaps are compared with each other.

Defined results: null texts count as empty and have no spans; repeated rows come out as often as they came in; of two
overlapping proposals with one score the one that starts first stays, then the shorter.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmesh.llm.common import documents
from seqmesh.llm.pii_contexts import AGAINST, FOR

PRECISION, TRAIN, GRAMS, ROUNDS, RATE, BLOCK = 0.9, 6000, 80, 40, 0.3, 128

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LOCAL = r"A-Za-z0-9._%+-"
#: Base kinds in order: pattern, and what must be in a text for the pattern to be tried.
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
#: Generators of the method: kind and pattern. Each is a superset of what is meant.
GENERATORS = {
    "email-spelt": r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{<] ?(?i:at) ?[)\]}>] ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|[(\[{<] ?(?i:dot) ?[)\]}>]) ?[A-Za-z0-9-]{1,64}+){1,8}+",
    "phone-local": r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "national-id": r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
KINDS = [*BASE, *GENERATORS]
#: Characters before a proposal that the features look at.
BEFORE = 32
#: Characters of a page of a text that is redacted.
_PAGE = 1024

_SPAN = "struct<start:int,end:int,found:string,before:string>"
_FREE = "struct<start:int,rank:int,end:int,kind:string,found:string,before:string,free:boolean>"
_RATED = "struct<minus_p:double,start:int,end:int,kind:string>"
_FOUND = "struct<start:int,rank:int,end:int,kind:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _walk(items: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """What ``step`` gives for each item in order, from the state that it hands on.

    ``aggregate`` copies what it has gathered at each item. So the states at the starts of blocks are found first, without
    outputs, and then the outputs of each block apart.
    """
    zero = F.struct(*[v.alias(k) for k, v in state.items()])

    def onward(acc: Column, x: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in step(acc, x)[0].items()])

    def over(acc: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, acc["now"], onward).alias("now"), F.array_append(acc["starts"], acc["now"]).alias("starts"))

    def add(acc: Column, x: Column) -> Column:
        new, out = step(acc, x)
        return F.struct(*[v.alias(k) for k, v in new.items()], F.array_append(acc["out"], out.cast(kind)).alias("out"))

    def outputs(block: Column, at: Column) -> Column:
        begin = F.struct(*[at[k].alias(k) for k in state], _none(kind).alias("out"))
        return F.aggregate(block, begin, add, lambda acc: acc["out"])

    def by_blocks(blocks: Column) -> Column:
        begin = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("starts"))
        return F.flatten(F.zip_with(blocks, F.aggregate(blocks, begin, over, lambda acc: acc["starts"]), outputs))

    cut = _let(items, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(v, i + 1, BLOCK)))
    return _let(cut, by_blocks)


def _last(text: Column) -> Column:
    return F.substring(text, -BEFORE, BEFORE)


def _spans(text: str, found: str, pattern: str, valid, context: bool = False) -> Column:
    """Spans of the matches in column ``found`` of ``pattern`` that are ``valid``, with the text before each if asked for.

    A text counts as having a space before it, so that a word at its start reads as elsewhere.
    """
    between = F.split(F.col(text), pattern, -1)
    pieces = F.zip_with(F.col(found), between, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), (_last(g) if context else F.lit("")).alias("gap")))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        begin = acc["at"] + x["g"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        before = _last(F.concat(acc["tail"], x["gap"])) if context else F.lit("")
        tail = _last(F.concat(acc["tail"], x["gap"], F.coalesce(x["m"], F.lit("")))) if context else F.lit("")
        return {"at": end, "tail": tail}, F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("found"), F.lower(before).alias("before"))

    every = _walk(pieces, {"at": F.lit(0), "tail": F.lit(" ")}, step, _SPAN)
    return F.when(F.size(found) > 0, F.filter(every, lambda s: s["found"].isNotNull() & valid(s["found"]))).otherwise(_none(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _matches(text: str, pattern: str, must: str) -> Column:
    all_of = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.when(F.contains(F.col(text), F.lit(must)), all_of).otherwise(F.array().cast("array<string>")) if must else all_of


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with an array of spans for each base kind, in columns of the kinds' names."""
    hits = docs.withColumns({f"m_{k}": _matches("text", p, must) for k, (p, must) in BASE.items()})
    return hits.select("doc_id", "text", *[_spans("text", f"m_{k}", p, VALID[k]).alias(k) for k, (p, _) in BASE.items()])


def proposals(docs: DataFrame) -> DataFrame:
    """``docs`` with column ``proposed``: the generators' spans with kind and the text before each, overlaps and all."""
    hits = docs.withColumns({f"g_{k}": _matches("text", p, "") for k, p in GENERATORS.items()})

    def tagged(k: str) -> Column:
        spans = _spans("text", f"g_{k}", GENERATORS[k], lambda m: F.lit(True), context=True)
        return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["found"], F.lit(k).alias("kind"), s["before"]))

    return hits.withColumn("proposed", F.concat(*[tagged(k) for k in GENERATORS])).drop(*[f"g_{k}" for k in GENERATORS])


def _checks_out(found: Column) -> Column:
    """Whether the number formed as an IBAN's check asks, first four characters last and letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(found, " ", "")
    signs = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code == 0, acc).when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(signs, F.lit(0), step) == 1


def formats(x: Column) -> list[Column]:
    """What the trees see of a proposal's format."""
    d, last = _digits(x["found"]), F.element_at(F.split(x["found"], "[^A-Za-z]+"), -1)
    out = [F.length(c).cast("double") for c in (x["found"], d, last, F.regexp_replace(x["found"], "[^A-Z]", ""), F.regexp_replace(x["found"], "[^a-z]", ""), F.regexp_replace(x["found"], "[^ .:()-]", ""), F.regexp_replace(x["found"], "[^:]", ""))]
    out += [c.cast("double") for c in (d.rlike("^(.)\\1*$"), d.rlike("^(?:000|666|9)"), x["found"].rlike("(?i)[(\\[{<] ?dot"), x["found"].contains("("))]
    out.append(((x["kind"] == "iban") & _checks_out(x["found"])).cast("double"))
    return [*out, *[x["before"].rlike(p).cast("double") for p in ("[:=] ?\"?$", "[#°º] ?$", "[0-9][^a-z]*$")]]


#: Numbers of cue phrases are below; a sentence without a cue has its own from here on.
PLAIN = 1000
#: How many features there are of a format.
FORMATS = 15


def _thing(kind: str, good: bool, r: random.Random) -> str:
    """A string of a generator's format: personal, or one that only looks so."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k, n: ":".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for _ in range(k))
    name = lambda: "".join(r.choice(["an", "be", "co", "di", "el", "jo", "ma", "ra", "ti"]) for _ in range(r.randint(2, 3)))
    if kind == "phone-local":
        s = r.choice(" .-")
        return r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{s}{digits(3)}{s}{digits(4)}"])
    if kind == "email-spelt":
        at = r.choice(["(at)", "[at]", " (at) ", " [at] ", "{at}"])
        if good:
            return name() + at + name() + r.choice(["(dot)", "[dot]", " (dot) ", " [dot] ", "."]) + r.choice(["com", "org", "net", "de", "fr", "es"])
        return f"{name()} (at) {r.choice(['the', 'a', 'das', 'le', 'la', 'el'])}.{r.choice(['then', 'so', 'dann', 'alors', 'luego'])}"
    if kind == "national-id":
        return f"{r.randint(100, 665) if good else r.choice(['000', '666', '9' + digits(2)])}{r.choice('- ')}{digits(2)}-{digits(4)}".replace(" ", "-")
    if kind == "iban":
        country, body = r.choice(["DE", "FR", "ES", "GB", "IT", "NL"]), digits(16 + 2 * r.randrange(3))
        number = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
        check = 98 - number % 97
        plain = f"{country}{check if good else (check + r.randint(1, 80)) % 97:02d}{body}"
        return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))
    return hexes(8, 4) if good else r.choice([":".join(digits(2) for _ in range(r.randint(5, 6))), hexes(6, 2)])


def sentences(n: int = TRAIN, seed: int = 7, cues: tuple[dict, dict] = (AGAINST, FOR)) -> list[tuple[str, str, int, int]]:
    """(sentence with one proposal, its kind, 1 if it is personal, its cue phrase's number) in a fixed order.

    Personal ones follow a cue or, one in ten, none. The others have a cue against them or a format that can't be right.
    """
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice(["an", "be", "con", "di", "el", "hew", "mo", "rin", "ti", "uß", "ée"]) for _ in range(r.randint(1, 3)))
    for i in range(n):
        label, kind = i % 2, list(GENERATORS)[i // 2 % len(GENERATORS)]
        phrases = cues[label][kind]
        k = r.randrange(len(phrases))
        plain = r.random() < 0.1
        good = bool(label) or (kind not in ("iban", "email-spelt") and not plain) or kind == "phone-local"
        cue = "" if plain and (label or kind != "phone-local") else phrases[k]
        cue += r.choice(["", "", ":"]) if cue[-1:].isalpha() else ""
        filler = " ".join(word() for _ in range(r.randint(1, 6)))
        out.append((f"{filler} {cue} {_thing(kind, good, r)} {word()} {word()}", kind, label, 2 * k + label if cue else PLAIN + i))
    return out


def _tree(x: np.ndarray, low: np.ndarray, cuts: list[tuple[int, float]], residual: np.ndarray, weight: np.ndarray, depth: int, least: int = 8):
    """A leaf value, or (feature, threshold, left where value <= threshold, right); ``low`` has a column of 0 and 1 for each cut."""
    r, w, n = residual.sum(), max(weight.sum(), 1e-6), len(x)
    if depth == 0 or n < 2 * least or not cuts:
        return float(r / w)
    rl, wl, nl = residual @ low, weight @ low, low.sum(axis=0)
    gain = rl**2 / np.maximum(wl, 1e-6) + (r - rl) ** 2 / np.maximum(weight.sum() - wl, 1e-6) - r**2 / w
    gain[np.minimum(nl, n - nl) < least] = 0
    best = int(gain.argmax())
    if gain[best] <= 1e-9:
        return float(r / w)
    left = low[:, best] > 0
    return *cuts[best], *[_tree(x[s], low[s], cuts, residual[s], weight[s], depth - 1) for s in (left, ~left)]


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    return np.where(low, _value(tree[2], x), _value(tree[3], x))


def choose(before: list[str], y: np.ndarray, cue: np.ndarray) -> list[str]:
    """The character sequences in the contexts that tell most about the answer, each cue phrase counting once.

    Of those that the same phrases hold the shortest stays. Each phrase also has its best one that speaks for one answer
    only, so that a phrase that shares nothing with others is known as well.
    """
    answer = dict(zip(cue.tolist(), y.tolist(), strict=True))
    mean = sum(answer.values()) / max(len(answer), 1)
    where: dict[str, set[int]] = {}
    rows: dict[str, int] = {}
    for b, c in zip(before, cue.tolist(), strict=True):
        tail = b[-24:]
        for g in {tail[k : k + n] for n in (3, 4, 5) for k in range(len(tail) - n + 1)}:
            if not g.isspace():
                where.setdefault(g, set()).add(c)
                rows[g] = rows.get(g, 0) + 1
    rated, known = [], set()
    for g, at in sorted(where.items(), key=lambda e: (len(e[0]), e[0])):
        key = frozenset(at)
        if key not in known:
            known.add(key)
            rated.append((-abs(sum(answer[c] for c in at) - len(at) * mean) / np.sqrt(len(at)), -rows[g], g))
    chosen, own = [g for *_, g in sorted(rated)[:GRAMS]], set()
    for _, g in sorted((n, g) for _, n, g in rated):
        at = where[g]
        if len({answer[c] for c in at}) == 1 and not at <= own:
            own |= at
            chosen.append(g)
    return list(dict.fromkeys(chosen))


def fit(x: np.ndarray, y: np.ndarray) -> list:
    """Boosted trees of depth three."""
    cuts = [(f, float(t)) for f in range(x.shape[1]) for t in np.unique(x[:, f])[:-1]]
    low = np.array([x[:, f] <= t for f, t in cuts], dtype=float).reshape(len(cuts), len(x)).T
    trees, score = [], np.zeros(len(x))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, low, cuts, y - p, p * (1 - p), 3))
        score += RATE * _value(trees[-1], x)
    return trees


def calibrate(s: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset."""
    slope, offset = 1.0, 0.0
    for _ in range(500):
        e = 1 / (1 + np.exp(-(slope * s + offset))) - t
        slope, offset = slope - 0.1 * ((e * s).mean() + 0.001 * slope), offset - 0.1 * e.mean()
    return float(slope), float(offset)


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest probability, one half at least, from which on PRECISION of the rows are personal; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.r_[np.diff(p[order]) != 0, True][: len(p)]  # rows of one probability stand or fall together
    fits = np.flatnonzero((right >= PRECISION) & last & (p[order] >= 0.5))
    return float(p[order][fits[-1]]) if len(fits) else 2.0


def _case(tree, grams: list[str]) -> str:
    """A tree in SQL over a proposal x; features beyond those of the format ask for character sequences."""
    if isinstance(tree, float):
        return f"{tree!r}D"
    feature, cut, low, high = tree
    if feature < FORMATS:
        return f"CASE WHEN x.f[{feature}] <= {cut!r}D THEN {_case(low, grams)} ELSE {_case(high, grams)} END"
    found = grams[feature - FORMATS].replace("\\", "\\\\").replace("'", "\\'")
    return f"CASE WHEN contains(x.before, '{found}') THEN {_case(high, grams)} ELSE {_case(low, grams)} END"


def read(spark: SparkSession, rows: list[str]) -> tuple[np.ndarray, list[str]]:
    """Format features and context of the first proposal of each sentence, through the expressions that read the corpus."""
    data = F.lit(json.dumps([{"doc_id": i, "text": s} for i, s in enumerate(rows)]))
    docs = spark.range(1).select(F.explode(F.from_json(data, "array<struct<doc_id:long,text:string>>")).alias("r")).select("r.*")
    first = proposals(docs).select("doc_id", F.get("proposed", F.lit(0)).alias("x"))
    got = sorted(first.select("doc_id", F.array(*formats(F.col("x"))), "x.before").collect())
    return np.array([r[1] for r in got], dtype=float), [r[2] for r in got]


def seen(format_: np.ndarray, before: list[str], grams: list[str]) -> np.ndarray:
    """All features: those of the format, then for each sequence whether the context holds it."""
    return np.hstack([format_, np.array([[g in b for g in grams] for b in before], dtype=float).reshape(len(before), len(grams))])


class Model:
    """The sequences, trees, calibration and threshold of one kind."""

    def __init__(self, format_: np.ndarray, before: list[str], y: np.ndarray, cue: np.ndarray):
        def trained(rows: np.ndarray) -> tuple[list[str], list]:
            at, cued = np.flatnonzero(rows), np.flatnonzero(rows & (cue < PLAIN))
            grams = choose([before[i] for i in cued], y[cued], cue[cued])
            return grams, fit(seen(format_[at], [before[i] for i in at], grams), y[at])

        fold, score = np.where(cue // 2 % 2 == 0, cue // 4 % 3, np.arange(len(y)) // 2 % 3), np.zeros(len(y))
        for k in range(3):
            grams, trees = trained(fold != k)
            score[fold == k] = self.score(seen(format_, before, grams)[fold == k], trees)
        self.slope, self.offset = calibrate(score, y)
        self.threshold = threshold(1 / (1 + np.exp(-(self.slope * score + self.offset))), y)
        self.grams, self.trees = trained(fold >= 0)

    @staticmethod
    def score(x: np.ndarray, trees: list) -> np.ndarray:
        return RATE * sum(_value(t, x) for t in trees)

    def probability(self, format_: np.ndarray, before: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(seen(format_, before, self.grams), self.trees) + self.offset)))

    def minus_p(self) -> str:
        """Minus the probability of a proposal x in SQL."""
        trees = " + ".join(_case(t, self.grams) for t in self.trees)
        return f"-1 / (1 + exp(-({self.slope!r}D * {RATE}D * ({trees}) + {self.offset!r}D)))"


_MODELS: dict[str, Model] = {}


def models(spark: SparkSession) -> dict[str, Model]:
    """A model for each kind, made once a process; sentences and seed are fixed, so they are always the same."""
    if not _MODELS:
        rows = sentences()
        format_, before = read(spark, [s for s, *_ in rows])
        for k in GENERATORS:
            at = [i for i, r in enumerate(rows) if r[1] == k]
            y, cue = np.array([rows[i][2] for i in at], dtype=float), np.array([rows[i][3] for i in at])
            _MODELS[k] = Model(format_[at], [before[i] for i in at], y, cue)
    return _MODELS


def _free(base: str, proposed: str) -> Column:
    """The proposals that no base span overlaps, by a sweep from the left (bases before) and one from the right."""
    spans = F.transform(F.col(base), lambda b: F.struct(b["start"], b["rank"], b["end"], b["kind"], F.lit("").alias("found"), F.lit("").alias("before"), F.lit(False).alias("free")).cast(_FREE))
    rest = F.transform(F.col(proposed), lambda x: F.struct(x["start"], _rank(x["kind"]).alias("rank"), x["end"], x["kind"], x["found"], x["before"], F.lit(True).alias("free")).cast(_FREE))

    def sweep(hit, onward) -> Callable[[Column, Column], tuple[dict[str, Column], Column]]:
        def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
            is_base = x["rank"] < len(BASE)
            return {"edge": F.when(is_base, onward(acc["edge"], x)).otherwise(acc["edge"])}, x.withField("free", x["free"] & ~hit(acc["edge"], x))

        return step

    right = _walk(F.array_sort(F.concat(spans, rest)), {"edge": F.lit(-1)}, sweep(lambda e, x: e > x["start"], lambda e, x: F.greatest(e, x["end"])), _FREE)
    left = _walk(F.reverse(right), {"edge": F.lit(2**31 - 1)}, sweep(lambda e, x: e < x["end"], lambda e, x: F.least(e, x["start"])), _FREE)
    return F.filter(left, lambda x: x["free"])


def _rank(kind: Column) -> Column:
    return functools.reduce(lambda c, k: F.when(kind == k, F.lit(KINDS.index(k))).otherwise(c), GENERATORS, F.lit(len(KINDS)))


def _best(rated: Column) -> Column:
    """Of rated proposals the better ones first, as long as they don't overlap; only within groups that hang together."""
    by_place = F.array_sort(F.transform(rated, lambda x: F.struct(x["start"], x["end"], x["minus_p"], x["kind"])))
    end = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("minus_p"), F.lit("").alias("kind"))

    def gather(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        apart, one = x["start"] >= acc["edge"], F.struct(x["minus_p"], x["start"], x["end"], x["kind"]).cast(_RATED)
        group = F.when(apart, F.array(one)).otherwise(F.array_append(acc["group"], one))
        return {"edge": F.greatest(acc["edge"], x["end"]), "group": group}, F.when(apart, acc["group"]).otherwise(_none(_RATED))

    groups = _walk(F.concat(by_place, F.array(end)), {"edge": F.lit(0), "group": _none(_RATED)}, gather, f"array<{_RATED}>")

    def add(acc: Column, x: Column) -> Column:
        new = F.struct(x["start"], _rank(x["kind"]).alias("rank"), x["end"], x["kind"]).cast(_FOUND)
        return F.when(F.exists(acc, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])), acc).otherwise(F.array_append(acc, new))

    return F.flatten(F.transform(groups, lambda g: F.aggregate(F.array_sort(g), _none(_FOUND), add)))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and all: arrays of (start, rank, end, kind) in order; base kinds keep every span."""
    fitted = models(docs.sparkSession)

    def spans_of(k: str) -> Column:
        return F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind")))

    rows = proposals(base_spans(documents(docs)))
    base = F.array_sort(F.concat(*[spans_of(k) for k in BASE]))
    rows = rows.withColumn("base", base).drop(*BASE)

    free = F.transform(_free("base", "proposed"), lambda x: F.struct(x["start"], x["end"], x["kind"], x["before"], F.array(*formats(x)).alias("f")))
    score = " ".join(f"WHEN '{k}' THEN {m.minus_p()}" for k, m in fitted.items())
    enough = " OR ".join(f"(x.kind = '{k}' AND x.minus_p <= -{m.threshold!r}D)" for k, m in fitted.items())
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,before:string,f:array<double>>>")
    rows = rows.withColumn("free", F.when(F.size("proposed") > 0, free).otherwise(empty))
    rows = rows.withColumn("rated", F.expr(f"filter(transform(free, x -> named_struct('minus_p', CASE x.kind {score} END, 'start', x.start, 'end', x.end, 'kind', x.kind)), x -> {enough})"))
    added = F.when(F.size("rated") > 0, _best(F.col("rated"))).otherwise(_none(_FOUND))
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat(F.col("base"), added)).alias("all"))


def _written(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and all spans as a string."""
    found = find(docs)

    def count(k: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("all").alias("spans"))


def redact(docs: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """(doc_id, text): the text with every span replaced by the mask; of overlapping base spans the first one is written."""
    head, _, tail = mask.partition("{kind}")
    found = find(docs).withColumn("pages", F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % _PAGE), F.lit(0)))

    def piece(begin: Column, end: Column) -> Column:
        """The text from begin to end, out of the pages that hold it."""
        first = F.floor(begin / _PAGE).cast("int")
        held = F.array_join(F.slice("pages", first + 1, F.floor(end / _PAGE).cast("int") - first + 1), "")
        return F.when(end > begin, F.substring(held, begin % _PAGE + 1, end - begin)).otherwise("")

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column]:
        label = F.concat(F.lit(head), s["kind"] if "{kind}" in mask else F.lit(""), F.lit(tail))
        return {"at": F.greatest(acc["at"], s["end"])}, F.when(s["start"] >= acc["at"], F.concat(piece(acc["at"], s["start"]), label)).otherwise("")

    cut = _walk(F.col("all"), {"at": F.lit(0)}, step, "string")
    rest = piece(F.coalesce(F.array_max(F.transform("all", lambda s: s["end"])), F.lit(0)), F.length("text"))
    return found.select("doc_id", F.concat(F.array_join(cut, ""), rest).alias("text"))


# The patterns as they are stated, for tests and for readers.
STATED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
