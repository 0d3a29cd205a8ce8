"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Input of a word: an embedding of the word, if training has met it often enough, beside the mean embedding of its
character 3-, 4- and 5-grams (hashed). A window of ``WIDTH`` words runs through a gated recurrent unit in either direction,
attention pools the states, and a linear layer gives the window's logit. Windows start every ``STRIDE`` words, so all
words but a text's first and last few stand in two; every window of every text is scored, and the largest logit,
calibrated, is the text's score.

Training takes a bounded sample of labelled rows (``SAMPLE`` of either label, by hash of the doc_id, texts of up to
``LONGEST`` characters) whose doc_id does not belong to the held-out fifth. Only texts have labels, so each epoch
scores all windows of the sample and learns from the likeliest windows of each text. Embeddings start from how
unevenly a word or n-gram is spread over the labels. A sixth of the sample calibrates, at the labels' true ratio.

Scale: training sees at most 2 x ``SAMPLE`` texts, whatever the corpus; the model is about one MB and is broadcast.
Scoring is one pass without a shuffle, a few thousand windows at a time.

Defined results: null and empty texts, and texts of white space, count as one window of padding; labels other than 0
and 1, and null ids, are not learnt from; of labels that differ for one doc_id the toxic one counts; without both
labels in the sample every score is the share of toxic labels (0 if there are none); a null doc_id is not held out;
labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmesh.llm.common import documents, give_back, slices
from seqmesh.session import ship

#: Texts of either label that training may take, and the longest of them in characters.
SAMPLE, LONGEST = 2000, 20_000
WIDTH, STRIDE, HIDDEN, ATTEND = 24, 12, 8, 8
WORDS, WORD_DIM, GRAMS, GRAM_DIM = 8192, 8, 1 << 14, 8
EPOCHS, BATCH, RATE = 8, 64, 0.05
#: Windows that run through the network together.
BLOCK = 4096
_EDGE = ".,;:!?*#$%&\"'()[]{}|-_/\\<>~^`+=…«»“”„¿¡@"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words of each text, index of each word, distinct words), lower-cased, without marks at their ends."""
    counts, index, words = _raw_tokens(column)
    return counts, index, [w.strip(_EDGE) for w in words]


def _raw_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same with the marks."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")  # splitting nothing gives one empty piece
    coded = flat.filter(real).dictionary_encode()
    counts = np.diff(np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy() - lists.offsets[0].as_py()])
    return counts, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def tokens_of(texts: list[str], block: int = 128) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What ``tokens`` makes of all texts, some at a time, so that their words are never all there as strings."""
    known: dict[str, int] = {}
    counts, index = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
    for i in range(0, len(texts), block):
        n, at, words = _raw_tokens(pa.array(texts[i : i + block]))
        place = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32)
        counts.append(n)
        index.append(place[at])
    give_back()
    return np.concatenate(counts), np.concatenate(index).astype(np.int64), [w.strip(_EDGE) for w in known]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of the words between their edges, word after word."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in (3, 4, 5):
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            buckets.append((h % np.uint64(GRAMS)).astype(np.int32))
            owners.append(owner[at])
    bucket, of = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return bucket[order], of[order]


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word within the text) of every window; a text has one at least, and its last window reaches its end."""
    n = 1 + np.maximum(0, -(-(counts - WIDTH) // STRIDE))
    text = np.repeat(np.arange(len(counts)), n)
    return text, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def cut(counts: np.ndarray, index: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word indices) of all windows as rows of WIDTH; ``empty`` pads."""
    text, first = windows(counts)
    start, padded = np.cumsum(counts) - counts, np.r_[index, empty].astype(np.int32)
    out = np.empty((len(text), WIDTH), dtype=np.int32)
    for i in range(0, len(text), BLOCK):
        own, f = text[i : i + BLOCK], first[i : i + BLOCK, None] + np.arange(WIDTH)
        out[i : i + BLOCK] = padded[np.where(f < counts[own][:, None], start[own][:, None] + f, len(index))]
    return text.astype(np.int32), out


class Network:
    """Parameters by name; ``vocabulary`` maps words to rows of ``word``, whose row 0 is for all others."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        draw = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
        self.vocabulary, self.slope, self.offset, self.constant = vocabulary, 1.0, 0.0, None
        self.p = {"word": draw(len(vocabulary) + 1, WORD_DIM, by=0.05), "gram": draw(GRAMS, GRAM_DIM, by=0.05), "att": draw(2 * h, ATTEND), "pick": draw(ATTEND), "out": draw(2 * h), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"in_{way}": draw(d, 3 * h), f"gate_{way}": draw(h, 2 * h), f"new_{way}": draw(h, h), f"b_{way}": np.zeros(3 * h, np.float32)}
        self.p["word"][0] = 0

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of distinct words. A last row of zeros is the padding."""
        x = np.zeros((len(words) + 1, WORD_DIM + GRAM_DIM), dtype=np.float32)
        for i in range(0, len(words), 16384):
            part = words[i : i + 16384]
            bucket, of = grams(part)
            n = np.maximum(np.bincount(of, minlength=len(part)), 1).astype(np.float32)
            x[i : i + len(part), :WORD_DIM] = self.p["word"][[self.vocabulary.get(w, 0) for w in part]]
            for k in range(GRAM_DIM):
                x[i : i + len(part), WORD_DIM + k] = np.bincount(of, weights=self.p["gram"][bucket, k], minlength=len(part)) / n
        return x

    def forward(self, seen: np.ndarray, project: dict[str, np.ndarray], keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows (rows of indices into the projected inputs)."""
        n, held = len(seen), {}
        states = np.empty((WIDTH, n, 2 * HIDDEN), dtype=np.float32)
        for way in "fb":
            gate, new, table = self.p[f"gate_{way}"], self.p[f"new_{way}"], project[way]
            h, part, steps = np.zeros((n, HIDDEN), np.float32), slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None), []
            for t in range(WIDTH) if way == "f" else range(WIDTH - 1, -1, -1):
                x = table[seen[:, t]]
                zr = h @ gate
                zr += x[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                rh = r * h
                c = rh @ new
                c += x[:, 2 * HIDDEN :]
                np.tanh(c, out=c)
                if keep:
                    steps.append((t, h, z, r, rh, c))
                h = c + z * (h - c)
                states[t, :, part] = h
            held[way] = steps
        a = np.tanh(states @ self.p["att"])
        e = a @ self.p["pick"]
        e -= e.max(axis=0)
        w = np.exp(e)
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, {"steps": held, "states": states, "a": a, "w": w, "pooled": pooled} if keep else {}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"in_{way}"] + self.p[f"b_{way}"] for way in "fb"}

    def gradients(self, seen: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted logistic loss by parameter, and by input vector."""
        logit, k = self.forward(seen, self.project(x), keep=True)
        g = {n: np.zeros_like(v) for n, v in self.p.items() if n not in ("word", "gram")}
        dl = ((_sigmoid(logit) - target) * weight / len(seen)).astype(np.float32)
        g["out"], g["bias"][0] = k["pooled"].T @ dl, dl.sum()
        dp = dl[:, None] * self.p["out"]
        states, w, a = k["states"], k["w"], k["a"]
        ds = w[:, :, None] * dp
        dw = np.einsum("nd,tnd->tn", dp, states)
        de = w * (dw - (w * dw).sum(axis=0))
        g["pick"] = np.einsum("tn,tna->a", de, a)
        da = de[:, :, None] * self.p["pick"] * (1 - a * a)
        g["att"] = np.einsum("tnd,tna->da", states, da)
        ds += da @ self.p["att"].T
        dx = np.zeros_like(x)
        for way in "fb":
            part = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
            gate, new, into = self.p[f"gate_{way}"], self.p[f"new_{way}"], self.p[f"in_{way}"]
            dh = np.zeros((len(seen), HIDDEN), np.float32)
            for t, h, z, r, rh, c in reversed(k["steps"][way]):
                dh = dh + ds[t, :, part]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                drh = dc @ new.T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                g[f"new_{way}"] += rh.T @ dc
                g[f"gate_{way}"] += h.T @ dzr
                dh = dh * z + drh * r + dzr @ gate.T
                both = np.concatenate([dzr, dc], axis=1)
                g[f"b_{way}"] += both.sum(axis=0)
                g[f"in_{way}"] += x[seen[:, t]].T @ both
                np.add.at(dx, seen[:, t], both @ into.T)
        return g, dx

    def logits(self, column: pa.Array) -> np.ndarray:
        """The largest window logit of each text."""
        counts, index, words = tokens(column)
        x = self.inputs(words)
        table, out = self.project(x), np.full(len(counts), -np.inf, dtype=np.float64)
        text, first = windows(counts)
        start, index = np.cumsum(counts) - counts, np.r_[index, len(words)]
        for i in range(0, len(text), BLOCK):
            own, f = text[i : i + BLOCK], first[i : i + BLOCK]
            at = (start[own] + f)[:, None] + np.arange(WIDTH)
            seen = index[np.where(f[:, None] + np.arange(WIDTH) < counts[own][:, None], at, -1)]
            np.maximum.at(out, own, self.forward(seen, table)[0])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        # how texts share a block of windows moves the last bits of single precision
        return np.round(_sigmoid(self.slope * self.logits(column) + self.offset), 6)


def _uneven(hit: np.ndarray, miss: np.ndarray, hits: int, misses: int) -> np.ndarray:
    """How unevenly something met in so many texts of either label is spread, in standard deviations, within -1 and 1."""
    odds = np.log((hit + 0.5) / (hits - hit + 0.5)) - np.log((miss + 0.5) / (misses - miss + 0.5))
    return np.tanh(odds / np.sqrt(1 / (hit + 0.5) + 1 / (miss + 0.5)) / 6)


def _presence(owner: np.ndarray, item: np.ndarray, items: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of label 1 and 0 each item is."""
    pairs = np.unique(owner * items + item)
    got = label[pairs // items]
    return np.bincount(pairs[got == 1] % items, minlength=items), np.bincount(pairs[got == 0] % items, minlength=items)


def train(texts: list[str], labels: np.ndarray, share: float, seed: int = 5) -> Network:
    """A network from texts and their 0/1 labels; ``share`` is the true share of label 1, at which scores are calibrated."""
    if not len(labels) or labels.min() == labels.max():
        out = Network({})
        out.constant = float(share)
        return out
    r = np.random.default_rng(seed)
    counts, index, words = tokens_of(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    fitted = np.arange(len(texts)) % 6 != 0
    kept = fitted[owner]
    hits, misses = int((labels[fitted] == 1).sum()), int((labels[fitted] == 0).sum())
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    same = np.array([distinct[w] for w in words])
    hit, miss = _presence(owner[kept], same[index[kept]], len(distinct), labels)
    uneven = _uneven(hit, miss, hits, misses)
    names = list(distinct)
    often = [k for k in np.argsort(-np.abs(uneven), kind="stable").tolist() if hit[k] + miss[k] >= 4 and names[k]][:WORDS]
    net = Network({names[k]: i + 1 for i, k in enumerate(often)}, seed)
    net.p["word"][1:, 0] = uneven[often]
    cuts = []
    for i in range(0, len(words), 16384):
        some, of = grams(words[i : i + 16384])
        cuts.append((some.astype(np.int16), np.bincount(of, minlength=min(16384, len(words) - i)).astype(np.int32)))
    bucket, n = (np.concatenate([c[k] for c in cuts]) for k in (0, 1))
    edge = np.r_[0, np.cumsum(n)]
    del cuts, some, of
    hit, miss = np.zeros(GRAMS, dtype=np.int64), np.zeros(GRAMS, dtype=np.int64)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(0, len(texts), 64):  # a few texts at a time, for their n-grams are many
        some = slice(first[i], first[min(i + 64, len(texts))])
        pairs = np.unique(owner[some][kept[some]] * len(words) + index[some][kept[some]])
        text_of, word_of = pairs // len(words), pairs % len(words)
        size = np.diff(edge)[word_of]
        flat = np.repeat(edge[word_of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        more = _presence(np.repeat(text_of, size), bucket[flat], GRAMS, labels)
        hit, miss = hit + more[0], miss + more[1]
    net.p["gram"][:, 0] = _uneven(hit, miss, hits, misses)

    text, seen = cut(counts, index, len(words))
    row = np.array([net.vocabulary.get(w, 0) for w in words], dtype=np.int32)
    n_words = len(words)
    del words, distinct, names, uneven, often, hit, miss, owner, kept, same, index
    give_back()

    def vectors(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, and what passes their gradients on: n-gram buckets, whose they are, how many each has."""
        size = n[some]
        flat = bucket[np.repeat(edge[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        of, many = np.repeat(np.arange(len(some)), size), np.maximum(size, 1).astype(np.float32)
        out = np.empty((len(some), WORD_DIM + GRAM_DIM), dtype=np.float32)
        out[:, :WORD_DIM] = net.p["word"][row[some]]
        for k in range(GRAM_DIM):
            out[:, WORD_DIM + k] = np.bincount(of, weights=net.p["gram"][flat, k], minlength=len(some)) / many
        return out, flat, of, many

    def all_vectors() -> np.ndarray:
        x = np.zeros((n_words + 1, WORD_DIM + GRAM_DIM), dtype=np.float32)
        for i in range(0, n_words, 16384):
            x[i : i + 16384][: n_words - i] = vectors(np.arange(i, min(i + 16384, n_words)))[0]
        return x

    x = all_vectors()
    mine = np.flatnonzero(fitted[text])
    best = x[:, 0][seen].max(axis=1) + x[:, WORD_DIM][seen].max(axis=1)
    squares = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}
    for epoch in range(EPOCHS):
        if epoch:
            best = _logits(net, seen, x)
        order = mine[np.lexsort((-best[mine], text[mine]))]
        place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = order[place < np.where(labels[text[order]] == 1, 1, 3)]
        chosen = np.r_[chosen, r.choice(mine[labels[text[mine]] == 0], min(len(chosen), 2000))] if misses else chosen
        r.shuffle(chosen)
        target = labels[text[chosen]].astype(np.float32)
        weight = np.where(target == 1, (target == 0).sum() / max((target == 1).sum(), 1), 1).astype(np.float32)
        weight = np.minimum(weight, 4)
        for i in range(0, len(chosen), BATCH):
            some = seen[chosen[i : i + BATCH]]
            used, local = np.unique(some, return_inverse=True)
            words_used = used[used < n_words]
            vec = np.zeros((len(used), WORD_DIM + GRAM_DIM), dtype=np.float32)
            vec[: len(words_used)], own_bucket, of_local, many = vectors(words_used)
            g, dx = net.gradients(local.reshape(some.shape), vec, target[i : i + BATCH], weight[i : i + BATCH])
            for k, v in g.items():
                squares[k] += v * v
                net.p[k] -= RATE * v / np.sqrt(squares[k])
            dw = np.zeros_like(net.p["word"])
            np.add.at(dw, row[words_used], dx[: len(words_used), :WORD_DIM])
            dw[0] = 0
            dg = np.zeros_like(net.p["gram"])
            np.add.at(dg, own_bucket, (dx[: len(words_used), WORD_DIM:] / many[:, None])[of_local])
            for k, v in (("word", dw), ("gram", dg)):
                squares[k] += v * v
                net.p[k] -= RATE * v / np.sqrt(squares[k])
        x = all_vectors()
    _calibrate(net, seen, text, x, labels, fitted, share)
    return net


def _logits(net: Network, seen: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Logits of windows, a block at a time with the words that it holds."""
    out = np.empty(len(seen), dtype=np.float32)
    for i in range(0, len(seen), BLOCK):
        used, local = np.unique(seen[i : i + BLOCK], return_inverse=True)
        out[i : i + BLOCK] = net.forward(local.reshape(-1, WIDTH), net.project(x[used]))[0]
    return out


def _calibrate(net: Network, seen: np.ndarray, text: np.ndarray, x: np.ndarray, labels: np.ndarray, fitted: np.ndarray, share: float) -> None:
    """Slope and offset of the scores from the texts that were not fitted, each label at its true weight."""
    logit = _logits(net, seen, x)
    most = np.full(len(labels), -np.inf)
    np.maximum.at(most, text, logit)
    held = ~fitted if len(set(labels[~fitted].tolist())) == 2 else np.ones(len(labels), dtype=bool)
    s, t = most[held], labels[held]
    weight = np.where(t == 1, share / max((t == 1).sum(), 1), (1 - share) / max((t == 0).sum(), 1))
    slope, offset = 1.0, 0.0
    for _ in range(60):  # Newton's method, with a little ridge towards slope one
        p = _sigmoid(slope * s + offset)
        e, v = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([(e * s).sum() + 1e-3 * (slope - 1), e.sum() + 1e-4 * offset])
        hess = np.array([[(v * s * s).sum() + 1e-3, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-4]])
        step = np.linalg.solve(hess, grad)
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
    net.slope, net.offset = float(max(slope, 1e-3)), float(offset)


def held_out(doc_id: Column) -> Column:
    """Whether a doc_id belongs to the fifth that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs``; at most 2 x SAMPLE rows come to the driver."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    by_hash = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    ids = [r for label in (1, 0) for r in by_hash.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id", "toxic").collect()]
    if not ids:
        return train([], np.zeros(0, dtype=np.int64), 0.0)
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")  # no more than 2 x SAMPLE rows
    rows = documents(docs).join(F.broadcast(picked), "doc_id").where(F.length("text") <= LONGEST).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted(((r.doc_id, r.toxic, r.text) for r in rows.collect()), key=lambda r: (hash((r[0], 17)), r[0]))
    net = train([r[2] for r in got], np.array([r[1] for r in got], dtype=np.int64), (toxic or 0) / max(n, 1))
    del got
    gc.collect()
    give_back()
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text")), pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the texts whose score reaches one half, with all their columns, scored row by row in one pass.

    Rows are judged by their own text; nothing is joined back, so repeated and null doc_ids are of no matter.
    """
    net = fit(docs, labels)
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, 2 << 20):
            yield b.filter(pa.array(model.scores(b.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
