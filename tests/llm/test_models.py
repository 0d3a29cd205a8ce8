"""Toxicity and decontamination: gradients, held-out accuracy, recall, defined results."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seqmesh.llm import decontamination, toxicity


def corpus(n, seed):
    """Texts of invented words; the toxic ones hold a word of a small list, in a few forms."""
    r = random.Random(seed)
    part = ["ta", "ro", "mi", "len", "sor", "ka", "pu", "vi"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 150))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["gruzzle", "GRUZZLED", "snorf!", "snorfing", "blarkt."]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_gradients():
    net = toxicity.Network({"a": 1, "b": 2}, 3)
    r = np.random.default_rng(1)
    x = r.standard_normal((5, toxicity.WORD_DIM + toxicity.GRAM_DIM)).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seen, target, weight = r.integers(0, 5, (4, toxicity.WIDTH)), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        p = toxicity._sigmoid(net.forward(seen, net.project(x))[0])
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).mean()

    g, dx = net.gradients(seen, x, target, weight)
    for name in ("in_f", "gate_b", "new_f", "b_b", "att", "pick", "out", "bias"):
        at = tuple(r.integers(0, s) for s in net.p[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-2
        up = loss()
        net.p[name][at] = keep - 1e-2
        slope = (up - loss()) / 2e-2
        net.p[name][at] = keep
        assert abs(slope - g[name][at]) < 2e-3 + 0.05 * abs(slope), name
    keep = x[1, 2]
    x[1, 2] = keep + 1e-2
    up = loss()
    x[1, 2] = keep - 1e-2
    assert abs((up - loss()) / 2e-2 - dx[1, 2]) < 2e-3


def test_windows_cover_every_word():
    counts = np.array([0, 1, 24, 25, 36, 100])
    text, first = toxicity.windows(counts)
    for t, n in enumerate(counts.tolist()):
        covered = {w for f in first[text == t] for w in range(f, f + toxicity.WIDTH)}
        assert set(range(n)) <= covered and (text == t).sum() >= 1


def test_toxicity_learns_from_the_rest_only(spark):
    rows = corpus(900, 2)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows] + [(5000, None, 1, "x"), (5001, "", 1, "x"), (None, "gruzzle snorf! gruzzle", 1, "x"), (5002, "gruzzle " * 20_000, 1, "x"), (5003, " \n\t ", 1, "x")], "doc_id long, text string, score int, lang string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 5
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) <= len(held) + 5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    assert max(got[i].score for i in (5000, 5001, 5003)) - min(got[i].score for i in (5000, 5001, 5003)) < 1e-5 and not got[5000].predicted
    assert got[None].predicted and got[5002].predicted and not got[None].held_out
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, r in got.items() if not r.predicted)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, one).collect()} == {1.0}


def test_grams_are_by_word():
    bucket, of = toxicity.grams(["", "ab", "é😀x"])
    assert of.tolist() == sorted(of.tolist()) and np.bincount(of, minlength=3).tolist() == [0, 3, 6]
    assert toxicity.tokens(pa.array(["A b\u2003C.", None, ""]))[0].tolist() == [3, 0, 0]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_tokens_in_blocks(block):
    texts = ["A b\u2003C. b", "", "b! c d", "  ", "D (a) a b", "x"]
    whole, parts = toxicity.tokens(pa.array(texts)), toxicity.tokens_of(texts, block)
    assert [x.tolist() for x in whole[:2]] == [x.tolist() for x in parts[:2]] and whole[2] == parts[2]


def bench(n, seed):
    r = random.Random(seed)
    part = ["be", "do", "fal", "gim", "hu", "jor", "ne", "qui", "sa", "tem", "ul", "wex"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randint(2, 4)))
    common = [word() for _ in range(12)]
    text = lambda k: " ".join(r.choice(common) if r.random() < 0.4 else word() for _ in range(k))
    return r, text, [(i, text(r.randint(12, 60)) + ". " + text(4) + ".") for i in range(n)]


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    r, text, items = bench(40, 1)
    docs, want = [], set()
    for d in range(600):
        body = text(r.randint(20, 400)).split()
        if d % 6 == 0:
            k = d // 6 % 40
            at = r.randrange(len(body))
            body[at:at] = items[k][1].upper().split() if d % 12 else items[k][1].replace(" ", "*** ").split()
            want.add((d, k))
        docs.append((d, " ".join(body)))
    odd = [(9000, None), (9001, ""), (None, items[3][1]), (9002, "z " * 50_000 + items[5][1]), (9002, "z " * 50_000 + items[5][1])]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs + odd], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([*items, (77, None), (78, ""), (79, "too short to tell"), (80, items[0][1])], "item_id long, text string")
    got = [(x.doc_id, x.item_id) for x in decontamination.contaminated(frame, table).collect()]
    found = set(got)
    assert want <= found and (None, 3) in found and got.count((9002, 5)) == 2
    assert found - want == {(None, 3), (9002, 5)} | {(d, 80) for d, k in want if k == 0}
    clean = decontamination.keep_clean(frame, table)
    assert clean.columns == frame.columns
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want} | {9000, 9001}


def test_paraphrases_need_their_answer():
    r, text, items = bench(6, 4)
    basis = np.zeros((decontamination.DIMENSIONS + 1, decontamination.RANK), dtype=np.float32)
    box = decontamination.Items(items, basis)
    for k, (_, t) in enumerate(items):
        w = decontamination.words(t)
        answer = len(w) - 4
        loose = [x for i, x in enumerate(w) if i >= answer or i % 4]
        yes, share, found = box.leaked(k, [b"x", *loose, b"y"])
        assert yes and found and share < 1
        cut = [x for i, x in enumerate(w[:answer]) if i % 4]
        yes, share, found = box.leaked(k, cut)
        assert not found and yes == (share >= decontamination.SURE)
        best = np.zeros((len(w) + 1, len(cut) + 1), dtype=int)
        for i, a in enumerate(w):
            for j, b in enumerate(cut):
                best[i + 1, j + 1] = best[i, j] + 1 if a == b else max(best[i, j + 1], best[i + 1, j])
        assert abs(share - best[-1, -1] / len(w)) < 1e-12


@pytest.mark.parametrize("around", ["plain", "repeated", "rare"])
def test_search_by_words_finds_what_brute_force_finds(around):
    """A basis of zeros, so that no window is near by cosine: verbatim and paraphrased plants, against LCS at every window."""
    r, text, items = bench(30, 6)
    box = decontamination.Items(items, np.zeros((decontamination.DIMENSIONS + 1, decontamination.RANK), dtype=np.float32))
    fill = {"plain": text, "repeated": lambda n: "fal fal gim " * (n // 3), "rare": lambda n: " ".join(f"zz{r.random()}" for _ in range(n))}[around]
    rows, whole = [], []
    for k, (_, t) in enumerate(items):
        w = t.split()
        for keep in (1.0, 0.85, 0.7, 0.6, 0.5):
            got = [x for i, x in enumerate(w) if r.random() < keep or i >= len(w) - 4 and keep < 0.85]
            if keep == 0.7:
                got = [y for x in got for y in (x, *fill(3).split()[: r.randrange(3)])]
            rows.append(" ".join([fill(r.randrange(120)), *got, fill(r.randrange(120))]))
            if keep == 1.0:
                whole.append((len(rows) - 1, k))
    found = {(i, k) for i, h in enumerate(box.search(rows, np.zeros((decontamination.DIMENSIONS + 1, decontamination.RANK), dtype=np.float32))) for k in h}
    want = set()
    for i, t in enumerate(rows):
        w = decontamination.words(t)
        for k in range(len(items)):
            n = len(box.words[k])
            if any(box.leaked(k, w[max(0, f - n) : f + 32 + n])[0] for f in range(0, len(w), 16)):
                want.add((i, k))
    assert set(whole) <= want and len(want) > 2 * len(items) and found == want


def test_paraphrases_end_to_end(spark):
    """The whole operator against the LCS at every window: plants with words replaced, dropped and put in, and short items."""
    r, text, items = bench(24, 12)
    short = [(100, "Zorb plinth"), (101, "quorl"), (102, "fal gim fal jorwex!")]
    rows = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        for change in (0.0, 0.2, 0.3, 0.35, 0.5):
            got = [text(1) if r.random() < change and i < len(w) - 4 else x for i, x in enumerate(w)]
            if k % 3 == 1:
                got = [y for x in got for y in ([x, text(1)] if r.random() < 0.15 else [x])]
            rows.append(" ".join([text(r.randrange(1, 90)), *got, text(r.randrange(1, 90))]))
    rows += [text(300) for _ in range(60)]
    rows += ["so ZORB, plinth it is", "zorb and plinth", "plinth zorb plinth", "a quorl.", "quorls", "fal gim fal gim fal jorwex gim", "fal gim jorwex", "", "zorb"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(items + short, "item_id long, text string")).collect()
    box = decontamination.Items(items, np.zeros((decontamination.DIMENSIONS + 1, decontamination.RANK), dtype=np.float32))
    want = set()
    for i, t in enumerate(rows):
        w = decontamination.words(t)
        for k in range(len(items)):
            n = len(box.words[k])
            if any(box.leaked(k, w[max(0, f - n) : f + 32 + n])[0] for f in range(0, len(w), 16)):
                want.add((i, k))
        for k, x in short:
            y = decontamination.words(x)
            if any(w[f : f + len(y)] == y for f in range(len(w))):
                want.add((i, k))
    found = {(x.doc_id, x.item_id) for x in got}
    assert len(want) > 3 * len(items) and {(180, 100), (182, 100), (183, 101), (185, 102)} <= want
    assert len(found & want) >= 0.9 * len(want) and found == want
    assert all((x.cosine is None) == (x.item_id >= 100) for x in got)


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).count() == 0 and decontamination.keep_clean(docs, none).count() == 1
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert decontamination.contaminated(docs.limit(0), items).count() == 0


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    r, text, items = bench(5, 8)
    docs = spark.createDataFrame([(k, text(60) + " " + t + " " + text(60)) for k, t in items] + [(100 + k, text(200)) for k in range(60)], "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(5)}


def test_basis_is_fitted_on_every_document(spark):
    """Far more documents than a sample would have: each has a word of its own, and all of these have a place in the basis."""
    docs = spark.createDataFrame([(d, f"own{d} at{d % 7} by{d % 11}") for d in range(6000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "own1 at1 by1 some more words of an item")], "item_id long, text string")
    _, basis = next(decontamination._searchers(docs, items))
    met = decontamination.hashed([f"own{d}".encode() for d in range(6000)])
    assert basis.value[met].any(axis=1).all() and not basis.value[-1].any()


def test_products_of_passages():
    r = np.random.default_rng(3)
    size = r.integers(1, decontamination.PASSAGE + 1, 700)
    ids = np.where(r.random(size.sum()) < 0.3, 5, r.integers(0, 400, size.sum()))  # one word in runs far longer than a passage
    idf = (r.random(decontamination.DIMENSIONS) + 0.1).astype(np.float32)
    a = np.zeros((700, decontamination.DIMENSIONS), dtype=np.float32)
    np.add.at(a, (np.repeat(np.arange(700), size), ids), idf[ids])
    per_place = np.zeros(700)
    np.add.at(per_place, np.repeat(np.arange(700), size), idf[ids].astype(float) ** 2)
    a /= np.sqrt(per_place)[:, None]
    q = r.standard_normal((decontamination.DIMENSIONS, 8), dtype=np.float32)
    got, want = np.zeros_like(q), a.T @ (a @ q)
    decontamination.gram(ids, size, idf, *decontamination.rounded(q * idf[:, None]), got)
    assert np.abs(got * idf[:, None] - want).max() < 2e-3 * np.abs(want).max()
    x, length = decontamination.along(ids, size, idf, q * idf[:, None])
    assert np.allclose(x / length[:, None], a @ q, atol=1e-4)


def test_orthonormal():
    z = np.random.default_rng(1).standard_normal((500, 32)).astype(np.float32)
    q = decontamination.orthonormal(z.copy())
    assert np.abs(q.T @ q - np.eye(32)).max() < 1e-3 and np.abs(q @ (q.T @ z) - z).max() < 1e-2


@pytest.mark.parametrize("words", [0, 1, 16, 17, 32, 33, 200])
def test_document_windows(words):
    basis = np.random.default_rng(2).standard_normal((decontamination.DIMENSIONS + 1, decontamination.RANK)).astype(np.float32)
    basis[-1] = 0
    ids = np.random.default_rng(words).integers(0, decontamination.DIMENSIONS, words)
    v, first, text = decontamination.window_vectors(ids, np.array([words]), basis)
    assert set(range(words)) <= {w for f in first for w in range(f, f + 32)}
    for k, f in enumerate(first.tolist()):
        want = basis[ids[f : f + 32]].sum(axis=0)
        assert np.allclose(v[k], want / np.linalg.norm(want), atol=1e-4)
