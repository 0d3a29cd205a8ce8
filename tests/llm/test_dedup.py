"""Exact dedup and SimHash near-dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from seqmesh.llm import exact_dedup, simhash
from seqmesh.llm.components import connected_components, forest

ROWS = [(1, "Same"), (2, "sAME"), (2, "same"), (3, "other"), (4, None), (5, ""), (None, "same"), (None, "lonely"), (6, "É"), (7, "é"), (3, "other"), (8, "x" * 100_000), (9, "X" * 100_000), (-5, "other")]
SCHEMA = "doc_id long, text string, lang string, digest string, tag int, fp string, component_id int, kept string, first int, `row` string, keep_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "clash", 1, "clash", 2, "clash", 3, "clash", 4) for i, t in rows], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


def test_exact_groups(spark):
    got = exact_dedup.deduplicate(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for i, t in ROWS:
        by.setdefault(lower(t), []).append(i)
    kept = {}
    for r in got:
        key = next(k for k in by if hashlib.sha256(k).hexdigest() == r.text_sha256)
        ids = [i for i in by[key] if i is not None]
        assert r.group_size == len(by[key]) and r.keep_id == (max(ids) if ids else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[key] = kept.get(key, 0) + r.kept
    assert set(kept.values()) == {1}


def test_exact_keeps_one_row_each_with_all_columns(spark):
    got = exact_dedup.keep_winners(frame(spark, ROWS))
    assert got.columns == frame(spark, []).columns
    assert {(r.digest, r.kept, r["row"], r.keep_id) for r in got.collect()} == {("clash", "clash", "clash", 4)}
    assert sorted((r.doc_id or -99, lower(r.text)[:5]) for r in got.collect()) == sorted([(2, b"same"), (3, b"other"), (5, b""), (-99, b"lonel"), (6, "É".encode()), (7, "é".encode()), (9, b"xxxxx")])


def test_exact_empty(spark):
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0
    assert exact_dedup.keep_winners(frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_checked():
    r = np.random.default_rng(1)
    words = r.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    h = exact_dedup.PerfectHash.load(*exact_dedup.PerfectHash.build(words).dump())
    assert sorted(h.slots(words).tolist()) == list(range(5000)) and h.n == 5000
    assert (h.slots(r.integers(0, 2**63, (5000, 4), dtype=np.uint64)) < 5000).all()
    with pytest.raises(ValueError, match="not distinct"):
        exact_dedup.PerfectHash.build(np.zeros((2, 4), dtype=np.uint64))


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "a b c d", "a\x0bb\x0cc\x1cd e f", "É é ß 😀 x", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == slow_fingerprint(text)


def groups(fps, threshold=4):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= threshold):
            a, b = find(i), find(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def planted(seed, n=600):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 5])):
            out.append(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 6)))
    return np.array(out, dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1 << 28, 1 << 32, 1 << 36])
def test_every_plan_finds_every_link(n):
    """All tiers of windows: any two fingerprints up to four bits apart meet at the home anchor of either."""
    r = random.Random(n)
    for _ in range(40):
        x = r.getrandbits(64)
        y = x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        anchor, owner, home = simhash.entries(np.array([x, y], dtype=np.uint64), simhash.windows(n))
        seen = {(int(a), int(o)) for a, o in zip(anchor, owner, strict=True)}
        assert len(seen) == len(anchor)
        for me, other in ((x, y), (y, x)):
            assert any((int(a), other) in seen for a, o, h in zip(anchor, owner, home, strict=True) if h and int(o) == me)


@pytest.mark.parametrize("small", [512, 3])
def test_components_of_planted_fingerprints(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    fps = np.unique(planted(5))
    anchor, owner, home = simhash.entries(fps, simhash.windows(len(fps)))
    order = np.argsort(anchor, kind="stable")
    a, b = simhash.compare(anchor[order], owner[order], home[order])
    root = dict(zip(*(x.tolist() for x in forest(a, b)), strict=True))
    want = groups(fps)
    assert [root.get(int(f), int(f)) for f in fps] == [int(fps[w]) for w in want]


@pytest.mark.parametrize("cap", [1 << 18, 40])
def test_near_duplicates(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "CAP", cap)
    r = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    rows = [(1000, None), (1001, "")]
    for i in range(60):
        text = [r.choice(words) for _ in range(400)]
        rows.append((i, " ".join(text)))
        for k in range(i % 3):
            text[r.randrange(400)] = "changed"
            rows.append((100 + 10 * i + k, " ".join(text).upper() if k else " ".join(text)))
    rows += [(7, rows[2][1]), (None, rows[2][1])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    distinct = sorted({slow_fingerprint(t) for _, t in rows})
    root = dict(zip(distinct, groups(np.array(distinct, dtype=np.uint64)), strict=True))
    least = {}
    for i, t in rows:
        if i is not None:
            g = root[slow_fingerprint(t)]
            least[g] = min(i, least.get(g, i))
    assert all(x.component_id == least[root[x.fp & (1 << 64) - 1]] for x in got)
    kept = simhash.keep_first(frame(spark, rows)).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(i for i in [*least.values()] for _ in range(sum(j == i for j, _ in rows)))


@pytest.mark.parametrize(("block", "hashes"), [(8192, 1 << 22), (5, 1 << 22), (8192, 500)])
def test_pipeline_stage_keeps_one_of_similar_texts(spark, monkeypatch, block, hashes):
    """Copies with a few words replaced, against brute force over five-word shingles; buckets whole and cut into blocks."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HASHES", hashes)
    r = random.Random(21)
    words = ["w%d" % i for i in range(3000)]
    rows = [(5000, None), (5001, ""), (5002, "two words"), (5003, "Two  words")]
    for i in range(80):
        text = [r.choice(words) for _ in range(r.randint(40, 200))]
        rows.append((i, " ".join(text)))
        for k in range(2):
            for _ in range(r.randint(1, 5)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((100 + 10 * i + k, " ".join(text)))
    # drifting copies: a bucket's head is similar to some of its members only
    for i in range(3):
        text = [r.choice(words) for _ in range(120)]
        for k in range(40):
            rows.append((2000 + 100 * i + k, " ".join(text)))
            text[r.randrange(len(text))] = r.choice(words)
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    fps = [slow_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            bits, alike = (fps[i] ^ fps[j]).bit_count() <= 4, len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            far += alike and not bits
            if bits or alike:
                up = [up[j] if x == up[i] else x for x in up]
    want = {}
    for (i, _), g in zip(rows, up, strict=True):
        want[g] = min(i, want.get(g, i))
    kept = {x.doc_id for x in corpus_pipeline.simhash_stage(spark, frame(spark, rows), "").collect()}
    assert far > 30 and kept == set(want.values())


def test_agreement_is_a_binomial_tail():
    n, least = simhash.band_number(0.8) * simhash.ROWS, simhash.agreement(0.8)
    r = np.random.default_rng(1)
    assert least < 0.8 * n and (r.binomial(n, 0.8, 1_000_000) < least).mean() <= 2 * simhash.MISS
    assert (r.binomial(n, 0.8, 1_000_000) < least + 2).mean() > simhash.MISS
    assert simhash.agreement(1) == simhash.ROWS


def test_pairs_within_buckets_against_all_pairs():
    """Each pair that agrees enough and shares a band comes once, from its first shared band, and no other does."""
    r = np.random.default_rng(5)
    n_bands, least = simhash.band_number(0.8), simhash.agreement(0.8)
    width, docs = n_bands * simhash.ROWS, 150
    base = r.integers(0, 256, (12, width), dtype=np.uint8)
    sketch = base[r.integers(0, 12, docs)]
    change = r.random((docs, width)) < r.random((docs, 1)) * 0.5
    sketch = np.where(change, r.integers(0, 256, (docs, width)), sketch).astype(np.uint8)
    root, fp, n = r.integers(0, 100, docs), r.integers(0, 140, docs), r.integers(80, 130, docs)
    rows = []
    for b in range(n_bands):
        for d in range(docs):
            rows.append((b, bytes(sketch[d, b * 4 : b * 4 + 4]), int(n[d]), d))
    rows.sort()
    name = {key: i for i, key in enumerate(sorted({x[:2] for x in rows}))}
    bucket, band, who = np.array([name[x[:2]] for x in rows]), np.array([x[0] for x in rows]), np.array([x[3] for x in rows])
    no = np.zeros(len(rows), dtype=bool)
    x, y = simhash.alike_within(bucket, band, np.zeros(len(rows), dtype=int), no, root[who], fp[who], n[who], sketch[who], 0.8)
    got = sorted(tuple(sorted(p)) for p in zip(who[x].tolist(), who[y].tolist()))
    want = []
    for i in range(docs):
        for j in range(i):
            same = sketch[i] == sketch[j]
            shared = same.reshape(n_bands, 4).all(axis=1).any()
            if root[i] != root[j] and fp[i] != fp[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and same.sum() >= least and shared:
                want.append((j, i))
    assert got == sorted(want) and len(want) > 100


def test_a_bucket_of_many_dissimilar_members_names_no_pairs():
    r = np.random.default_rng(2)
    m, width = 6000, simhash.band_number(0.8) * simhash.ROWS
    sketch = r.integers(0, 256, (m, width), dtype=np.uint8)
    sketch[:, 12:16] = 7
    n, zero = np.sort(r.integers(50, 5000, m)), np.zeros(m, dtype=int)
    x, y = simhash.alike_within(zero, zero + 3, zero, zero > 0, np.arange(m), np.arange(m), n, sketch, 0.8)
    assert not len(x) and not len(y)


def test_a_shared_passage_links_nothing(spark):
    """Texts that share a long passage and are not similar enough, and near copies of some of them."""
    r = random.Random(4)
    shared, rows = " ".join(f"s{i}" for i in range(300)), []
    for i in range(400):
        rows.append((i, shared + " " + " ".join(f"t{i}x{j}" for j in range(100))))
    for i in range(0, 400, 40):
        w = rows[i][1].split()
        w[r.randrange(310, 390)] = "changed"
        rows.append((1000 + i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame(spark, rows), 0.8).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    for i in range(0, 400, 40):
        assert got[1000 + i] == got[i]
    apart = [i for i in range(400) if all((fps[i] ^ f).bit_count() > 4 for j, f in fps.items() if j != i and j != i + 1000)]
    assert len(apart) > 300 and all(got[i] == i for i in apart)


def test_near_duplicates_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_first(frame(spark, [])).count() == 0


def test_connected_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(40), 1000 + r.randrange(40)) for _ in range(30)] + [(5, 5), (None, 3)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up}
