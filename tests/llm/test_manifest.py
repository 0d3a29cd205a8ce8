"""Merkle manifests against a plain tree, and the laws of the forests that make them."""

import hashlib
import random
import zlib

import pytest

from seqmesh.llm import manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    out = []
    for row in tree[:-1]:
        j = i ^ 1
        out.append((row[j] if j < len(row) else None, j < i))
        i //= 2
    return out


def leaf(d, n):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d[0], d[1], d[2], n, d[4])))


def plain(rows):
    groups = {}
    for d in rows:
        groups.setdefault(d[2], []).append((leaf(d, d[3]), d))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {k: levels([h for h, _ in groups[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, (h, d) in enumerate(groups[k]):
            path = way(trees[k], i) + way(top, g)
            hit = d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            now = leaf(d, d[3] + 1) if hit else h
            for s, left in path:
                now = sha(now) if s is None else sha(s + now) if left else sha(now + s)
            out.append((d[0], h, trees[k][-1][0], top[-1][0], sha("".join(s for s, _ in path if s)), now, now == top[-1][0]))
            assert hit == (now != top[-1][0])
    return sorted(out, key=repr)


def rows(n, langs, seed):
    r = random.Random(seed)
    out = [(i, r.choice(["web", None, ""]), r.choice(langs), r.choice([None, i % 50]), r.choice(["", None, "é中", "long " * 2000, f"text {i}"])) for i in range(n)]
    return [*out, (None, "s", langs[0], 5, "x"), (None, "s", langs[0], 5, "x"), (3, "web", langs[0], 1, "twice"), (3, "web", langs[0], 1, "twice")]


@pytest.mark.parametrize(("n", "langs", "chunk"), [(300, ["de", "en", None, "", "é", "zz"], 1 << 16), (1000, ["en"], 16), (333, ["a", "b", None], 8), (90, [f"l{k}" for k in range(60)], 32), (0, ["only"], 4)])
def test_against_a_plain_tree(spark, n, langs, chunk):
    data = rows(n, langs, n)
    docs = spark.createDataFrame([(*d, "clash", 1) for d in data], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int").repartition(7)
    got = manifest.tampered(docs, chunk)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(data)


def test_segments_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SEGMENTS", 0)
    data = rows(200, ["x", "y"], 4)
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(r) for r in manifest.tampered(docs, 8).collect()), key=repr) == plain(data)


def test_empty_and_single(spark):
    kinds = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.tampered(spark.createDataFrame([], kinds)).count() == 0
    row = manifest.tampered(spark.createDataFrame([(1, "s", "en", 2, "t")], kinds)).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 200])
def test_forests_merge_in_any_grouping(n):
    r = random.Random(n)
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    want = levels([x.hex() for x in leaves])[-1][0]
    for _ in range(5):
        cuts = sorted({0, n, *(r.randrange(n) for _ in range(6))})
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            f = manifest.Forest({manifest.TOP: 1, 0: n})
            _, loose = manifest.climb(a, b"".join(leaves[a:b]), n)
            for level, index, value in loose:
                f.put((0, level, index), value)
            parts.append(f)
        while len(parts) > 1:  # neighbours or not, in any order
            i = r.randrange(len(parts) - 1)
            parts[i].merge(parts.pop(i + 1 if r.random() < 0.5 else len(parts) - 1 if i < len(parts) - 1 else i + 1))
        assert [v.hex() for v in parts[0].open.values()] == [want]
