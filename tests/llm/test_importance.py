"""Importance resampling against a plain computation, and its counting for longer runs of words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from seqmesh.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text, n, buckets):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))


def plain(rows, target, seed, percent, n, buckets, least):
    counts = [(i, len(words(t)), features(t, n, buckets)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in counts:
        s.update(f)
    for x in target:
        t.update(features(x, n, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, size, f in counts:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in f.items())
        out.append((size, [i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]))
    fit = [row for size, row in out if size >= least]
    for k, row in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))[: percent * len(fit) // 100]):
        row[4] = k + 1
    return sorted((tuple(r) for _, r in out), key=repr)


def corpus():
    r = random.Random(9)
    names = ["Alpha", "beta", "ÉTÉ", "été", "x1", "42", "中文", "don't", "a_b", "nul\x00l", "Straße", "gamma", "delta"]
    texts = [" ".join(r.choice(names) for _ in range(r.randint(0, 60))) for _ in range(120)]
    return [*enumerate(texts), (7, None), (8, ""), (9, " \t.,;"), (None, texts[3]), (None, texts[3]), (11, texts[11]), (11, texts[12]), (500, "word " * 30_000)]


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 1, 100)])
def test_against_a_plain_computation(spark, n, buckets, percent):
    rows, target = corpus(), ["alpha beta gamma", "the 42 ÉTÉ", None, ""]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2.0) for i, t in rows], "doc_id long, text string, gains string, weight int, score double").repartition(6)
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "doc_id int, text string")
    got = importance.resample(docs, wanted, 2024, percent, n, buckets, 20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, target, 2024, percent, n, buckets, 20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "one two three " * 10)], "doc_id long, text string")
    assert importance.resample(none, one, 1).count() == 0
    row = importance.resample(one, none, 1, percent=100).first()
    assert row.n_features == 30 and row["rank"] == 1
    with pytest.raises(ValueError, match="one word or more"):
        importance.feature_counts(one, 0)
