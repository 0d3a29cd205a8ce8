"""Distances, graphs, paths, medoids against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmesh.functions.distance import hamming, leading_int
from seqmesh.operators import graph, medoids, pairs, paths
from seqmesh.operators.order import numbered
from seqmesh.plans.pipeline import cluster_sequences

INF = paths.INF


def seqs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "idx long, seq string")


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight int")


def floyd(n, rows, zero=False):
    m = np.full((n, n), INF, dtype=np.int64)
    for a, b, w in rows:
        if a != b and (w or zero):
            m[a, b] = m[b, a] = w
    np.fill_diagonal(m, 0)
    for k in range(n):
        m = np.minimum(m, m[:, k, None] + m[k])
    return np.where(m >= INF, INF, m)


def dense(df, n):
    m = np.full((n, n), -1, dtype=np.int64)
    for r in df.collect():
        m[r.i, r.j] = INF if r.d is None else r.d
    return m


def test_hamming_pairs_three_ways(spark):
    r = random.Random(1)
    rows = ["".join(r.choice("ACGT") for _ in range(130)) for _ in range(40)]
    want = sorted((i, j, sum(a != b for a, b in zip(rows[i], rows[j], strict=True))) for i in range(40) for j in range(i + 1, 40))
    for alphabet, size in (("ACGT", 1 << 20), ("ACGT", 1000), (None, 1 << 20), (None, 1000)):
        assert sorted(map(tuple, pairs.pairwise_hamming(seqs(spark, rows), alphabet, broadcast_bytes=size).collect())) == want
    below = sorted(map(tuple, pairs.threshold_graph(seqs(spark, rows), 95).collect()))
    assert below == [x for x in want if x[2] < 95]


def test_pairs_in_chunks_and_of_many_letters(spark, monkeypatch):
    """Pairs come as runs of one i with few j, also those of any alphabet, which are compared by bits, not letter by letter."""
    monkeypatch.setattr(pairs, "CHUNK", 8)
    r = random.Random(2)
    rows = ["".join(r.choice("01xyzé😀\\-^") for _ in range(130)) for _ in range(70)] + ["0" * 130] * 2
    want = sorted((i, j, sum(a != b for a, b in zip(rows[i], rows[j], strict=True))) for i in range(72) for j in range(i + 1, 72))
    found = pairs.pairwise_hamming(seqs(spark, rows).coalesce(1), None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "Sort [chunk" in plan
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(pairs, "LETTERS", 3)
    assert sorted(map(tuple, pairs.pairwise_hamming(seqs(spark, rows), None).collect())) == want


def test_unequal_lengths_and_letters(spark):
    with pytest.raises(ValueError, match="unequal length"):
        pairs.pairwise_hamming(seqs(spark, ["AC", "A"]))
    with pytest.raises(Exception, match="letters outside"):
        pairs.pairwise_hamming(seqs(spark, ["AC", "AN"])).collect()
    with pytest.raises(Exception, match="unequal length"):
        spark.range(1).select(hamming(F.lit("ab"), F.lit("abc"))).collect()
    assert pairs.pairwise_hamming(seqs(spark, [])).count() == 0


def test_hamming_of_wide_characters(spark):
    assert pairs.pairwise_hamming(seqs(spark, ["aé😀", "ae😀"]), None).first().d == 1


def test_numbering(spark):
    df = spark.createDataFrame([(x,) for x in "qwertyuiopasdfghjkl"], "name string").repartition(5)
    assert [r.name for r in numbered(df, ["name"]).orderBy("idx").collect()] == sorted("qwertyuiopasdfghjkl")
    assert numbered(df.limit(0), ["name"]).count() == 0


def test_leading_int(spark):
    got = spark.createDataFrame([("3.7",), (" -2x",), ("+5",)], "s string").select(leading_int(F.col("s"), F.lit("e"))).collect()
    assert [r[0] for r in got] == [3, -2, 5]
    for bad in ("", "x1", None):
        with pytest.raises(Exception, match="no integer weight on e"):
            spark.createDataFrame([(bad,)], "s string").select(leading_int(F.col("s"), F.lit("e"))).collect()


def test_zero_weight_loops_negative_parallel(spark):
    rows = [(0, 1, 0), (1, 2, 3), (2, 2, 9)]
    v = spark.range(3).withColumnRenamed("id", "idx")
    assert (dense(paths.shortest_paths(v, edges_of(spark, rows)), 3) == floyd(3, rows)).all()
    assert (dense(paths.shortest_paths(v, edges_of(spark, rows), zero_weight="edge"), 3) == floyd(3, rows, True)).all()
    with pytest.raises(Exception, match="negative weight"):
        paths.shortest_paths(v, edges_of(spark, [(0, 1, -1)])).collect()
    many = spark.createDataFrame([(0, 1, 5, 1), (1, 0, 9, 2), (0, 1, 7, 3)], "src long, dst long, weight int, at int")
    assert [tuple(r) for r in graph.last_wins(many, ["at"]).collect()] == [(0, 1, 7)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 45
    rows = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.randint(1, 50)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(60))}.values())
    v = spark.range(n).withColumnRenamed("id", "idx")
    want = floyd(n, rows)
    for strategy, strip in (("relational", 0), ("strips", 7), ("strips", 512)):
        got = dense(paths.shortest_paths(v, edges_of(spark, rows), strategy, strip=strip), n)
        assert (got == want).all()
    assert (want == want.T).all()


def test_path_sums_beyond_the_bound(spark):
    rows = [(0, 1, 600_000_000), (1, 2, 600_000_000)]
    v = spark.range(3).withColumnRenamed("id", "idx")
    for strategy in ("relational", "strips"):
        assert dense(paths.shortest_paths(v, edges_of(spark, rows), strategy), 3)[0, 2] == INF


def test_no_vertices_no_edges(spark):
    v = spark.range(0).withColumnRenamed("id", "idx")
    assert paths.shortest_paths(v, edges_of(spark, [])).count() == 0
    two = spark.range(2).withColumnRenamed("id", "idx")
    for strategy in ("relational", "strips"):
        assert dense(paths.shortest_paths(two, edges_of(spark, []), strategy), 2).tolist() == [[0, INF], [INF, 0]]
    assert medoids.k_medoids(spark.createDataFrame([], "i long, j long, d int")).medoids == []


def brute(m, k, init, cap=100_000):
    c = np.minimum(m, cap)
    med, n = list(init), len(m)
    cost = c[:, med].min(axis=1).sum()
    while True:
        best = (cost, None, None)
        for s in range(k):
            for h in range(n):
                if h not in med:
                    new = c[:, [h if x == s else med[x] for x in range(k)]].min(axis=1).sum()
                    if new < best[0]:
                        best = (new, s, h)
        if best[1] is None:
            return med, int(cost)
        cost, med[best[1]] = best[0], best[2]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_medoids_with_ties_asymmetry_and_gaps(spark, k):
    r = np.random.default_rng(k)
    m = r.integers(0, 6, (14, 14))
    m[r.random((14, 14)) < 0.15] = INF
    np.fill_diagonal(m, 0)
    rows = [(i, j, None if m[i, j] == INF else int(m[i, j])) for i in range(14) for j in range(14)]
    dist = spark.createDataFrame(rows, "i long, j long, d int")
    found = medoids.k_medoids(dist, k, list(range(k)))
    assert (found.medoids, found.total_cost) == brute(m, k, range(k))
    c = np.minimum(m, 100_000)[:, found.medoids]
    for row in found.assignment.collect():
        assert row.dist == c[row.vertex].min()
        assert row.cluster == (int(c[row.vertex].argmin()) if row.dist < 100_000 else 0)
        assert row.medoid == found.medoids[row.cluster]


def test_medoid_arguments(spark):
    dist = spark.createDataFrame([(i, j, abs(i - j)) for i in range(5) for j in range(5)], "i long, j long, d int")
    with pytest.raises(ValueError, match="k is 6"):
        medoids.k_medoids(dist, 6)
    with pytest.raises(ValueError, match="different"):
        medoids.k_medoids(dist, 2, [1, 1])
    with pytest.raises(ValueError, match="must be vertices"):
        medoids.k_medoids(dist, 2, [1, 77])
    assert medoids.k_medoids(dist, 2, seed=3).medoids == medoids.k_medoids(dist, 2, seed=3).medoids
    assert medoids.k_medoids(dist, 5, seed=3).total_cost == 0


def test_pipeline_duplicates_are_not_adjacent(spark):
    rows = ["AAAAAAAA", "AAAAAAAA", "AAAAAAAT", "TTTTTTTT"]
    run = cluster_sequences(seqs(spark, rows), epsilon=4, k=2, init=[0, 3])
    got = {(r.i, r.j): r.d for r in run.distances.collect()}
    assert got[0, 1] == 2 and got[0, 2] == 1 and got[0, 3] is None
    assert run.report["edges"] == 3 and run.report["total_cost"] == 2


def test_degrees_and_isolated(spark):
    v = spark.range(4).withColumnRenamed("id", "idx")
    e = edges_of(spark, [(0, 1, 1), (1, 2, 1)])
    assert sorted(map(tuple, graph.degrees(v, e).collect())) == [(0, 1), (1, 2), (2, 1), (3, 0)]
    assert [r.idx for r in graph.isolated(v, e).collect()] == [3]


def test_blocks_of_pairs_are_met_as_arrays(spark, monkeypatch):
    """However small a broadcast may be, a sequence is sent to as many buckets as there are blocks of sequences; nulls stay."""
    r = random.Random(5)
    rows = [(7 * k - 900, "".join(r.choice("ACGT") for _ in range(130))) for k in range(300)] + [(5, None)]
    want = sorted((a, b, None if x is None or y is None else sum(p != q for p, q in zip(x, y, strict=True))) for (a, x), (b, y) in itertools.combinations(sorted(rows), 2))
    for block, bound in ((50, None), (50, 95), (1000, None)):
        monkeypatch.setattr(pairs, "BLOCK", block)
        found = pairs.pairwise_hamming(spark.createDataFrame(rows, "idx long, seq string"), "ACGT", bound, 64)
        got = [tuple(x) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if bound is None or w[2] is not None and w[2] < bound}
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_min_plus_by_blocks(spark, monkeypatch):
    """Blocks of the result give what the join gives: repeated pairs, nulls, distances from INF on, ids from below 0."""
    r = random.Random(4)
    ends = [r.randrange(-50, 60) for _ in range(40)]
    tables = [spark.createDataFrame([(r.choice(ends), r.choice(ends), r.choice([None, 0, 5, 17, 999_999_990, 1_500_000_000])) for _ in range(600)], "i long, j long, d int") for _ in range(2)]
    want = sorted(map(tuple, paths.min_plus(*tables).collect()))
    shuffled = []
    found = paths.products.by_blocks
    monkeypatch.setattr(paths.products, "by_blocks", lambda *a: shuffled.append(a) or found(*a, side=16))
    monkeypatch.setattr(paths, "PRODUCTS", 0)
    assert sorted(map(tuple, paths.min_plus(*tables).collect())) == want and shuffled and len(want) > 500
