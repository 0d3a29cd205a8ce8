"""The whole chain on a set of sequences made here, from file to file, against plain loops."""

import os
import random

import pytest

from seqmesh.operators.medoids import random_medoids
from seqmesh.plans.pipeline import cluster_sequences, dot_to_matrix, fasta_to_dot, matrix_to_clusters
from seqmesh.sources.clustering import read_clustering
from seqmesh.sources.fasta import read_fasta
from seqmesh.sources.matrix import read_matrix

N, LENGTH, EPSILON, K, CAP = 90, 60, 34, 4, 100_000


def sequences():
    """Five families around random centres, and a few strangers."""
    r = random.Random(17)
    centres = ["".join(r.choice("ACGT") for _ in range(LENGTH)) for _ in range(5)]
    out = []
    for i in range(N):
        s = list(centres[i % 5] if i % 11 else "".join(r.choice("ACGT") for _ in range(LENGTH)))
        for _ in range(r.randrange(28)):
            s[r.randrange(LENGTH)] = r.choice("ACGT")
        out.append("".join(s))
    return out


def plain(seqs, init):
    """(edges, distances, medoids, cost) by loops."""
    far = 10**9
    edges = {(i, j): d for i in range(N) for j in range(i + 1, N) if (d := sum(a != b for a, b in zip(seqs[i], seqs[j], strict=True))) < EPSILON}
    d = [[0 if i == j else edges.get((min(i, j), max(i, j)), far) or far for j in range(N)] for i in range(N)]
    for k in range(N):
        for i in range(N):
            for j in range(N):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    cost = lambda m: sum(min(CAP, *(d[i][x] for x in m)) for i in range(N))
    medoids, now = list(init), cost(init)
    while True:
        best = min((cost([*medoids[:m], h, *medoids[m + 1 :]]), m, h) for m in range(K) for h in range(N) if h not in medoids)
        if best[0] >= now:
            return edges, d, medoids, now
        now, medoids[best[1]] = best[0], best[2]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder, seqs = tmp_path_factory.mktemp("golden"), sequences()
    (folder / "set.fa").write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(seqs)))
    return folder, seqs


def test_chain(spark, made):
    folder, seqs = made
    edges, d, medoids, cost = plain(seqs, [0, 1, 2, 3])
    run = cluster_sequences(read_fasta(spark, str(folder / "set.fa")), EPSILON, K, [0, 1, 2, 3])
    assert {(r.src, r.dst): r.weight for r in run.edges.collect()} == edges and run.report["edges"] == len(edges)
    assert all(r.d == (d[r.i][r.j] if d[r.i][r.j] < 10**9 else None) for r in run.distances.collect())
    assert (run.clustering.medoids, run.clustering.total_cost) == (medoids, cost)


def test_stages_from_file_to_file(spark, made):
    folder, seqs = made
    path = lambda name: str(folder / name)
    assert fasta_to_dot(spark, path("set.fa"), path("g.dot"), EPSILON)["n"] == N
    assert dot_to_matrix(spark, path("g.dot"), path("m.txt"))["vertices"] == N
    start = random_medoids(read_matrix(spark, path("m.txt")), K, 3)
    _, d, medoids, cost = plain(seqs, start)
    got = matrix_to_clusters(spark, path("m.txt"), path("c.txt"), K, seed=3)
    assert (got["medoids"], got["total_cost"]) == (medoids, cost)
    back, rows, total = read_clustering(spark, path("c.txt"))
    assert back == medoids and total == cost
    for r in rows.collect():
        near = [min(CAP, d[r.vertex][m]) for m in medoids]
        assert (r.cluster, r.medoid, r.dist) == (near.index(min(near)), medoids[near.index(min(near))], min(near))


EXAMPLE = [os.environ.get(x, "") for x in ("SEQMESH_EXAMPLE_FASTA", "SEQMESH_EXAMPLE_RESULT")]


@pytest.mark.skipif(not all(map(os.path.isfile, EXAMPLE)), reason="a published set of sequences and its result, as two paths")
def test_published_example(spark):
    """Threshold 70 and four medoids from the first four sequences end at the published medoids, cost and assignment."""
    run = cluster_sequences(read_fasta(spark, EXAMPLE[0]).select("idx", "seq"), 70, 4, [0, 1, 2, 3])
    medoids, rows, cost = read_clustering(spark, EXAMPLE[1])
    assert run.clustering.total_cost == cost and sorted(run.clustering.medoids) == sorted(medoids)
    # slots are numbered by the start, and ties go to the lowest slot, so a vertex is compared by its distance
    assert sorted((r.vertex, r.dist) for r in run.clustering.assignment.collect()) == sorted((r.vertex, r.dist) for r in rows.collect())
