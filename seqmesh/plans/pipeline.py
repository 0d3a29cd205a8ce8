"""The whole chain: sequences, threshold graph, shortest paths, medoids; and each stage from file to file."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqmesh.operators import strip_medoids
from seqmesh.operators.medoids import CAP, Clustering
from seqmesh.operators.pairs import sequence_length, threshold_graph
from seqmesh.operators.paths import path_strips
from seqmesh.session import materialise
from seqmesh.sources.clustering import write_clustering
from seqmesh.sources.dot import graph_of, read_dot, write_dot
from seqmesh.sources.fasta import read_fasta
from seqmesh.sources.matrix import read_matrix, write_strips


@dataclass
class Run:
    """The tables of a run and what a report needs: sizes, cost, medoids, medoids and cost of each pass, seconds by stage."""

    edges: DataFrame
    distances: DataFrame
    clustering: Clustering
    report: dict


def cluster_sequences(seqs: DataFrame, epsilon: int = 70, k: int = 4, init: list[int] | None = None, seed: int = 0, cap: int = CAP, zero_weight: str = "absent", alphabet: str | None = "ACGT") -> Run:
    """Cluster ``seqs`` (idx 0..n-1, seq) of equal length by path distance in the graph of pairs below ``epsilon``."""
    clock = [time.perf_counter()]

    def lap() -> float:
        clock.append(time.perf_counter())
        return round(clock[-1] - clock[-2], 3)

    n, length = sequence_length(seqs)
    # counted as they are written, not by another job
    seen = Observation("edges")
    edges = materialise(threshold_graph(seqs, epsilon, alphabet).observe(seen, F.count(F.lit(1)).alias("edges")), "edges")
    report = {"n": n, "length": length, **seen.get, "graph_s": lap()}
    strips = path_strips(seqs.select("idx"), edges, zero_weight)
    report["paths_s"] = lap()
    found = strip_medoids.k_medoids(strips, k, init, seed, cap)
    report |= {"medoids": found.medoids, "total_cost": found.total_cost, "passes": len(found.history), "history": found.history, "medoids_s": lap()}
    return Run(edges, strips.long(), found, report)


def fasta_to_dot(spark: SparkSession, fasta: str, dot: str, epsilon: int = 70) -> dict:
    began = time.perf_counter()
    seqs = materialise(read_fasta(spark, fasta), "sequences")
    n, length = sequence_length(seqs)
    if not n:
        raise ValueError(f"no sequences in {fasta}")
    edges = threshold_graph(seqs, epsilon, None if seqs.where("seq rlike '[^ACGT]'").limit(1).count() else "ACGT")
    write_dot(seqs, edges, dot)
    return {"n": n, "length": length, "seconds": round(time.perf_counter() - began, 3)}


def dot_to_matrix(spark: SparkSession, dot: str, matrix: str, zero_weight: str = "absent") -> dict:
    began = time.perf_counter()
    vertices, edges = graph_of(*read_dot(spark, dot))
    strips = path_strips(vertices, edges, zero_weight)
    write_strips(strips, matrix)
    return {"vertices": strips.n, "seconds": round(time.perf_counter() - began, 3)}


def matrix_to_clusters(spark: SparkSession, matrix: str, out: str, k: int = 4, init: list[int] | None = None, seed: int = 0) -> dict:
    began = time.perf_counter()
    found = strip_medoids.k_medoids(strip_medoids.of_long(read_matrix(spark, matrix)), k, init, seed)
    write_clustering(found, out)
    return {"medoids": found.medoids, "total_cost": found.total_cost, "history": found.history, "seconds": round(time.perf_counter() - began, 3)}
