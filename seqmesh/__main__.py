"""python -m seqmesh graph|paths|medoids|run IN OUT: the stages from file to file, or all of them."""

from __future__ import annotations

import argparse
import json

from seqmesh.plans import pipeline
from seqmesh.session import local_session


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="seqmesh", description=__doc__)
    p.add_argument("stage", choices=["graph", "paths", "medoids", "run"])
    p.add_argument("source")
    p.add_argument("target", help="the output file; for run a prefix of three files")
    p.add_argument("--epsilon", type=int, default=70)
    p.add_argument("--k", type=int, default=4)
    p.add_argument("--init", type=int, nargs="*")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--zero-weight", choices=["absent", "edge"], default="absent")
    p.add_argument("--cores", type=int, default=8)
    a = p.parse_args(args)
    spark = local_session(a.cores)
    if a.stage == "graph":
        out = pipeline.fasta_to_dot(spark, a.source, a.target, a.epsilon)
    elif a.stage == "paths":
        out = pipeline.dot_to_matrix(spark, a.source, a.target, a.zero_weight)
    elif a.stage == "medoids":
        out = pipeline.matrix_to_clusters(spark, a.source, a.target, a.k, a.init, a.seed)
    else:
        dot, matrix, result = (f"{a.target}.{x}" for x in ("dot", "matrix.txt", "clusters.txt"))
        out = {"graph": pipeline.fasta_to_dot(spark, a.source, dot, a.epsilon), "paths": pipeline.dot_to_matrix(spark, dot, matrix, a.zero_weight), "medoids": pipeline.matrix_to_clusters(spark, matrix, result, a.k, a.init, a.seed)}
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
