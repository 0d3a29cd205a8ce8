"""Connected components of a link table of any size, by alternating stars.

Each round sends every node's larger neighbours to its smallest one and then all to the smallest; links end as stars
whose centre is the component's smallest node. Rounds grow with the logarithm of the longest path. Minima are
pre-aggregated by the larger end, where keys are rarely hot; links are joined to them by sort-merge joins whose hot
keys (centres of large stars) adaptive execution splits. Each step is a written table, so that no lineage grows and
nothing is collected; a round's tables are deleted when the next one's are written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.session import discard, materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links within one task, without the smallest themselves."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(up, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (up[up] != up).any():
            up = up[up]
    moved = up != np.arange(len(nodes))
    return nodes[moved], nodes[up[moved]]


def _least(links: DataFrame) -> DataFrame:
    """(x, m): the smallest neighbour below x. Written, so that joins with it are dealt anew and hot keys can be split."""
    return materialise(links.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")), "least")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the root is the component's smallest node; only nodes that have a link, roots included.

    ``links`` has long columns a and b, in any order, repeats allowed. Null ends and loops link nothing. A link is
    held as (larger, smaller) throughout.
    """
    now = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialise(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark.n:
            break
        before = mark
        # large star: what hangs on b moves to the smallest neighbour of b, if b has one below it
        least = _least(now)
        moved = now.join(least, now["b"] == F.col("x"), "left").select("a", F.coalesce("m", "b").alias("b"))
        large = materialise(moved.distinct(), "links")
        # small star: of the neighbours below a, and a itself, all but the smallest move to the smallest
        lower = _least(large)
        small = large.join(lower, large["a"] == F.col("x"))
        down = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        new = materialise(down.where("a != b").distinct(), "links")
        for gone in (now, least, large, lower):
            discard(gone)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
