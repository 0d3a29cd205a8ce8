"""Weighted undirected graphs as tables: vertices (idx, name) and edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.operators.order import numbered
from seqmesh.session import materialise


def last_wins(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each unordered pair: the last in ``order``. Hot pairs are reduced before the shuffle."""
    pair = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    last = pair.groupBy("a", "b").agg(F.max(F.struct(*order, "weight")).alias("w"))
    return last.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w.weight").alias("weight"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; loops once."""
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(back)


def usable(edges: DataFrame, zero_weight: str = "absent") -> DataFrame:
    """Edges as paths see them, both ways: without loops, and by default without weight 0. Negative weights are an error."""
    if zero_weight not in ("absent", "edge"):
        raise ValueError("zero_weight is 'absent' or 'edge'")
    weight = F.when(F.col("weight") < 0, F.raise_error(F.concat(F.lit("negative weight on "), F.col("src").cast("string"), F.lit(" -- "), F.col("dst").cast("string"))).cast("int")).otherwise(F.col("weight"))
    checked = edges.where("src <> dst").withColumn("weight", weight)
    return symmetrised(checked.where("weight > 0" if zero_weight == "absent" else "weight >= 0"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, degree) of every vertex, 0 for isolated ones."""
    ends = symmetrised(edges).groupBy(F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.join(ends, "idx", "left").select("idx", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = symmetrised(edges).select(F.col("src").alias("idx"))
    return vertices.join(ends, "idx", "left_anti").select("idx")


def on_ordinals(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between ordinals, names (idx, at)) of vertices of any ids, numbered in their order."""
    names = materialise(numbered(vertices.select("idx"), ["idx"], "at"), "ordinals")
    a, b = (names.withColumnsRenamed({"idx": x, "at": f"{x}_at"}) for x in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("src_at").alias("src"), F.col("dst_at").alias("dst"), "weight"), names
