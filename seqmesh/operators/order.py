"""Dense ordinals for rows in a stated order, without a window over all rows."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmesh.session import materialise

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """``df`` with column ``name``: 0, 1, ... in ascending order of ``keys``, which must tell rows apart.

    Rows are dealt to ranges and sorted there; the driver adds up one count for each range.
    """
    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    rows = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = list(itertools.accumulate((n for _, n in counts), initial=0))
    if not counts:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("_at")
    # one row a range: as many as tasks, a few bytes each
    base = df.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(counts, before, strict=False)], "_part long, _base long")
    held = rows.withColumn("_part", part).join(F.broadcast(base), "_part")
    return held.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(_ROW)).drop("_at", "_part", "_base")
