"""FASTA files as tables (idx, header, seq), and back.

A header line starts with ``>``; the lines up to the next one are joined. Blank lines count for nothing, records
without a sequence vanish and leave no gap in idx, text ahead of the first header is a record with null header, and
carriage returns are kept. The file is split at header lines, so a large one is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmesh.operators.order import numbered
from seqmesh.sources.text import records, write_ordered


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    rows = records(spark, path, "\n>")
    # only a file's first record still has its mark, or none if it starts without a header
    bare = F.col("first") & ~F.startswith("value", F.lit(">"))
    body = F.when(F.col("first") & ~bare, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    parts = rows.select("seq", bare.alias("bare"), body.alias("body")).withColumn("cut", F.instr("body", "\n"))
    header = F.when(F.col("bare"), F.lit(None).cast("string")).when(F.col("cut") == 0, F.col("body")).otherwise(F.substring_index("body", "\n", 1))
    rest = F.when(F.col("bare"), F.col("body")).when(F.col("cut") == 0, F.lit("")).otherwise(F.expr("substring(body, cut + 1)"))
    found = parts.select(F.col("seq").alias("at"), header.alias("header"), F.replace(rest, F.lit("\n"), F.lit("")).alias("seq")).where("seq <> ''")
    return numbered(found, ["at"]).select("idx", "header", "seq")


def fasta_record(header: Column, seq: Column, width: int = 70) -> Column:
    """A record's text: the header line and the sequence in lines of ``width``."""
    wrapped = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), F.coalesce(header, F.lit("")), F.lit("\n"), wrapped)


def write_fasta(seqs: DataFrame, path: str, width: int = 70) -> None:
    write_ordered(seqs.select("idx", fasta_record(F.col("header"), F.col("seq"), width).alias("line")), path, ["idx"])
