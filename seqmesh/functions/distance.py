"""Scalar functions: Hamming distance as column expressions, labels, weights, block ownership."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that one long of a bit plane holds.
PLANE = 60


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings of equal length differ; any alphabet. Unequal lengths raise an error, null gives null."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda z: z))
    return F.when(F.length(a) == F.length(b), differ).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("sequences of unequal length")).cast("int"))


def planes(seq: Column, length: int, alphabet: str) -> Column:
    """A string over at most four letters as an array of longs, two bit planes for every ``PLANE`` characters.

    Two characters differ where either plane does, so a distance is a population count. Other letters raise an error.
    """
    if not 1 <= len(alphabet) <= 4:
        raise ValueError("bit planes need an alphabet of one to four letters")
    low, high = ("".join(str(i >> k & 1) for i in range(len(alphabet))) for k in (0, 1))
    bits = [F.conv(F.substring(F.translate(seq, alphabet, digits), at + 1, PLANE), 2, 10).cast("long") for at in range(0, length, PLANE) for digits in (low, high)]
    strange = F.length(F.translate(seq, alphabet, "")) > 0
    checked = F.when(F.length(seq) != length, F.raise_error(F.lit("sequences of unequal length"))).when(strange, F.raise_error(F.lit(f"letters outside {alphabet}")))
    return F.when(checked.isNull(), F.array(*bits))


def code_planes(seq: Column, length: int, letters: str) -> Column:
    """The same for any number of ``letters``, which must be all that the strings have: as many planes as their codes have bits."""
    bits = plane_count(letters)
    digits = ["".join(str(i >> k & 1) for i in range(len(letters))) for k in range(bits)]
    return F.when(F.length(seq) == length, F.array(*[F.conv(F.substring(F.translate(seq, letters, d), at + 1, PLANE), 2, 10).cast("long") for at in range(0, length, PLANE) for d in digits]))


def plane_count(letters: str) -> int:
    return max(1, (len(letters) - 1).bit_length())


def plane_distance(a: Column, b: Column, length: int, planes: int = 2) -> Column:
    """The Hamming distance of two strings of ``length`` characters given as bit planes, so many for each ``PLANE`` characters."""
    differ = [functools.reduce(Column.bitwiseOR, [a[k].bitwiseXOR(b[k]) for k in range(at * planes, (at + 1) * planes)]) for at in range(-(-length // PLANE))]
    parts = [F.bit_count(x) for x in differ]
    return sum(parts[1:], parts[0]).cast("int") if parts else F.lit(0)


def vertex_name(idx: Column) -> Column:
    return F.concat(F.lit("A"), (idx + 1).cast("string"))


def leading_int(text: Column, what: Column) -> Column:
    """The integer at the start of a string, as C's stoi reads it; an error that names ``what`` if there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.raise_error(F.concat(F.lit("no integer weight on "), what)).cast("int")).otherwise(digits.cast("int"))


def block_owner(bi: Column, bj: Column, rows: int, cols: int) -> Column:
    """The process of a rows x cols grid that owns a block, dealt cyclically in both directions."""
    return (bi % rows) * cols + bj % cols


def initial_distance(i: Column, j: Column, weight: Column, zero_is_absent: bool = True) -> Column:
    """0 on the diagonal, else the edge's weight; null without an edge, and by default for weight 0 too."""
    absent = weight.isNull() | (weight == 0) if zero_is_absent else weight.isNull()
    return F.when(i == j, F.lit(0)).when(absent, F.lit(None).cast("int")).otherwise(weight)


def capped(d: Column, cap: int) -> Column:
    """A distance as clustering counts it: unreachable or beyond the cap is the cap."""
    return F.least(F.coalesce(d, F.lit(cap)), F.lit(cap))
