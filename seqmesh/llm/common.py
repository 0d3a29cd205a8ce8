"""What the operators share: bounded Arrow batches and column hygiene."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null read as empty; other columns, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def give_back() -> None:
    """Hand memory that is free but still held to the system; workers and drivers live long after their largest task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: A key with more than one in this many of all rows is hot, so there are fewer hot keys than this.
HOT = 1000


def join_whole(rows: DataFrame, whole: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` (``n`` of them, a written table) joined to ``whole``, a written table with one row for each key.

    Column ``often`` of ``whole`` says how many rows have the key. Hot keys, at most ``HOT``, are broadcast, so that
    their rows stay where they are; the others' rows meet by a shuffle.
    """
    often = F.col("often") > n // HOT
    hot, cold = F.broadcast(whole.where(often).drop("often")), whole.where(~often).drop("often")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)


_STATE: dict = {}


def state(key: tuple, make: Callable[[], object]):
    """What an operator keeps between the tasks of a Python worker: one operator's things at a time, so that they don't add up."""
    if key not in _STATE:
        _STATE.clear()
        give_back()
        _STATE[key] = make()
    return _STATE[key]


def slices(batches: Iterable[pa.RecordBatch], size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text; one long text is a slice of its own."""
    for b in batches:
        n = np.asarray(pc.binary_length(b.column(column)).fill_null(0), dtype=np.int64)
        cut = np.cumsum(n) // size
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(n)]
        for i, j in zip(edges, edges[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)
    give_back()


def texts(b: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in b.column(column).to_pylist()]
