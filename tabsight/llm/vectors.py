"""What the vector searches share: vectors as integers, blocks of queries of a
bounded size, and matrices of the rows a task reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored

#: Components of a block of queries that goes to the tasks (8 MB of integers).
BLOCK_VALUES = 1 << 20
#: Rows that a task scans at once.
CHUNK = 4096


def integer_vectors(df: DataFrame, vector: Column, scale: int, name: str, **columns: Column) -> DataFrame:
    """Rows whose ``vector`` is neither null nor holds a null or non-finite component:
    ``row`` (a number of their own), ``columns``, and ``x``, the vector's components
    times ``scale`` rounded down to whole numbers. Written once."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    rows = df.where(vector.isNotNull() & ok).select(F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in columns.items()], whole.alias("x"))
    return stored(rows, name)


def query_blocks(queries: DataFrame, dims: int) -> list[DataFrame]:
    """``queries`` cut into ranges of row numbers with at most ``BLOCK_VALUES``
    components each, from the row counts of the files (one number per file)."""
    most, cuts = max(1, BLOCK_VALUES // max(1, dims)), []
    numbered = queries.select("row", F.shiftright("row", 33).alias("part"))
    parts = numbered.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi")).orderBy("part").collect()
    room = 0
    for p in parts:
        # A file's queries are spread over its row numbers: cut at even steps, then
        # halve a step that holds too many.
        spans = [(p["lo"], p["hi"] + 1, p["n"])]
        while spans:
            lo, hi, n = spans.pop(0)
            if n > most:
                mid = (lo + hi) // 2
                left = queries.where((F.col("row") >= lo) & (F.col("row") < mid)).count()
                spans[:0] = [(lo, mid, left), (mid, hi, n - left)]
            elif n:
                if n > room:
                    cuts.append([lo, hi])
                    room = most
                cuts[-1][1] = hi
                room -= n
    return [queries.where((F.col("row") >= lo) & (F.col("row") < hi)) for lo, hi in cuts]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` integers; missing components are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a task, ``CHUNK`` at most at a time, with their matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, matrix(part.column("x"), dims)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A long column as values (0 for null) and a mask of its nulls."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def exact(m: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 where their inner products are exact in it (floats multiply
    faster), else unchanged: products of longs, exact while they fit a long."""
    top = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
    small = top(m) * top(other) * max(1, m.shape[-1]) < 2.0**52
    return (m.astype(np.float64), other.astype(np.float64)) if small else (m, other)


class Best:
    """The ``k`` best candidates of each of ``n`` lists: highest score first, then
    smallest id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.count = np.zeros(n, np.int64)
        self.score = np.zeros((n, k), np.int64)
        self.null = np.zeros((n, k), bool)
        self.id = np.zeros((n, k), np.int64)

    def kth(self) -> tuple[np.ndarray, np.ndarray]:
        """The kth scores, and where there is one."""
        return self.score[:, -1], self.count == self.k

    def add(self, which: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """Candidate i goes to list ``which[i]``."""
        if not len(which):
            return
        old = np.unique(which)
        a, b = np.nonzero(np.arange(self.k) < self.count[old][:, None])
        which = np.concatenate([which, old[a]])
        score, null, ids = np.concatenate([score, self.score[old[a], b]]), np.concatenate([null, self.null[old[a], b]]), np.concatenate([ids, self.id[old[a], b]])
        order = np.lexsort((ids, null, -score, which))
        which = which[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        order, which, rank = order[rank < self.k], which[rank < self.k], rank[rank < self.k]
        self.score[which, rank], self.null[which, rank], self.id[which, rank] = score[order], null[order], ids[order]
        self.count[old] = np.bincount(which, minlength=len(self.count))[old]

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """List number, score and id of everything kept."""
        a, b = np.nonzero(np.arange(self.k) < self.count[:, None])
        return a, self.score[a, b], pa.array(self.id[a, b], mask=self.null[a, b])
