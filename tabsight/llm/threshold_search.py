"""Exact top-k search by inner product: Fagin's threshold algorithm.

Each task sorts every dimension of the rows it holds into a list. A query walks
all lists in step, from the end where its own component makes the largest
contributions; a row met in any list is scored in full. After each step the bound is the
sum of the contributions at the places reached: no unseen row can score more. The
walk stops when the bound is below the kth score found so far, including that of
earlier rows of the task. Queries go to the tasks in blocks of bounded size, one
block at a time; Spark merges the tasks' k best of each query.

Defined results: rows with a null vector or a null or non-finite component take no
part; vectors of other lengths count as padded with zeros; a query excludes its own
row only, so rows that repeat an id are candidates and queries of their own; a null
id comes last among ties. Scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import stored
from tabsight.llm.vectors import Best, chunks, exact, integer_vectors, matrix, numbers, query_blocks

#: Queries that walk the lists together.
GROUP = 64
#: Places read from each list before the first test of the bound; each later step reads twice as many.
FIRST = 8


def walk(q: np.ndarray, q_rows: np.ndarray, m: np.ndarray, rows: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best, offset: int) -> int:
    """Adds to ``best`` what the queries ``q`` (lists ``offset`` and on) find in ``m``.
    Returns how many rows were scored in full, over all queries."""
    up = np.argsort(m, axis=0, kind="stable")
    values = np.take_along_axis(m, up, axis=0)
    fq, fm = exact(q, m)
    high, low = np.maximum(q, 0), np.minimum(q, 0)
    place = {r: i for i, r in enumerate(rows.tolist())}
    scored = 0
    for g in range(0, len(q), GROUP):
        own = np.array([place.get(r, -1) for r in q_rows[g : g + GROUP].tolist()])
        seen = np.zeros((len(own), len(m)), bool)
        seen[own >= 0, own[own >= 0]] = True  # a query does not find its own row
        active, at, step = np.arange(len(own)), 0, FIRST
        while len(active):
            before, end = seen[active], min(at + step, len(m))
            for d in range(m.shape[1]):
                sign = q[g + active, d]
                seen[np.ix_(active[sign > 0], up[len(m) - end : len(m) - at, d])] = True
                seen[np.ix_(active[sign < 0], up[at:end, d])] = True
            if end == len(m):
                seen[active] = True  # also rows that only lists of zero weight hold
            new = seen[active] & ~before
            some = np.flatnonzero(new.any(axis=0))
            score = fq[g + active] @ fm[some].T
            new = new[:, some]
            scored += int(new.sum())
            last, full = best.kth()
            last, full = last[offset + g + active], full[offset + g + active]
            a, b = np.nonzero(new & (~full[:, None] | (score >= last[:, None])))
            best.add(offset + g + active[a], score[a, b].astype(np.int64), null[some[b]], ids[some[b]])
            if end == len(m):
                break
            # Contributions at the places reached; places of weight zero add nothing.
            bound = high[g + active] @ values[len(m) - end] + low[g + active] @ values[end - 1]
            last, full = best.kth()
            active = active[~(full[offset + g + active] & (bound < last[offset + g + active]))]
            at, step = end, 2 * step
    return scored


def top_k(vectors: DataFrame, queries: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For each row that ``queries`` selects, the ``k`` other rows with the highest
    integer inner product: query_id, rank, vec_id, score."""
    table = integer_vectors(vectors, F.col(vector), scale, "vectors", id=F.col(vec_id).cast("long"), query=F.coalesce(queries, F.lit(False)))
    dims = table.agg(F.max(F.size("x"))).first()[0] or 0
    asked = table.where("query")
    found = []
    for block in query_blocks(asked, dims):
        rows = block.select("row", "id", "x").toArrow()
        q, q_rows, q_ids = matrix(rows.column("x"), dims), rows.column("row").to_numpy(), rows.column("id").combine_chunks()
        found.append(stored(table.select("row", "id", "x").mapInArrow(_searcher(q, q_rows, q_ids, k), "query_row long, query_id long, vec_id long, score long"), "top-k"))
    if not found:
        return table.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("row").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    merged = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def _searcher(q: np.ndarray, q_rows: np.ndarray, q_ids: pa.Array, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(q), k)
        for batch, m in chunks(batches, q.shape[1]):
            ids, null = numbers(batch.column("id"))
            walk(q, q_rows, m, batch.column("row").to_numpy(), ids, null, best, 0)
        which, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q_rows[which]), q_ids.take(pa.array(which)), ids, pa.array(score)], ["query_row", "query_id", "vec_id", "score"])

    return run
