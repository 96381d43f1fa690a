"""Hard negatives by a vertical scan (BOND: branch and bound on decomposed data).

Rows lie column by column. An anchor reads the dimensions in descending magnitude
of its own components and adds their contributions to the partial scores of its
candidates, a bitmap. What the dimensions not yet read can add lies between the sums of their smallest and
largest contributions (from the column's minimum and maximum), so a candidate is
dropped once its highest possible score is below the kth sure one or below its
window, or its lowest is above the window. What is left at the end is exact.

Two scans for each block of anchors (bounded in size): the first finds the best
rows of the anchor's label, its positives; the second finds, per positive, the best
rows of other labels whose score lies in the window the positive's score gives.
Spark merges the tasks' best.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; vectors of other lengths count as padded with zeros; rows
that repeat an id are rows of their own, only the anchor's own row is left out; a
null id comes last among ties. Scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import stored
from tabsight.llm.vectors import Best, chunks, exact, integer_vectors, matrix, numbers, query_blocks

#: Dimensions read between two tests of the bounds.
STEP = 8


def scan(anchor: np.ndarray, m: np.ndarray, least: np.ndarray, most: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, kth: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One anchor over the columns ``m`` (one row per dimension), whose smallest and
    largest values are ``least`` and ``most``. Window w takes scores from ``low[w]``
    to ``high[w]``; it has ``k`` candidates already where ``full[w]``, the last of
    them scoring ``kth[w]``. Returns what may still enter: window, row, score."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * least, anchor * most])[:, order]
    rest_low = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0)
    rest_high = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0)
    at = np.flatnonzero(alive)
    inside = np.ones((len(low), len(at)), bool)
    partial = np.zeros(len(at), m.dtype)
    floor = np.where(full, np.maximum(low, kth), low)
    for d in range(0, len(order) + 1, STEP):
        if d:
            dims = order[d - STEP : d]
            partial = partial + anchor[dims] @ m[dims][:, at]
        d = min(d, len(order))
        worst, top = partial + rest_low[d], partial + rest_high[d]
        inside &= (top >= floor[:, None]) & (worst <= high[:, None])
        for w in range(len(low)):
            sure = worst[inside[w] & (worst >= low[w]) & (top <= high[w])]
            if len(sure) >= k:
                floor[w] = max(floor[w], np.partition(sure, len(sure) - k)[len(sure) - k])
                inside[w] &= top >= floor[w]
        keep = inside.any(axis=0)
        if not keep.all():
            at, inside, partial = at[keep], inside[:, keep], partial[keep]
        if not len(at):
            break
    if len(order) % STEP and len(at):
        dims = order[len(order) - len(order) % STEP :]
        partial = partial + anchor[dims] @ m[dims][:, at]
        inside &= (partial >= floor[:, None]) & (partial <= high[:, None])
    window, b = np.nonzero(inside)
    return window, at[b], partial[b].astype(np.int64)


class Windows:
    """Windows of a block of anchors: anchor i has those from ``first[i]`` to
    ``first[i + 1]``, ``same`` tells whether they take rows of its label or of others."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.x, self.rows, self.labels, self.first, self.low, self.high, self.same, self.k = x, rows, labels, first, low, high, same, k

    def searcher(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(self.low), self.k)
            for batch, m in chunks(batches, self.x.shape[1]):
                ids, null = numbers(batch.column("id"))
                rows, labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
                x, m = exact(self.x, m)
                columns = np.ascontiguousarray(m.T)
                least, most = columns.min(axis=1), columns.max(axis=1)
                for i, anchor in enumerate(x):
                    own = slice(self.first[i], self.first[i + 1])
                    alive = (labels == self.labels[i]) == self.same
                    alive &= rows != self.rows[i]
                    kth, full = best.kth()
                    w, at, score = scan(anchor, columns, least, most, alive, self.low[own], self.high[own], self.k, kth[own], full[own])
                    best.add(own.start + w, score, null[at], ids[at])
            which, score, ids = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(which), ids, pa.array(score)], ["window", "id", "score"])

        return run

    def search(self, table: DataFrame) -> DataFrame:
        """The k best of each window: window, id, score, rank."""
        order = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = table.select("row", "id", "label", "x").mapInArrow(self.searcher(), "window long, id long, score long")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int, negatives: int, low: int, high: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256
) -> DataFrame:
    """For each row that ``anchors`` selects, its ``positives`` best rows of the same
    label, and for each of these the ``negatives`` best rows of other labels whose
    score is ``low`` to ``high`` percent of the positive's: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score."""
    table = integer_vectors(vectors.where(F.col(label).isNotNull()), F.col(vector), scale, "vectors", id=F.col(vec_id).cast("long"), label=F.col(label).cast("long"), anchor=F.coalesce(anchors, F.lit(False)))
    dims = table.agg(F.max(F.size("x"))).first()[0] or 0
    asked = table.where("anchor")
    found = []
    for block in query_blocks(asked, dims):
        rows = block.select("row", "id", "label", "x").toArrow()
        x, at, labels, ids = matrix(rows.column("x"), dims), rows.column("row").to_numpy(), rows.column("label").to_numpy(), rows.column("id").to_pylist()
        widest = np.full(len(x), 2**62)
        near = Windows(x, at, labels, np.arange(len(x) + 1), -widest, widest, True, positives).search(table)
        near = near.orderBy("window", "rank").toArrow()  # at most ``positives`` rows for an anchor of the block
        window, score = near.column("window").to_numpy(), near.column("score").to_numpy()
        first = np.searchsorted(window, np.arange(len(x) + 1))
        # 100 * s from low * p to high * p, for whole s.
        floor, ceiling = [-((-low * p) // 100) for p in score.tolist()], [(high * p) // 100 for p in score.tolist()]
        far = Windows(x, at, labels, first, np.array(floor, np.int64), np.array(ceiling, np.int64), False, negatives).search(table)
        pairs = [(i, ids[w], p, s) for i, (w, p, s) in enumerate(zip(window.tolist(), near.column("id").to_pylist(), score.tolist()))]
        pairs = vectors.sparkSession.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
        far = far.join(pairs, "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.append(stored(far, "hard-negatives"))
    if not found:
        none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], none)
    return reduce(DataFrame.unionAll, found)
