"""Per-key folds over a stream in event-time order.

A stream's files bring a user's events in any order. ``InOrder`` holds them in
state, cut into slices of event time, and releases a slice in ``(ts, seq)`` order
once the watermark has passed its end (an event-time timer per slice). What a fold
then sees is the batch order, however the rows were spread over micro-batches.

State per key: its held rows in pieces, each sorted (``MapState``), with the slices that
a piece spans (``MapState`` of keys alone); the end of the last released slice; and the
fold's own state. A micro-batch's rows arrive as a sequence of frames and go to state
frame by frame. A piece is one slice's rows, ``CHUNK`` at most, or several whole slices
with ``SMALL`` rows at most together: a call to the state costs far more than a row, and
most keys have few rows in a slice. One timer is set, for a key's earliest slice. At
release pieces are loaded when the merge reaches their first slice, and the fold's rows
leave in frames of at most ``CHUNK`` rows. No frame ever holds a key's whole input.

A row of a slice that has been released is late: it changes nothing, and leaves by
itself with its columns under ``late_...``. The watermark's own column is dropped
before the operator, or Spark would discard such rows without a trace. Rows
without a time have no place in the order and are not taken.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a piece of state and of an output frame, and of a piece of several slices.
CHUNK, SMALL = 10_000, 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What happens to one key's rows in order. ``columns`` of the input are passed as
    a tuple; ``step`` returns the output rows (without the key)."""

    columns: dict[str, str] = {}
    output: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self) -> None:
        """Called before the first step of a release."""

    def step(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def save(self) -> None:
        """Called after the last step of a release."""


def _place(row: tuple) -> tuple:
    """Order of a row; without a ``seq`` it is the last of its time."""
    return row[0], row[1] is None, row[1] or 0


class InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, key: str, slice_ms: int, chunk: int = CHUNK):
        self.fold, self.key, self.slice_ms, self.chunk = fold, key, slice_ms, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{c} array<{t}>" for c, t in self.fold.columns.items())
        self.slices = handle.getMapState("slices", "piece int, first bigint, last bigint", "rows int")
        self.held = handle.getMapState("held", "piece int", arrays)
        self.released = handle.getValueState("released", "ts bigint")
        self.fold.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = self.released.get()
        index = self._index()
        before = min((first for first, _, _ in index), default=None)
        for frame in rows:
            frame = frame[list(self.fold.columns)].sort_values(["ts", "seq"], kind="stable")
            if end is not None:
                late, frame = frame[frame["ts"] < end[0]], frame[frame["ts"] >= end[0]]
                if len(late):
                    yield self._late(key[0], late)
            columns = [[None if pd.isna(v) else v for v in frame[c].tolist()] for c in self.fold.columns]
            index += self._hold(columns, max((piece for _, piece, _ in index), default=-1) + 1)
        self._set_timer(index, before)

    def _index(self) -> list[tuple[int, int, int]]:
        """Of each piece its first slice, its number, and its last slice."""
        return sorted((first, piece, last) for piece, first, last in list(self.slices.keys()))

    def _set_timer(self, index: list[tuple[int, int, int]], before: int | None) -> None:
        earliest = min((first for first, _, _ in index), default=None)
        if earliest is not None and (before is None or earliest < before):
            self.handle.registerTimer((earliest + 1) * self.slice_ms)

    def _hold(self, columns: list[list], piece: int) -> list[tuple[int, int, int]]:
        """Sorted rows go to state in pieces, numbered from ``piece``."""
        numbers = [int(ts // self.slice_ms) for ts in columns[0]]
        ends = [i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1]] + [len(numbers)]
        added, a, k = [], 0, 0
        while a < len(numbers):
            while k + 1 < len(ends) and ends[k + 1] - a <= SMALL:
                k += 1
            for i in range(a, ends[k], self.chunk):
                j = min(i + self.chunk, ends[k])
                self.held.updateValue((piece,), tuple(c[i:j] for c in columns))
                self.slices.updateValue((piece, numbers[i], numbers[j - 1]), (j - i,))
                added.append((numbers[i], piece, numbers[j - 1]))
                piece += 1
            a, k = ends[k], k + 1
        return added

    def _load(self, entry: tuple[int, int, int], limit: int) -> tuple[Iterator[tuple], list[list]]:
        """A piece's rows up to the slice ``limit``, taken from state, and the columns of
        the others."""
        first, piece, last = entry
        columns = [list(c) for c in self.held.getValue((piece,))]
        self.held.removeKey((piece,))
        self.slices.removeKey((piece, first, last))
        cut = len(columns[0]) if last <= limit else bisect_left(columns[0], (limit + 1) * self.slice_ms)
        return zip(*(c[:cut] for c in columns)), [c[cut:] for c in columns]

    def _in_order(self, due: list[tuple[int, int, int]], limit: int, kept: list[list[list]]) -> Iterator[tuple]:
        """The rows of the pieces ``due``, merged; what is not due yet goes to ``kept``."""
        heap: list[tuple] = []
        waiting = due[::-1]
        while waiting or heap:
            while waiting and (not heap or waiting[-1][0] * self.slice_ms <= heap[0][0][0]):
                entry = waiting.pop()
                rows, rest = self._load(entry, limit)
                if rest[0]:
                    kept.append(rest)
                row = next(rows)
                heapq.heappush(heap, (_place(row), entry[1], row, rows))
            _, piece, row, rows = heap[0]
            yield row
            after = next(rows, None)
            if after is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (_place(after), piece, after, rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All slices that are due, in order, whichever timer comes first.
        limit = timerValues.getCurrentWatermarkInMs() // self.slice_ms - 1
        index = self._index()
        due = [entry for entry in index if entry[0] <= limit]
        if not due:
            return
        self.fold.load()
        out: list[tuple] = []
        kept: list[list[list]] = []
        for row in self._in_order(due, limit, kept):
            out += self.fold.step(row)
            while len(out) >= self.chunk:
                yield self._out(key[0], out[: self.chunk])
                out = out[self.chunk :]
        index = index[len(due) :]
        for columns in kept:
            index += self._hold(columns, max((piece for _, piece, _ in index), default=-1) + 1)
        self.released.update(((int(row[0] // self.slice_ms) + 1) * self.slice_ms,))
        self._set_timer(index, None)
        self.fold.save()
        if out:
            yield self._out(key[0], out)

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        return self._frame(key, len(rows), dict(zip(self.fold.output, zip(*rows))))

    def _late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        values = {f"late_{c}": [None if pd.isna(v) else v for v in rows[c].tolist()] for c in self.fold.columns}
        return self._frame(key, len(rows), values)

    def _frame(self, key, n: int, values: dict) -> pd.DataFrame:
        """All output columns, as plain objects; those without values are null."""
        names = [*self.fold.output, *self._late_names()]
        columns = {self.key: [key] * n, **{c: values.get(c, [None] * n) for c in names}}
        return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in columns.items()})

    def _late_names(self) -> list[str]:
        return [f"late_{c}" for c in self.fold.columns]

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_order(events: DataFrame, fold: Fold, key: str, key_type: str, delay_ms: int) -> DataFrame:
    """``fold`` over each ``key``'s rows of the stream ``events`` (with ``ts`` in epoch
    milliseconds and ``seq``), in order. Rows may come up to ``delay_ms`` behind the newest
    one seen. Returns the fold's rows, and late rows under ``late_...`` (:func:`split_late`)."""
    use_rocksdb(events.sparkSession)
    timed = events.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", f"{delay_ms} milliseconds")
    # One condition on both columns: on ``kind`` alone it would move below the
    # watermark, which then would not see the times of other rows.
    rows = timed.where(F.when(F.col("event_time").isNotNull(), F.col("kind")).isNotNull()).select(key, *fold.columns)
    late = [f"late_{c} {t}" for c, t in fold.columns.items()]
    schema = ", ".join([f"{key} {key_type}", *(f"{c} {t}" for c, t in fold.output.items()), *late])
    return rows.groupBy(key).transformWithStateInPandas(InOrder(fold, key, delay_ms), schema, "append", "EventTime")


def split_late(out: DataFrame, fold: Fold, key: str) -> tuple[DataFrame, DataFrame]:
    """The fold's rows, and the late rows with their own columns."""
    ordered = out.where("late_ts IS NULL").select(key, *fold.output)
    late = out.where("late_ts IS NOT NULL").select(key, *(F.col(f"late_{c}").alias(c) for c in fold.columns))
    return ordered, late
