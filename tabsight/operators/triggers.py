"""Trigger coalescing: which editor events end in a model request, and when.

Every event that passes the trigger gate schedules its own timer at
``t + delay`` with ``delay = 150 ms``, raised to ``300 ms - (t - last fire)``
when the last fire is under 300 ms ago. A new event does not cancel earlier
timers; only when more than two are pending is the oldest cancelled. A fire
sets the last-fire time. Timers due at or before an event's time run before
that event, in (fire time, event order).

This is a sequential fold with timers, so it runs as ``applyInPandas``. The
groups are not whole users: a gap of at least two throttle intervals
(600 ms) empties the pending queue and makes the throttle irrelevant, so each
burst of a user is independent. Bursts are numbered with a sliced scan
(no per-user window), and only one burst is ever held by one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from .scan import event_slice, ordered_scan, with_prev

TRIGGER_OUT = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("fire_at", T.LongType()),
        T.StructField("cancelled", T.BooleanType()),
    ]
)


def simulate(times: list[int], debounce: int, throttle: int, max_pending: int) -> list[tuple[int | None, bool]]:
    """Fire time (or None) and cancelled flag per event, events in order."""
    fire_at: list[int | None] = [None] * len(times)
    cancelled = [False] * len(times)
    due: list[tuple[int, int]] = []  # (fire time, event index)
    pending: list[int] = []  # event indices in scheduling order
    last_fire: int | None = None

    def run_until(limit: float) -> None:
        nonlocal last_fire
        while due and due[0][0] <= limit:
            when, idx = heapq.heappop(due)
            if cancelled[idx]:
                continue
            last_fire = when
            fire_at[idx] = when
            pending.remove(idx)

    for idx, t in enumerate(times):
        run_until(t)
        delay = debounce
        if last_fire is not None and t - last_fire < throttle:
            delay = max(delay, throttle - (t - last_fire))
        heapq.heappush(due, (t + delay, idx))
        pending.append(idx)
        if len(pending) > max_pending:
            oldest = pending.pop(0)
            cancelled[oldest] = True
    run_until(float("inf"))
    return list(zip(fire_at, cancelled))


def coalesce_triggers(
    events: DataFrame,
    debounce_ms: int = config.DEBOUNCE_MS,
    throttle_ms: int = config.THROTTLE_MS,
    max_pending: int = config.MAX_PENDING_TRIGGERS,
    slice_ms: int = config.EVENT_SLICE_MS,
) -> DataFrame:
    """``events``: ``(user_id, t, seq)`` gate-passing triggers, ``t`` in ms.
    Output: ``(user_id, seq, t, fire_at, cancelled)``, one row per event;
    ``fire_at`` is null for a cancelled timer."""
    gap = 2 * throttle_ms
    e = events.select("user_id", "t", "seq")
    e = with_prev(e, ["user_id"], ["t", "seq"], event_slice("t", slice_ms), "t", "__prev_t")
    e = e.withColumn("__new", (F.col("__prev_t").isNull() | (F.col("t") - F.col("__prev_t") >= gap)).cast("long"))
    e = ordered_scan(e, ["user_id"], ["t", "seq"], event_slice("t", slice_ms), running_sums={"burst": F.col("__new")})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        users = pdf["user_id"].to_numpy()
        bursts = pdf["burst"].to_numpy()
        times = pdf["t"].to_numpy()
        n = len(pdf)
        change = np.flatnonzero((users[1:] != users[:-1]) | (bursts[1:] != bursts[:-1])) + 1
        bounds = np.concatenate([[0], change, [n]])
        fire = np.zeros(n, dtype=np.int64)
        has_fire = np.zeros(n, dtype=bool)
        cancelled = np.zeros(n, dtype=bool)
        for b0, b1 in zip(bounds[:-1], bounds[1:]):
            for k, (f, c) in enumerate(simulate(times[b0:b1].tolist(), debounce_ms, throttle_ms, max_pending)):
                if f is not None:
                    fire[b0 + k] = f
                    has_fire[b0 + k] = True
                cancelled[b0 + k] = c
        return pd.DataFrame(
            {
                "user_id": users,
                "seq": pdf["seq"].to_numpy(),
                "t": times,
                "fire_at": pd.arrays.IntegerArray(fire, ~has_fire),
                "cancelled": cancelled,
            }
        )

    def run(batches):
        # Rows arrive grouped by (user, burst) and time-ordered; a burst cut by
        # an Arrow batch boundary is carried into the next batch.
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            last = (pdf["user_id"].iat[-1], pdf["burst"].iat[-1])
            tail = (pdf["user_id"] == last[0]) & (pdf["burst"] == last[1])
            carry, ready = pdf[tail], pdf[~tail]
            if len(ready):
                yield fold(ready)
        if carry is not None and len(carry):
            yield fold(carry)

    # Bursts are hash-distributed (a hot user's bursts land on many tasks) and
    # each task folds its bursts in one pass over time-sorted rows.
    ordered = (
        e.select("user_id", "burst", "t", "seq")
        .repartition("user_id", "burst")
        .sortWithinPartitions("user_id", "burst", "t", "seq")
    )
    return ordered.mapInPandas(run, TRIGGER_OUT)
