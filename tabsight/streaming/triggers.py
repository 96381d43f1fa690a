"""Trigger coalescing on a stream.

Per-user state: the last fire time and the pending timers. Timers are
event-time timeouts: when the watermark passes the earliest pending fire time
the group is called without rows and fires every timer at or before the
watermark (no event earlier than the watermark can still arrive). Each input
event yields one output row once its timer resolves: fired (``fire_at``) or
cancelled. Timers still pending when the input ends fire only after the
watermark moves past them (e.g. a closing event).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config

OUT = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("fire_at", T.LongType()),
        T.StructField("cancelled", T.BooleanType()),
    ]
)
STATE = T.StructType([T.StructField("last_fire", T.LongType()), T.StructField("pending", T.StringType())])


def _processor(debounce: int, throttle: int, max_pending: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (user,) = key
        if state.exists:
            last_fire, pending = state.get[0], [tuple(p) for p in json.loads(state.get[1])]
        else:
            last_fire, pending = None, []
        # pending: [seq, t, fire_at] in scheduling order
        out = []

        def fire_until(limit):
            nonlocal last_fire
            due = sorted((p for p in pending if p[2] <= limit), key=lambda p: (p[2], p[0]))
            for p in due:
                last_fire = p[2]
                pending.remove(p)
                out.append((user, p[0], p[1], p[2], False))

        if state.hasTimedOut:
            fire_until(state.getCurrentWatermarkMs())
        else:
            for r in pd.concat(list(batches), ignore_index=True).sort_values(["t", "seq"], kind="stable").itertuples(index=False):
                t = int(r.t)
                fire_until(t)
                delay = debounce
                if last_fire is not None and t - last_fire < throttle:
                    delay = max(delay, throttle - (t - last_fire))
                pending.append((int(r.seq), t, t + delay))
                if len(pending) > max_pending:
                    old = pending.pop(0)
                    out.append((user, old[0], old[1], None, True))
        if pending:
            state.update((last_fire, json.dumps(pending)))
            state.setTimeoutTimestamp(max(min(p[2] for p in pending), state.getCurrentWatermarkMs() + 1))
        elif last_fire is not None:
            state.update((last_fire, "[]"))
        if not out:
            return
        yield pd.DataFrame(
            {
                "user_id": pd.array([o[0] for o in out], dtype="Int64"),
                "seq": pd.array([o[1] for o in out], dtype="Int64"),
                "t": pd.array([o[2] for o in out], dtype="Int64"),
                "fire_at": pd.array([o[3] for o in out], dtype="Int64"),
                "cancelled": pd.array([o[4] for o in out], dtype="boolean"),
            }
        )

    return run


def stream_coalesce_triggers(
    events: DataFrame,
    watermark_delay: str = "0 seconds",
    debounce_ms: int = config.DEBOUNCE_MS,
    throttle_ms: int = config.THROTTLE_MS,
    max_pending: int = config.MAX_PENDING_TRIGGERS,
) -> DataFrame:
    """``events``: a stream of ``(user_id, t, seq)`` with ``t`` in ms."""
    e = events.select("user_id", "t", "seq", F.timestamp_millis("t").alias("event_time")).withWatermark(
        "event_time", watermark_delay
    )
    return e.groupBy("user_id").applyInPandasWithState(
        _processor(debounce_ms, throttle_ms, max_pending), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
