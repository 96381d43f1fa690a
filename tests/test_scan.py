"""The sliced scans equal plain per-key windows, for any slice width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsight.operators.scan import event_slice, ordered_scan, with_next, with_prev


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(3)
    rows = []
    seq = 0
    for user, n in ((1, 400), (2, 15), (3, 1)):  # one hot key
        t = 0
        for _ in range(n):
            t += rnd.choice([0, 1, 5, 50, 400])
            v = rnd.choice([None, 0, 1, 2])
            rows.append((user, t, seq, v))
            seq += 1
    return spark.createDataFrame(rows, "user_id long, ts long, seq long, v long")


@pytest.mark.parametrize("width", [1, 7, 100, 10**9])
def test_sliced_equals_window(spark, events, width):
    w = Window.partitionBy("user_id").orderBy("ts", "seq")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = events.select(
        "seq",
        F.sum(F.coalesce("v", F.lit(0))).over(run).alias("s"),
        F.last("v", ignorenulls=True).over(run).alias("l"),
        F.lead("ts").over(w).alias("nx"),
        F.lag("ts").over(w).alias("pv"),
    )
    sl = event_slice("ts", width)
    got = ordered_scan(events, ["user_id"], ["ts", "seq"], sl, running_sums={"s": F.coalesce("v", F.lit(0))},
                       running_lasts={"l": F.col("v")})
    got = with_next(got, ["user_id"], ["ts", "seq"], sl, "ts", "nx")
    got = with_prev(got, ["user_id"], ["ts", "seq"], sl, "ts", "pv")
    a = sorted(tuple(r) for r in got.select("seq", "s", "l", "nx", "pv").collect())
    b = sorted(tuple(r) for r in want.collect())
    assert a == b


@pytest.mark.parametrize("width", [1, 10, 10**9])
def test_null_keys_and_times_stay(spark, width):
    rows = [(None, 5, 0, 1), (None, 50, 1, None), (1, None, 2, 7), (1, 3, 3, None), (1, 30, 4, 2), (None, None, 5, 3)]
    ev = spark.createDataFrame(rows, "user_id long, ts long, seq long, v long")
    w = Window.partitionBy("user_id").orderBy("ts", "seq")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = ev.select(
        "user_id", "ts", "seq", F.last("v", ignorenulls=True).over(run).alias("l"),
        F.lead("seq").over(w).alias("nx"), F.lag("seq").over(w).alias("pv"),
        F.min("v").over(Window.partitionBy("user_id")).alias("m"),
    )
    sl = event_slice("ts", width)
    got = ordered_scan(ev, ["user_id"], ["ts", "seq"], sl, running_lasts={"l": F.col("v")}, key_mins={"m": F.col("v")})
    got = with_next(got, ["user_id"], ["ts", "seq"], sl, "seq", "nx")
    got = with_prev(got, ["user_id"], ["ts", "seq"], sl, "seq", "pv")
    cols = want.columns
    assert sorted(map(tuple, got.select(*cols).collect()), key=lambda r: r[2]) == sorted(
        map(tuple, want.collect()), key=lambda r: r[2]
    )


@pytest.mark.parametrize("width", [1, 7, 100, 10**9])
def test_switched_lasts_equal_a_plain_walk(spark, width):
    """Session state against a row-by-row walk, for any slice width; a null user too."""
    from tabsight.operators.sessions import resolve_outcomes, session_state

    rnd = random.Random(9)
    kinds = ["toggle", "clear", "reject", "dismiss", "selection", "tab", "content", "shown", "accept"]
    rows, t = [], 0
    for seq in range(700):
        t += rnd.choice([0, 1, 5, 50, 400])
        rows.append((rnd.choice([1, 1, 1, 2, None]), t, seq, rnd.choice(kinds)))
    state, pending = {}, {}
    want, outcomes = [], []
    for user, t, seq, kind in rows:
        epoch, enabled, suppressed = state.get(user, (0, True, False))
        epoch += kind == "clear"
        if kind == "toggle":
            enabled = not enabled
            suppressed = suppressed or not enabled
        elif kind in ("reject", "dismiss"):
            suppressed = True
        elif kind in ("selection", "tab", "content"):
            suppressed = False
        state[user] = (epoch, enabled, suppressed)
        want.append((user, seq, epoch, enabled, suppressed))
        if kind in ("shown", "accept", "reject", "dismiss"):
            if pending.get(user) is not None:
                outcomes.append((user, pending[user], {"shown": "ignored", "accept": "accepted"}.get(kind, "rejected"), t))
            pending[user] = seq if kind == "shown" else None
    events = spark.createDataFrame(rows, "user_id long, ts long, seq long, kind string")
    got = session_state(events, slice_ms=width).select("user_id", "seq", "epoch", "enabled", "suppressed")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    got = resolve_outcomes(events, slice_ms=width).select("user_id", "shown_seq", "outcome", "outcome_ts")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(outcomes, key=str)
