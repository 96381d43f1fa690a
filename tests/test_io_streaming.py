"""Preference log round trip, default path, and batch = stream."""

import datetime
import os
import random
import tempfile

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabsight.operators import preferences as P
from tabsight.operators import sessions as S
from tabsight.plans.queries import QUERIES
from tabsight.sources import fixtures as fx
from tabsight.streaming.ordered import CHUNK, InOrder, split_late
from tabsight.streaming.runner import run_available, run_to_end, write_preference_stream
from tabsight.streaming.state import Activations, Outcomes, stream_first_activation, stream_outcomes

SF = "/root/testdata/sf0.001"


def test_default_log_path():
    assert P.default_log_path("/x/log.jsonl", "/ws") == "/x/log.jsonl"
    assert P.default_log_path("", "/ws").startswith("/ws/")
    with pytest.raises(ValueError):
        P.default_log_path("", None)


def test_logging_disabled_writes_nothing(spark):
    d = tempfile.mkdtemp(prefix="tabsight-test-")
    df = spark.createDataFrame([(1,)], "x int")
    assert P.write_preferences(df, os.path.join(d, "log"), enabled=False) is False
    assert not os.path.exists(os.path.join(d, "log"))


def test_roundtrip_and_quarantine(spark):
    d = tempfile.mkdtemp(prefix="tabsight-test-")
    path = os.path.join(d, "log")
    rows = QUERIES["preference_log_roundtrip"](spark, SF).count()
    assert rows > 0
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{not json\n")
    samples, bad = P.read_preferences(spark, os.path.join(d, "bad.json"))
    assert samples.count() == 0 and bad.count() == 1
    assert path


def _in_order(tmp):
    """The file source takes files by modification time: make it the name order."""
    for i, name in enumerate(sorted(os.listdir(tmp))):
        os.utime(os.path.join(tmp, name), (1_700_000_000 + i, 1_700_000_000 + i))


def _split_events(tmp, n_parts=4):
    t = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    step = (t.num_rows + n_parts - 1) // n_parts
    for i in range(n_parts):
        pq.write_table(t.slice(i * step, step), os.path.join(tmp, f"events_{i:02d}.parquet"))
    _in_order(tmp)


def _shuffled_events(tmp, n_parts):
    """The events dealt out over files at random, so that each file holds all times."""
    t = pq.read_table(f"{SF}/events.parquet")
    order = list(range(t.num_rows))
    random.Random(7).shuffle(order)
    for i in range(n_parts):
        pq.write_table(t.take(order[i::n_parts]), os.path.join(tmp, f"events_{i:02d}.parquet"))
    _in_order(tmp)


def _span_ms():
    ts = pq.read_table(f"{SF}/events.parquet").column("ts").to_pylist()
    return int((max(ts) - min(ts)).total_seconds() * 1000) + 1000


def _both(spark, source, delay_ms):
    out = run_to_end(spark, source, lambda ev: stream_outcomes(fx.decisions_from(ev), delay_ms), "t_outcomes")
    outcomes = split_late(out, Outcomes(), "user_id")
    out = run_to_end(spark, source, lambda ev: stream_first_activation(fx.session_events_from(ev), delay_ms), "t_first")
    return outcomes, split_late(out, Activations(), "user_id")


def _batch(decisions, events):
    tabs = S.session_state(events).where(F.col("kind") == "tab")
    first = S.first_activation(tabs).select("user_id", "seq", "file", "epoch", "is_first")
    return (sorted(map(tuple, df.collect()), key=str) for df in (S.resolve_outcomes(decisions), first))


def test_stream_equals_batch_on_shuffled_files(spark):
    """Rows within the delay may come in any micro-batch."""
    tmp = tempfile.mkdtemp(prefix="tabsight-stream-")
    _shuffled_events(tmp, 4)
    outcomes, first = _both(spark, fx.event_stream(spark, tmp), _span_ms())
    want_outcomes, want_first = _batch(fx.decisions(spark, SF), fx.session_events(spark, SF))
    assert sorted(map(tuple, outcomes[0].collect()), key=str) == want_outcomes != []
    assert sorted(map(tuple, first[0].collect()), key=str) == want_first != []
    assert outcomes[1].count() == first[1].count() == 0


def test_late_rows_are_kept_apart(spark):
    """A delay of an hour and ordered files but for one row: it alone is late, and the
    rest equals the batch without it."""
    tmp = tempfile.mkdtemp(prefix="tabsight-late-")
    t = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    kinds = t.column("event_type").to_pylist()
    stray = next(i for i, k in enumerate(kinds) if k in ("view", "purchase", "error"))
    rest = [i for i in range(t.num_rows) if i != stray]
    step = len(rest) // 3 + 1
    parts = [rest[i : i + step] for i in range(0, len(rest), step)]
    parts[-1].append(stray)
    for i, part in enumerate(parts):
        pq.write_table(t.take(part), os.path.join(tmp, f"events_{i:02d}.parquet"))
    _in_order(tmp)
    source = fx.event_stream(spark, tmp)
    out = run_to_end(spark, source, lambda ev: stream_outcomes(fx.decisions_from(ev), 3_600_000), "t_late")
    got, late = split_late(out, Outcomes(), "user_id")
    own = t.slice(stray, 1).to_pylist()[0]
    user_before = [i for i in rest if t.column("user_id")[i].as_py() == own["user_id"] and i < stray + 2 * step]
    late_rows = [(r["user_id"], r["seq"]) for r in late.collect()]
    # It is late only if a slice of its user that holds its time was released before.
    assert late_rows in ([], [(own["user_id"], own["event_id"])]) and (late_rows or not user_before)
    kept = spark.createDataFrame(t.take(rest if late_rows else list(range(t.num_rows))).to_pandas(), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    want = S.resolve_outcomes(fx.decisions_from(kept))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_coalescing_equals_batch(spark):
    from tabsight.operators.triggers import coalesce_triggers
    from tabsight.streaming.triggers import stream_coalesce_triggers

    tmp = tempfile.mkdtemp(prefix="tabsight-trig-")
    # Epoch-like times: an event exactly at the initial watermark (0) counts as late.
    times = [1_700_000_000_000 + x for x in [0, 50, 100, 400, 5000, 5010, 5020, 5030, 5040, 9000, 9100]]
    rows = [(1, t, i) for i, t in enumerate(times)] + [(2, t + 3, 100 + i) for i, t in enumerate(times)]
    tbl = pa.table({"user_id": [r[0] for r in rows], "t": [r[1] for r in rows], "seq": [r[2] for r in rows]})
    pq.write_table(tbl.slice(0, 9), os.path.join(tmp, "part_00.parquet"))
    pq.write_table(tbl.slice(9), os.path.join(tmp, "part_01.parquet"))
    # A closing event far in the future moves the watermark past every timer.
    pq.write_table(pa.table({"user_id": [99], "t": [1_800_000_000_000], "seq": [999]}), os.path.join(tmp, "part_02.parquet"))
    _in_order(tmp)
    stream = (
        spark.readStream.schema("user_id bigint, t bigint, seq bigint").option("maxFilesPerTrigger", 1).parquet(tmp)
    )
    got = run_available(spark, stream_coalesce_triggers(stream), "t_trig")
    got = sorted(tuple(r) for r in got.where("user_id <> 99").collect())
    batch = spark.createDataFrame(rows, "user_id long, t long, seq long")
    want = sorted(tuple(r) for r in coalesce_triggers(batch, slice_ms=1000).collect())
    assert got == want


def test_stream_orders_a_hot_user(spark):
    """One user, 100,000 rows in shuffled files; a null user and null files too."""
    rnd = random.Random(5)
    n = 100_000
    seqs = list(range(n))
    rnd.shuffle(seqs)
    kinds = ["shown", "accept", "reject", "dismiss", "content"]
    tmp = tempfile.mkdtemp(prefix="tabsight-big-")
    for i in range(2):
        part = seqs[i::2]
        pq.write_table(
            pa.table({
                "user_id": pa.array([1 if s % 100 else None for s in part], pa.int64()),
                "ts": [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s // 3) for s in part],
                "seq": part, "kind": [kinds[s * 7 % 11 % 5] for s in part],
            }),
            os.path.join(tmp, f"part_{i}.parquet"),
        )
    schema = "user_id bigint, ts timestamp_ntz, seq bigint, kind string"

    def decided(df):
        return df.withColumn("ts", fx.event_ms(F.col("ts")))

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(tmp)
    want = S.resolve_outcomes(decided(spark.read.schema(schema).parquet(tmp)))
    out = run_to_end(spark, source, lambda ev: stream_outcomes(decided(ev), 86_400_000), "t_big")
    got, late = split_late(out, Outcomes(), "user_id")
    assert late.count() == 0 and want.where("outcome = 'rejected'").count() > 0
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


class _Map(dict):
    getValue, containsKey, removeKey = dict.__getitem__, dict.__contains__, dict.pop

    def updateValue(self, key, value):
        self[key] = value


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    """State variables in memory."""

    def getMapState(self, *_):
        return _Map()

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, _):
        pass


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_frames_are_bounded():
    """No chunk of state and no output frame holds more than ``CHUNK`` rows."""
    n = 60_000
    processor = InOrder(Outcomes(), "user_id", 1000 * n)
    processor.init(_Handle())
    seqs = list(range(n))
    random.Random(2).shuffle(seqs)
    frame = pd.DataFrame({"user_id": 1, "ts": seqs, "seq": seqs, "kind": "shown"})
    assert list(processor.handleInputRows((1,), iter([frame[:25_000], frame[25_000:]]), None)) == []
    assert all(len(v[0]) <= CHUNK for v in processor.held.values())
    frames = list(processor.handleExpiredTimer((1,), _Now(1000 * n), None))
    assert all(len(f) <= CHUNK for f in frames)
    assert pd.concat(frames)["shown_seq"].tolist() == list(range(n - 1))
    late = list(processor.handleInputRows((1,), iter([frame[:3]]), None))
    assert late[0]["late_seq"].tolist() == sorted(seqs[:3]) and late[0]["outcome"].isna().all()
    assert not processor.held and not processor.slices


def test_union_and_latest_wins_on_shuffled_files(spark):
    """Streams over files that each hold all times give the batch rows."""
    from tabsight.streaming.feeds import stream_event_union, stream_latest_wins

    tmp = tempfile.mkdtemp(prefix="tabsight-union-")
    _shuffled_events(tmp, 3)
    source = fx.event_stream(spark, tmp)
    documents = fx.documents(spark, SF).select("path", "text")

    def union(ev):
        ticks = fx.session_events_from(ev).where("kind IS NULL")
        return stream_event_union(fx.editor_feeds_from(ev), fx.user_file(0), documents, ticks, _span_ms())[0]

    got = run_to_end(spark, source, union, "t_union")
    want = QUERIES["event_union"](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

    def decided(ev):
        rows = fx.session_events_from(ev).withColumn("seq", F.when(F.col("kind") == "shown", F.col("seq")))
        return stream_latest_wins(fx.requests_from(rows), 100_000_000, _span_ms())

    got = run_to_end(spark, source, decided, "t_latest")
    want = QUERIES["latest_wins"](spark, SF).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_log_tail_counts_malformed_lines(spark):
    """A log tailed while it grows: samples and malformed lines apart."""
    from tabsight.streaming.feeds import tail_preferences

    d = tempfile.mkdtemp(prefix="tabsight-tail-")
    line = '{"timestamp":%d,"context":[],"completion":{"rawModelOutput":"x","parsedAction":null,"avgLogprob":null},"outcome":"accepted","outcomeTimestamp":5,"modelName":"m"}\n'
    with open(os.path.join(d, "one.jsonl"), "w") as f:
        f.write(line % 1 + "{broken\n" + "\n" + line % 2)
    with open(os.path.join(d, "two.jsonl"), "w") as f:
        f.write(line % 3 + "also broken\n")
    samples, bad = tail_preferences(spark, d)
    assert sorted(r["timestamp"] for r in run_available(spark, samples, "t_tail").collect()) == [1, 2, 3]
    assert sorted(r[0] for r in run_available(spark, bad, "t_bad").collect()) == ["also broken", "{broken"]


def _sample_rows(spark, rows):
    """Samples ``(timestamp, raw, outcome)`` in the log's layout."""
    action = F.lit(None).cast("struct<kind:string,position:struct<line:int,ch:int>,range:struct<start:struct<line:int,ch:int>,end:struct<line:int,ch:int>>,text:string,filePath:string,selections:array<struct<start:struct<line:int,ch:int>,end:struct<line:int,ch:int>>>>")
    return rows.select(
        "timestamp",
        F.array().cast("array<struct<role:string,content:string>>").alias("context"),
        F.struct(F.col("raw").alias("rawModelOutput"), action.alias("parsedAction"), F.lit(-0.5).alias("avgLogprob")).alias("completion"),
        "outcome", F.col("timestamp").alias("outcomeTimestamp"), F.lit("m").alias("modelName"),
    )


def test_preference_stream_commits_each_batch_once(spark):
    """A query that dies after a batch's lines are written, before its commit is, runs
    the batch again on restart; no line is there twice. A new checkpoint adds its own."""
    d = tempfile.mkdtemp(prefix="tabsight-once-")
    src, log, ckpt = (os.path.join(d, n) for n in ("src", "log", "ckpt"))
    schema = "timestamp long, raw string, outcome string"

    def run(checkpoint):
        rows = spark.readStream.schema(schema).parquet(src)
        q = write_preference_stream(_sample_rows(spark, rows), log, checkpoint, available_now=True)
        q.awaitTermination()
        return q

    def stamps():
        samples, bad = P.read_preferences(spark, log)
        assert bad.count() == 0
        return sorted(r["timestamp"] for r in samples.collect())

    spark.createDataFrame([(1, "a", "accepted"), (2, "b", "rejected")], schema).write.parquet(src)
    run(ckpt)
    assert stamps() == [1, 2]
    # The commit of the only batch is lost, as if the driver had died before it.
    for name in os.listdir(os.path.join(ckpt, "commits")):
        os.remove(os.path.join(ckpt, "commits", name))
    run(ckpt)
    assert stamps() == [1, 2]
    spark.createDataFrame([(3, "c", "accepted")], schema).write.mode("append").parquet(src)
    run(ckpt)
    assert stamps() == [1, 2, 3]
    run(os.path.join(d, "other"))
    assert stamps() == [1, 1, 2, 2, 3, 3]


def test_stream_reward_labels_once_within_the_watermark(spark):
    from tabsight.streaming.feeds import stream_reward_labels

    d = tempfile.mkdtemp(prefix="tabsight-labels-")
    schema = "timestamp long, raw string, outcome string"
    day = 86_400_000
    files = [
        [(10, "a", "accepted"), (20, "b", "ignored"), (30, None, "rejected")],
        [(40, "a", "rejected"), (50, "c", "rejected"), (60, None, "rejected"), (None, "d", "accepted")],
        [(9 * day, "e", "accepted")],
        [(9 * day + 2, "g", "ignored"), (9 * day + 2, "h", "rejected")],  # works with the new watermark
        [(9 * day + 1, "c", "accepted"), (5, "f", "accepted")],
    ]
    for i, rows in enumerate(files):
        pq.write_table(pa.Table.from_pylist([dict(zip(("timestamp", "raw", "outcome"), r)) for r in rows], pa.schema([("timestamp", pa.int64()), ("raw", pa.string()), ("outcome", pa.string())])), os.path.join(d, f"{i}.parquet"))
    _in_order(d)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    got = run_available(spark, stream_reward_labels(_sample_rows(spark, rows)), "t_labels").collect()
    # Out: the ignored one, the second of "a" and of null, the one without a time and the late one.
    assert sorted((r["timestamp"], r["label"]) for r in got) == [(10, 1), (30, 0), (50, 0), (9 * day, 1), (9 * day + 1, 1), (9 * day + 2, 0)]


def test_few_calls_for_a_user_of_few_rows():
    """The rows of many slices lie in one piece, under one timer; what is due leaves, in
    order over all pieces, and the rest stays."""
    calls = []

    class Counted(_Handle):
        def registerTimer(self, ms):
            calls.append(ms)

    processor = InOrder(Outcomes(), "user_id", 1000)
    processor.init(Counted())
    frame = pd.DataFrame({"user_id": 1, "ts": [500 * i for i in range(60)], "seq": range(60), "kind": "shown"})
    assert list(processor.handleInputRows((1,), iter([frame[::2]]), None)) == []
    assert len(processor.held) == len(processor.slices) == 1 and calls == [1000]
    assert list(processor.handleInputRows((1,), iter([frame[1::2]]), None)) == []
    assert len(processor.held) == len(processor.slices) == 2 and calls == [1000]
    frames = list(processor.handleExpiredTimer((1,), _Now(10_400), None))
    assert pd.concat(frames)["shown_seq"].tolist() == list(range(19))
    assert sum(len(v[0]) for v in processor.held.values()) == 40 and calls == [1000, 11_000]
    late = list(processor.handleInputRows((1,), iter([frame[19:21]]), None))
    assert late[0]["late_seq"].tolist() == [19]
    frames = list(processor.handleExpiredTimer((1,), _Now(1_000_000), None))
    assert pd.concat(frames)["shown_seq"].tolist() == [19, *sorted([*range(20, 60), 20])][:41]
    assert not processor.held and not processor.slices


def test_stream_actions_parses_in_several_tasks(spark):
    """One file is one split: its rows are dealt out before the parse."""
    out = QUERIES["stream_actions"](spark, SF)
    assert len(out.inputFiles()) > 1 or spark.sparkContext.defaultParallelism == 1


def test_outcomes_of_a_long_release_are_not_broadcast(spark):
    """Timers release rows in a micro-batch without input, which looks empty to the planner:
    a release longer than the broadcast's time must not fail the query."""
    from tabsight.streaming.ordered import in_order

    class Slow(Outcomes):
        def load(self):
            import time

            time.sleep(4)
            Outcomes.load(self)

    tmp = tempfile.mkdtemp(prefix="tabsight-test-")
    day, rows = 86_400_000, []
    for user in (1, 2):
        rows += [(user, 1000, user * 10, "shown"), (user, 2000, user * 10 + 1, "accept"), (user, 9 * day, user * 10 + 2, "reject")]
    schema = "user_id long, ts long, seq long, kind string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp}/events")
    shown = [(10, "a", "x", -0.5, "m", 1), (20, "b", "y", -0.5, "m", 2)]
    names = "seq long, raw string, action string, avg_logprob double, model_name string, conv_id long"
    spark.createDataFrame(shown, names).write.parquet(f"{tmp}/shown")
    before = spark.conf.get("spark.sql.broadcastTimeout")
    spark.conf.set("spark.sql.broadcastTimeout", "1")
    try:
        stream = spark.readStream.schema(schema).parquet(f"{tmp}/events")
        outcomes = split_late(in_order(stream, Slow(), "user_id", "bigint", day), Outcomes(), "user_id")[0]
        samples = P.samples_from_outcomes(outcomes, spark.read.parquet(f"{tmp}/shown"))
        got = run_available(spark, samples, "slow_release").select("sample_id", "outcome", "completion.rawModelOutput").collect()
    finally:
        spark.conf.set("spark.sql.broadcastTimeout", before)
    assert sorted(map(tuple, got)) == [(10, "accepted", "a"), (20, "accepted", "b")]
