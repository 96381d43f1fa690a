"""Streams made of several streams: the event union and the tail of the preference
log, and requests joined with later requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators.preferences import context_digest, parse_log_lines
from ..sources import events as evs
from .ordered import Fold, in_order, split_late


class FirstTabs(Fold):
    """Tab events marked as the first of their file or not. The file active when the
    session starts (``start``) is a tab event before the user's first event."""

    columns = {"ts": "bigint", "seq": "bigint", "kind": "string", "file": "string", "start": "string"}
    output = {"ts": "bigint", "seq": "bigint", "file": "string", "is_first": "boolean"}

    def init(self, handle) -> None:
        self.begun = handle.getValueState("begun", "ts bigint")
        self.files = handle.getMapState("files", "file string", "ts bigint")

    def load(self) -> None:
        self.new = self.empty = not self.begun.exists()
        self.seen: dict[tuple, int] = {}

    def _first(self, ts: int, file: str | None) -> bool:
        name = ("x" + file if file is not None else "",)
        if name in self.seen or not self.empty and self.files.containsKey(name):
            return False
        self.seen[name] = ts
        return True

    def step(self, row: tuple) -> list[tuple]:
        ts, seq, kind, file, start = row
        out = []
        if self.new:
            self.new = False
            self.begun.update((ts,))
            out.append((ts, -1, start, self._first(ts, start)))
        if kind == "tab":
            out.append((ts, seq, file, self._first(ts, file)))
        return out

    def save(self) -> None:
        for name, ts in self.seen.items():
            self.files.updateValue(name, (ts,))


def stream_event_union(feeds: dict[str, DataFrame], start_file: Column, documents: DataFrame, ticks: DataFrame | None = None, delay_ms: int = config.STREAM_DELAY_MS) -> tuple[DataFrame, DataFrame]:
    """``sources.events.event_union`` over streams of the editor's feeds, one of each
    kind: (events, late tab rows). Selections, changes and terminal events need no
    state and leave at once. Tab events go through ``FirstTabs``, for which every event
    counts that may be a session's first; the first of a file gets its text from the
    static ``documents`` (path, text). ``ticks``: rows of a time alone that move the
    watermark (heartbeats, an end marker)."""
    every = [f.select("user_id", "ts", "seq", F.lit(kind).alias("kind"), (F.col("file") if kind == "tab" else F.lit(None).cast("string")).alias("file")) for kind, f in feeds.items()]
    if ticks is not None:
        none = F.lit(None).cast("string")
        every.append(ticks.select("user_id", "ts", "seq", none.alias("kind"), none.alias("file")))
    rows = reduce(DataFrame.unionByName, every)
    tabs, late = split_late(in_order(rows.withColumn("start", start_file), FirstTabs(), "user_id", "bigint", delay_ms), FirstTabs(), "user_id")
    texts = documents.select(F.col("path").alias("__path"), "text")
    tabs = tabs.join(texts, F.when(F.col("is_first"), F.col("file")) == F.col("__path"), "left").drop("__path", "is_first").withColumn("kind", F.lit("tab"))
    union = evs.event_union(evs.first_selection(feeds["selection"]), tabs, evs.explode_changes(feeds["content"]), feeds["terminal_command"], feeds["terminal_output"])
    return union, late


def tail_preferences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``read_preferences`` over a log that still grows: streams of the samples and
    of the malformed lines (to be written, and counted, apart)."""
    return parse_log_lines(spark.readStream.text(path))


def stream_reward_labels(samples: DataFrame, delay_ms: int = config.STREAM_DELAY_MS) -> DataFrame:
    """``context_sha256, raw_sha256, timestamp, label`` of a stream of log samples:
    accepted 1, rejected 0, once per distinct (context, output) while the watermark,
    ``delay_ms`` behind the newest sample, has not passed the first one. The first to
    arrive stays (of one micro-batch any); state holds digests of the last ``delay_ms``
    only, so a pair that comes back later is labelled again. Samples behind the
    watermark are dropped as late. A micro-batch works with the watermark of those before it."""
    label = F.when(F.col("outcome") == "accepted", 1).when(F.col("outcome") == "rejected", 0).cast("int")
    timed = samples.select(
        context_digest(F.col("context")).alias("context_sha256"),
        F.sha2(F.col("completion.rawModelOutput"), 256).alias("raw_sha256"),
        "timestamp", label.alias("label"), F.timestamp_millis("timestamp").alias("time"),
    ).withWatermark("time", f"{delay_ms} milliseconds")
    # One condition with the time, which keeps it above the watermark (see ``in_order``).
    labelled = timed.where(F.when(F.col("time").isNotNull(), F.col("label")).isNotNull())
    return labelled.dropDuplicatesWithinWatermark(["context_sha256", "raw_sha256"]).drop("time")


def stream_latest_wins(requests: DataFrame, max_latency_ms: int, delay_ms: int = config.STREAM_DELAY_MS) -> DataFrame:
    """``user_id, seq, ts, response_ts, was_shown`` per request of a stream ``(user_id,
    ts, seq, response_ts)``: whether no newer request of the user started before the
    response came. A stream–stream outer join of requests with newer ones, watermarks
    on both sides: a superseded request leaves once (with its first newer one), a shown one
    when the watermark has passed all that could supersede it. State holds the
    requests of the last ``max_latency_ms``, which no response may exceed."""
    # One condition with the time, which keeps it above the watermark (see ``in_order``).
    timed = requests.withColumn("time", F.timestamp_millis("ts"))
    whole = F.when(F.col("time").isNotNull(), F.col("seq")).isNotNull()
    one = timed.withWatermark("time", f"{delay_ms} milliseconds").where(whole)
    newer = timed.select(F.col("user_id").alias("n_user"), F.col("ts").alias("n_ts"), F.col("seq").alias("n_seq"), F.col("time").alias("n_time"))
    newer = newer.withWatermark("n_time", f"{delay_ms} milliseconds").where(F.when(F.col("n_time").isNotNull(), F.col("n_seq")).isNotNull())
    supersedes = (
        F.col("user_id").eqNullSafe(F.col("n_user"))
        & (F.col("n_time") >= F.col("time"))
        & (F.col("n_time") <= F.col("time") + F.expr(f"INTERVAL {max_latency_ms // 1000 + 1} SECONDS"))
        & ((F.col("n_ts") > F.col("ts")) | (F.col("n_seq") > F.col("seq")))
        & (F.col("n_ts") <= F.col("response_ts"))
    )
    joined = one.join(newer, supersedes, "left_outer").withColumn("was_shown", F.col("n_seq").isNull())
    return joined.dropDuplicates(["user_id", "seq", "time"]).select("user_id", "seq", "ts", "response_ts", "was_shown")
