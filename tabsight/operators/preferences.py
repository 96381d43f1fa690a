"""Preference samples, the JSONL preference log, and the training tables
derived from it (reward labels, preference pairs, outcome report).

A sample is created when a response passes the gate and parses to an action
(``status = ok``) and is shown; its outcome comes from ``resolve_outcomes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..sources.schemas import PREFERENCE_DISK
from .scan import event_slice, ordered_scan
from .sessions import DECIDED, resolve_outcomes


def context_arrays(truncated: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, context)``: the truncated conversation as an ordered
    ``array<struct<role, content>>``, the order key carried in the struct."""
    ctx = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
    )
    return truncated.groupBy(key).agg(ctx.alias("context"))


def preference_samples(
    shown: DataFrame,
    decisions: DataFrame,
    contexts: DataFrame | None = None,
    include_pending: bool = False,
) -> DataFrame:
    """Resolved preference samples.

    ``shown``: ``(user_id, ts, seq, raw, action, avg_logprob, model_name,
    conv_id)``, one row per shown suggestion; ``decisions``: ``(user_id, ts,
    seq, kind)`` with accept / reject / dismiss rows. ``contexts``: ``(conv_id,
    context)``. Output: the log's fields plus ``user_id`` and ``sample_id``
    (the shown row's ``seq``).
    """
    seq_rows = shown.select("user_id", "ts", "seq", F.lit("shown").alias("kind")).unionByName(
        decisions.where(F.col("kind").isin(*DECIDED)).select("user_id", "ts", "seq", "kind")
    )
    outcomes = resolve_outcomes(seq_rows, include_pending=include_pending)
    return samples_from_outcomes(outcomes, shown, contexts)


def samples_from_outcomes(outcomes: DataFrame, shown: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Attach the shown suggestion's details and context to resolved outcomes
    (batch or stream: both joins are equi-joins with ``shown`` and
    ``contexts`` as the static side)."""
    info = shown.select(
        F.col("seq").alias("shown_seq"), "raw", "action", "avg_logprob", "model_name", "conv_id"
    )
    if outcomes.isStreaming:
        # A micro-batch without new rows looks empty to the planner, though timers release
        # rows in it: all outcomes would be broadcast, in the broadcast's time.
        info = info.hint("merge")
    s = outcomes.join(info, "shown_seq")
    if contexts is not None:
        s = s.join(contexts, "conv_id", "left")
    else:
        s = s.withColumn("context", F.lit(None).cast("array<struct<role:string,content:string>>"))
    empty_ctx = F.array().cast("array<struct<role:string,content:string>>")
    return s.select(
        "user_id",
        F.col("shown_seq").alias("sample_id"),
        F.col("shown_ts").alias("timestamp"),
        F.coalesce(F.col("context"), empty_ctx).alias("context"),
        F.struct(
            F.col("raw").alias("rawModelOutput"),
            F.col("action").alias("parsedAction"),
            F.col("avg_logprob").alias("avgLogprob"),
        ).alias("completion"),
        "outcome",
        F.col("outcome_ts").alias("outcomeTimestamp"),
        F.col("model_name").alias("modelName"),
    )


# -- JSONL log ------------------------------------------------------------


def _pos_to_disk(p: Column) -> Column:
    return F.when(p.isNotNull(), F.array(p["line"].cast("long"), p["ch"].cast("long")))


def _range_to_disk(r: Column) -> Column:
    return F.when(r.isNotNull(), F.struct(_pos_to_disk(r["start"]).alias("start"), _pos_to_disk(r["end"]).alias("end")))


def _pos_from_disk(a: Column) -> Column:
    return F.when(a.isNotNull(), F.struct(F.get(a, 0).cast("int").alias("line"), F.get(a, 1).cast("int").alias("ch")))


def _range_from_disk(r: Column) -> Column:
    return F.when(
        r.isNotNull(), F.struct(_pos_from_disk(r["start"]).alias("start"), _pos_from_disk(r["end"]).alias("end"))
    )


def to_log_records(samples: DataFrame) -> DataFrame:
    """Log layout: positions as two-element arrays, NaN written as null."""
    a = F.col("completion.parsedAction")
    action = F.when(
        a.isNotNull(),
        F.struct(
            a["kind"].alias("kind"),
            _pos_to_disk(a["position"]).alias("position"),
            _range_to_disk(a["range"]).alias("range"),
            a["text"].alias("text"),
            a["filePath"].alias("filePath"),
            F.transform(a["selections"], _range_to_disk).alias("selections"),
        ),
    )
    avg = F.col("completion.avgLogprob")
    return samples.select(
        "timestamp",
        "context",
        F.struct(
            F.col("completion.rawModelOutput").alias("rawModelOutput"),
            action.alias("parsedAction"),
            F.when(~F.isnan(avg), avg).alias("avgLogprob"),
        ).alias("completion"),
        "outcome",
        "outcomeTimestamp",
        "modelName",
    )


def default_log_path(configured: str = "", workspace: str | None = None) -> str:
    """Configured path, else ``<first workspace folder>/<log file name>``."""
    if configured:
        return configured
    if workspace:
        return workspace.rstrip("/") + "/" + config.PREFERENCE_LOG_FILE_NAME
    raise ValueError("set a log path or a workspace folder for the preference log")


def write_preferences(samples: DataFrame, path: str, enabled: bool = True) -> bool:
    """Append samples as JSON lines (nulls kept). Returns False, writing
    nothing, when logging is disabled."""
    if not enabled:
        return False
    to_log_records(samples).write.mode("append").option("ignoreNullFields", "false").json(path)
    return True


def read_preferences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(samples, quarantine)``: the log read with the declared schema;
    malformed lines go to the quarantine frame instead of failing the job."""
    return parse_log_lines(spark.read.text(path))


def parse_log_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(samples, quarantine)`` of a log's lines (``value``), batch or stream."""
    # Lines are read as text and parsed with the declared schema: a malformed
    # line keeps its text in ``_corrupt_record`` instead of failing the job.
    lines = lines.where(F.length(F.trim("value")) > 0)
    parsed = lines.select(
        F.from_json("value", PREFERENCE_DISK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    ).select("r.*")
    good = parsed.where(F.col("_corrupt_record").isNull())
    bad = parsed.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    a = F.col("completion.parsedAction")
    action = F.when(
        a.isNotNull(),
        F.struct(
            a["kind"].alias("kind"),
            _pos_from_disk(a["position"]).alias("position"),
            _range_from_disk(a["range"]).alias("range"),
            a["text"].alias("text"),
            a["filePath"].alias("filePath"),
            F.transform(a["selections"], _range_from_disk).alias("selections"),
        ),
    )
    samples = good.select(
        "timestamp",
        "context",
        F.struct(
            F.col("completion.rawModelOutput").alias("rawModelOutput"),
            action.alias("parsedAction"),
            F.col("completion.avgLogprob").alias("avgLogprob"),
        ).alias("completion"),
        "outcome",
        "outcomeTimestamp",
        "modelName",
    )
    return samples, bad


# -- training tables ---------------------------------------------------------


def context_digest(ctx: Column) -> Column:
    """SHA-256 of a context: the key that stands for it in every shuffle."""
    return F.sha2(F.to_json(ctx), 256)


def reward_labels(samples: DataFrame, keep_ignored: bool = False) -> DataFrame:
    """Accepted -> 1, rejected -> 0 (ignored dropped, or -1 with
    ``keep_ignored``), one row per distinct (context, output): the earliest.
    A grouped ``min`` of a struct (map-side combined), not a window; contexts
    and outputs travel as digests only."""
    lab = (
        F.when(F.col("outcome") == "accepted", 1)
        .when(F.col("outcome") == "rejected", 0)
        .when(F.lit(keep_ignored) & (F.col("outcome") == "ignored"), -1)
    )
    s = samples.withColumn("label", lab).where(F.col("label").isNotNull())
    first = s.groupBy(
        context_digest(F.col("context")).alias("__ctx"),
        F.sha2(F.col("completion.rawModelOutput"), 256).alias("__raw"),
    ).agg(F.min(F.struct("timestamp", "sample_id", "label")).alias("m"))
    return first.select(F.col("m.sample_id").alias("sample_id"), F.col("m.timestamp").alias("timestamp"),
                        F.col("m.label").cast("int").alias("label"))


def dpo_pairs(samples: DataFrame, slice_ms: int = config.EVENT_SLICE_MS) -> DataFrame:
    """One preference pair per rejected sample with an accepted sample of the
    same context: the most recent earlier one is ``chosen``, else the nearest
    later one, which then is the first of the context.

    Linear in the log (no all-pairs product within a context): one sliced
    ordered scan keyed by the context's digest.
    """
    s = samples.select(
        context_digest(F.col("context")).alias("__ctx"),
        F.col("timestamp").alias("ts"),
        F.col("sample_id").alias("seq"),
        "outcome",
    ).where(F.col("outcome").isin("accepted", "rejected"))
    is_accepted = F.col("outcome") == "accepted"
    scanned = ordered_scan(
        s, ["__ctx"], ["ts", "seq"], event_slice("ts", slice_ms),
        running_lasts={"__earlier": F.when(is_accepted, F.col("seq"))},
        key_mins={"__first": F.when(is_accepted, F.struct("ts", "seq"))},
    )
    return scanned.where(F.col("outcome") == "rejected").select(
        F.coalesce(F.col("__earlier"), F.col("__first.seq")).alias("chosen_id"), F.col("seq").alias("rejected_id")
    ).where(F.col("chosen_id").isNotNull())


def logprob_bucket(avg: Column, width: float = 0.25) -> Column:
    return F.when(~F.isnan(avg), F.floor(avg / F.lit(width)) * F.lit(width))


def outcome_report(samples: DataFrame) -> DataFrame:
    """Counts, acceptance rate and decision latency by model, action kind and
    log-probability bucket.

    Counts per (group, latency) combine map-side; a sliced running sum over
    them gives the exact nearest-rank percentiles, so no group is one task.
    """
    group = ["model_name", "kind", "lp_bucket"]
    hist = samples.groupBy(
        F.col("modelName").alias("model_name"),
        F.col("completion.parsedAction.kind").alias("kind"),
        logprob_bucket(F.col("completion.avgLogprob")).alias("lp_bucket"),
        (F.col("outcomeTimestamp") - F.col("timestamp")).cast("long").alias("lat"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("outcome") == "accepted").cast("long")).alias("n_accepted"),
        F.sum((F.col("outcome") == "rejected").cast("long")).alias("n_rejected"),
        F.sum((F.col("outcome") == "ignored").cast("long")).alias("n_ignored"),
    )
    timed = F.when(F.col("lat").isNotNull(), F.col("n"))
    ranked = ordered_scan(
        hist, group, ["lat"], event_slice("lat", config.EVENT_SLICE_MS),
        running_sums={"__upto": timed}, key_totals={"__timed": timed},
    )

    def percentile(p: int) -> Column:
        reached = F.col("lat").isNotNull() & (F.col("__upto") * 100 >= F.col("__timed") * p)
        return F.min(F.when(reached, F.col("lat"))).alias(f"p{p}_latency_ms")

    counts = ["n", "n_accepted", "n_rejected", "n_ignored"]
    g = ranked.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.sum(F.col("lat") * F.col("n")).alias("__lat_sum"),
        F.min("lat").alias("min_latency_ms"),
        F.max("lat").alias("max_latency_ms"),
        percentile(50),
        percentile(95),
    )
    decided = F.col("n_accepted") + F.col("n_rejected")
    return g.select(
        "model_name", "kind", "lp_bucket", "n", "n_accepted", "n_rejected", "n_ignored",
        F.when(decided > 0, F.round(F.col("n_accepted") / decided, 6)).alias("acceptance_rate"),
        F.round(F.col("__lat_sum") / F.col("n"), 3).alias("avg_latency_ms"),
        "min_latency_ms", "p50_latency_ms", "p95_latency_ms", "max_latency_ms",
    )
