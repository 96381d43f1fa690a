"""Responses -> gate -> text -> action, with a status per response.

Order of checks (each stops the row): body not JSON or no token list ->
``bad_response``; mean log-probability below the floor -> ``low_confidence``;
text missing or blank -> ``empty_content``; nothing parsed -> ``no_action``;
else ``ok``. The gate runs before any text work, so low-confidence rows never
reach the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import responses as R
from ..functions.commands import with_action
from ..functions.jscompat import js_trim


def with_scores(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add ``n_tokens``, ``avg_logprob`` and ``text`` (body parsed once)."""
    v = F.col("__v")
    lps = F.col("__lps")
    return (
        responses.withColumn("__v", R.parse_body(F.col(body)))
        .withColumn("__lps", R.token_logprobs(v))
        .withColumn("n_tokens", F.size(lps).cast("long"))
        .withColumn("avg_logprob", F.when(lps.isNotNull(), R.mean_logprob(lps)))
        .withColumn("text", R.response_text(v))
        .withColumn("has_logprobs", lps.isNotNull())
        .drop("__v", "__lps")
    )


def parse_responses(
    responses: DataFrame,
    min_avg_logprob: float = config.DEFAULT_MIN_AVG_LOGPROB,
    body: str = "body",
) -> DataFrame:
    """Add ``avg_logprob``, ``n_tokens``, ``text``, ``parse_status`` and
    ``action``. Needs ``active_path, line_count, last_line_len`` (null path:
    no document, terminal branch only)."""
    scored = with_scores(responses, body)
    status = (
        F.when(~F.col("has_logprobs"), F.lit("bad_response"))
        .when(R.below_floor(F.col("avg_logprob"), min_avg_logprob), F.lit("low_confidence"))
        .when(F.col("text").isNull() | (F.length(js_trim(F.col("text"))) == 0), F.lit("empty_content"))
    )
    staged = scored.withColumn("__pre", status).withColumn(
        "__raw", F.when(F.col("__pre").isNull(), F.col("text"))
    )
    parsed = with_action(staged, raw="__raw")
    return parsed.withColumn(
        "parse_status",
        F.coalesce(F.col("__pre"), F.when(F.col("action").isNull(), F.lit("no_action")), F.lit("ok")),
    ).drop("__pre", "__raw", "has_logprobs", "route", "sed_form")


def confidence_gate(scored: DataFrame, min_avg_logprob: float = config.DEFAULT_MIN_AVG_LOGPROB) -> DataFrame:
    """Keep responses whose mean is not below the floor (equal and NaN pass)."""
    # Out of a generator: else the filter moves below the scores and parses the body again for
    # each mention of the mean.
    others = [c for c in scored.columns if c != "avg_logprob"]
    means = scored.select(*others, F.inline(F.array(F.struct("avg_logprob"))))
    kept = means.where(F.col("avg_logprob").isNotNull() & ~R.below_floor(F.col("avg_logprob"), min_avg_logprob))
    return kept.select(*scored.columns)


def avg_logprob_tokens(tokens: DataFrame, key: str = "request_id", value: str = "logprob") -> DataFrame:
    """Mean log-probability from a long token table: a grouped ``avg`` with
    map-side partial aggregation, so one huge response is not one task's sum."""
    return tokens.groupBy(key).agg(F.count(F.lit(1)).alias("n_tokens"), F.avg(value).alias("avg_logprob"))
