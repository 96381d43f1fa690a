"""Conversation messages: role normalisation, token budget, request bodies.

Long form: one row per turn ``(conv_id, turn, role, content)``. The system
prompt is not stored; it is a parameter and is prepended on output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .scan import block_slice, ordered_scan


def normalize_role(role: Column) -> Column:
    """``user`` stays ``user``; every other role is sent as ``assistant``."""
    return F.when(role == "user", F.lit("user")).otherwise(F.lit("assistant"))


def estimate_tokens(text: Column, chars_per_token: int = config.CHARS_PER_TOKEN) -> Column:
    """Our token estimate: ceil(characters / chars_per_token)."""
    return F.ceil(F.length(text) / F.lit(chars_per_token)).cast("long")


def system_tokens(system_prompt: str, chars_per_token: int = config.CHARS_PER_TOKEN) -> int:
    return -(-len(system_prompt) // chars_per_token)


def role_normalize(messages: DataFrame) -> DataFrame:
    return messages.withColumn("role", normalize_role(F.col("role")))


def conversation_tokens(messages: DataFrame, system_prompt: str = config.DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Token sum per conversation, the system message counted apart.

    A plain grouped aggregate: partial sums are combined map-side, so a huge
    conversation costs no more than a small one in the shuffle.
    """
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(estimate_tokens(F.col("content"))).alias("turn_tokens"),
        F.lit(system_tokens(system_prompt)).cast("long").alias("system_tokens"),
    )


def truncate_context(
    messages: DataFrame,
    max_tokens: int = config.DEFAULT_MAX_CONTEXT_TOKENS,
    system_prompt: str = config.DEFAULT_SYSTEM_PROMPT,
    turn_slice: int = config.TURN_SLICE,
) -> DataFrame:
    """Drop-half truncation of every conversation.

    If the turns' tokens fit in ``max_tokens - system_tokens`` all are kept;
    otherwise the first ``ceil(n/2)`` turns are dropped, once (the rest may
    still be over budget). The system message is always kept and is emitted
    as turn -1. Output: ``conv_id, turn, role, content, tokens``.
    """
    sys_tok = system_tokens(system_prompt)
    available = max_tokens - sys_tok
    ranked = ordered_scan(
        messages.select("conv_id", "turn", normalize_role(F.col("role")).alias("role"), "content").withColumn(
            "tokens", estimate_tokens(F.col("content"))
        ),
        keys=["conv_id"],
        order=["turn"],
        slice_expr=block_slice("turn", turn_slice),
        running_sums={"rn": F.lit(1).cast("long")},
        key_totals={"n_turns": F.lit(1).cast("long"), "total_tokens": F.col("tokens")},
    )
    fits = F.coalesce(F.col("total_tokens"), F.lit(0)) <= F.lit(available)
    keep = fits | (F.col("rn") > F.ceil(F.col("n_turns") / F.lit(2)))
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.col("role"),
        F.col("content"),
        F.col("tokens"),
        keep.alias("keep"),
    )
    system_row = F.struct(
        F.lit(-1).cast("long").alias("turn"),
        F.lit("system").alias("role"),
        F.lit(system_prompt).alias("content"),
        F.lit(sys_tok).cast("long").alias("tokens"),
        F.lit(True).alias("keep"),
    )
    # The first turn of each conversation also emits its system row: one pass,
    # no extra exchange for a distinct list of conversations.
    rows = F.when(F.col("rn") == 1, F.array(system_row, row)).otherwise(F.array(row))
    return (
        ranked.select("conv_id", F.explode(rows).alias("m"))
        .where("m.keep")
        .select("conv_id", "m.turn", "m.role", "m.content", "m.tokens")
    )


def build_requests(
    truncated: DataFrame,
    model_name: str = config.DEFAULT_MODEL_NAME,
) -> DataFrame:
    """Request body per conversation: messages in order, then sampling fields.

    Collects one conversation's kept messages; the budget bounds what is
    kept, and the order key travels with the struct so the order never
    depends on ``collect_list``.
    """
    msgs = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
    )
    grouped = truncated.groupBy("conv_id").agg(
        msgs.alias("messages"),
        F.sum("tokens").alias("request_tokens"),
    )
    body = F.to_json(
        F.struct(
            F.lit(model_name).alias("model"),
            F.col("messages"),
            F.lit(config.TEMPERATURE).alias("temperature"),
            F.lit(config.TOP_P).alias("top_p"),
            F.lit(config.TOP_K).alias("top_k"),
            F.lit(config.MIN_P).alias("min_p"),
            F.lit(True).alias("logprobs"),
            F.struct(F.lit(False).alias("enable_thinking")).alias("chat_template_kwargs"),
        )
    )
    return grouped.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_messages"),
        "request_tokens",
        body.alias("body"),
        "messages",
    )
