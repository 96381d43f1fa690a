"""Interaction-event sources: per-kind feeds into one long event table.

Each feed has only its own columns; ``unionByName(allowMissingColumns=True)``
lines them up into ``schemas.EVENT``. A session-start feed adds the editor
that is already active when a session begins as a tab event with full text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import EVENT

_COLUMNS = [f.name for f in EVENT.fields]


def event_union(*feeds: DataFrame) -> DataFrame:
    """Union of per-kind feeds, every column of ``EVENT`` present (null where
    a kind has no such field), cast to the declared types."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    for c in _COLUMNS:
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None))
    return u.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def first_selection(selections: DataFrame, sel_col: str = "selections") -> DataFrame:
    """Selection events keep only the first selection's start offset, and only
    when they come from the active editor."""
    return selections.where(F.col("is_active_editor")).withColumn("offset", F.get(F.col(sel_col), 0)["start"]).drop(
        sel_col, "is_active_editor"
    )


def explode_changes(content: DataFrame, changes: str = "changes") -> DataFrame:
    """One content event per change of a batch, for the active document only;
    ``change_idx`` keeps the delivery order inside the batch."""
    keep = [c for c in content.columns if c not in (changes, "is_active_document")]
    return (
        content.where(F.col("is_active_document"))
        .select(*keep, F.posexplode(F.col(changes)).alias("change_idx", "__c"))
        .select(*keep, F.col("change_idx").cast("long").alias("change_idx"), "__c.offset", "__c.length", "__c.text")
    )


def session_start(events: DataFrame, initial_file: F.Column, initial_text: F.Column | None = None) -> DataFrame:
    """One tab event per user at the start of the session (before its first
    event): a grouped min, no window."""
    first = events.groupBy("user_id").agg(F.min("ts").alias("ts"))
    return first.select(
        "user_id",
        "ts",
        F.lit(-1).cast("long").alias("seq"),
        F.lit("tab").alias("kind"),
        initial_file.alias("file"),
        (initial_text if initial_text is not None else F.lit(None).cast("string")).alias("text"),
    )


def with_first_text(tabs: DataFrame, documents: DataFrame) -> DataFrame:
    """Tab events with ``text``: the first one of each file of a user carries the
    file's text (null for a file that is no document), the others none.
    ``documents``: ``(path, text)``. Only first events go into the join."""
    from ..operators.sessions import first_activation

    marked = first_activation(tabs.drop("text").withColumn("epoch", F.lit(0))).drop("epoch")
    texts = documents.select(F.col("path").alias("__path"), "text")
    here = F.when(F.col("is_first"), F.col("file"))
    return marked.join(texts, here == F.col("__path"), "left").drop("__path", "is_first")
