"""Completion tables -> typed actions.

``completions``: one model output per row with the active document's path
and line statistics. Parsing is a single projection of native expressions
(``functions.commands``); attaching documents is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.commands import may_hold_form, with_action, with_edit, with_edit_action
from ..functions.jscompat import last_line_len, line_count


def parse_completions(completions: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``action`` (null when the output holds no usable command)."""
    return with_action(completions, raw=raw)


def document_stats(documents: DataFrame) -> DataFrame:
    """``(path, line_count, last_line_len)`` per document. Computed before any
    join so the join moves three small columns instead of whole texts."""
    return documents.select(
        "path",
        line_count(F.col("text")).cast("int").alias("line_count"),
        last_line_len(F.col("text")).cast("int").alias("last_line_len"),
    )


def attach_documents(completions: DataFrame, documents: DataFrame) -> DataFrame:
    """Left join completions to their active document by exact path.

    No broadcast hint: the document table grows with the data. AQE turns the
    join into a broadcast at run time when the measured side is small, and
    splits a hot path (one file with many completions) as a skewed partition.
    A completion whose path is unknown keeps null statistics; its sed and view
    commands then match nothing and fall through to the terminal branch only
    if the path itself is null.
    """
    return completions.join(document_stats(documents), completions["active_path"] == F.col("path"), "left").drop(
        "path"
    )


def edits_on_documents(completions: DataFrame, documents: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """Completions that are a sed edit of one of the ``forms`` (delete, replace,
    insert, append) on their active document, with its ``text`` and the ``action``.

    The form and the parts of the edit depend on the completion alone, so each is parsed
    once, before the join, and other completions go there. The join is the only one: the
    documents are read once and give text and line statistics together. Columns of
    ``completions`` named like these are replaced."""
    keep = [c for c in completions.columns if c not in ("line_count", "last_line_len", "text", "path")]
    # Most outputs hold no such edit at a glance. Out of a generator, or the text is made again
    # for the look.
    others = [c for c in keep if c != "raw"]
    looked = completions.select(*others, F.inline(F.array(F.struct("raw")))).where(may_hold_form(F.col("raw"), forms))
    # Out of a generator, so that the filter stays above the chain (see ``with_action``).
    edits = with_edit(looked.select(*keep), "__edit").where(F.col("__edit.form").isin(*forms))
    docs = documents.select(
        "path", "text",
        line_count(F.col("text")).cast("int").alias("line_count"),
        last_line_len(F.col("text")).cast("int").alias("last_line_len"),
    )
    joined = edits.join(docs, F.col("active_path") == F.col("path")).drop("path")
    return with_edit_action(joined, "__edit", forms)


def action_mix(parsed: DataFrame) -> DataFrame:
    """Count of parsed actions by kind (``none`` when nothing parsed)."""
    return parsed.groupBy(F.coalesce(F.col("action.kind"), F.lit("none")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )
