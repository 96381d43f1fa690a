"""Per-user session state from the interaction-event log.

The editor keeps module-level mutable state (context epoch, activated files,
enabled and suppression flags, the pending suggestion). Here each becomes a
running aggregate over one user's events in ``(ts, seq)`` order, computed by
the sliced two-level scan of ``operators.scan`` so a very active user is
split across many tasks. Event times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from .scan import event_slice, ordered_scan, with_next

KEYS = ["user_id"]
ORDER = ["ts", "seq"]
# Events that decide the pending suggestion; all but ``accept`` reject it.
DECIDED = ("accept", "reject", "dismiss")


def _slice(slice_ms: int):
    return event_slice("ts", slice_ms)


def session_state(
    events: DataFrame,
    slice_ms: int = config.EVENT_SLICE_MS,
) -> DataFrame:
    """Add ``epoch`` (clears so far), ``enabled`` (suggestions on after this
    event) and ``suppressed`` (auto-preview suppressed after this event), all
    from one sliced scan, i.e. one shuffle of the event log.

    * a ``clear`` starts a new epoch (it belongs to the new one);
    * every ``toggle`` flips ``enabled``, which starts true;
    * ``reject``, ``dismiss`` and a toggle that turns suggestions off set the
      suppression flag; ``selection``, ``tab`` and ``content`` clear it.
    """
    kind = F.col("kind")
    flag = F.when(kind.isin("reject", "dismiss"), F.lit(True)).when(kind.isin("selection", "tab", "content"), F.lit(False))
    scanned = ordered_scan(
        events,
        KEYS,
        ORDER,
        _slice(slice_ms),
        running_sums={
            "epoch": (kind == "clear").cast("long"),
            "__toggles": (kind == "toggle").cast("long"),
        },
        # After an odd number of toggles suggestions are off: that toggle suppresses.
        switched_lasts={"suppressed": ("__toggles", flag, F.when(kind == "toggle", F.lit(True)).otherwise(flag))},
    )
    enabled = (F.col("__toggles") % 2) == 0
    return scanned.withColumn("enabled", enabled).withColumn("suppressed", F.coalesce("suppressed", F.lit(False))).drop("__toggles")


def context_epoch(events: DataFrame, slice_ms: int = config.EVENT_SLICE_MS) -> DataFrame:
    """Add ``epoch``: the number of ``clear`` events up to and including the row."""
    return ordered_scan(
        events, KEYS, ORDER, _slice(slice_ms), running_sums={"epoch": (F.col("kind") == "clear").cast("long")}
    )


def first_activation(tabs: DataFrame) -> DataFrame:
    """Add ``is_first``: the first tab event of a file within a user's epoch.

    A grouped ``min`` (combined map-side, so a hot user or file is cheap)
    joined back on ``(user, epoch, file)``; no window over a user.
    """
    place = tabs.withColumn("__file", F.struct("user_id", "epoch", "file"))  # never null itself
    firsts = place.groupBy("__file").agg(F.min(F.struct(*ORDER)).alias("__first"))
    return place.join(firsts, "__file").withColumn("is_first", F.struct(*ORDER) == F.col("__first")).drop("__file", "__first")


def trigger_gate(state: DataFrame) -> DataFrame:
    """Add ``passes``: a trigger event schedules a refresh only when
    suggestions are enabled, auto-preview is not suppressed, an editor with a
    non-empty document is active and the window has focus. The triggering
    event itself already cleared the suppression flag."""
    return state.withColumn(
        "passes",
        F.col("enabled")
        & ~F.col("suppressed")
        & F.coalesce(F.col("has_editor"), F.lit(True))
        & F.coalesce(F.col("focused"), F.lit(True))
        & (F.coalesce(F.col("doc_chars"), F.lit(0)) > 0),
    )


def latest_wins(requests: DataFrame, slice_ms: int = config.EVENT_SLICE_MS) -> DataFrame:
    """Add ``next_request_ts`` and ``was_shown``: a response is shown only if
    no newer request of the same user started before it returned."""
    nxt = with_next(requests, KEYS, ORDER, _slice(slice_ms), "ts", "next_request_ts")
    return nxt.withColumn(
        "was_shown", F.col("next_request_ts").isNull() | (F.col("next_request_ts") > F.col("response_ts"))
    )


def resolve_outcomes(
    decisions: DataFrame,
    include_pending: bool = False,
    slice_ms: int = config.EVENT_SLICE_MS,
) -> DataFrame:
    """Label every shown suggestion accepted / rejected / ignored.

    ``decisions``: ``(user_id, ts, seq, kind)`` with kind ``shown``, ``accept``,
    ``reject`` or ``dismiss`` (other rows are ignored). Rules: a new ``shown`` row
    labels the pending one ``ignored`` at its own time; the first accept, reject
    or dismiss (a rejection) after a shown row labels it and clears it; later decisions do nothing. A
    sample still pending at the end is emitted only with ``include_pending``
    (outcome null).

    Plan: among shown and deciding rows alone, the row that follows a shown one
    settles it, so a sliced ``lead`` answers: a slice tells the one before it only
    its first row. No per-user window and no join of samples with themselves.
    """
    kind = F.col("kind")
    d = decisions.where(kind.isin("shown", *DECIDED)).select("user_id", "ts", "seq", "kind")
    d = d.withColumn("__row", F.struct("kind", "ts"))
    shown = with_next(d, KEYS, ORDER, _slice(slice_ms), "__row", "__next").where(kind == "shown")
    after = F.col("__next.kind")
    outcome = F.when(after == "accept", "accepted").when(after == "shown", "ignored").when(after.isNotNull(), "rejected")
    out = shown.select(
        "user_id",
        F.col("seq").alias("shown_seq"),
        F.col("ts").alias("shown_ts"),
        outcome.alias("outcome"),
        F.col("__next.ts").alias("outcome_ts"),
    )
    return out if include_pending else out.where(F.col("outcome").isNotNull())


def terminal_transcript(outputs: DataFrame) -> DataFrame:
    """Output chunks of one terminal command in arrival order, joined.

    ``outputs``: ``(execution_id, ts, seq, text)``. The transcript of one
    command is the unit the report needs; chunks travel with their order key
    and are sorted before joining, so ``collect_list`` order never matters.
    """
    chunks = F.array_sort(F.collect_list(F.struct("ts", "seq", "text")))
    return outputs.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(F.transform(chunks, lambda c: c["text"]), "").alias("transcript"),
    )


def transcript_pages(
    outputs: DataFrame,
    page_chars: int = config.TRANSCRIPT_PAGE_CHARS,
    slice_ms: int = config.EVENT_SLICE_MS,
) -> DataFrame:
    """``execution_id, page, n_chunks, text``: the transcript of each command cut
    into pages of ``page_chars`` characters (the last is shorter); the texts of all
    pages in order are ``terminal_transcript``'s. ``n_chunks`` counts the chunks that
    start on the page. Null and empty chunks count on the page of the text before
    them; a command with no other chunk has one empty page.

    A sliced running sum of the lengths gives each chunk its offset, and a chunk is
    cut at the page borders it crosses, so no task holds more of a command than a
    page, whatever the command's output.
    """
    size = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    s = ordered_scan(outputs, ["execution_id"], ORDER, _slice(slice_ms), running_sums={"__end": size})
    s = s.withColumn("__from", F.col("__end") - size)
    begin, end, last = F.col("__from"), F.col("__end"), F.greatest(F.col("__end") - 1, F.lit(0))
    page_of = lambda c: F.floor(c / F.lit(page_chars)).cast("long")
    first = F.when(end > begin, page_of(begin)).otherwise(page_of(last))
    pieces = s.select(
        "execution_id", "text", "__from", "__end", first.alias("__first"), F.explode(F.sequence(first, page_of(last))).alias("page")
    )
    a = F.greatest(F.col("page") * page_chars, begin)
    b = F.least((F.col("page") + 1) * page_chars, end)
    cut = F.substr("text", (a - begin + 1).cast("int"), (b - a).cast("int"))
    # ``collect_list`` leaves nulls out: empty chunks cost a page nothing.
    piece = F.when(b > a, F.struct(a.alias("at"), cut.alias("text")))
    return pieces.groupBy("execution_id", "page").agg(
        F.sum((F.col("page") == F.col("__first")).cast("long")).alias("n_chunks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda c: c["text"]), "").alias("text"),
    )


def attach_to_last_command(events: DataFrame, slice_ms: int = config.EVENT_SLICE_MS) -> DataFrame:
    """Give output rows without an execution id the id of the user's last
    terminal command before them (sliced as-of scan)."""
    cmd_id = F.when(F.col("kind") == "terminal_command", F.col("execution_id"))
    s = ordered_scan(events, KEYS, ORDER, _slice(slice_ms), running_lasts={"__last_cmd": cmd_id})
    return s.withColumn("execution_id", F.coalesce(F.col("execution_id"), F.col("__last_cmd"))).drop("__last_cmd")


def session_state_asof(actions: DataFrame, slice_ms: int = config.EVENT_SLICE_MS) -> DataFrame:
    """Editor state after each executed action: ``active_file``,
    ``cursor_line``, ``terminal_text`` (typed, not submitted) as of the row.

    ``actions``: ``(user_id, ts, seq, action)``. Each action sets what it
    changes; the rest carries over (sliced last-non-null scan). A cursor line
    belongs to its file: opening a file without a selection sets it to null.
    """
    a = F.col("action")
    k = a["kind"]
    line = F.get(a["selections"], 0)["start"]["line"].cast("long")
    sets_cursor = (k == "openFile") | ((k == "setSelections") & line.isNotNull())
    out = ordered_scan(
        actions,
        KEYS,
        ORDER,
        _slice(slice_ms),
        running_lasts={
            "active_file": F.when(k == "openFile", a["filePath"]),
            "__cursor": F.when(sets_cursor, F.struct(line.alias("line"))),
            "terminal_text": F.when(k == "terminalSendText", a["text"]),
        },
    )
    return out.withColumn("cursor_line", F.col("__cursor.line")).drop("__cursor")
