"""Registered queries: ``name -> fn(spark, base_dir) -> DataFrame``.

Each query reads the driver tables (or data Spark derives from them), runs
one operator of the library over the whole input and returns flat scalar
columns whose names match the DuckDB oracle in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands as cm
from ..functions import display as dsp
from ..functions.positions import to_points, unit_count, utf16
from ..operators import actions as act
from ..operators import diffs as df_
from ..operators import edits as ed
from ..operators import messages as msg
from ..operators import responses as rsp
from ..operators import preferences as pref
from ..operators import sessions as ses
from ..operators import triggers as trg
from ..session import materialize, scratch_path
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed test parameter (FIXTURES.md): a 500-token budget splits the driver's
# conversations into fitting and truncated ones.
TEST_BUDGET = 500


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@query("role_normalize")
def q_role_normalize(spark, base):
    m = fx.messages(spark, base)
    return msg.role_normalize(m).groupBy("role").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(F.length("content")).cast("long").alias("n_chars")
    )


@query("conversation_tokens")
def q_conversation_tokens(spark, base):
    return msg.conversation_tokens(fx.messages(spark, base))


@query("truncate_context")
def q_truncate_context(spark, base):
    return msg.truncate_context(fx.messages(spark, base), max_tokens=TEST_BUDGET)


# -- command parsing over the completions fixture ---------------------------

KEY = ["l_orderkey", "l_linenumber"]


def _completions(spark, base):
    return fx.completions(spark, base)


@query("extract_command")
def q_extract_command(spark, base):
    c = cm.with_command(_completions(spark, base).select(*KEY, "raw"), out="cmd", extracted="extracted")
    return c.select(*KEY, F.col("extracted").alias("command"))


@query("strip_think")
def q_strip_think(spark, base):
    return cm.with_command(_completions(spark, base).select(*KEY, "raw")).select(*KEY, "command")


@query("sanitize_command")
def q_sanitize_command(spark, base):
    c = cm.with_command(_completions(spark, base).select(*KEY, "raw"))
    return c.select(*KEY, cm.sanitize_command(F.col("command")).alias("command"))


def _parsed(spark, base):
    return act.parse_completions(_completions(spark, base))


def _edit_kind(form):
    def run(spark, base):
        parsed = _parsed(spark, base)
        return parsed.where((F.col("sed_form") == form) & (F.col("route") == "edit")).select(
            *KEY, *cm.action_columns(F.col("action"))
        )

    return run


QUERIES["parse_edit_delete"] = _edit_kind("delete")
QUERIES["parse_edit_replace"] = _edit_kind("replace")
QUERIES["parse_edit_insert"] = _edit_kind("insert")
QUERIES["parse_edit_append"] = _edit_kind("append")


@query("parse_view")
def q_parse_view(spark, base):
    parsed = _parsed(spark, base).where(F.col("route") == "view")
    return parsed.select(*KEY, *cm.action_columns(F.col("action")))


@query("route_action")
def q_route_action(spark, base):
    return _parsed(spark, base).select(*KEY, *cm.action_columns(F.col("action")))


@query("action_mix")
def q_action_mix(spark, base):
    return act.action_mix(_parsed(spark, base))


@query("action_doc_join")
def q_action_doc_join(spark, base):
    c = _completions(spark, base).drop("line_count", "last_line_len")
    joined = act.attach_documents(c, fx.documents(spark, base))
    parsed = act.parse_completions(joined)
    return parsed.select(*KEY, "line_count", "last_line_len", *cm.action_columns(F.col("action")))



# -- responses ------------------------------------------------------------


def _avg_out(c):
    """Rounded mean for comparison; NaN (empty token list) shown as null."""
    return F.when(~F.isnan(c), F.round(c, 6)).alias("avg_logprob")


@query("response_text")
def q_response_text(spark, base):
    return rsp.with_scores(fx.responses(spark, base)).select("request_id", "text")


@query("avg_logprob")
def q_avg_logprob(spark, base):
    sc = rsp.with_scores(fx.responses(spark, base))
    return sc.select("request_id", "n_tokens", _avg_out(F.col("avg_logprob")))


@query("response_logprob")
def q_response_logprob(spark, base):
    t = fx.token_logprobs(spark, base)
    out = rsp.avg_logprob_tokens(t, "request_id", "logprob_centi")
    return out.select("request_id", "n_tokens", F.round(F.col("avg_logprob") / 100, 6).alias("avg_logprob"))


@query("confidence_gate")
def q_confidence_gate(spark, base):
    sc = rsp.with_scores(fx.responses(spark, base))
    return rsp.confidence_gate(sc).select("request_id", _avg_out(F.col("avg_logprob")))


@query("parse_status")
def q_parse_status(spark, base):
    p = rsp.parse_responses(fx.responses(spark, base))
    return p.select("request_id", "model_name", "parse_status", F.col("action.kind").alias("kind"))



# -- session state ----------------------------------------------------------


def _state(spark, base):
    return ses.session_state(fx.session_events(spark, base))


@query("context_epoch")
def q_context_epoch(spark, base):
    return ses.context_epoch(fx.session_events(spark, base)).select("user_id", "seq", "kind", "epoch")


@query("suppress_state")
def q_suppress_state(spark, base):
    return _state(spark, base).select("user_id", "seq", "kind", "epoch", "enabled", "suppressed")


def _doc_chars(spark, base):
    d = fx.documents(spark, base)
    return d.select(F.col("path").alias("file"), F.length("text").cast("long").alias("doc_chars"))


@query("first_activation")
def q_first_activation(spark, base):
    # The editor that is active when the session starts is a tab event before all others.
    from ..sources.events import session_start

    events = fx.session_events(spark, base)
    events = events.unionByName(session_start(events, fx.user_file(0)).drop("text"), allowMissingColumns=True)
    tabs = ses.session_state(events).where(F.col("kind") == "tab")
    docs = fx.documents(spark, base).select(F.col("path").alias("doc_file"), "text")
    fa = ses.first_activation(tabs)
    # Only first rows carry the file's text.
    fa = fa.join(docs, (F.col("file") == F.col("doc_file")) & F.col("is_first"), "left")
    return fa.select("user_id", "seq", "file", "epoch", "is_first", "text", F.length("text").cast("long").alias("n_chars"))


@query("trigger_gate")
def q_trigger_gate(spark, base):
    triggers = _state(spark, base).where(F.col("kind").isin("selection", "tab", "content"))
    g = ses.trigger_gate(triggers.join(_doc_chars(spark, base), "file", "left"))
    return g.select("user_id", "seq", "enabled", "suppressed", "passes")


@query("latest_wins")
def q_latest_wins(spark, base):
    lw = ses.latest_wins(fx.requests(spark, base))
    return lw.select("user_id", "seq", "ts", "response_ts", "next_request_ts", "was_shown")


@query("outcome_resolve")
def q_outcome_resolve(spark, base):
    return ses.resolve_outcomes(fx.decisions(spark, base, kinds=("shown", "accept", "reject")))



# -- preference log and training tables ---------------------------------------


def _samples(spark, base, include_pending=False, with_context=True):
    # ``shown`` carries the whole response-parse chain and is read three
    # times downstream (outcome scan, its slice totals, sample details), so it
    # is written once to the shared checkpoint folder; so are the samples,
    # which the pair and state jobs scan twice.
    parsed = rsp.parse_responses(fx.view_requests(spark, base))
    shown = materialize(fx.shown_suggestions(parsed), "shown")
    # Only jobs that use the context join it.
    contexts = pref.context_arrays(msg.truncate_context(fx.messages(spark, base))) if with_context else None
    decided = fx.decisions(spark, base, kinds=("accept", "reject"))
    samples = pref.preference_samples(shown, decided, contexts, include_pending)
    return materialize(samples, "samples")


@query("outcome_report")
def q_outcome_report(spark, base):
    return pref.outcome_report(_samples(spark, base, with_context=False))


@query("preference_log_roundtrip")
def q_preference_log_roundtrip(spark, base):
    import uuid

    path = scratch_path(spark, f"preferences-{uuid.uuid4().hex}")
    pref.write_preferences(_samples(spark, base), path)
    back, _bad = pref.read_preferences(spark, path)
    a = F.col("completion.parsedAction")
    return back.select(
        "timestamp", "outcome", "outcomeTimestamp", "modelName",
        F.size("context").cast("long").alias("n_context"),
        *cm.action_columns(a),
        F.round(F.col("completion.avgLogprob"), 6).alias("avg_logprob"),
        F.col("completion.rawModelOutput").alias("raw"),
    )


@query("reward_labels")
def q_reward_labels(spark, base):
    return pref.reward_labels(_samples(spark, base))


@query("dpo_pairs")
def q_dpo_pairs(spark, base):
    return pref.dpo_pairs(_samples(spark, base))



# -- positions, edit application, viewports ----------------------------------


def _docs_with_len(spark, base):
    return fx.documents(spark, base).withColumn("n", F.length("text").cast("long"))


@query("offset_to_position")
def q_offset_to_position(spark, base):
    d = _docs_with_len(spark, base).withColumn("o_mid", F.floor(F.col("n") / 2)).withColumn("o_end", F.col("n"))
    p = ed.offsets_to_positions(d, "text", {"p_mid": "o_mid", "p_end": "o_end"})
    return p.select(
        "doc_id",
        F.col("p_mid.line").cast("long").alias("line_mid"), F.col("p_mid.ch").cast("long").alias("ch_mid"),
        F.col("p_end.line").cast("long").alias("line_end"), F.col("p_end.ch").cast("long").alias("ch_end"),
    )


@query("position_to_offset")
def q_position_to_offset(spark, base):
    from ..functions.jscompat import line_count

    d = (
        fx.documents(spark, base)
        .withColumn("lc", line_count(F.col("text")))
        .withColumn("l_mid", F.floor(F.col("lc") / 2).cast("int"))
        .withColumn("c3", F.lit(3))
        .withColumn("l_past", F.col("lc") + 5)
        .withColumn("c0", F.lit(0))
        .withColumn("l1", F.lit(1))
        .withColumn("c_big", F.lit(1_000_000))
    )
    o = ed.positions_to_offsets(
        d, "text", {"off_mid": ("l_mid", "c3"), "off_past": ("l_past", "c0"), "off_clamp": ("l1", "c_big")}
    )
    return o.select("doc_id", "off_mid", "off_past", "off_clamp")


@query("utf16_positions")
def q_utf16_positions(spark, base):
    """Offsets as an editor logs them, in UTF-16 units, in texts with characters of two units."""
    d = fx.astral_documents(spark, base).withColumn("n_units", unit_count(utf16(F.col("text"))))
    d = d.withColumn("o_mid", F.floor(F.col("n_units") / 2)).withColumn("points", to_points(utf16(F.col("text")), F.col("o_mid")))
    d = ed.offsets_to_positions(d, "text", {"p": "o_mid"}, utf16_units=True)
    d = d.withColumn("line", F.col("p.line")).withColumn("ch", F.col("p.ch"))
    d = ed.positions_to_offsets(d, "text", {"back": ("line", "ch")}, utf16_units=True)
    return d.select("doc_id", "n_units", "points", F.col("line").cast("long").alias("line"), F.col("ch").cast("long").alias("ch"), "back")


def _applied(spark, base, *forms):
    edits = act.edits_on_documents(_completions(spark, base), fx.documents(spark, base), forms)
    out = ed.apply_action(edits.where(F.col("action").isNotNull()), changed="changed")
    return out.select(
        *KEY,
        F.length("new_text").cast("long").alias("new_len"),
        F.md5(F.col("new_text")).alias("new_md5"),
        dsp.significant_diff(F.col("text"), F.col("new_text"), F.col("changed")).alias("significant"),
    )


QUERIES["apply_insert"] = lambda spark, base: _applied(spark, base, "insert", "append")
QUERIES["apply_delete"] = lambda spark, base: _applied(spark, base, "delete")
QUERIES["apply_replace"] = lambda spark, base: _applied(spark, base, "replace")


@query("viewport_lines")
def q_viewport_lines(spark, base):
    from ..functions.jscompat import line_count

    d = fx.documents(spark, base).withColumn("cursor_line", F.floor(line_count(F.col("text")) / 2).cast("int"))
    v = ed.viewport_lines(d.select("doc_id", "text", "cursor_line"))
    return v.select("doc_id", "line_no", F.length("line").cast("long").alias("line_len"), F.md5("line").alias("line_md5"))


# -- display strings -----------------------------------------------------


@query("truncate_text")
def q_truncate_text(spark, base):
    m = fx.messages(spark, base)
    return m.select("conv_id", "turn", dsp.truncate_text(F.col("content"), 60).alias("t60"),
                    dsp.display_text(F.col("content"), 80).alias("d80"))


@query("path_basename")
def q_path_basename(spark, base):
    p = _parsed(spark, base).where(F.col("action.kind") == "openFile")
    return p.select(*KEY, dsp.path_basename(F.col("action.filePath")).alias("base_name"))


def _display_cols(a):
    vis = F.get(a["selections"], 0)["start"]["line"] <= 20
    desc = dsp.action_description(a)
    return [
        dsp.action_summary(a).alias("summary"),
        dsp.action_detail(a).alias("detail"),
        dsp.action_label(a, vis).alias("label"),
        desc["title"].alias("title"),
        desc["body"].alias("body"),
        desc["hint"].alias("hint"),
    ]


@query("action_summary")
def q_action_summary(spark, base):
    return _parsed(spark, base).select(*KEY, *_display_cols(F.col("action"))[:1])


@query("action_detail")
def q_action_detail(spark, base):
    return _parsed(spark, base).select(*KEY, *_display_cols(F.col("action"))[1:2])


@query("action_label")
def q_action_label(spark, base):
    return _parsed(spark, base).select(*KEY, *_display_cols(F.col("action"))[2:3])


@query("action_description")
def q_action_description(spark, base):
    return _parsed(spark, base).select(*KEY, *_display_cols(F.col("action"))[3:])



# -- revision diffs ------------------------------------------------------------


def _doc_parsed(spark, base):
    c = _completions(spark, base).drop("line_count", "last_line_len")
    return act.parse_completions(act.attach_documents(c, fx.documents(spark, base)))


def _revisions(spark, base):
    """Replacement actions on their documents: ``old_text`` is the whole
    replaced range, ``new_text`` the replacement. Only replacements carry
    document text into the join and the diff."""
    edits = act.edits_on_documents(_completions(spark, base), fx.documents(spark, base), ("replace",))
    withtext = edits.where(F.col("action.kind") == "editReplace")
    a = F.col("action")
    o = ed.positions_to_offsets(
        withtext.withColumn("__sl", a["range"]["start"]["line"]).withColumn("__sc", a["range"]["start"]["ch"])
        .withColumn("__el", a["range"]["end"]["line"]).withColumn("__ec", a["range"]["end"]["ch"]),
        "text",
        {"__o1": ("__sl", "__sc"), "__o2": ("__el", "__ec")},
    )
    o = (
        o.withColumn("range_start", F.least("__o1", "__o2"))
        .withColumn("old_text", F.substr(F.col("text"), F.col("range_start") + 1, F.abs(F.col("__o2") - F.col("__o1"))))
        .withColumn("new_text", a["text"])
        .drop("__sl", "__sc", "__el", "__ec", "__o1", "__o2")
    )
    return o


def _replacements(spark, base):
    return df_.with_diff_facts(df_.revision_diff(_revisions(spark, base)))


@query("revision_diff_totals")
def q_revision_diff_totals(spark, base):
    r = df_.revision_lengths(_revisions(spark, base))
    lcs = F.col("lcs_len")
    return r.select(
        *KEY, lcs.alias("equal_chars"),
        (F.length("old_text") - lcs).cast("long").alias("delete_chars"),
        (F.length("new_text") - lcs).cast("long").alias("insert_chars"),
    )


@query("diff_regions")
def q_diff_regions(spark, base):
    return _replacements(spark, base).select(*KEY, "regions")


@query("diff_flags")
def q_diff_flags(spark, base):
    return _replacements(spark, base).select(*KEY, "has_deletion", "has_insertions")


@query("coherent_replacement")
def q_coherent_replacement(spark, base):
    r = df_.to_positions(
        df_.with_range(_replacements(spark, base)),
        {"__ds": F.col("coherent.del_start"), "__de": F.col("coherent.del_end")},
    )
    return r.select(
        *KEY, F.col("coherent.is_coherent").alias("is_coherent"),
        F.when(F.col("coherent.is_coherent"), F.col("__ds.line")).cast("long").alias("del_start_line"),
        F.when(F.col("coherent.is_coherent"), F.col("__ds.ch")).cast("long").alias("del_start_ch"),
        F.when(F.col("coherent.is_coherent"), F.col("__de.line")).cast("long").alias("del_end_line"),
        F.when(F.col("coherent.is_coherent"), F.col("__de.ch")).cast("long").alias("del_end_ch"),
        F.col("coherent.text").alias("text"),
    )


@query("pure_insertion")
def q_pure_insertion(spark, base):
    r = df_.to_positions(df_.with_range(_replacements(spark, base)), {"__at": F.col("pure.at")})
    return r.select(
        *KEY, F.col("pure.is_pure").alias("is_pure"),
        F.when(F.col("pure.is_pure"), F.col("__at.line")).cast("long").alias("line"),
        F.when(F.col("pure.is_pure"), F.col("__at.ch")).cast("long").alias("ch"),
        F.col("pure.text").alias("text"),
    )


@query("deletion_ranges")
def q_deletion_ranges(spark, base):
    # A row of a deleted run carries the replaced range alone, not the document.
    r = df_.deletion_offsets(df_.with_range(_replacements(spark, base)).select(*KEY, "__base", "__range", "segments"))
    r = df_.to_positions(r, {"__s": F.col("del_start"), "__e": F.col("del_end")})
    return r.select(*KEY, "idx", F.col("__s.line").cast("long").alias("start_line"), F.col("__s.ch").cast("long").alias("start_ch"),
                    F.col("__e.line").cast("long").alias("end_line"), F.col("__e.ch").cast("long").alias("end_ch"))


@query("preview_class")
def q_preview_class(spark, base):
    # Replacements need their diff facts; every other kind is classified from
    # the action alone. Two disjoint branches, one union, no join.
    cl = df_.preview_class(F.col("action"), F.floor(F.col("line_count") / 2), F.lit(0))
    out = [F.col(k) for k in KEY] + [F.col("action.kind").alias("kind"), cl.alias("preview_class")]
    others = (
        _doc_parsed(spark, base)
        .where(~((F.col("route") == "edit") & (F.col("action.kind") == "editReplace")) | F.col("route").isNull())
        .withColumn("pure", F.lit(None).cast("struct<is_pure:boolean>"))
        .withColumn("has_insertions", F.lit(None).cast("boolean"))
        .withColumn("coherent", F.lit(None).cast("struct<is_coherent:boolean>"))
        .withColumn("has_deletion", F.lit(None).cast("boolean"))
        .withColumn("old_text", F.lit(None).cast("string"))
    )
    return others.select(*out).unionByName(_replacements(spark, base).select(*out))



# -- trigger coalescing and streams --------------------------------------------


@query("coalesce_triggers")
def q_coalesce_triggers(spark, base):
    return trg.coalesce_triggers(fx.trigger_events(spark, base))


def _stream(spark, base, fold, mapping, build):
    """The rows of a fold over the events stream, run to the end of the input."""
    from ..streaming.ordered import split_late
    from ..streaming.runner import run_to_end

    out = run_to_end(spark, fx.event_stream(spark, base), lambda ev: build(mapping(ev)), build.__name__)
    return split_late(out, fold, "user_id")[0]


@query("stream_outcomes")
def q_stream_outcomes(spark, base):
    from ..streaming.state import Outcomes, stream_outcomes

    return _stream(spark, base, Outcomes(), fx.decisions_from, stream_outcomes)


@query("stream_first_activation")
def q_stream_first_activation(spark, base):
    from ..streaming.state import Activations, stream_first_activation

    return _stream(spark, base, Activations(), fx.session_events_from, stream_first_activation)


#: No response of the fixture takes longer: ``value`` x 100 s, values below 1,000.
MAX_LATENCY_MS = 1000 * fx.LATENCY_MS_PER_VALUE


@query("stream_latest_wins")
def q_stream_latest_wins(spark, base):
    """The request decisions of ``latest_wins`` on a stream, run to its end."""
    from ..streaming.feeds import stream_latest_wins
    from ..streaming.runner import run_to_end

    def decided(ev):
        requests = fx.requests_from(fx.session_events_from(ev).withColumn("seq", F.when(F.col("kind") == "shown", F.col("seq"))))
        return stream_latest_wins(requests, max_latency_ms=MAX_LATENCY_MS)

    return run_to_end(spark, fx.event_stream(spark, base), decided, "stream_latest_wins")


@query("stream_event_union")
def q_stream_event_union(spark, base):
    """``event_union`` over a stream of the events, run to its end."""
    from ..streaming.feeds import stream_event_union
    from ..streaming.runner import run_to_end

    documents = fx.documents(spark, base).select("path", "text")

    def union(ev):
        ticks = fx.session_events_from(ev).where("kind IS NULL")
        return stream_event_union(fx.editor_feeds_from(ev), fx.user_file(0), documents, ticks)[0]

    return run_to_end(spark, fx.event_stream(spark, base), union, "stream_event_union")


# -- event sources, transcripts, state as of, request bodies -------------------


def _event_union(spark, base):
    from ..sources import events as evs

    feeds = fx.editor_feeds(spark, base)
    every = reduce(DataFrame.unionByName, [f.select("user_id", "ts") for f in feeds.values()])
    start = evs.session_start(
        every,
        fx.user_file(0),
    )
    tabs = evs.with_first_text(start.unionByName(feeds["tab"], allowMissingColumns=True), fx.documents(spark, base))
    return evs.event_union(
        evs.first_selection(feeds["selection"]), tabs, evs.explode_changes(feeds["content"]),
        feeds["terminal_command"], feeds["terminal_output"],
    )


@query("event_union")
def q_event_union(spark, base):
    return _event_union(spark, base)


@query("explode_changes")
def q_explode_changes(spark, base):
    from ..sources import events as evs

    c = evs.explode_changes(fx.editor_feeds(spark, base)["content"])
    return c.select("user_id", "seq", "change_idx", F.col("offset").cast("long").alias("offset"),
                    F.col("length").cast("long").alias("length"), "text")


@query("replay_edits")
def q_replay_edits(spark, base):
    from ..operators.replay import replay_edits
    from ..sources import events as evs

    edits = evs.explode_changes(fx.editor_feeds(spark, base)["content"])
    bases = fx.documents(spark, base).select(F.col("path").alias("file"), "text")
    r = replay_edits(edits, bases)
    return r.select("file", "n_edits", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


# Fixed test parameter: short pages, so that the short outputs of the fixture cross their borders.
TEST_PAGE_CHARS = 8


def _terminal_outputs(spark, base):
    ev = ses.attach_to_last_command(
        _event_union(spark, base).where(F.col("kind").isin("terminal_command", "terminal_output"))
    )
    return ev.where((F.col("kind") == "terminal_output") & F.col("execution_id").isNotNull())


@query("terminal_transcript")
def q_terminal_transcript(spark, base):
    return ses.terminal_transcript(_terminal_outputs(spark, base))


@query("transcript_pages")
def q_transcript_pages(spark, base):
    return ses.transcript_pages(_terminal_outputs(spark, base), page_chars=TEST_PAGE_CHARS)


@query("session_state_asof")
def q_session_state_asof(spark, base):
    acc = _samples(spark, base).where(F.col("outcome") == "accepted").select(
        "user_id", F.col("outcomeTimestamp").alias("ts"), F.col("sample_id").alias("seq"),
        F.col("completion.parsedAction").alias("action"),
    )
    st = ses.session_state_asof(acc)
    return st.select("user_id", "seq", F.col("action.kind").alias("kind"), "active_file", "cursor_line", "terminal_text")


REQUEST_BODY = (
    "model string, messages array<struct<role:string,content:string>>, temperature double, top_p double, "
    "top_k long, min_p double, logprobs boolean, chat_template_kwargs struct<enable_thinking:boolean>"
)


@query("request_build")
def q_request_build(spark, base):
    """Every field is read back from the JSON body; messages as a digest in order."""
    r = msg.build_requests(msg.truncate_context(fx.messages(spark, base), max_tokens=TEST_BUDGET))
    r = r.select("conv_id", "n_messages", "request_tokens", F.from_json("body", REQUEST_BODY).alias("b"))
    m = F.col("b.messages")
    lines = F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"]))
    return r.select(
        "conv_id", "n_messages", "request_tokens",
        F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("content_chars"),
        F.get(m, 0)["role"].alias("first_role"),
        F.element_at(m, -1)["role"].alias("last_role"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("messages_sha256"),
        *(F.col(f"b.{c}").alias(c) for c in ("model", "temperature", "top_p", "top_k", "min_p", "logprobs")),
        F.col("b.chat_template_kwargs.enable_thinking").alias("enable_thinking"),
    )


@query("stream_coalesce_triggers")
def q_stream_coalesce_triggers(spark, base):
    """Streaming coalescing over the events file. Timers still pending when
    the input ends stay pending (the watermark never passes them), so this has
    at most the rows of ``coalesce_triggers``."""
    from ..streaming.runner import run_available
    from ..streaming.triggers import stream_coalesce_triggers

    ev = fx.session_events_from(fx.event_stream(spark, base))
    trig = ev.select("user_id", F.floor(F.col("ts") / 100_000).cast("long").alias("t"), "seq")
    return run_available(spark, stream_coalesce_triggers(trig), "stream_triggers")



@query("stream_actions")
def q_stream_actions(spark, base):
    """The stateless parse on a stream of completions; equals ``route_action``."""
    from ..streaming.runner import run_available

    li = fx.table_stream(spark, base, "lineitem", fx.LINEITEM_SCHEMA)
    # A file of one row group is read by one task, whatever its size.
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(spark.sparkContext.defaultParallelism)
    parsed = act.parse_completions(fx.completions(spark, base, li))
    out = parsed.select(*KEY, *cm.action_columns(F.col("action")))
    return run_available(spark, out, "stream_actions")


@query("stream_preference_log")
def q_stream_preference_log(spark, base):
    """Samples appended to the JSONL log as their outcome resolves (stream of
    events, static shown and context tables), then read back like
    ``preference_log_roundtrip``."""
    import uuid

    from ..streaming.ordered import split_late
    from ..streaming.runner import EndMarker, write_preference_stream
    from ..streaming.state import Outcomes, stream_outcomes

    parsed = rsp.parse_responses(fx.view_requests(spark, base))
    shown = materialize(fx.shown_suggestions(parsed), "shown")
    contexts = materialize(pref.context_arrays(msg.truncate_context(fx.messages(spark, base))), "contexts")
    marker = EndMarker(fx.event_stream(spark, base))
    ev = fx.decisions_from(marker.stream)
    # A view counts as shown only if its response parsed ok (stream-static join).
    ok = shown.select("seq", F.lit(True).alias("ok")).hint("merge")  # it grows with the events
    kind = F.when((F.col("kind") != "shown") | F.col("ok"), F.col("kind"))
    outcomes = stream_outcomes(ev.join(ok, "seq", "left").withColumn("kind", kind))
    samples = pref.samples_from_outcomes(split_late(outcomes, Outcomes(), "user_id")[0], shown, contexts)
    tag = uuid.uuid4().hex
    path, ckpt = scratch_path(spark, f"stream-log-{tag}"), scratch_path(spark, f"stream-log-ckpt-{tag}")
    marker.run(lambda: write_preference_stream(samples, path, ckpt, available_now=True))
    back, _bad = pref.read_preferences(spark, path)
    a = F.col("completion.parsedAction")
    return back.select(
        "timestamp", "outcome", "outcomeTimestamp", "modelName",
        F.size("context").cast("long").alias("n_context"),
        *cm.action_columns(a),
        F.round(F.col("completion.avgLogprob"), 6).alias("avg_logprob"),
        F.col("completion.rawModelOutput").alias("raw"),
    )


FLAGSHIP = "outcome_report"
