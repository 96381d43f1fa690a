"""Adapters from the driver's tables to the record shapes the jobs consume.

The driver data carries no editor logs, so every input here is derived by
Spark from the given tables with a fixed rule (see FIXTURES.md section 3).
All adapters are lazy projections, joins and windows over whole tables; their
size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

BT = "`" * 3


def s(c: Column) -> Column:
    return c.cast("string")


# Orders whose completions edit the same document; files between one user's
# first file and the next user's. Documents touched grow with the tables.
ORDERS_PER_DOC, FILES_PER_USER = 15, 7


def doc_path(n: Column) -> Column:
    return F.concat(F.lit("/src/f"), s(n), F.lit(".py"))


def user_file(k: Column | int) -> Column:
    """One of the twenty files that a user works on."""
    return doc_path(F.col("user_id") * FILES_PER_USER + k % 20)


def messages(spark: SparkSession, base: str) -> DataFrame:
    """``conversations`` -> ``(conv_id, turn, role, content)``."""
    return table(spark, base, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )


def completions(
    spark: SparkSession, base: str, lineitems: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One model output per lineitem row, ten command shapes, three wrappings. Columns
    ``keep`` of ``lineitems`` stay beside it."""
    li = lineitems if lineitems is not None else table(spark, base, "lineitem")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *keep)
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    shape = ((ok * 7 + ln) % 10).cast("long")
    active = doc_path(F.floor(ok / ORDERS_PER_DOC))
    target = F.when(ln % 4 == 0, F.lit("/src/other.py")).otherwise(active)
    st = 1 + ok % 45
    en = st + ln
    pay = F.concat(F.lit("x = "), s(F.col("l_partkey")))
    q, bs, nl = F.lit("'"), F.lit("\\"), F.lit("\n")
    cmd = (
        F.when(shape == 0, F.concat(F.lit("sed -i "), q, s(st), F.lit(","), s(en), F.lit("d"), q, F.lit(" "), target))
        .when(
            shape == 1,
            F.concat(F.lit("sed -i "), q, s(st), F.lit(","), s(en), F.lit("c"), bs, nl, pay, q, F.lit(" "), target),
        )
        .when(
            shape == 2,
            F.concat(
                F.lit("sed -E -i "), q, s(st), F.lit("i"), bs, nl, pay, bs, F.lit("n"), q, F.lit(" "), target,
                F.lit(" && cat -n "), target,
            ),
        )
        .when(shape == 3, F.concat(F.lit("sed -i "), q, F.lit("$a"), bs, nl, pay, q, F.lit(" "), target))
        .when(shape == 4, F.concat(F.lit("cat -n "), target))
        .when(
            shape == 5,
            F.concat(F.lit("cat -n "), target, F.lit(" | sed -n "), q, s(st), F.lit(","), s(en), F.lit("p"), q),
        )
        .when(shape == 6, F.concat(F.lit("-A ls "), bs, bs, F.lit("n "), pay, bs, F.lit("t")))
        .when(
            shape == 7,
            F.concat(
                F.lit("sed -i "), q, s(st), F.lit(","), s(en), F.lit("c"), bs, nl, F.lit("a && "), pay, q,
                F.lit(" "), target,
            ),
        )
        .when(shape == 8, F.concat(F.lit("<think>"), pay, F.lit("</think> pytest -k "), s(ok)))
        .otherwise(F.lit(""))
    )
    # The command once, between its wrapping, or the generated method is over the JIT's size limit.
    plain, bash = ln % 3 == 0, ln % 3 == 1
    before = F.when(plain, "").when(bash, "Plan.\n" + BT + "bash\n").otherwise(BT + "\n")
    after = F.when(plain, "").when(bash, "\n" + BT).otherwise("\n" + BT + "\ndone")
    raw = F.concat(before, cmd, after)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        active.alias("active_path"),
        (1 + F.col("l_suppkey") % 40).cast("int").alias("line_count"),
        (F.col("l_suppkey") % 7).cast("int").alias("last_line_len"),
        shape.alias("shape"),
        raw.alias("raw"),
        *keep,
    )


def documents(spark: SparkSession, base: str) -> DataFrame:
    """Edit-target documents: ``path = /src/f<doc_id>.py``, text as is."""
    return table(spark, base, "documents").select(
        "doc_id", doc_path(F.col("doc_id")).alias("path"), "text"
    )


def astral_documents(spark: SparkSession, base: str) -> DataFrame:
    """:func:`documents` with a character beyond the basic plane for each ``o``."""
    return documents(spark, base).withColumn("text", F.translate("text", "o", "\U0001F600"))


# Event-type mapping of the driver's ``events`` table to editor decisions.
DECISION_KIND = {"view": "shown", "purchase": "accept", "error": "reject", "click": "content", "signup": "clear"}


_EPOCH_NTZ = "1970-01-01 00:00:00"


def event_ms(ts: Column) -> Column:
    """Epoch milliseconds of a ``timestamp_ntz`` read as UTC wall clock,
    independent of the session time zone (NTZ arithmetic only)."""
    return F.timestamp_diff("MILLISECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), ts)


def decisions(spark: SparkSession, base: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``events`` -> ``(user_id, ts, seq, kind, value, props)``; ``ts`` in ms,
    ``seq`` = event_id breaks ties. ``kinds`` keeps only those decision kinds,
    as a filter on the raw ``event_type`` that reaches the parquet scan."""
    ev = table(spark, base, "events")
    if kinds is not None:
        ev = ev.where(F.col("event_type").isin([k for k, v in DECISION_KIND.items() if v in kinds]))
    return decisions_from(ev)


def decisions_from(ev: DataFrame) -> DataFrame:
    """The decision mapping over any events frame (batch or stream). A third of
    the rejections are dismissals (event_id % 3 = 1)."""
    kind = F.lit(None).cast("string")
    for src, dst in reversed(DECISION_KIND.items()):
        kind = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(kind)
    kind = F.when((kind == "reject") & (F.col("event_id") % 3 == 1), "dismiss").otherwise(kind)
    return ev.select(
        "user_id",
        event_ms(F.col("ts")).alias("ts"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        "value",
        "props",
    )


def token_logprobs(spark: SparkSession, base: str) -> DataFrame:
    """Per-token log-probabilities: one token per lineitem, in line order, in
    integer hundredths (-25 x round(discount x 100)), i.e. multiples of
    -0.25: exact in binary, so any summation order gives the same double until the last step."""
    li = table(spark, base, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").cast("long").alias("idx"),
        (F.lit(-25) * F.round(F.col("l_discount") * 100)).cast("long").alias("logprob_centi"),
    )


# Response shapes by request_id % 20 (others: content = the completion text).
RESPONSE_SHAPES = {0: "text_field", 1: "number_content", 2: "blank_content", 3: "no_logprobs", 4: "no_choices", 5: "not_json"}


def responses(spark: SparkSession, base: str, request_ids: DataFrame | None = None) -> DataFrame:
    """One model response per order: ``(request_id, model_name, body,
    active_path, line_count, last_line_len)``. The body is JSON written with
    ``to_json``; its text is the order's first completion, its tokens the
    order's lineitems (none for an order without lines: mean NaN).
    ``request_ids`` (one column ``request_id``) restricts the build to those
    requests before any aggregation (a semi-join on both inputs)."""
    li = table(spark, base, "lineitem")
    if request_ids is not None:
        li = li.join(request_ids.withColumnRenamed("request_id", "l_orderkey"), "l_orderkey", "left_semi")
    # One pass over the lines of an order: its tokens in line order, and its
    # first line (lowest line number, then part and supplier: equal keys give
    # equal text), whose completion is the response text.
    per_order = li.groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("l_linenumber").cast("long").alias("idx"),
                    (F.lit(-25) * F.round(F.col("l_discount") * 100)).cast("long").alias("logprob_centi"),
                )
            )
        ).alias("toks"),
        F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("m"),
    )
    # Tokens and completion go on together, or each would aggregate and join the lines anew.
    lines = per_order.select(F.col("request_id").alias("l_orderkey"), "m.l_linenumber", "m.l_partkey", "m.l_suppkey", "toks")
    first = completions(spark, base, lines, keep=("toks",)).withColumnRenamed("l_orderkey", "request_id")
    first = first.select("request_id", "raw", "active_path", "line_count", "last_line_len", "toks")
    orders = table(spark, base, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("model-"), F.substring("o_orderpriority", 1, 1)).alias("model_name"),
    )
    if request_ids is not None:
        orders = orders.join(request_ids, "request_id", "left_semi")
    d = orders.join(first, "request_id", "left")
    lp = F.transform(
        F.coalesce(F.col("toks"), F.array().cast("array<struct<idx:long,logprob_centi:long>>")),
        lambda t: F.struct((t["logprob_centi"] / F.lit(100.0)).alias("logprob")),
    )
    logprobs = F.struct(lp.alias("content"))
    k = F.col("request_id") % 20
    regular = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("raw").alias("content")).alias("message"), logprobs.alias("logprobs"))).alias("choices"))
    )
    body = (
        F.when(k == 0, F.to_json(F.struct(F.array(F.struct(F.col("raw").alias("text"), logprobs.alias("logprobs"))).alias("choices"))))
        .when(k == 1, F.concat(F.lit('{"choices":[{"message":{"content":5},"logprobs":'), F.to_json(logprobs), F.lit("}]}")))
        .when(k == 2, F.concat(F.lit('{"choices":[{"message":{"content":"  "},"logprobs":'), F.to_json(logprobs), F.lit("}]}")))
        .when(k == 3, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("raw").alias("content")).alias("message"))).alias("choices"))))
        .when(k == 4, F.concat(F.lit('{"id":'), s(F.col("request_id")), F.lit("}")))
        .when(k == 5, F.concat(F.lit("not json "), s(F.col("request_id"))))
        .otherwise(regular)
    )
    return d.select("request_id", "model_name", body.alias("body"), "active_path", "line_count", "last_line_len")


def session_events(spark: SparkSession, base: str) -> DataFrame:
    """``events`` as editor session events ``(user_id, ts, seq, kind, file,
    value, has_editor, focused)``: view -> shown, purchase -> accept, error ->
    dismiss where event_id % 3 = 1, else reject, click -> selection where
    event_id % 5 = 3, content where it is 4, else tab (file ``user_file(k)``, k =
    ``props.k``), signup -> clear for even event ids and toggle for odd ones. No
    editor is active where event_id % 11 = 0; the window has no focus where
    event_id % 13 = 0."""
    return session_events_from(table(spark, base, "events"))


def session_events_from(ev: DataFrame) -> DataFrame:
    """The session-event mapping over any events frame (batch or stream)."""
    et, eid = F.col("event_type"), F.col("event_id")
    kind = (
        F.when(et == "view", "shown")
        .when(et == "purchase", "accept")
        .when(et == "error", F.when(eid % 3 == 1, "dismiss").otherwise("reject"))
        .when(et == "click", F.when(eid % 5 == 3, "selection").when(eid % 5 == 4, "content").otherwise("tab"))
        .when(et == "signup", F.when(eid % 2 == 0, "clear").otherwise("toggle"))
    )
    k = F.get_json_object("props", "$.k").cast("long")
    file = F.when(et == "click", user_file(k))
    return ev.select(
        "user_id", event_ms(F.col("ts")).alias("ts"), eid.alias("seq"), kind.alias("kind"), file.alias("file"), "value",
        (eid % 11 != 0).alias("has_editor"), (eid % 13 != 0).alias("focused"),
    )


# Response latency of the fixture: value x 100,000 ms.
LATENCY_MS_PER_VALUE = 100_000


def requests(spark: SparkSession, base: str) -> DataFrame:
    """Model requests: every shown event, answered after ``value`` x 100 s."""
    return requests_from(session_events(spark, base).where(F.col("kind") == "shown"))


def requests_from(ev: DataFrame) -> DataFrame:
    """The request mapping over any shown session events (batch or stream)."""
    return ev.select(
        "user_id",
        "ts",
        "seq",
        (F.col("ts") + F.round(F.col("value") * LATENCY_MS_PER_VALUE).cast("long")).alias("response_ts"),
    )


def view_requests(spark: SparkSession, base: str) -> DataFrame:
    """``view`` events with the response to their request
    (``request_id = event_id``): only these responses are ever shown, so only
    these are parsed."""
    views = decisions(spark, base, kinds=("shown",)).select("user_id", "ts", "seq")
    wanted = views.select(F.col("seq").alias("request_id"))
    return views.join(responses(spark, base, wanted), views["seq"] == F.col("request_id")).drop("seq")


def shown_suggestions(parsed_views: DataFrame) -> DataFrame:
    """Shown rows: a view whose response parsed ``ok``. Other views created no
    sample. The user's conversation (``conv_id = user_id``) is the context."""
    return parsed_views.where(F.col("parse_status") == "ok").select(
        "user_id", "ts", F.col("request_id").alias("seq"), F.col("text").alias("raw"), "action", "avg_logprob",
        "model_name", F.col("user_id").alias("conv_id"),
    )


def trigger_events(spark: SparkSession, base: str) -> DataFrame:
    """Every event as an editor trigger on a compressed clock:
    ``t = epoch ms div 100,000`` (median gap of a user a few hundred ms)."""
    ev = session_events(spark, base)
    return ev.select("user_id", F.floor(F.col("ts") / 100_000).cast("long").alias("t"), "seq")


EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, base: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The ``events`` parquet file(s) under ``base`` as a stream."""
    return (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(base)
    )


def editor_feeds(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The editor's feeds from the ``events`` table."""
    return editor_feeds_from(table(spark, base, "events"))


def editor_feeds_from(ev: DataFrame) -> dict[str, DataFrame]:
    """Per-kind event feeds from ``events`` (k = ``props.k``): view ->
    selection (selections [k, k+5] and [0, 0]; from the active editor unless
    event_id % 5 = 0), click -> tab, purchase -> content (a batch of
    1 + event_id % 3 changes; for the active document unless event_id % 4 = 0),
    error -> terminal command ``pytest -k <k>``, signup -> terminal output
    chunk ``ok <k>\n``."""
    k = F.get_json_object("props", "$.k").cast("long")
    eid = F.col("event_id")
    basecols = [F.col("user_id"), event_ms(F.col("ts")).alias("ts"), eid.alias("seq")]
    file = user_file(k).alias("file")
    et = F.col("event_type")
    sel = F.array(
        F.struct(k.cast("int").alias("start"), (k + 5).cast("int").alias("end")),
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")),
    )
    changes = F.transform(
        F.sequence(F.lit(0), (eid % 3).cast("int")),
        lambda j: F.struct(((eid + j) % 20).cast("int").alias("offset"), j.alias("length"), F.concat(F.lit("c"), s(j)).alias("text")),
    )
    return {
        "selection": ev.where(et == "view").select(
            *basecols, F.lit("selection").alias("kind"), file, sel.alias("selections"), (eid % 5 != 0).alias("is_active_editor")
        ),
        "tab": ev.where(et == "click").select(*basecols, F.lit("tab").alias("kind"), file),
        "content": ev.where(et == "purchase").select(
            *basecols, F.lit("content").alias("kind"), file, changes.alias("changes"), (eid % 4 != 0).alias("is_active_document")
        ),
        "terminal_command": ev.where(et == "error").select(
            *basecols, F.lit("terminal_command").alias("kind"), F.concat(F.lit("pytest -k "), s(k)).alias("text"),
            eid.alias("execution_id"),
        ),
        "terminal_output": ev.where(et == "signup").select(
            *basecols, F.lit("terminal_output").alias("kind"), F.concat(F.lit("ok "), s(k), F.lit("\n")).alias("text")
        ),
    }


LINEITEM_SCHEMA = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz"
)


def table_stream(spark: SparkSession, base: str, name: str, schema: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A driver table's parquet file(s) under ``base`` as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}*.parquet")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(base)
    )
