"""Model output -> command -> typed action, as native column expressions.

Every function here returns a ``Column``; nothing leaves the JVM. The action
is one wide nullable struct (``sources.schemas.ACTION``) with a ``kind``
discriminator; branches that do not apply are null and are merged with
``coalesce``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import ACTION
from .jscompat import LINE_START, WS, js_trim, literal_replace, nonempty, try_int

# The command grammar understood by the parser (JavaScript
# semantics re-expressed for Java regexes: \s is the JavaScript whitespace
# class, $ is end of input \z, [\s\S] is (?s). ).
FENCE = rf"(?is)```(?:bash)?{WS}*(.*?)```"
THINK = r"(?is)<think>.*?</think>"
COMMAND_SPLIT = r"&&|\|\|"
SED = (
    rf"sed{WS}+(?:-[A-Za-z]+{WS}+)*-i{WS}+(?:-[A-Za-z]+{WS}+)*'(.*?)'{WS}+"
    rf"([^{WS[1:-1]}&|]+){WS}*\z"
)
SED_DELETE = r"(\d+),(\d+)d"
SED_REPLACE = r"(\d+),(\d+)c\\\n(.*)"
SED_INSERT = r"(\d+)i\\\n(.*)"
SED_APPEND = r"\$a\\\n(.*)"
CAT = rf"cat{WS}+-n{WS}+([^{WS[1:-1]}|]+){WS}*"
CAT_SLICE = rf"\|{WS}*sed{WS}+-n{WS}+'(\d+),(\d+)p'{WS}*"
STRAY_FLAG = rf"{LINE_START}-[A-Z]{WS}*"
SHELL_QUOTE = "'\"'\"'"
BT = "`" * 3

# One match gives all groups of a pattern: the whole text becomes the groups with a
# separator between them (an unmatched group is empty), split once. Each pattern ends
# in an alternative without groups that takes any other text. The separator is a line
# feed, which only the last group may hold.
SED_PARTS = rf"(?s)\A(?:.*?{SED}|.*\z)", "$2\n$1"
SCRIPT_PARTS = (
    rf"(?s)\A(?:{SED_DELETE}|{SED_REPLACE}|{SED_INSERT}|{SED_APPEND}|.*)\z",
    "$1\n$2\n$3\n$4\n$6\n$5$7$8",
)
CAT_PARTS = rf"(?s)\A(?:{CAT}(?:{CAT_SLICE})?|.*)\z", "$1\n$2\n$3"


def parts(text: Column, pattern: tuple[str, str], n: int) -> Column:
    """The ``n`` groups of a pattern's single match as an array; null stays null."""
    return F.split(F.regexp_replace(text, F.lit(pattern[0]), F.lit(pattern[1])), "\n", n)



def strip_think(cmd: Column) -> Column:
    """Remove every ``<think>...</think>`` block, trim; empty -> null."""
    has_think = cmd.contains("<") & cmd.rlike(r"(?i)<think>")
    return nonempty(js_trim(F.when(has_think, F.regexp_replace(cmd, THINK, "")).otherwise(cmd)))


def sanitize_command(cmd: Column) -> Column:
    """Clean a terminal command for display (order matters)."""
    c = F.when(cmd.rlike(STRAY_FLAG), F.regexp_replace(cmd, STRAY_FLAG, "")).otherwise(cmd)
    c = literal_replace(c, SHELL_QUOTE, "'")
    c = literal_replace(c, "\\\\", "\\")
    c = literal_replace(c, "\\n", "\n")
    c = literal_replace(c, "\\t", "\t")
    return js_trim(c)


def unescape_payload(p: Column) -> Column:
    """Payload escapes of a sed script; backslash pairs come last here."""
    c = literal_replace(p, SHELL_QUOTE, "'")
    c = literal_replace(c, "\\n", "\n")
    c = literal_replace(c, "\\t", "\t")
    c = literal_replace(c, "\\'", "'")
    return literal_replace(c, "\\\\", "\\")


def first_command(cmd: Column) -> Column:
    """Only the part before the first ``&&`` or ``||``, trimmed."""
    head = F.when(cmd.contains("&&") | cmd.contains("||"), F.get(F.split(cmd, COMMAND_SPLIT, -1), 0)).otherwise(cmd)
    return js_trim(head)


def pos(line: Column, ch: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), ch.cast("int").alias("ch"))


def rng(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def make_action(
    kind: str,
    position: Column | None = None,
    range_: Column | None = None,
    text: Column | None = None,
    file_path: Column | None = None,
    selections: Column | None = None,
) -> Column:
    def typed(c, t):
        return (c if c is not None else F.lit(None)).cast(t)

    fields = {f.name: f.dataType for f in ACTION.fields}
    return F.struct(
        F.lit(kind).alias("kind"),
        typed(position, fields["position"]).alias("position"),
        typed(range_, fields["range"]).alias("range"),
        typed(text, "string").alias("text"),
        typed(file_path, "string").alias("filePath"),
        typed(selections, fields["selections"]).alias("selections"),
    )


def _end_position(end1: Column, line_count: Column, last_line_len: Column) -> Column:
    """Line after the last deleted line, column 0; past the end: end of document."""
    end_line = F.greatest(F.lit(0), end1 - 1) + 1
    past = end_line >= line_count
    return pos(F.when(past, line_count - 1).otherwise(end_line), F.when(past, last_line_len).otherwise(F.lit(0)))


def _with_text(payload: Column) -> Column:
    return F.when(payload.endswith(F.lit("\n")), payload).otherwise(F.concat(payload, F.lit("\n")))


# Parsing runs as a short chain of projections. Each intermediate (trimmed
# text, command, first command, sed script, ...) is its own column, so every
# regex runs once per row: nesting the column functions instead would repeat
# the whole chain inside each branch. Catalyst keeps the projections apart
# because the intermediates are referenced more than once.
_P = "__p_"


def with_command(df: DataFrame, raw: str = "raw", out: str = "command", extracted: str | None = None) -> DataFrame:
    """Add ``out`` = the normalised command (fence body or whole text, think
    blocks removed, trimmed; null when nothing is left). ``extracted`` also
    keeps the command as taken from the text, before think removal."""
    t = F.col(f"{_P}t")
    return (
        df.withColumn(f"{_P}t", js_trim(F.col(raw)))
        .withColumn(
            f"{_P}cmd0",
            F.when(
                F.length(F.col(raw)) > 0,
                F.coalesce(
                    # no match and an empty body both give '' -> fall back to the text
                    nonempty(F.when(t.contains(BT), F.regexp_extract(t, FENCE, 1))), nonempty(t)
                ),
            ),
        )
        .withColumn(out, strip_think(F.col(f"{_P}cmd0")))
        .withColumnRenamed(f"{_P}cmd0", extracted or f"{_P}cmd0")
        .drop(f"{_P}t", f"{_P}cmd0")
    )


def with_sed_form(df: DataFrame, cmd: str = "command", active_path: str = "active_path") -> DataFrame:
    """Add the sed pieces of ``cmd``: ``__p_main``, ``__p_script`` (the groups of its
    script, only when the target is the active document) and ``sed_form``."""
    main = F.col(f"{_P}main")
    sed = F.col(f"{_P}sed")
    script = F.col(f"{_P}script")
    return (
        df.withColumn(f"{_P}main", first_command(F.col(cmd)))
        .withColumn(
            f"{_P}sed",
            F.when(
                F.col(active_path).isNotNull() & main.contains("sed") & main.contains("'"), parts(main, SED_PARTS, 2)
            ),
        )
        # The target group is never empty: '' means "no match".
        .withColumn(
            f"{_P}raw_script",
            F.when((F.get(sed, 0) != "") & (F.get(sed, 0) == F.col(active_path)), F.get(sed, 1)),
        )
        .withColumn(f"{_P}script", parts(F.col(f"{_P}raw_script"), SCRIPT_PARTS, 6))
        .withColumn(
            "sed_form",
            F.when(F.get(script, 0) != "", F.lit("delete"))
            .when(F.get(script, 2) != "", F.lit("replace"))
            .when(F.get(script, 4) != "", F.lit("insert"))
            # Only the append form has no number.
            .when(F.col(f"{_P}raw_script").startswith("$a\\\n"), F.lit("append")),
        )
        .drop(f"{_P}sed", f"{_P}raw_script")
    )


EDIT_FORMS = ("delete", "replace", "insert", "append")


def with_edit_parts(df: DataFrame) -> DataFrame:
    """Add ``__p_a1``, ``__p_a2`` and ``__p_payload``, the line numbers and the text of a
    sed edit, to the pieces of :func:`with_sed_form`."""
    script, form = F.col(f"{_P}script"), F.col("sed_form")
    line1 = F.when(form == "delete", F.get(script, 0)).when(form == "replace", F.get(script, 2)).when(form == "insert", F.get(script, 4))
    line2 = F.when(form == "delete", F.get(script, 1)).when(form == "replace", F.get(script, 3))
    return (
        df.withColumn(f"{_P}a1", try_int(line1))
        .withColumn(f"{_P}a2", try_int(line2))
        .withColumn(f"{_P}payload", unescape_payload(F.when(form != "delete", F.get(script, 5))))
    )


def edit_action(
    form: Column,
    line1: Column,
    line2: Column,
    payload: Column,
    line_count: Column,
    last_line_len: Column,
    forms: tuple[str, ...] = EDIT_FORMS,
) -> Column:
    """The edit that a sed command of one of the ``forms`` makes, from its form and parts
    and the document's line statistics; null where there is none or a line number does not
    fit an int."""
    start = pos(F.greatest(F.lit(0), line1 - 1), F.lit(0))
    end = _end_position(line2, line_count, last_line_len)
    both = line1.isNotNull() & line2.isNotNull()
    text = _with_text(payload)
    appended = F.when(line_count > 0, F.concat(F.lit("\n"), text)).otherwise(text)
    edits = {
        "delete": (both, make_action("editDelete", range_=rng(start, end))),
        "replace": (both, make_action("editReplace", range_=rng(start, end), text=text)),
        "insert": (line1.isNotNull(), make_action("editInsert", position=start, text=text)),
        "append": (F.lit(True), make_action("editInsert", position=pos(line_count, F.lit(0)), text=appended)),
    }
    return F.coalesce(*[F.when((form == f) & edits[f][0], edits[f][1]) for f in forms])


#: What the text of every command of a form holds as it stands.
FORM_MARKS = {"delete": "d'", "replace": "c\\\n", "insert": "i\\\n", "append": "$a\\\n"}


def may_hold_form(raw: Column, forms: tuple[str, ...]) -> Column:
    """A cheap look at a model output: where it is false or null, :func:`with_sed_form`
    finds none of the ``forms``. A command is a stretch of the output, unless a think
    block is cut out of it, so outputs with one always pass."""
    marks = [raw.contains(FORM_MARKS[f]) for f in forms]
    return reduce(or_, marks) | (raw.contains("<") & raw.rlike(r"(?i)<think>"))


def with_action(
    df: DataFrame,
    raw: str = "raw",
    active_path: str = "active_path",
    line_count: str = "line_count",
    last_line_len: str = "last_line_len",
    out: str = "action",
    keep_command: bool = False,
) -> DataFrame:
    """Add ``out``: the typed action parsed from the model output ``raw``.

    Routing: sed edit of the active document, else a view command, else
    ``terminalSendText`` of the sanitised command. Without an active document
    (null ``active_path``) only the terminal branch applies. Null when the
    output holds no command at all.
    """
    cmd_col = "command" if keep_command else f"{_P}command"
    d = with_sed_form(with_command(df, raw, cmd_col), cmd_col, active_path)
    form, main = F.col("sed_form"), F.col(f"{_P}main")
    lc, lll, path = F.col(line_count), F.col(last_line_len), F.col(active_path)
    has_doc = path.isNotNull() & (F.length(main) > 0)

    cat_parts = F.col(f"{_P}cat_parts")
    d = (
        with_edit_parts(d)
        .withColumn(f"{_P}cat_parts", F.when(has_doc & main.startswith("cat"), parts(main, CAT_PARTS, 3)))
        .withColumn(f"{_P}sliced", F.get(cat_parts, 1) != "")
    )
    a1, a2, payload, sliced = (F.col(f"{_P}{n}") for n in ("a1", "a2", "payload", "sliced"))
    d = (
        d.withColumn(f"{_P}cat", F.when(~sliced, nonempty(F.get(cat_parts, 0))))
        .withColumn(f"{_P}vfile", F.when(sliced, F.get(cat_parts, 0)))
        .withColumn(f"{_P}vs", try_int(F.when(sliced, F.get(cat_parts, 1))).cast("long"))
        .withColumn(f"{_P}ve", try_int(F.when(sliced, F.get(cat_parts, 2))).cast("long"))
    )
    cat, vfile, vs, ve = (F.col(f"{_P}{n}") for n in ("cat", "vfile", "vs", "ve"))

    edit = edit_action(form, a1, a2, payload, lc, lll)
    center0 = F.greatest(F.lit(0), F.floor((vs + ve) / 2) - 1)
    view = F.when(
        cat.isNotNull(),
        F.when(cat != path, make_action("openFile", file_path=cat)).otherwise(make_action("showTextDocument")),
    ).when(
        vfile.isNotNull() & vs.isNotNull() & ve.isNotNull(),
        F.when(
            vfile != path,
            make_action("openFile", file_path=vfile, selections=F.array(rng(pos(center0, F.lit(0)), pos(center0, F.lit(0))))),
        ).otherwise(
            make_action(
                "setSelections",
                selections=F.array(
                    rng(
                        pos(F.least(center0, F.greatest(F.lit(0), lc - 1)), F.lit(0)),
                        pos(F.least(center0, F.greatest(F.lit(0), lc - 1)), F.lit(0)),
                    )
                ),
            )
        ),
    )
    cmd = F.col(cmd_col)
    terminal = make_action("terminalSendText", text=sanitize_command(cmd))
    # ``route``: which branch produced the action (cheap to filter on; a filter
    # on the action struct itself would be inlined down the whole chain).
    route = (
        F.when(cmd.isNull(), F.lit(None))
        .when(form.isNotNull() & (a1.isNotNull() | (form == "append")), F.lit("edit"))
        .when(cat.isNotNull() | (vfile.isNotNull() & vs.isNotNull() & ve.isNotNull()), F.lit("view"))
        .otherwise(F.lit("terminal"))
    )
    keep = [c for c in d.columns if not c.startswith(_P) and c not in (out, "route", "sed_form")]
    # The results come out of a one-row ``inline``: a filter on them (e.g.
    # ``route = 'edit'``) then stays above the generator instead of being
    # inlined down the whole parse chain, which would copy every regex into
    # the predicate once per reference.
    parsed = F.struct(
        F.when(cmd.isNotNull(), F.coalesce(edit, view, terminal)).alias(out),
        route.alias("route"),
        form.alias("sed_form"),
    )
    return d.select(*keep, F.inline(F.array(parsed)))


def with_edit(df: DataFrame, out: str, raw: str = "raw", active_path: str = "active_path") -> DataFrame:
    """Add ``out``: what the output alone says of a sed edit, the part of :func:`with_action`
    that needs no document. Its ``form`` is null where the route is another."""
    cmd = F.col(f"{_P}command")
    d = with_edit_parts(with_sed_form(with_command(df, raw, f"{_P}command"), f"{_P}command", active_path))
    form, line1, line2 = F.col("sed_form"), F.col(f"{_P}a1"), F.col(f"{_P}a2")
    edit = F.struct(
        F.when(line1.isNotNull() | (form == "append"), form).alias("form"),
        line1.alias("line1"),
        line2.alias("line2"),
        F.col(f"{_P}payload").alias("payload"),
        # Of a range whose end fits no int: such a command goes to the terminal as it is.
        F.when(form.isin("delete", "replace") & line2.isNull(), cmd).alias("command"),
    )
    keep = [c for c in df.columns if c != out]
    return d.select(*keep, F.inline(F.array(F.struct(edit.alias(out)))))


def with_edit_action(
    df: DataFrame,
    edit: str,
    forms: tuple[str, ...],
    line_count: str = "line_count",
    last_line_len: str = "last_line_len",
) -> DataFrame:
    """The ``action``, ``route`` and ``sed_form`` of :func:`with_action` in place of the
    column ``edit`` of :func:`with_edit`, whose form is one of the ``forms`` here. No edit
    is a view: a view command does not end in a quoted script and a target."""
    e = F.col(edit)
    action = edit_action(e["form"], e["line1"], e["line2"], e["payload"], F.col(line_count), F.col(last_line_len), forms)
    if {"delete", "replace"} & set(forms):
        action = F.coalesce(action, make_action("terminalSendText", text=sanitize_command(e["command"])))
    keep = [c for c in df.columns if c not in (edit, "action", "route", "sed_form")]
    parsed = F.struct(action.alias("action"), F.lit("edit").alias("route"), e["form"].alias("sed_form"))
    return df.select(*keep, F.inline(F.array(parsed)))


def action_columns(a: Column, prefix: str = "") -> list[Column]:
    """Flatten an action into scalar columns (for reports and oracles)."""
    sel0 = F.get(a["selections"], 0)
    p = prefix
    return [
        a["kind"].alias(f"{p}kind"),
        F.coalesce(a["position"]["line"], a["range"]["start"]["line"], sel0["start"]["line"]).cast("long").alias(f"{p}line"),
        F.coalesce(a["position"]["ch"], a["range"]["start"]["ch"], sel0["start"]["ch"]).cast("long").alias(f"{p}ch"),
        a["range"]["end"]["line"].cast("long").alias(f"{p}end_line"),
        a["range"]["end"]["ch"].cast("long").alias(f"{p}end_ch"),
        a["text"].alias(f"{p}text"),
        a["filePath"].alias(f"{p}file_path"),
    ]

