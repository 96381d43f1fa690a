"""Display strings for actions: one-line truncation, base names, summaries,
details, indicator labels and long descriptions. Pure ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jscompat import js_collapse_ws

# Display symbols and texts.
NEWLINE_MARK = "↵"  # ↵
TAB_MARK = "→"  # →
ELLIPSIS = "…"  # …
EN_DASH = "–"  # –


def truncate_text(text: Column, n: int) -> Column:
    """Newlines (``\\r?\\n``) become ↵; longer than ``n``: first n-1 + …."""
    one = F.regexp_replace(text, r"\r?\n", NEWLINE_MARK)
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.left(one, F.lit(n - 1)), F.lit(ELLIPSIS)))


def display_text(text: Column, n: int) -> Column:
    """Inline-preview form: \\n -> ↵, tab -> →, then ``truncate_text``."""
    return truncate_text(F.replace(F.replace(text, F.lit("\n"), F.lit(NEWLINE_MARK)), F.lit("\t"), F.lit(TAB_MARK)), n)


def path_basename(p: Column) -> Column:
    """Last part after ``/`` or ``\\``; the whole path when that is empty."""
    last = F.element_at(F.split(p, r"[/\\]", -1), -1)
    return F.when(F.length(last) > 0, last).otherwise(p)


def significant_diff(old: Column, new: Column, changed: Column | None = None) -> Column:
    """False when equal, or equal after collapsing whitespace and trimming.

    ``changed``: ``struct(old, new)``, the only stretch where the texts differ with the
    character on either side. Collapsed, the stretches differ exactly when the texts do:
    a run of whitespace that reaches over an edge is seen by that character, and what
    lies beyond is the same in both. The whole texts are collapsed where it is null."""
    if changed is None:
        before, after = old, new
    else:
        before, after = F.coalesce(changed["old"], old), F.coalesce(changed["new"], new)
    return (old != new) & (js_collapse_ws(before) != js_collapse_ws(after))


def _line1(c: Column) -> Column:
    return (c + 1).cast("string")


def action_summary(a: Column) -> Column:
    k = a["kind"]
    sel = F.get(a["selections"], 0)
    return (
        F.when(k == "terminalSendText", F.lit("Run terminal command"))
        .when(k == "openFile", F.concat(F.lit("Open file: "), path_basename(a["filePath"])))
        .when(k == "setSelections", F.concat(F.lit("Move cursor to line "), _line1(sel["start"]["line"])))
        .when(k == "editInsert", F.lit("Insert text"))
        .when(k == "editReplace", F.lit("Replace text"))
        .when(
            k == "editDelete",
            F.concat(F.lit("Delete lines "), _line1(a["range"]["start"]["line"]), F.lit(EN_DASH), _line1(a["range"]["end"]["line"])),
        )
        .when(k == "terminalShow", F.lit("Show terminal"))
        .when(k == "showTextDocument", F.lit("Show document"))
        .otherwise(F.lit("Execute action"))
    )


def action_detail(a: Column) -> Column:
    k = a["kind"]
    sel = F.get(a["selections"], 0)
    return (
        F.when(k == "terminalSendText", a["text"])
        .when(
            k == "openFile",
            F.when(sel.isNotNull(), F.concat(a["filePath"], F.lit(":"), _line1(sel["start"]["line"]))).otherwise(a["filePath"]),
        )
        .when(
            k == "setSelections",
            F.concat(F.lit("Line "), _line1(sel["start"]["line"]), F.lit(", Column "), _line1(sel["start"]["ch"])),
        )
        .when(k.isin("editInsert", "editReplace"), truncate_text(a["text"], 200))
        .when(
            k == "editDelete",
            F.concat(F.lit("Lines "), _line1(a["range"]["start"]["line"]), F.lit(" to "), _line1(a["range"]["end"]["line"])),
        )
        .otherwise(F.lit(""))
    )


def action_label(a: Column, target_visible: Column) -> Column:
    """Indicator label of terminal, cursor and file actions; null otherwise."""
    k = a["kind"]
    sel = F.get(a["selections"], 0)
    return (
        F.when(k == "terminalSendText", F.concat(F.lit("Run: "), truncate_text(a["text"], 60)))
        .when(
            k == "openFile",
            F.when(
                sel.isNotNull(),
                F.concat(F.lit("Open: "), path_basename(a["filePath"]), F.lit(":"), _line1(sel["start"]["line"])),
            ).otherwise(F.concat(F.lit("Open: "), path_basename(a["filePath"]))),
        )
        .when(
            k == "setSelections",
            F.when(target_visible, F.lit("Move cursor here")).otherwise(
                F.concat(F.lit("Go to line "), _line1(sel["start"]["line"]))
            ),
        )
    )


def action_description(a: Column) -> Column:
    """Long description: ``struct(title, body, hint)``; null for kinds
    without one."""
    k = a["kind"]
    sel = F.get(a["selections"], 0)

    def d(title, body, hint):
        return F.struct(F.lit(title).alias("title"), body.alias("body"), F.lit(hint).alias("hint"))

    return (
        F.when(k == "terminalSendText", d("Terminal Command", a["text"], "Press Tab to execute, Esc to dismiss"))
        .when(
            k == "openFile",
            d(
                "Open File",
                F.concat(
                    F.lit("`"), a["filePath"], F.lit("`"),
                    F.when(sel.isNotNull(), F.concat(F.lit(" at line "), _line1(sel["start"]["line"]))).otherwise(F.lit("")),
                ),
                "Press Tab to open, Esc to dismiss",
            ),
        )
        .when(
            k == "setSelections",
            d("Move Cursor", F.concat(F.lit("Go to line "), _line1(sel["start"]["line"])), "Press Tab to move, Esc to dismiss"),
        )
        .when(k == "editInsert", d("Insert Text", a["text"], "Press Tab to insert, Esc to dismiss"))
        .when(k == "editReplace", d("Replace Text", a["text"], "Press Tab to replace, Esc to dismiss"))
        .when(
            k == "editDelete",
            d(
                "Delete Text",
                F.concat(F.lit("Lines "), _line1(a["range"]["start"]["line"]), F.lit(EN_DASH), _line1(a["range"]["end"]["line"])),
                "Press Tab to delete, Esc to dismiss",
            ),
        )
    )
