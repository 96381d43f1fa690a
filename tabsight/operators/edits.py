"""Applying edit actions to document text, and viewports.

Everything is a projection over ``(text, action)`` rows: offsets come from searches
for line ends, and the new text is a ``concat`` of slices. Documents reach the actions through one equi-join on the
path (``operators.actions.attach_documents`` style), with no broadcast of a
table that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.jscompat import lines
from ..functions.positions import bytes_at, feeds, line_pieces, odd_pieces, offset_at, to_points, to_units, utf16, with_position


def with_pieces(df: DataFrame, text: str = "text", utf16_units: bool = False) -> DataFrame:
    """UTF-16 units need every line, code points only those of texts with odd line ends."""
    return df.withColumn("__pieces", (line_pieces if utf16_units else odd_pieces)(F.col(text)))


def _points(pieces: Column, line: Column, ch: Column, utf16_units: bool) -> Column:
    """``ch``, which may count units, in code points."""
    if utf16_units:
        ch = F.coalesce(to_points(utf16(F.get(pieces, F.greatest(line, F.lit(0)))), ch), F.lit(0))
    return ch


def _offset(text: Column, pieces: Column, line: Column, ch: Column, utf16_units: bool) -> Column:
    """Code-point offset of a position whose ``ch`` counts code points or units."""
    return offset_at(text, pieces, line, _points(pieces, line, ch, utf16_units))


def apply_action(
    df: DataFrame,
    text: str = "text",
    action: str = "action",
    out: str = "new_text",
    utf16_units: bool = False,
    changed: str | None = None,
) -> DataFrame:
    """Add ``out``: the text after an ``editInsert`` / ``editDelete`` /
    ``editReplace``; other kinds leave the text unchanged. Positions past the
    end are clamped to the document, as the editor does. ``utf16_units``: the
    action's characters are counted in UTF-16 units, as editors log them.

    ``changed``: a column of that name with what the edit changes,
    ``struct(old, new)``: the edited stretch before and after, with the character on
    either side; null where there is no edit. Texts are cut at bytes, so that
    characters are not counted for each piece."""
    t, a = F.col(text), F.col(action)
    d = df.withColumn("__feeds", feeds(t))
    if utf16_units:
        d = with_pieces(d, text, utf16_units)
    b = F.col("__bytes")

    def at(line, ch):
        return bytes_at(t, F.col("__feeds"), line, _points(F.col("__pieces"), line, ch, utf16_units))

    kind, to = a["kind"], a["range"]["end"]
    inserts = kind == "editInsert"
    d = (
        d.withColumn("__from", F.when(inserts, a["position"]).otherwise(a["range"]["start"]))
        .withColumn("__line", F.col("__from.line"))
        .withColumn("__ch", F.col("__from.ch"))
        .withColumn("__o1", at(F.col("__line"), F.col("__ch")))
        .withColumn("__o2", F.when(inserts, F.col("__o1")).otherwise(at(to["line"], to["ch"])))
    )
    # Out of a generator, so that the cuts are a generated method of their own: the JIT leaves
    # one over 8 KB to the interpreter.
    ends = F.struct(F.least("__o1", "__o2").alias("__s"), F.greatest("__o1", "__o2").alias("__e"))
    d = d.select("*", F.inline(F.array(ends))).withColumn("__bytes", t.cast("binary"))
    s, e = F.col("__s"), F.col("__e")
    edits = kind.isin("editInsert", "editDelete", "editReplace")
    ins = F.when(kind == "editDelete", F.lit("")).otherwise(a["text"])
    spliced = F.concat(F.left(b, s), ins.cast("binary"), F.substr(b, e + 1)).cast("string")
    d = d.withColumn(out, F.when(edits, spliced).otherwise(t))
    if changed:
        # A character has at most four bytes.
        head, tail = F.substr(b, F.greatest(s - 3, F.lit(1)), F.least(s, F.lit(4))), F.substr(b, e + 1, F.lit(4))
        d = d.withColumn("__before", F.right(head.cast("string"), F.lit(1)))
        d = d.withColumn("__after", F.left(tail.cast("string"), F.lit(1)))
        old = F.concat("__before", F.substr(b, s + 1, e - s).cast("string"), "__after")
        new = F.concat("__before", ins, "__after")
        d = d.withColumn(changed, F.when(edits, F.struct(old.alias("old"), new.alias("new"))))
    return d.select(*dict.fromkeys([*df.columns, out, *([changed] if changed else [])]))


def offsets_to_positions(df: DataFrame, text: str, offsets: dict[str, str], utf16_units: bool = False) -> DataFrame:
    """For each ``name -> offset column`` add ``name`` = struct(line, ch). With
    ``utf16_units`` offsets and characters count UTF-16 units."""
    if not utf16_units:
        for name, off in offsets.items():
            df = with_position(df, name, F.col(text), F.col(off))
        return df
    d = with_pieces(df, text, utf16_units).withColumn("__units", utf16(F.col(text)))
    for name, off in offsets.items():
        d = d.withColumn("__at", to_points(F.col("__units"), F.col(off)))
        d = with_position(d, "__pos", F.col(text), F.col("__at"))
        ch = to_units(F.get("__pieces", F.col("__pos.line")), F.col("__pos.ch")).cast("int")
        d = d.withColumn(name, F.struct(F.col("__pos.line").alias("line"), ch.alias("ch")))
    return d.drop("__pieces", "__units", "__at", "__pos")


def positions_to_offsets(
    df: DataFrame, text: str, positions: dict[str, tuple[str, str]], utf16_units: bool = False
) -> DataFrame:
    """For each ``name -> (line column, ch column)`` add the offset ``name``. With
    ``utf16_units`` characters and offsets count UTF-16 units."""
    d = with_pieces(df, text, utf16_units)
    for name, (line, ch) in positions.items():
        off = _offset(F.col(text), F.col("__pieces"), F.col(line), F.col(ch), utf16_units)
        d = d.withColumn(name, to_units(F.col(text), off) if utf16_units else off)
    return d.drop("__pieces")


def viewport_lines(
    df: DataFrame, text: str = "text", cursor_line: str = "cursor_line", radius: int = config.DEFAULT_VIEWPORT_RADIUS
) -> DataFrame:
    """One row per line within ``radius`` of the cursor line: ``line_no``
    (0-based) and ``line``. The window is sliced out of the line array before
    exploding, so a long document yields 2 x radius + 1 rows, not all lines."""
    ls = lines(F.col(text))
    first = F.greatest(F.col(cursor_line) - radius, F.lit(0))
    window = F.slice(ls, first + 1, F.lit(2 * radius + 1))
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, first.alias("__first"), F.posexplode(window).alias("__i", "line")).select(
        *keep, (F.col("__first") + F.col("__i")).cast("long").alias("line_no"), "line"
    )
