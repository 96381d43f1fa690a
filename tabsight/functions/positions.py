"""Editor positions over document text, as higher-order column expressions.

A position is ``(line, ch)`` with 0-based line and character; lines end at
``\\r\\n``, ``\\n`` or ``\\r``. Conversions follow the editor's validation:
offsets are clamped to the text, lines past the end map to the end of the
document and characters are clamped to the line's length.

Offsets and characters count code points, as Spark's strings do. An editor's own
logs count UTF-16 units, two for a character beyond the basic plane; ``to_points``
and ``to_units`` lead from one count to the other over a text's ``utf16`` form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Split after each line terminator, keeping it with its line.
_PIECES = r"(?<=\n)|(?<=\r)(?!\n)"
_TERMINATOR = r"(\r\n|\n|\r)\z"


def line_pieces(text: Column) -> Column:
    """Lines with their terminators; concatenated they give the text back."""
    return F.split(text, _PIECES, -1)


def _content_len(piece: Column) -> Column:
    return F.length(F.regexp_replace(piece, _TERMINATOR, ""))


def odd_pieces(text: Column) -> Column:
    """:func:`line_pieces` of a text with a carriage return, null for others, whose
    lines :func:`offset_at` finds by plain searches."""
    return F.when(text.contains("\r"), line_pieces(text))


def _line_start(text: Column, line: Column, size=F.length) -> Column:
    """Offset of a line of a text whose lines end at ``\\n`` alone; of one past the end, the
    text's ``size``."""
    # More lines than that no text has, and a count must fit an int.
    n = F.least(line, size(text) + 1).cast("int")
    before = size(F.call_function("substring_index", text, F.lit("\n"), n))
    return F.when(line > 0, F.least(before + 1, size(text))).otherwise(F.lit(0))


def offset_at(text: Column, pieces: Column, line: Column, ch: Column) -> Column:
    """Offset of a position (editor ``offsetAt``). ``pieces``: the text's
    :func:`line_pieces`, or its :func:`odd_pieces`."""
    wanted = F.greatest(ch, F.lit(0))
    # Where the lines end at \n alone. Most positions are at a line's start.
    start = _line_start(text, line)
    content = F.length(F.call_function("substring_index", F.substr(text, start + 1), F.lit("\n"), F.lit(1)))
    inside = F.when(wanted > 0, F.least(wanted, content)).otherwise(F.lit(0))
    plain = F.when(line.isNotNull(), start + inside).when(text.isNotNull(), wanted)
    # Joined, not summed, so that it is one pass over the text.
    before = F.length(F.array_join(F.slice(pieces, F.lit(1), F.greatest(line, F.lit(0)).cast("int")), ""))
    odd = F.when(line >= F.size(pieces), F.length(text)).otherwise(before + F.least(wanted, _content_len(F.get(pieces, line.cast("int")))))
    return F.when(line < 0, F.lit(0)).when(pieces.isNull(), plain).otherwise(odd).cast("long")


def feeds(text: Column) -> Column:
    """The text, byte for byte as long, with every line ending at ``\\n`` alone: what
    :func:`bytes_at` needs. Make that a column of its own."""
    ends = F.replace(F.replace(text, F.lit("\r\n"), F.lit(" \n")), F.lit("\r"), F.lit("\n"))
    return F.when(text.contains("\r"), ends).otherwise(text)


def bytes_at(text: Column, fed: Column, line: Column, ch: Column) -> Column:
    """:func:`offset_at` in bytes of the text, ``fed`` being its :func:`feeds`: the place of
    a line's start is found without counting the characters before it."""
    wanted = F.greatest(ch, F.lit(0))
    start = _line_start(fed, line, F.octet_length)
    rest = F.substr(text.cast("binary"), start + 1).cast("string")
    for end in ("\n", "\r"):
        rest = F.call_function("substring_index", rest, F.lit(end), F.lit(1))
    inside = F.when(wanted > 0, F.octet_length(F.left(rest, wanted))).otherwise(F.lit(0))
    return (
        F.when(line < 0, F.lit(0))
        .when(line.isNotNull(), start + inside)
        .when(text.isNotNull(), F.octet_length(F.left(text, wanted)))
    )


def text_before(text: Column, offset: Column) -> Column:
    """The text before an offset (clamped to it) with ``\\n`` as the only line end: what
    :func:`position_of` needs. An offset inside ``\\r\\n`` goes to its start."""
    o = F.least(F.greatest(offset, F.lit(0)), F.length(text)).cast("int")
    inside = F.substr(text, F.greatest(o, F.lit(1)), F.lit(2)) == "\r\n"
    head = F.left(text, F.when((o > 0) & inside, o - 1).otherwise(o))
    return F.replace(F.replace(head, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def position_of(before: Column) -> Column:
    """``struct(line, ch)`` of the offset whose :func:`text_before` is given. Make that a
    column of its own, so that it is computed once."""
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    ch = F.length(F.substring_index(before, "\n", -1))
    return F.struct(line.cast("int").alias("line"), ch.cast("int").alias("ch"))


def with_position(df: DataFrame, name: str, text: Column, offset: Column) -> DataFrame:
    """Add ``name``: ``struct(line, ch)`` of an offset (editor ``positionAt``)."""
    return df.withColumn("__before", text_before(text, offset)).withColumn(name, position_of(F.col("__before"))).drop("__before")


def utf16(text: Column) -> Column:
    """The text in UTF-16, two bytes a unit: the map between the two counts.
    Make it once per text and look up any number of offsets in it."""
    return F.encode(text, "UTF-16BE")


def unit_count(units: Column) -> Column:
    return (F.octet_length(units) / 2).cast("long")


def to_points(units: Column, offset: Column) -> Column:
    """Code points before the UTF-16 ``offset`` of a text given as ``utf16``. The
    offset is clamped to the text; one inside a character goes to its start."""
    o = F.least(F.greatest(offset.cast("long"), F.lit(0)), unit_count(units)).cast("int")
    before = F.hex(F.substr(units, F.greatest(2 * o - 1, F.lit(1)), F.lit(1)))
    inside = (o > 0) & before.isin("D8", "D9", "DA", "DB")
    whole = o - inside.cast("int")
    return F.length(F.decode(F.substr(units, F.lit(1), 2 * whole), "UTF-16BE")).cast("long")


def to_units(text: Column, offset: Column) -> Column:
    """UTF-16 units before the code point ``offset`` of ``text``, clamped to it."""
    o = F.greatest(offset.cast("long"), F.lit(0))
    return unit_count(utf16(F.left(text, F.least(o, F.length(text)).cast("int"))))
