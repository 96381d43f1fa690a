"""JavaScript text semantics as Spark column expressions.

Java regexes differ from JavaScript ones in three places that matter here:
``\\s`` (JavaScript's is Unicode-aware), ``$`` (Java also matches before a
final newline) and ``String.trim`` (Spark's ``trim`` strips only spaces). Every
parser in the package goes through these helpers instead of the raw forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the JavaScript whitespace set (WhiteSpace + LineTerminator).
JS_WS_CHARS = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS = f"[{JS_WS_CHARS}]"  # JavaScript \s
# The same set as a plain string of characters, for ``trim(str, chars)``.
JS_WS_STRING = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
NOT_WS = f"[^{JS_WS_CHARS}]"  # JavaScript \S
# JavaScript line terminators, for multiline ^.
JS_LINE_TERMINATORS = r"\n\r\x{2028}\x{2029}"
LINE_START = rf"(?:\A|(?<=[{JS_LINE_TERMINATORS}]))"
# Line separators used by the editor's document model.
EOL = r"\r\n|\n|\r"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """``String.prototype.trim`` (character-set trim, no regex)."""
    return F.btrim(col(c), F.lit(JS_WS_STRING))


def js_collapse_ws(c: Column | str) -> Column:
    """``s.replace(/\\s+/g, ' ').trim()``. A single space, the most common run by far,
    is left as it is."""
    return js_trim(F.regexp_replace(col(c), f"(?:[{JS_WS_CHARS}&&[^ ]]{WS}*+| {WS}++)", " "))


def nonempty(c: Column) -> Column:
    """``c`` when it is a non-empty string, else null (JavaScript truthiness)."""
    return F.when(F.length(c) > 0, c)


def lines(c: Column | str) -> Column:
    """Lines of a text as the editor splits them (keeps trailing empty line)."""
    return F.split(col(c), EOL, -1)


def _odd(text: Column) -> Column:
    """Lines may end at ``\\r``: only then is a text split to count or measure them."""
    return text.contains("\r") | text.isNull()


def line_count(c: Column | str) -> Column:
    """Editor line count: an empty text still has one line."""
    text = col(c)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(_odd(text), F.size(lines(text))).otherwise(breaks + 1)


def last_line_len(c: Column | str) -> Column:
    text = col(c)
    last = F.substring_index(text, "\n", -1)
    return F.length(F.when(_odd(text), F.element_at(lines(text), -1)).otherwise(last))


def literal_replace(c: Column, search: str, replacement: str) -> Column:
    """``s.split(search).join(replacement)``: every non-overlapping occurrence,
    left to right, with no regex or replacement-string escapes."""
    return F.replace(c, F.lit(search), F.lit(replacement))


def try_int(c: Column) -> Column:
    """``Number(digits)`` for a digit string; null when it does not fit an int
    (such line numbers cannot address a document anyway)."""
    return c.try_cast("int")
