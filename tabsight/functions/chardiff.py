"""Character diff of two texts, as Arrow batch UDFs.

The longest-common-subsequence table has no native Spark form, so Python runs
here; everything derived from the segments is computed back in the JVM.

Which alignment is reported: from the end of both texts, equal characters are
matched; where they differ, a strictly larger value above wins, else the walk
goes left. Each common character then takes its leftmost place in either text;
between two places deletions come before insertions.

A row of the table is one integer with a bit per character of the new text: rows
differ by at most one from column to column, and a zero bit marks a column where the
value rises. Adding and subtracting such integers makes the next row at once. Every
sqrt(m)-th row is kept, and the rows between are made again, block by block from the
end, so memory grows with n * sqrt(m) bits. There is no size limit.
"""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import DIFF_SEGMENT


def _columns(text: str) -> dict[str, int]:
    """For each character, the bits of its places."""
    where: dict[str, int] = {}
    for i, c in enumerate(text):
        where[c] = where.get(c, 0) | 1 << i
    return where


def _next_row(flat: int, same: int, full: int) -> int:
    """The table row below ``flat``; ``same``: columns whose character equals the new one."""
    hit = flat & same
    return ((flat + hit) | (flat - hit)) & full


def _running_parity(bits: int, n: int) -> int:
    """Bit p tells whether an odd number of bits up to p is set."""
    step = 1
    while step < n:
        bits ^= bits << step
        step *= 2
    return bits & ((1 << n) - 1)


def _matches(old: str, new: str) -> list[int]:
    """Places in ``old`` of the characters that the walk from the end matches."""
    if not old or not new:
        return []
    where, full, step = _columns(new), (1 << len(new)) - 1, isqrt(len(old)) + 1
    row = full
    kept = [row]
    for i, c in enumerate(old[: (len(old) - 1) // step * step], 1):
        row = _next_row(row, where.get(c, 0), full)
        if i % step == 0:
            kept.append(row)
    out, j = [], len(new)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept.pop()]
        block = old[k * step : (k + 1) * step]
        for c in block:
            rows.append(_next_row(rows[-1], where.get(c, 0), full))
        for i in range(len(block) - 1, -1, -1):
            if not j:
                return out[::-1]
            # The walk leaves a row at the last column, up to j, that either matches
            # or has a larger value above than to its left. The value above is larger
            # only where it rises, and if the rows do not differ one column before.
            low = (1 << j) - 1
            same, rises = where.get(block[i], 0) & low, ~rows[i] & low
            j = (same | rises).bit_length()
            if j and not same >> (j - 1) & 1:
                differ = _running_parity((rows[i] ^ rows[i + 1]) & low, j)
                j = (same | rises & ~(differ << 1)).bit_length()
            if j and same >> (j - 1) & 1:
                out.append(k * step + i)
                j -= 1
    return out[::-1]


def common_text(old: str, new: str) -> str:
    """The longest common subsequence that the alignment rules pick."""
    end = 0  # equal ends are matched first, so they need no table
    while end < min(len(old), len(new)) and old[-1 - end] == new[-1 - end]:
        end += 1
    tail = old[len(old) - end :]
    return "".join(old[i] for i in _matches(old[: len(old) - end], new[: len(new) - end])) + tail


def lcs_length(old: str, new: str) -> int:
    """Length alone, a bit per character of ``old`` in one integer: a zero bit
    marks a column where the row's value rises."""
    where = _columns(old)
    full = (1 << len(old)) - 1
    flat = full
    for c in new:
        flat = _next_row(flat, where.get(c, 0), full)
    return len(old) - flat.bit_count()


def _leftmost(common: str, text: str) -> list[int]:
    places, at = [], -1
    for c in common:
        at = text.index(c, at + 1)
        places.append(at)
    return places


def diff_chars(old: str, new: str) -> list[tuple[str, str]]:
    """Ordered ``(type, value)`` segments, type ``equal`` / ``insert`` / ``delete``."""
    common = common_text(old, new)
    in_old = [-1, *_leftmost(common, old), len(old)]
    in_new = [-1, *_leftmost(common, new), len(new)]
    out: list[tuple[str, str]] = []
    held = ""
    for n in range(1, len(in_old)):
        gone, added = old[in_old[n - 1] + 1 : in_old[n]], new[in_new[n - 1] + 1 : in_new[n]]
        if gone or added:
            out += [("equal", held), ("delete", gone), ("insert", added)]
            held = ""
        held += common[n - 1 : n]
    return [s for s in [*out, ("equal", held)] if s[1]]


@F.pandas_udf(T.ArrayType(DIFF_SEGMENT))
def segments_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [{"type": t, "value": v} for t, v in diff_chars(a, b)] for a, b in zip(old, new)], dtype=object)


@F.pandas_udf(T.LongType())
def lcs_length_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else lcs_length(a, b) for a, b in zip(old, new)], dtype="Int64")
