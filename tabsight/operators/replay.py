"""Replaying content edits into the text of each file.

A file's history is cut into slices of ``SLICE`` edits, numbered by the skew-safe
scan, so a file that holds a third of all edits is many slices. Then, per
``(file, slice)`` and up a tree of ``FAN`` slices or nodes at a time:

1. up: each slice's length function, composed to one per file;
2. down: from the base text's length, the length at the start of every slice;
3. up: with it, each slice's edits clamped and composed to one delta, and these to
   one per file (``functions.deltas``), which is applied to the base text.

A node's functions and deltas are as large as the texts they speak of, however
long the history: pieces beyond the text merge, and what was inserted and
dropped again is gone. No group holds more than a slice or ``FAN`` nodes.

Edits apply in ``(ts, seq, change_idx)`` order. An offset beyond the text is its
end, a length beyond it reaches its end; negative or null ones count as zero, a null
text as empty. A file without a base text starts empty; edits without a file are no
file's history. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import deltas as dl
from ..session import materialize
from .scan import event_slice, ordered_scan

SLICE, FAN = 1024, 16
_LONGS = T.ArrayType(T.LongType())
_LENGTHS = T.StructType([T.StructField(c, _LONGS) for c in ("starts", "vals", "slopes")])
_DELTAS = T.StructType([T.StructField("runs", _LONGS), T.StructField("texts", T.ArrayType(T.StringType()))])


# Most groups are a handful of edits, so a group is a row of arrays, and rows go to Python a
# hundred at a time (no Arrow batch of ten thousand slices): a call costs far less than a
# data frame per group.


@F.udf(_LENGTHS, useArrow=False)
def _slice_lengths(offsets: list, lengths: list, added: list) -> dl.Lengths:
    return dl.together([dl.edit_lengths(*e) for e in zip(offsets, lengths, added)], dl.compose_lengths)


@F.udf(_LENGTHS, useArrow=False)
def _node_lengths(starts: list, vals: list, slopes: list) -> dl.Lengths:
    return dl.together(list(zip(starts, vals, slopes)), dl.compose_lengths)


@F.udf(_LONGS, useArrow=False)
def _handed_down(before: int, starts: list, vals: list, slopes: list) -> list[int]:
    """The length before each node, from that before their parent."""
    out = []
    for part in zip(starts, vals, slopes):
        out.append(before)
        before = dl.length_after(part, before)
    return out


@F.udf(_DELTAS, useArrow=False)
def _slice_deltas(before: int, offsets: list, lengths: list, texts: list) -> dl.Delta:
    parts = []
    for o, m, text in zip(offsets, lengths, texts):
        o = min(o, before)
        m = min(m, before - o)
        parts.append(dl.edit_delta(o, m, text))
        before += len(text) - m
    return dl.together(parts, dl.compose)


@F.udf(_DELTAS, useArrow=False)
def _node_deltas(runs: list, texts: list) -> dl.Delta:
    return dl.together(list(zip(runs, texts)), dl.compose)


def _in_order(rows: DataFrame, keys: list[str], place: str, columns: tuple[str, ...], *aggs: Column) -> DataFrame:
    """One row per ``keys`` with ``place`` and the ``columns`` of its rows as arrays in
    ``place``'s order, and ``aggs``."""
    own = F.sort_array(F.collect_list(F.struct(place, *columns))).alias("__own")
    grouped = rows.groupBy(*keys).agg(own, *aggs)
    return grouped.withColumns({c: F.col("__own")[c] for c in (place, *columns)}).drop("__own")


def _valued(groups: DataFrame, value: Column, *keys: Column | str) -> DataFrame:
    """``keys`` and the fields of the struct ``value``, which is computed once."""
    return groups.select(*keys, value.alias("__value")).select("file", "node", "__value.*")


def _above(nodes: DataFrame, join: Callable[..., Column], columns: tuple[str, ...], fan: int) -> DataFrame:
    """The nodes above ``nodes``: ``join`` of the ``columns`` of up to ``fan`` neighbours."""
    groups = _in_order(nodes.withColumn("parent", F.expr(f"node div {fan}")), ["file", "parent"], "node", columns)
    return _valued(groups, join(*columns), "file", F.col("parent").alias("node"))


@F.pandas_udf(T.StringType())
def _applied(text: pd.Series, runs: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([dl.apply_delta(t, (list(r), list(s))) for t, r, s in zip(text, runs, texts)], dtype=object)


def replay_edits(edits: DataFrame, bases: DataFrame, slice_edits: int = SLICE, fan: int = FAN, slice_ms: int = config.EVENT_SLICE_MS) -> DataFrame:
    """``file, n_edits, text``: each edited file's text after all its ``edits`` (file,
    ts, seq, change_idx, offset, length, text), from ``bases`` (file, text)."""
    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c)
    own = edits.where("file IS NOT NULL").select("file", "ts", "seq", "change_idx", count("offset"), count("length"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = ordered_scan(own, ["file"], ["ts", "seq", "change_idx"], event_slice("ts", slice_ms), running_sums={"n": F.lit(1).cast("long")})
    numbered = materialize(numbered.select("file", "n", "offset", "length", "text", F.expr(f"(n - 1) div {slice_edits}").alias("node")), "edits")
    most = numbered.agg(F.max("node")).first()[0] or 0

    own = ("offset", "length", "added")
    slices = _in_order(numbered.withColumn("added", F.length("text")), ["file", "node"], "n", own)
    nodes, levels, left = _valued(slices, _slice_lengths(*own), "file", "node"), [], most
    while left > 0:  # the topmost level's functions are not needed
        levels.append(materialize(nodes, "replay"))
        nodes, left = _above(levels[-1], _node_lengths, ("starts", "vals", "slopes"), fan), left // fan
    counts = numbered.groupBy("file").agg(F.max("n").alias("n_edits"))
    texts = counts.join(bases.select("file", "text"), "file", "left").withColumn("text", F.coalesce("text", F.lit("")))
    down = texts.select("file", F.lit(0).cast("long").alias("node"), F.length("text").cast("long").alias("before"))
    at = F.min("before").alias("before")
    for below in reversed(levels):
        here = below.withColumn("parent", F.expr(f"node div {fan}")).join(down.withColumnRenamed("node", "parent"), ["file", "parent"])
        here = _in_order(here, ["file", "parent"], "node", ("starts", "vals", "slopes"), at)
        here = here.select("file", "node", _handed_down("before", "starts", "vals", "slopes").alias("before"))
        down = here.select("file", F.inline(F.arrays_zip("node", "before")))

    own = ("offset", "length", "text")
    slices = _in_order(numbered.join(down, ["file", "node"]), ["file", "node"], "n", own, at)
    whole, left = _valued(slices, _slice_deltas("before", *own), "file", "node"), most
    while left > 0:
        whole, left = _above(materialize(whole, "replay"), _node_deltas, ("runs", "texts"), fan), left // fan
    out = whole.drop("node").join(texts, "file")
    return out.select("file", "n_edits", _applied("text", "runs", "texts").alias("text"))
