"""Revision diffs and the quantities the preview derives from them.

``revision_diff`` runs the character diff once per pair (Arrow batch UDF,
``functions.chardiff``); every derived value (change regions, deletion and
insertion flags, coherent replacement, pure insertion, deletion ranges) is a
higher-order expression over the segment array, so the diff is never
recomputed per question as an interactive preview would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chardiff import lcs_length_udf, segments_udf
from ..functions.jscompat import js_trim
from ..functions.positions import with_position


def revision_diff(pairs: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """Add ``segments``, null where a text is null."""
    return pairs.withColumn("segments", segments_udf(F.col(old), F.col(new)))


def revision_lengths(pairs: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """Add ``lcs_len`` alone, which needs no alignment."""
    return pairs.withColumn("lcs_len", lcs_length_udf(F.col(old), F.col(new)))


def _is_change(s: Column) -> Column:
    return s["type"] != "equal"


def change_regions(segs: Column) -> Column:
    """Runs of consecutive non-equal segments."""
    n = F.size(segs)
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i <= n) & _is_change(F.get(segs, i - 1)) & ((i == 1) | ~_is_change(F.get(segs, i - 2))),
    )
    return F.size(starts).cast("long")


def _insert_regions(segs: Column) -> Column:
    n = F.size(segs)
    is_ins = lambda s: s["type"] == "insert"
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i <= n) & is_ins(F.get(segs, i - 1)) & ((i == 1) | ~is_ins(F.get(segs, i - 2))),
    )
    return F.size(starts).cast("long")


def has_deletion(segs: Column) -> Column:
    return F.exists(segs, lambda s: s["type"] == "delete")


def has_insertions(new: Column, segs: Column) -> Column:
    """New text non-empty and some inserted run is not blank."""
    return (F.length(new) > 0) & F.exists(segs, lambda s: (s["type"] == "insert") & (F.length(js_trim(s["value"])) > 0))


def _offset_before(segs: Column, i: Column) -> Column:
    """Old-text offset before segment ``i`` (1-based): equal and deleted
    lengths advance it, insertions do not."""
    return F.aggregate(
        F.slice(segs, 1, F.greatest(i - 1, F.lit(0))),
        F.lit(0).cast("long"),
        lambda a, s: a + F.when(s["type"] != "insert", F.length(s["value"])).otherwise(F.lit(0)),
    )


def _indices(segs: Column, kind: str) -> Column:
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(segs), F.lit(1))),
                    lambda i: (i <= F.size(segs)) & (F.get(segs, i - 1)["type"] == kind))


def _joined(segs: Column, kind: str) -> Column:
    return F.array_join(F.transform(F.filter(segs, lambda s: s["type"] == kind), lambda s: s["value"]), "")


def coherent_replacement(segs: Column) -> Column:
    """``struct(is_coherent, del_start, del_end, text)``, offsets relative to
    the old text: exactly one change region holding a deletion and a
    non-empty insertion."""
    dels = _indices(segs, "delete")
    first_del, last_del = F.get(dels, 0), F.element_at(dels, -1)
    text = _joined(segs, "insert")
    ok = (change_regions(segs) == 1) & (F.size(dels) > 0) & (F.length(text) > 0)
    start = _offset_before(segs, first_del)
    end = _offset_before(segs, last_del) + F.length(F.get(segs, last_del - 1)["value"])
    return F.struct(
        ok.alias("is_coherent"),
        F.when(ok, start).alias("del_start"),
        F.when(ok, end).alias("del_end"),
        F.when(ok, text).alias("text"),
    )


def pure_insertion(segs: Column) -> Column:
    """``struct(is_pure, at, text)``: no deletion and exactly one inserted run."""
    ins = _indices(segs, "insert")
    text = _joined(segs, "insert")
    ok = ~has_deletion(segs) & (_insert_regions(segs) == 1) & (F.length(text) > 0)
    return F.struct(
        ok.alias("is_pure"),
        F.when(ok, _offset_before(segs, F.get(ins, 0))).alias("at"),
        F.when(ok, text).alias("text"),
    )


def with_diff_facts(d: DataFrame, segs: str = "segments", new: str = "new_text") -> DataFrame:
    """Add ``regions``, ``has_deletion``, ``has_insertions``, ``coherent``,
    ``pure`` from the segment array (null where a text is null)."""
    s = F.col(segs)
    ok = s.isNotNull()
    return (
        d.withColumn("regions", F.when(ok, change_regions(s)))
        .withColumn("has_deletion", F.when(ok, has_deletion(s)))
        .withColumn("has_insertions", F.when(ok, has_insertions(F.col(new), s)))
        .withColumn("coherent", F.when(ok, coherent_replacement(s)))
        .withColumn("pure", F.when(ok, pure_insertion(s)))
    )


def deletion_offsets(d: DataFrame, segs: str = "segments") -> DataFrame:
    """``(…, idx, del_start, del_end)``: relative offsets of each deleted run,
    ``idx`` numbering the deleted runs from 1 in order."""
    # One pass over the segments, with the old text's length so far.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<idx:bigint,start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, seg: Column) -> Column:
        end = acc["at"] + F.length(seg["value"])
        span = F.struct((F.size(acc["spans"]) + 1).cast("long").alias("idx"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(
            F.when(seg["type"] == "insert", acc["at"]).otherwise(end).alias("at"),
            F.when(seg["type"] == "delete", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(F.col(segs), start, step, lambda acc: acc["spans"])
    keep = [c for c in d.columns if c != segs]
    return d.select(*keep, F.explode(spans).alias("__span")).select(
        *keep, F.col("__span.idx").cast("long").alias("idx"), F.col("__span.start").alias("del_start"),
        F.col("__span.end").alias("del_end"),
    )


def with_range(d: DataFrame, text: str = "text", start: str = "range_start", old: str = "old_text") -> DataFrame:
    """Add what :func:`to_positions` needs of a replaced range: ``__base``, the position of
    its start, and ``__range``, its text with one character more, so that a line end of
    two characters at its end is seen whole. The whole text is needed no longer."""
    more = F.substr(F.col(text), F.col(start) + 1, F.length(old) + 1)
    return with_position(d, "__base", F.col(text), F.col(start)).withColumn("__range", more)


def to_positions(d: DataFrame, offsets: dict[str, Column]) -> DataFrame:
    """Positions in the whole text of offsets in the replaced range, from the columns of
    :func:`with_range`: the work grows with the range, not with the document."""
    base = F.col("__base")
    for name, off in offsets.items():
        d = with_position(d, "__in", F.col("__range"), off)
        here = F.col("__in")
        ch = here["ch"] + F.when(here["line"] == 0, base["ch"]).otherwise(F.lit(0))
        d = d.withColumn(name, F.struct((base["line"] + here["line"]).alias("line"), ch.alias("ch"))).drop("__in")
    return d


def preview_class(action: Column, cursor_line: Column, cursor_ch: Column) -> Column:
    """How a suggestion is previewed. Needs the diff facts for replacements
    (columns ``pure``, ``has_insertions``, ``coherent``, ``has_deletion``) and
    ``old_text``: without a deletion or insertion the whole range is marked."""
    k = action["kind"]
    p = action["position"]
    after_cursor = (p["line"] > cursor_line) | ((p["line"] == cursor_line) & (p["ch"] >= cursor_ch))
    replace = (
        F.when(F.col("pure.is_pure"), F.lit("inline_insertion"))
        .when(F.col("has_insertions") & F.col("coherent.is_coherent"), F.lit("coherent_inline"))
        .when(F.col("has_insertions"), F.lit("replace_block"))
        .when(~F.col("has_deletion") & (F.length("old_text") > 0), F.lit("whole_range"))
        .otherwise(F.lit("deletion_only"))
    )
    return (
        F.when(k == "editInsert", F.when(after_cursor, F.lit("ghost")).otherwise(F.lit("insert_block")))
        .when(k == "editReplace", replace)
        .when(k == "editDelete", F.lit("range_delete"))
        .when(k.isin("terminalSendText", "setSelections", "openFile"), F.lit("indicator"))
        .when(k.isin("terminalShow", "showTextDocument"), F.lit("none"))
    )
