"""Skew-safe ordered scans (running sums, last-non-null, key totals).

Per-user state in the editor (context epoch, toggle state, suppression flag,
which suggestion is pending) is a running aggregate over that user's events in
time order. A plain ``Window.partitionBy(user)`` puts a whole user into one
task, so one very active user (or a bot holding a third of all rows) would be
one task over a third of the data.

Instead the ordered sequence of every key is cut into *slices* by a coarse
column that is monotone in the order (an hour of event time, a block of turn
numbers). The scan then runs in two levels, the classic parallel prefix sum:

1. within each ``(key, slice)``: a running window (bounded by one slice);
2. per ``(key, slice)``: partial totals (map-side combined), a tiny running
   window over the slices of a key gives each slice its carry-in;
3. one equi-join on ``(key, slice)`` adds the carry. The big side is already
   hash-partitioned on ``(key, slice)`` by step 1, so only the small slice
   table moves; AQE turns it into a broadcast when its runtime size allows.

The result equals the single-window scan exactly, rows with a null key or a
null order column included: the cell ``(key, slice)`` is one struct column,
and structs compare equal when the same fields are null, so the carry join
stays a plain equi-join on the column the rows are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE = "__slice"
_CELL = "__cell"


def _with_cell(df: DataFrame, keys: Sequence[str], slice_expr: Column) -> DataFrame:
    """Add the slice and the ``(key, slice)`` cell, never null itself."""
    return df.withColumn(_SLICE, slice_expr).withColumn(_CELL, F.struct(*keys, _SLICE))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_expr: Column,
    running_sums: Mapping[str, Column] | None = None,
    running_lasts: Mapping[str, Column] | None = None,
    key_totals: Mapping[str, Column] | None = None,
    key_mins: Mapping[str, Column] | None = None,
    switched_lasts: Mapping[str, tuple[str, Column, Column]] | None = None,
) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order`` (ties must not exist).

    ``running_sums``: name -> numeric expression; inclusive running sum.
    ``running_lasts``: name -> expression; last non-null value up to and
    including the row (``last(x, ignorenulls) over unbounded preceding``).
    ``key_totals``: name -> numeric expression; the sum over the whole key.
    ``key_mins``: name -> orderable expression; the minimum over the whole key.
    ``switched_lasts``: name -> (name of a running sum, expression where that sum is
    even at the row, expression where it is odd); the last non-null value so
    chosen. An event is then a function on (parity, value), and such functions
    compose: a slice's is known from its parity and its last value for either
    parity it may start with, so one scan does for both.
    ``slice_expr`` must be non-decreasing along ``order`` within a key.
    """
    switched_lasts = dict(switched_lasts or {})
    running_sums = dict(running_sums or {})
    running_lasts = dict(running_lasts or {})
    key_totals = dict(key_totals or {})
    key_mins = dict(key_mins or {})
    keys = list(keys)
    order_cols = [F.col(c) for c in order]

    src = _with_cell(df, keys, slice_expr)
    for name, e in {**running_sums, **running_lasts, **key_totals, **key_mins}.items():
        src = src.withColumn(f"__v_{name}", e)

    w_local = (
        Window.partitionBy(_CELL)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = src
    for name in running_sums:
        local = local.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(w_local))
    for name in running_lasts:
        local = local.withColumn(f"__l_{name}", F.last(f"__v_{name}", ignorenulls=True).over(w_local))

    if switched_lasts:
        if key_totals or key_mins:
            raise ValueError("switched_lasts do not go with totals of a key")
        for name, (total, even, odd) in switched_lasts.items():
            starts_even = F.col(f"__l_{total}") % 2 == 0
            for start, value in ((0, F.when(starts_even, even).otherwise(odd)), (1, F.when(starts_even, odd).otherwise(even))):
                local = local.withColumn(f"__l_{name}_{start}", F.last(value, ignorenulls=True).over(w_local))
        return _switched(local, keys, order_cols, running_sums, running_lasts, switched_lasts)

    # Slice totals: one row per (key, slice); partial aggregation before the shuffle.
    order_struct = F.struct(*order_cols)
    aggs = [F.sum(f"__v_{n}").alias(f"__t_{n}") for n in running_sums]
    aggs += [
        F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), order_struct)).alias(f"__t_{n}")
        for n in running_lasts
    ]
    aggs += [F.sum(f"__v_{n}").alias(f"__k_{n}") for n in key_totals]
    aggs += [F.min(f"__v_{n}").alias(f"__k_{n}") for n in key_mins]
    if not aggs:
        raise ValueError("ordered_scan needs at least one aggregate")
    totals = src.groupBy(_CELL).agg(*aggs)
    totals = totals.select(f"{_CELL}.*", "*")

    w_before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    w_key = Window.partitionBy(*keys)
    carry_cols = [F.coalesce(F.sum(f"__t_{n}").over(w_before), F.lit(0)).alias(f"__c_{n}") for n in running_sums]
    carry_cols += [F.last(f"__t_{n}", ignorenulls=True).over(w_before).alias(f"__c_{n}") for n in running_lasts]
    carry_cols += [F.sum(f"__k_{n}").over(w_key).alias(n) for n in key_totals]
    carry_cols += [F.min(f"__k_{n}").over(w_key).alias(n) for n in key_mins]
    carry = totals.select(_CELL, *carry_cols)

    out = local.join(carry, _CELL, "inner")
    for name in running_sums:
        out = out.withColumn(name, F.col(f"__l_{name}") + F.col(f"__c_{name}"))
    for name in running_lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}")))
    drop = [_SLICE, _CELL] + [c for c in out.columns if c.startswith(("__v_", "__l_", "__c_"))]
    return out.drop(*drop)


def _switched(
    local: DataFrame,
    keys: list[str],
    order_cols: list[Column],
    running_sums: Mapping[str, Column],
    running_lasts: Mapping[str, Column],
    switched_lasts: Mapping[str, tuple[str, Column, Column]],
) -> DataFrame:
    """The carry of :func:`ordered_scan` where a value depends on a running sum: the
    slices' composed functions are their last rows' local values."""
    both = [f"{n}_{start}" for n in switched_lasts for start in (0, 1)]
    names = [*running_sums, *running_lasts, *both]
    next_row = F.lead(F.lit(1)).over(Window.partitionBy(_CELL).orderBy(*order_cols))
    last_row = local.withColumn("__end", next_row.isNull()).where("__end")
    totals = last_row.select(_CELL, *[F.col(f"__l_{n}").alias(f"__t_{n}") for n in names]).select(f"{_CELL}.*", "*")
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({f"__c_{n}": F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)) for n in running_sums})
    carry = carry.withColumns({f"__c_{n}": F.last(f"__t_{n}", ignorenulls=True).over(before) for n in running_lasts})
    for n, (total, _, _) in switched_lasts.items():
        own = F.when(F.col(f"__c_{total}") % 2 == 0, F.col(f"__t_{n}_0")).otherwise(F.col(f"__t_{n}_1"))
        carry = carry.withColumn(f"__c_{n}", F.last(own, ignorenulls=True).over(before))
    out = local.join(carry.select(_CELL, *[f"__c_{n}" for n in [*running_sums, *running_lasts, *switched_lasts]]), _CELL)
    for n, (total, _, _) in switched_lasts.items():
        own = F.when(F.col(f"__c_{total}") % 2 == 0, F.col(f"__l_{n}_0")).otherwise(F.col(f"__l_{n}_1"))
        out = out.withColumn(n, F.coalesce(own, F.col(f"__c_{n}")))
    out = out.withColumns({n: F.col(f"__l_{n}") + F.col(f"__c_{n}") for n in running_sums})
    out = out.withColumns({n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in running_lasts})
    return out.drop(_SLICE, _CELL, *[c for c in out.columns if c.startswith(("__v_", "__l_", "__c_"))])


def event_slice(ts_ms: Column | str, slice_ms: int) -> Column:
    """Slice of an epoch-millisecond event time."""
    c = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return F.floor(c / F.lit(slice_ms)).cast("long")


def block_slice(n: Column | str, block: int) -> Column:
    """Slice of a non-negative integer order key (turn number)."""
    c = F.col(n) if isinstance(n, str) else n
    return F.floor(c / F.lit(block)).cast("long")


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_expr: Column,
    value: str,
    out: str,
) -> DataFrame:
    """``lead(value)`` per key in ``order``, computed in slices.

    Inside a slice the local ``lead`` answers; the last row of a slice takes
    the first value of the key's next non-empty slice, found on the small
    per-slice table (one row per key and slice) and joined back on
    ``(key, slice)``.
    """
    keys = list(keys)
    order_cols = [F.col(c) for c in order]
    src = _with_cell(df, keys, slice_expr)
    w_local = Window.partitionBy(_CELL).orderBy(*order_cols)
    local = src.withColumn("__lead", F.lead(value).over(w_local)).withColumn(
        "__is_last", F.lead(F.lit(1)).over(w_local).isNull()
    )
    firsts = src.groupBy(_CELL).agg(F.min_by(F.col(value), F.struct(*order_cols)).alias("__first"))
    w_slices = Window.partitionBy(*keys).orderBy(_SLICE)
    carry = firsts.select(f"{_CELL}.*", "*").select(
        _CELL, F.lead("__first").over(w_slices).alias("__next_first")
    )
    out_df = local.join(carry, _CELL, "inner").withColumn(
        out, F.when(F.col("__is_last"), F.col("__next_first")).otherwise(F.col("__lead"))
    )
    return out_df.drop(_SLICE, _CELL, "__lead", "__is_last", "__next_first")


def with_prev(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_expr: Column,
    value: str,
    out: str,
) -> DataFrame:
    """``lag(value)`` per key in ``order``, computed in slices (the mirror of
    ``with_next``: the first row of a slice takes the last value of the key's
    previous non-empty slice)."""
    keys = list(keys)
    order_cols = [F.col(c) for c in order]
    src = _with_cell(df, keys, slice_expr)
    w_local = Window.partitionBy(_CELL).orderBy(*order_cols)
    local = src.withColumn("__lag", F.lag(value).over(w_local)).withColumn(
        "__is_first", F.lag(F.lit(1)).over(w_local).isNull()
    )
    lasts = src.groupBy(_CELL).agg(F.max_by(F.col(value), F.struct(*order_cols)).alias("__last"))
    w_slices = Window.partitionBy(*keys).orderBy(_SLICE)
    carry = lasts.select(f"{_CELL}.*", "*").select(
        _CELL, F.lag("__last").over(w_slices).alias("__prev_last")
    )
    out_df = local.join(carry, _CELL, "inner").withColumn(
        out, F.when(F.col("__is_first"), F.col("__prev_last")).otherwise(F.col("__lag"))
    )
    return out_df.drop(_SLICE, _CELL, "__lag", "__is_first", "__prev_last")
