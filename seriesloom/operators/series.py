"""Row-offset operators over many series: growth, forward peak, lags, ordered arrays.

A series is the set of rows sharing ``keys``, in the order of ``order``. Rows that tie
on ``order`` are ranked by their remaining columns, so results never depend on
partitioning.

Scale: a plain ``Window.partitionBy(keys)`` puts a whole series into one task. That is
only used for series of at most ``max_rows`` rows. Longer ones are range-partitioned into
blocks, and each block hands the rows at its ends to its neighbours (a halo): every window
is then over keys and block. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.enrich import MAX_BROADCAST_BYTES
from seriesloom.storage import written_table

# Longest series handled by one task; None in the operators below means "no check":
# the caller knows a bound, for instance one row per calendar day.
MAX_SERIES_ROWS = 2_000_000
# Most blocks one range partitioning makes; beyond it blocks grow and sort with spill.
MAX_BLOCKS = 20_000
# Most rows (one per block and series) of the tables that place blocks, for these to be broadcast.
MAX_SPANS = 200_000
# Columns beyond keys and order that decide ties by their value; a hash of all others decides the rest.
TIE_COLUMNS = 4
# Horizons up to this many rows are searched row by row.
DIRECT_HORIZON = 32

_BLOCK, _ROW_ID, _INDEX = "__block", "__row_id", "__index"

Order = Sequence[str | Column]
# Columns from a window, or a table with more columns from (table, partition columns, order).
Build = Callable[[WindowSpec], dict[str, Column]]
Extend = Callable[[DataFrame, Sequence[str], Order], DataFrame]


def from_window(build: Build) -> Extend:
    """The table with the columns that ``build`` makes of the window."""
    return lambda df, by, order: df.withColumns(build(Window.partitionBy(*by).orderBy(*order)))


def total_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[str | Column]:
    """``order`` and a repeatable tie-break from the other columns.

    The first few numbers and dates decide by their value, then one hash of all columns left. So the
    order stays narrow however wide the rows are, as range partitioning samples it.
    """
    used = {c.lower() for c in (*keys, *order)}
    rest = [f for f in df.schema.fields
            if f.name.lower() not in used and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    narrow = [f.name for f in rest if isinstance(f.dataType, (T.NumericType, T.DatetimeType, T.BooleanType))][:TIE_COLUMNS]
    others = [F.col(f"`{f.name}`") for f in rest if f.name not in narrow]
    return [*order, *narrow, *([F.xxhash64(*others)] if others else [])]


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Condition that each key equals its renamed copy, NULL being equal to NULL."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`{prefix}{k}`"))
    return cond


def renamed_keys(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with its key columns prefixed, ready to be joined by ``same_keys``."""
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


class Parts(NamedTuple):
    """Rows of short series, rows of long series (or None), and the measured size of the latter."""

    short: DataFrame
    long: DataFrame | None = None
    long_keys: int = 0
    long_rows: int = 0
    key_bytes: int = 0

    def sized(self, per_key: DataFrame, row_bytes: int = 64) -> DataFrame:
        """Mark a table of one row per long series for broadcasting if its bytes allow it."""
        size = self.key_bytes + self.long_keys * row_bytes
        return F.broadcast(per_key) if size <= MAX_BROADCAST_BYTES else per_key


def separate_long(df: DataFrame, keys: Sequence[str], max_rows: int | None = MAX_SERIES_ROWS) -> Parts:
    """Split ``df`` into rows of short series and rows of series longer than ``max_rows``.

    The measuring job reads the key columns only and combines counts before its shuffle. There
    are fewer than rows / max_rows long keys; they are stored, and broadcast when their measured size is
    small, else joined by shuffle.
    """
    if max_rows is None:
        return Parts(df)
    if not keys:
        n_rows = df.count()
        return Parts(df) if n_rows <= max_rows else Parts(df.limit(0), df, 1, n_rows)
    long_keys = written_table(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > max_rows))
    n_keys, n_rows, n_bytes = long_keys.agg(
        F.count(F.lit(1)), F.sum("__rows"), F.sum(F.octet_length(F.to_json(F.struct(*keys))))).first()
    if n_keys == 0:
        return Parts(df)
    parts = Parts(df, None, n_keys, n_rows, n_bytes)
    marks = parts.sized(renamed_keys(long_keys.drop("__rows"), keys, "__long_"))
    same = same_keys(keys, "__long_")
    return parts._replace(short=df.join(marks, same, "left_anti"), long=df.join(marks, same, "left_semi"))


def over_short(df: DataFrame, keys: Sequence[str], order: Order, extend: Extend,
               position: str | None = None) -> DataFrame:
    """Add window columns to series known to fit one task: one shuffle on the keys."""
    out = extend(df, keys, order)
    if position:
        out = out.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return out


def block_spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., __block, __first, __from, __until``: index of a block's first row, place of its rows in their series.

    At most blocks + long keys rows, as blocks follow the key order; only counts meet per key.
    """
    sizes = rows.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__rows"), F.min(_INDEX).alias("__first"))
    until = F.sum("__rows").over(Window.partitionBy(*keys).orderBy(_BLOCK))
    return sizes.select(*keys, _BLOCK, "__first", (until - F.col("__rows")).alias("__from"), until.alias("__until"))


def halo_targets(spans: DataFrame, keys: Sequence[str], before: int, after: int) -> DataFrame:
    """``__h_keys..., __h_block, __target, __last, __head``: how many rows at the ends of a block which other needs.

    Block c needs the last ``__last`` rows of an earlier block b if fewer than ``before`` rows lie between them, and
    block b the first ``__head`` rows of c likewise. Mostly that is the next block; short blocks hand on to
    several. Blocks meet by the stretch of ``reach`` rows in which one ends and the other begins.
    """
    reach = max(before, after)
    at = F.floor(F.col("__until") / reach)
    earlier = spans.select(*[F.col(f"`{k}`").alias(f"__h_{k}") for k in keys], F.col(_BLOCK).alias("__b"),
                           F.col("__until").alias("__b_until"), F.explode(F.array(at, at + 1)).alias("__at"))
    met = earlier.join(spans.withColumn("__here", F.floor(F.col("__from") / reach)),
                       same_keys(keys, "__h_") & (F.col("__at") == F.col("__here")) & (F.col("__from") >= F.col("__b_until")))
    room, none = F.col("__from") - F.col("__b_until"), F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("__b").alias(f"__h_{_BLOCK}"), F.col(_BLOCK).alias("__target"), (before - room).alias("__last"), none.alias("__head")),
        F.struct(F.col(_BLOCK).alias(f"__h_{_BLOCK}"), F.col("__b").alias("__target"), none.alias("__last"), (after - room).alias("__head")))
    needed = met.select(*[F.col(f"`__h_{k}`") for k in keys], F.inline(both))
    return needed.where((F.col("__last") > 0) | (F.col("__head") > 0))


def over_long(df: DataFrame, n_rows: int, keys: Sequence[str], order: Order, extend: Extend,
              before: int, after: int, max_rows: int, position: str | None = None,
              prepare: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Add window columns to long series block by block: (rows inside blocks, rows at borders).

    A row is inside if its block holds ``before`` rows ahead of it and ``after`` rows behind it. The rows at
    borders are computed from the ends of their block and the rows its neighbours hand over. The
    rows are stored once, sorted, with a row id (so that exact copies can be spread over blocks; given in sorted order,
    it is the same if a task runs again), their block number and their index in it: so ranks and ends of blocks are known
    without a window. ``prepare`` may add columns to the stored rows.
    """
    n_blocks = max(2, min(MAX_BLOCKS, math.ceil(n_rows / max_rows)))
    ranked = df.sortWithinPartitions(*keys, *order).withColumn(_ROW_ID, F.monotonically_increasing_id())
    order, by = [*order, _ROW_ID], [*keys, _BLOCK]
    dealt = ranked.repartitionByRange(n_blocks, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = written_table(dealt.withColumns({_BLOCK: F.spark_partition_id(), _INDEX: F.monotonically_increasing_id()}))
    spans = written_table(block_spans(rows, keys))
    few = n_blocks + n_rows // max_rows <= MAX_SPANS
    sized = F.broadcast if few else (lambda table: table)
    if prepare:
        rows = prepare(rows)
    rows = rows.join(sized(renamed_keys(spans, by, "__s_")), same_keys(by, "__s_")).drop(*[f"__s_{k}" for k in by])
    rank, behind = F.col(_INDEX) - F.col("__first"), F.col("__until") - F.col("__from") + F.col("__first") - F.col(_INDEX) - 1
    if position:
        rows = rows.withColumn(position, F.col("__from") + rank + 1)
    complete = (rank >= before) & (behind >= after)
    inner = extend(rows, by, order).where(complete)
    helpers = (_ROW_ID, _BLOCK, _INDEX, "__first", "__from", "__until")
    columns = [F.col(f"`{c}`") for c in inner.columns if c not in helpers]
    if before + after == 0:
        return inner.select(*columns), inner.select(*columns).where(F.lit(False))

    # The ends of each block: what may be incomplete, and as many rows as their frames can reach.
    ends = rows.where((rank < before + after) | (behind < before + after))
    handed = ends.join(sized(halo_targets(spans, keys, before, after)), same_keys(by, "__h_")).where(
        (behind < F.col("__last")) | (rank < F.col("__head")))
    handed = handed.withColumn(_BLOCK, F.col("__target")).select(*[F.col(f"`{c}`") for c in rows.columns])
    both = ends.withColumn("__own", F.lit(True)).unionByName(handed.withColumn("__own", F.lit(False)))
    border = extend(both, by, order).where(F.col("__own") & ~complete)
    return inner.select(*columns), border.select(*columns)


def over_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], build: Build | None = None, *,
                before: int = 0, after: int = 0, position: str | None = None,
                max_rows: int | None = MAX_SERIES_ROWS, extend: Extend | None = None) -> DataFrame:
    """Add the columns ``build(window)`` to every row of every series.

    The expressions may look at most ``before`` rows back and ``after`` rows ahead.
    ``position`` names an extra column with the 1-based row number in the series. ``extend``, in place of
    ``build``, adds its columns in several steps.
    """
    extend = extend or from_window(build)
    order = total_order(df, keys, order)
    parts = separate_long(df, keys, max_rows)
    out = over_short(parts.short, keys, order, extend, position)
    if parts.long is None:
        return out
    inner, border = over_long(parts.long, parts.long_rows, keys, order, extend, before, after, max_rows, position)
    return out.unionByName(inner).unionByName(border)


def growth(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "growth",
           max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Difference to the previous row of the series; the first row counts from zero."""
    def build(w: WindowSpec) -> dict[str, Column]:
        return {out: F.col(value) - F.lag(value, 1, 0).over(w)}
    return over_series(df, keys, order, build, before=1, max_rows=max_rows)


def peak_by_stretches(value: str, out: str, horizon: int) -> Extend:
    """Largest of the next ``horizon`` values at a cost per row that does not grow with ``horizon``.

    Rows are cut into stretches of ``horizon``. The rows ahead of a row are the rest of its stretch and as many
    rows of the next stretch as stand before the row in its own. So one running maximum from the end of each stretch
    and one from its start give every result. At the end of the series the next stretch is cut short, and its
    maximum so far is that of the last row.
    """
    def extend(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
        names = df.columns
        place, stretch = F.col("__place"), F.col("__stretch")
        placed = df.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
        placed = placed.withColumn("__stretch", F.floor(place / horizon))
        inside = Window.partitionBy(*by, "__stretch")
        scanned = placed.withColumns({
            "__rest": F.max(value).over(inside.orderBy(place.desc()).rowsBetween(Window.unboundedPreceding, -1)),
            "__so_far": F.max(value).over(inside.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))})
        along = Window.partitionBy(*by).orderBy(place)
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        scanned = scanned.withColumns({
            "__next": F.lead("__so_far", horizon).over(along), "__reached": F.lead(F.lit(1), horizon).over(along),
            "__end": F.last("__so_far").over(whole), "__last": F.last("__stretch").over(whole)})
        beyond = F.when(F.col("__reached").isNotNull(), F.col("__next")).when(stretch < F.col("__last"), F.col("__end"))
        return scanned.withColumn(out, F.coalesce(F.greatest("__rest", beyond), F.col(value))).select(
            *[F.col(f"`{c}`") for c in dict.fromkeys([*names, out])])

    return extend


def next_peak(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "max_peak",
              horizon: int = 14, mode: str = "chunk", max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Largest value among the next ``horizon`` rows; the row's own value if it is the last.

    ``mode="sliding"`` keeps every row. ``mode="chunk"`` keeps the first row of every
    ``horizon + 1`` consecutive rows.
    """
    if mode not in ("chunk", "sliding"):
        raise ValueError(f"unknown mode {mode!r}")

    def build(w: WindowSpec) -> dict[str, Column]:
        return {out: F.coalesce(F.max(value).over(w.rowsBetween(1, horizon)), F.col(value))}

    extend = from_window(build) if horizon <= DIRECT_HORIZON else peak_by_stretches(value, out, horizon)
    if mode == "sliding":
        return over_series(df, keys, order, after=horizon, max_rows=max_rows, extend=extend)
    ranked = over_series(df, keys, order, after=horizon, position="__position", max_rows=max_rows, extend=extend)
    return ranked.where((F.col("__position") - 1) % (horizon + 1) == 0).drop("__position")


def lag_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                 max_lag: int, keep_incomplete: bool = False,
                 max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Add ``<column>_lag1 .. <column>_lag<max_lag>``.

    The first ``max_lag`` rows of a series lack some lags and are left out unless
    ``keep_incomplete`` is set.
    """
    def build(w: WindowSpec) -> dict[str, Column]:
        lags = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, max_lag + 1)}
        return {**lags, "__full": F.lag(F.lit(1), max_lag).over(w).isNotNull()}

    lagged = over_series(df, keys, order, build, before=max_lag, max_rows=max_rows)
    if not keep_incomplete:
        lagged = lagged.where("__full")
    return lagged.drop("__full")


def collect_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                   segment_rows: int = 100_000, max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """One ordered array per column and series: ``keys..., segment, columns..., n``.

    An array can hold only so much, so a series of more than ``segment_rows`` rows
    continues in segments 1, 2, ...; up to that length there is one row per series.
    A row with a NULL in any collected column is left out, which keeps the arrays aligned.
    """
    wanted = list(dict.fromkeys([*order, *columns]))
    rows = df.select(*keys, *wanted).na.drop(subset=wanted)
    placed = over_series(rows, keys, order, lambda w: {}, position="__position", max_rows=max_rows)
    placed = placed.withColumn("segment", F.floor((F.col("__position") - 1) / segment_rows))
    item = F.struct("__position", *columns)
    packed = placed.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(item)).alias("__items"))
    return packed.select(*keys, "segment", *[F.col("__items")[c].alias(c) for c in columns],
                         F.size("__items").cast("long").alias("n"))
