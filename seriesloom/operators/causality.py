"""Granger causality: does the past of x help to predict y beyond y's own past?

For lag L the target y(t) is regressed on its own last L values (restricted) and on
the last L values of x as well (full). The F statistic compares the residual sums.

How it runs on Spark. The last L values of a series span the same space as its last value and
the L - 1 differences before it, and the target may be replaced by its difference. In that
form the columns of a trending series stay apart however long it gets. Every cross product
a regression at any lag L <= M needs is then one of 8 M + 9 sums of products of levels and differences at
distances 0..M, except for the few rows at either end of a series, which only some lags
include. So one ordinary aggregation yields those sums for all lags together, with map-side
combining; the at most 3 M rows at the ends travel along, and a small numpy routine per Arrow
batch turns (sums, ends) into the Gram matrices and solves them. No series is ever
gathered: a series of any length becomes one row of about 120 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.fdist import f_upper_tail
from seriesloom.operators.series import (
    MAX_SERIES_ROWS, Parts, from_window, over_long, over_short, renamed_keys, same_keys, separate_long, total_order)

# Fixed value: largest lag tested by default.
MAX_LAG = 14
# Scale of the optional jitter and number of its steps.
JITTER_UNIT, JITTER_STEPS = 1e-8, 100
# A column explained by the earlier ones up to this share of its sum of squares is lost in rounding.
ROUNDING = 1e-12
_SOLVE_ROWS = 512

DOF_MODES = ("reference", "standard")


# Products per row: y, x, their differences, then these, the later factor first ("y" level, "dy" difference).
_SINGLE = (("y", "y", 0), ("x", "x", 0), ("y", "x", 0), ("dy", "y", 1), ("dy", "x", 1))
_DIFFERENCES = (("dy", "dy"), ("dx", "dx"), ("dy", "dx"), ("dx", "dy"))
_LEVELS = (("y", "dy"), ("x", "dx"), ("y", "dx"), ("x", "dy"))


def _product_list(m: int) -> list[tuple[str, str, int]]:
    """(later factor, earlier factor, distance) of every product, in order."""
    return [*_SINGLE, *[(a, b, d) for d in range(m) for a, b in _DIFFERENCES],
            *[(a, b, d) for d in range(m) for a, b in _LEVELS]]


def _end_products(first: np.ndarray, last: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels, differences and products of the first m and of the last m rows.

    ``first`` holds (y, x) of the first m rows, ``last`` of the last 2m. Products that reach beyond what is
    held are meaningless; no regression uses them.
    """
    rows = m + np.arange(m)

    def products(padded: np.ndarray) -> np.ndarray:
        change = np.diff(padded, axis=2, prepend=0.0)
        series = {"y": padded[:, 0], "x": padded[:, 1], "dy": change[:, 0], "dx": change[:, 1]}
        return np.stack([*[series[c][:, rows] for c in ("y", "x", "dy", "dx")],
                         *[series[a][:, rows] * series[b][:, rows - d] for a, b, d in _product_list(m)]], axis=-1)

    return products(np.concatenate([np.zeros_like(first), first], axis=2)), products(last)


def _grams(lags: Sequence[int], n: np.ndarray, core: np.ndarray, head: np.ndarray, tail: np.ndarray,
           m: int) -> dict[int, np.ndarray]:
    """Lower triangles of the cross products of (1, y columns, x columns, target) after the first lag rows.

    The columns of a series are its level one row back and its differences 1..lag - 1 rows back; the target is
    the difference of y. A product with its later factor i rows back runs over the rows
    from lag + 1 - i to n - i: all core rows, the head rows from that start on, and the tail rows
    up to that end.
    """
    row = np.arange(1, m + 1)
    tail_row = n[:, None] - m + row
    at_differences = 4 + len(_SINGLE)
    at_levels = at_differences + 4 * m
    grams = {lag: np.zeros((len(n), 2 * lag + 2, 2 * lag + 2)) for lag in lags}
    for lag, g in grams.items():
        g[:, 0, 0] = n - lag
    for i in range(max(max(lags), 2)):
        late = (tail_row > m) & (tail_row <= n[:, None] - i)
        ended = core + np.einsum("br,brk->bk", late.astype(float), tail)
        from_row = (head * (row <= n[:, None] - i)[:, :, None])[:, ::-1].cumsum(axis=1)[:, ::-1]
        for lag in lags:
            if lag < max(i, 1):
                continue
            start = lag - i
            sums = ended + from_row[:, start] if start < m else ended
            g = grams[lag]
            y_at, x_at = 1, lag + 1  # the levels; the difference k rows back is k columns further
            dd = sums[:, at_differences:at_levels].reshape(len(n), m, 4)
            if i == 0:
                g[:, -1, 0] = sums[:, 2]
                g[:, -1, y_at], g[:, -1, x_at] = sums[:, 7], sums[:, 8]
                g[:, -1, y_at + 1:x_at] = dd[:, 1:lag, 0]
                g[:, -1, x_at + 1:-1] = dd[:, 1:lag, 2]
                g[:, -1, -1] = dd[:, 0, 0]
                continue
            if i == 1:
                level = sums[:, at_levels:].reshape(len(n), m, 4)[:, :lag]
                g[:, y_at, 0], g[:, x_at, 0] = sums[:, 0], sums[:, 1]
                g[:, y_at, y_at], g[:, x_at, x_at], g[:, x_at, y_at] = sums[:, 4], sums[:, 5], sums[:, 6]
                g[:, y_at + 1:x_at, y_at] = level[:, :lag - 1, 0]
                g[:, x_at + 1:-1, x_at] = level[:, :lag - 1, 1]
                g[:, x_at + 1:-1, y_at] = level[:, :lag - 1, 2]
                g[:, x_at, y_at + 1:x_at] = level[:, :lag - 1, 3]
            if i < lag:
                far = lag - i
                g[:, y_at + i, 0], g[:, x_at + i, 0] = sums[:, 2], sums[:, 3]
                g[:, y_at + i:x_at, y_at + i] = dd[:, :far, 0]
                g[:, x_at + i:-1, x_at + i] = dd[:, :far, 1]
                g[:, x_at + i:-1, y_at + i] = dd[:, :far, 2]
                g[:, x_at + i, y_at + i:x_at] = dd[:, :far, 3]
    return grams


def _cholesky(g: np.ndarray) -> np.ndarray:
    """Lower factors; NaN from the column on where a matrix has none."""
    try:
        return np.linalg.cholesky(g)
    except np.linalg.LinAlgError:
        out = np.zeros_like(g)
        for j in range(g.shape[1]):
            rest = g[:, j:, j] - np.einsum("bik,bk->bi", out[:, j:, :j], out[:, j, :j])
            out[:, j:, j] = rest / np.sqrt(np.where(rest[:, :1] > 0, rest[:, :1], np.nan))
        return out


def _residuals(g: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(drop in residual sum by the x lags, full residual sum); NaN if not determined."""
    scale = np.einsum("bii->bi", g).copy()
    total = scale[:, -1]
    # doubling the last entry keeps the matrix definite even if y is fitted exactly
    g[:, -1, -1] *= 2
    factor = _cholesky(g)
    pivots = np.einsum("bii->bi", factor)[:, :-1] ** 2
    explained = factor[:, -1, :-1] ** 2
    drop = explained[:, lag + 1:].sum(axis=1)
    restricted = total - explained[:, :lag + 1].sum(axis=1)
    full = np.maximum(restricted - drop, np.finfo(float).eps * total)
    sound = (pivots > ROUNDING * scale[:, :-1]).all(axis=1) & (restricted > ROUNDING * total)
    return np.where(sound, drop, np.nan), full


def _tests(lags: Sequence[int], n: np.ndarray, core: np.ndarray, first: np.ndarray, last: np.ndarray,
           m: int, dof_mode: str) -> np.ndarray:
    """f of every lag, then p of every lag, per series; NaN where there is none."""
    head, tail = _end_products(first, last, m)
    rows, lag = n[:, None], np.array(lags)
    drop, full = np.full((len(n), len(lags)), np.nan), np.ones((len(n), len(lags)))
    for i, (k, g) in enumerate(_grams(lags, n, core, head, tail, m).items()):
        enough = n >= 3 * k + 2
        if enough.any():
            drop[enough, i], full[enough, i] = _residuals(g[enough], k)
    spare = np.maximum(rows - 3 * lag - 1, 1)
    f = (drop / lag) / (full / (spare + (1 if dof_mode == "reference" else 0)))
    return np.concatenate([f, f_upper_tail(f, lag, spare)], axis=1)


def _solver(lags: Sequence[int], m: int, dof_mode: str):
    """Pandas UDF: (n, means and deviations with sums, values at the ends) to f and p per lag."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solved(n: pd.Series, sums: pd.Series, ends_x: pd.Series, ends_y: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(n), _SOLVE_ROWS):
            part = slice(start, start + _SOLVE_ROWS)
            size = n.iloc[part].to_numpy(np.int64)
            table = np.stack(sums.iloc[part].to_numpy()).astype(float)
            first, last = np.zeros((len(size), 2, m)), np.zeros((len(size), 2, 2 * m))
            for i, pair in enumerate(zip(ends_y.iloc[part], ends_x.iloc[part])):
                values = (np.array(pair) - table[i, [[2], [0]]]) / table[i, [[3], [1]]]
                first[i, :, :min(m, values.shape[1])] = values[:, :m]
                last[i, :, max(0, 2 * m - values.shape[1]):] = values[:, -2 * m:]
            varies = np.isfinite(table[:, :4]).all(axis=1)
            found = np.full((len(size), 2 * len(lags)), np.nan)
            if varies.any():
                found[varies] = _tests(lags, size[varies], table[varies, 4:], first[varies], last[varies], m, dof_mode)
            out.extend(found)
        return pd.Series(out)

    return solved


def _jittered(value: Column, seed: int, salt: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    step = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys, *order), F.lit(JITTER_STEPS))
    return value + step * JITTER_UNIT


def _lag_sums(parts: Parts, keys: Sequence[str], order: Sequence[str], m: int, max_rows: int | None,
              xs: Sequence[str] = ("x",), unique: bool = False) -> DataFrame:
    """One row per series: row count, values of y at both ends, and for each driver (a column of ``xs``)
    moments with sums of products and its values at the ends.

    The sums that only y enters are written once per driver, but Spark computes equal aggregates once. ``unique``
    rows need no tie-break, so that rows sorted by keys and order already are not sorted again.
    """
    series = (*xs, "y")
    order = list(order) if unique else total_order(parts.short, keys, order)

    def build(w: WindowSpec) -> dict[str, Column]:
        lags = {f"z{c}{d}": F.lag(f"z{c}", d).over(w) for c in series for d in range(1, m + 1)}
        return {**lags,
                "__early": F.lag(F.lit(1), m).over(w).isNull(),
                "__late": F.lead(F.lit(1), m).over(w).isNull(),
                "__end": F.lead(F.lit(1), 2 * m).over(w).isNull()}

    # F and p do not change when x or y is shifted or scaled; standard scores keep the sums exact.
    scores = {f"z{c}": F.expr(f"({c} - __mean_{c}) / __sd_{c}") for c in series}

    def moments(aggregate) -> dict[str, Column]:
        return {f"__{name}_{c}": F.nullif(aggregate(agg(c)), F.lit(0.0)) if name == "sd" else aggregate(agg(c))
                for c in series for name, agg in (("mean", F.avg), ("sd", F.stddev_samp))}

    whole = (Window.partitionBy(*keys).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scored = parts.short.withColumns(moments(lambda a: a.over(whole))).withColumns(scores)
    lagged = edges = over_short(scored, keys, order, from_window(build))

    def with_scores(long: DataFrame) -> DataFrame:
        stats = long.groupBy(*keys).agg(*[c.alias(name) for name, c in moments(lambda a: a).items()])
        joined = long.join(parts.sized(renamed_keys(stats, keys, "__k_")), same_keys(keys, "__k_"))
        return joined.withColumns(scores).drop(*[f"__k_{k}" for k in keys])

    if parts.long is not None:
        inner, border = over_long(
            parts.long, parts.long_rows, keys, order, from_window(build), m, 2 * m, max_rows, prepare=with_scores)
        # The first m and the last 2 m rows of a series are always at a border.
        lagged, edges = lagged.unionByName(inner).unionByName(border), edges.unionByName(border)

    def back(factor: str, d: int, x: str) -> str:
        """A level ("y") or difference ("dy") ``d`` rows back."""
        c = x if factor[-1] == "x" else "y"
        level = [f"z{c}{k or ''}" for k in (d, d + 1)]
        return f"({level[0]} - {level[1]})" if factor[0] == "d" else level[0]

    inside = "CASE WHEN NOT __early AND NOT __late THEN {} END"
    lagged = lagged.withColumns({f"c{f}{c}": F.expr(inside.format(back(f"{f}{'y' if c == 'y' else 'x'}", 0, c)))
                                 for c in series for f in ("", "d")})

    def core(factor: str, x: str) -> str:
        return f"c{factor[:-1]}{x if factor[-1] == 'x' else 'y'}"

    def numbers(x: str) -> str:
        sums = [core(f, x) for f in ("y", "x", "dy", "dx")]
        sums += [f"{core(a, x)} * {back(b, d, x)}" for a, b, d in _product_list(m)]
        head = [f"coalesce(max(__{name}_{c}), double('NaN'))" for c in (x, "y") for name in ("mean", "sd")]
        return f"array({', '.join(head + [f'coalesce(sum({s}), 0D)' for s in sums])}) AS __sums_{x}"

    inner = lagged.groupBy(*keys).agg(F.expr("count(1) AS __n"), *[F.expr(numbers(x)) for x in xs])
    # At most 3 m rows of a series carry one of the flags.
    items = F.struct(F.struct(*order).alias("at"), *series)
    ends = (edges.where(F.col("__early") | F.col("__end")).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(items)).alias("__ends")))
    ends = ends.select(*keys, *[F.col(f"__ends.{c}").alias(f"__ends_{c}") for c in series])
    both = inner.join(renamed_keys(ends, keys, "__e_"), same_keys(keys, "__e_"))
    return both.select(*keys, "__n", "__ends_y", *[f"__{part}_{x}" for x in xs for part in ("sums", "ends")])


def _driver_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str],
                 y: str, max_rows: int | None) -> Parts:
    """Long form ``keys, driver, order, x, y``; rows with a missing value are left out.

    Rows are shuffled by the keys before they are repeated per driver; windows over keys and driver
    then need no shuffle of their own. The limit on rows in one task counts repeated rows.
    """
    if taken := {"x", "y", "driver"} & {c.lower() for c in (*keys, *order)}:
        raise ValueError(f"rename key or order columns {sorted(taken)} first")
    wide = df.select(*keys, *order, F.col(y).cast("double").alias("__y"),
                     *[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(xs)])
    parts = separate_long(wide, keys, None if max_rows is None else max(1, max_rows // len(xs)))

    def repeated(rows: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("driver"), F.col(f"__x{i}").alias("x"))
                                    for i, x in enumerate(xs)])).alias("__pair")
        rows = rows.select(*keys, *order, F.col("__y").alias("y"), pairs)
        rows = rows.select(*keys, "__pair.driver", *order, "__pair.x", "y")
        return rows.na.drop(subset=[*order, "x", "y"])

    short = parts.short.repartition(*keys) if keys and len(xs) > 1 else parts.short
    return Parts(repeated(short), None if parts.long is None else repeated(parts.long),
                 parts.long_keys * len(xs), parts.long_rows * len(xs))


def granger_all_lags(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str], y: str,
                     lags: Sequence[int] = range(1, MAX_LAG + 1), dof_mode: str = "reference",
                     jitter_seed: int | None = None,
                     max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """``keys..., driver, results``: an array of (lag, n, f, p) per series and driver.

    ``n`` is the number of regression rows. f and p are NULL when the series has fewer than
    3 lag + 2 rows or its lagged values are collinear. ``dof_mode="reference"`` divides the full
    residual sum by n - 2 lag, ``"standard"`` by n - 2 lag - 1; p always uses the latter.
    ``jitter_seed`` adds up to 1e-6 to x and y, repeatably, so that constant stretches stay testable.
    """
    if dof_mode not in DOF_MODES:
        raise ValueError(f"unknown dof_mode {dof_mode!r}")
    lags = sorted(set(lags))
    if not lags or lags[0] < 1:
        raise ValueError("lags must be positive")
    parts = _driver_rows(df, keys, order, xs, y, max_rows)
    by = [*keys, "driver"]
    if jitter_seed is not None:
        moved = {c: _jittered(F.col(c), jitter_seed, c, by, order) for c in ("x", "y")}
        parts = parts._replace(short=parts.short.withColumns(moved),
                               long=parts.long and parts.long.withColumns(moved))
    m = lags[-1]
    sums = _lag_sums(parts, by, order, m, max_rows)
    stat = _solver(lags, m, dof_mode)("__n", "__sums_x", "__ends_x", "__ends_y")
    return sums.select(*by, "__n", stat.alias("__stat")).select(*by, _lag_results(lags, "__stat").alias("results"))


def _lag_results(lags: Sequence[int], stat: str) -> Column:
    """(lag, n, f, p) of every lag from the solver's numbers."""
    def number(at: Column) -> Column:
        return F.nullif(F.get(stat, at), F.lit(float("nan")))

    return F.transform(F.array(*[F.lit(lag) for lag in lags]), lambda lag, i: F.struct(
        lag.alias("lag"), F.greatest(F.col("__n") - lag, F.lit(0)).cast("long").alias("n"),
        number(i).alias("f"), number(i + len(lags)).alias("p")))


def granger_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, lag: int,
                dof_mode: str = "reference", jitter_seed: int | None = None,
                max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Test at one lag: ``keys..., lag, n, f, p``, one row per series."""
    found = granger_all_lags(df, keys, order, [x], y, [lag], dof_mode, jitter_seed, max_rows)
    return found.select(*keys, F.inline("results"))


def _best(results: Column) -> Column:
    """Result with the smallest p below 1; the smaller lag wins ties."""
    usable = F.filter(results, lambda r: r["p"] < 1)
    ranked = F.transform(usable, lambda r: F.struct(
        r["p"].alias("p"), r["lag"].alias("lag"), r["n"].alias("n"), r["f"].alias("f")))
    return F.array_min(ranked)


def granger_panel(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str], y: str,
                  max_lag: int = MAX_LAG, dof_mode: str = "reference", jitter_seed: int | None = None,
                  max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Scan lags 1..max_lag for several drivers: ``keys..., driver, lag, n, f, p``.

    Keeps the lag with the smallest p. Where no lag gives p < 1: f = 1, p = 1, lag and n NULL.
    """
    found = granger_all_lags(df, keys, order, xs, y, range(1, max_lag + 1), dof_mode, jitter_seed, max_rows)
    best = found.select(*keys, "driver", _best(F.col("results")).alias("__best"))
    return best.select(*keys, "driver", "__best.lag", "__best.n",
                       F.coalesce("__best.f", F.lit(1.0)).alias("f"),
                       F.coalesce("__best.p", F.lit(1.0)).alias("p"))


def granger_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str,
                 max_lag: int = MAX_LAG, dof_mode: str = "reference", jitter_seed: int | None = None,
                 max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Scan of one driver: ``keys..., lag, n, f, p``, one row per series."""
    return granger_panel(df, keys, order, [x], y, max_lag, dof_mode, jitter_seed, max_rows).drop("driver")


def granger_pooled(df: DataFrame, order: Sequence[str], x: str, y: str, max_lag: int = MAX_LAG,
                   dof_mode: str = "reference", jitter_seed: int | None = None,
                   max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Treat the whole table as one series in ``order``: ``lag, n, f, p`` for every lag."""
    found = granger_all_lags(df, [], order, [x], y, range(1, max_lag + 1), dof_mode, jitter_seed, max_rows)
    return found.select(F.inline("results"))


def granger_wide(df: DataFrame, keys: Sequence[str], order: Sequence[str], xs: Sequence[str], y: str,
                 max_lag: int = MAX_LAG, dof_mode: str = "reference", max_rows: int | None = MAX_SERIES_ROWS,
                 unique: bool = False, prefix: str = "Causation_") -> DataFrame:
    """``keys..., Causation_<x>_F, Causation_<x>_p``: as ``wide_result`` of ``granger_panel``, in one pass for all drivers.

    Levels and differences of y and of every x stand in one row, and their cross products are summed per key in
    one aggregate, from which each driver's system is cut: no row is repeated per driver. That takes drivers with values
    in the same rows. If a row lacks some of its drivers only, their series differ, and drivers are
    tested one by one. ``unique`` says that no two rows of a series tie in ``order``.
    """
    names = [f"x{i}" for i in range(len(xs))]
    if taken := {"y", *names} & {c.lower() for c in (*keys, *order)}:
        raise ValueError(f"rename key or order columns {sorted(taken)} first")
    rows = df.select(*keys, *order, F.col(y).cast("double").alias("y"),
                     *[F.col(x).cast("double").alias(n) for x, n in zip(xs, names)]).na.drop(subset=[*order, "y"])
    missing = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
    if len(xs) > 1 and not rows.where(missing.between(1, len(xs) - 1)).isEmpty():
        panel = granger_panel(df, keys, order, xs, y, max_lag, dof_mode, max_rows=max_rows)
        return wide_result(panel, keys, xs, prefix)
    lags = list(range(1, max_lag + 1))
    parts = separate_long(rows.na.drop(subset=names), keys, max_rows)
    sums = _lag_sums(parts, keys, order, max_lag, max_rows, names, unique)
    solve = _solver(lags, max_lag, dof_mode)
    stats = sums.select(*keys, "__n", *[solve("__n", f"__sums_{n}", f"__ends_{n}", "__ends_y").alias(f"__{n}") for n in names])
    best = stats.select(*keys, *[_best(_lag_results(lags, f"__{n}")).alias(n) for n in names])
    return best.select(*keys, *[F.coalesce(f"{n}.{c}", F.lit(1.0)).alias(f"{prefix}{x}_{c.upper() if c == 'f' else c}")
                                for n, x in zip(names, xs) for c in ("f", "p")])


def wide_result(panel: DataFrame, keys: Sequence[str], xs: Sequence[str], prefix: str = "Causation_",
                ) -> DataFrame:
    """Pivot a panel result to ``keys..., Causation_<x>_F, Causation_<x>_p`` per driver."""
    columns = []
    for x in xs:
        here = F.col("driver") == x
        columns.append(F.max(F.when(here, F.col("f"))).alias(f"{prefix}{x}_F"))
        columns.append(F.max(F.when(here, F.col("p"))).alias(f"{prefix}{x}_p"))
    return panel.groupBy(*keys).agg(*columns)
