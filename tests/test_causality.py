"""Granger tests against least squares on explicit lag matrices."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.fdist import f_upper_tail
from seriesloom.operators import causality

SF = "/root/testdata"


def least_squares(x, y, lag, dof_mode="reference"):
    """(f, p) from two explicit regressions."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x) - lag
    target = y[lag:]
    own = [y[lag - k:-k] for k in range(1, lag + 1)]
    other = [x[lag - k:-k] for k in range(1, lag + 1)]

    def rss(columns):
        a = np.column_stack([np.ones(n), *columns])
        return float(((target - a @ np.linalg.lstsq(a, target, rcond=None)[0]) ** 2).sum())

    r0, r1 = rss(own), rss(own + other)
    f = ((r0 - r1) / lag) / (r1 / (n - 2 * lag - (dof_mode == "standard")))
    return f, float(f_upper_tail(f, lag, n - 2 * lag - 1))


def simulated(n, seed, strength=0.5, offset=0.0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.4 * y[t - 1] + strength * x[t - 1] + rnd.normal()
    return x + offset, y + offset


def frame(spark, series):
    rows = [(k, t, float(a), float(b)) for k, (x, y) in series.items() for t, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k string, d int, v double, w double").repartition(5)


def all_lags(spark, series, max_lag=14, **options):
    found = causality.granger_all_lags(frame(spark, series), ["k"], ["d"], ["v"], "w", range(1, max_lag + 1), **options)
    return {(r["k"], r["lag"]): r for r in found.select("k", F.inline("results")).collect()}


@pytest.mark.parametrize("max_rows", [None, 25])
@pytest.mark.parametrize("dof_mode", causality.DOF_MODES)
def test_equals_least_squares(spark, dof_mode, max_rows):
    series = {"a": simulated(60, 1), "b": simulated(200, 2, 0.0), "c": simulated(45, 3), "d": simulated(20, 4)}
    found = all_lags(spark, series, dof_mode=dof_mode, max_rows=max_rows)
    for k, (x, y) in series.items():
        for lag in range(1, 15):
            r = found[(k, lag)]
            assert r["n"] == len(x) - lag
            if len(x) < 3 * lag + 2:
                assert r["f"] is None and r["p"] is None
            else:
                f, p = least_squares(x, y, lag, dof_mode)
                assert r["f"] == pytest.approx(f, rel=1e-8, abs=1e-10)
                assert r["p"] == pytest.approx(p, rel=1e-8, abs=1e-10)


@pytest.mark.parametrize("n", list(range(3, 13)) + [29, 31, 43, 44])
def test_short_series(spark, n):
    x, y = simulated(n, n)
    found = all_lags(spark, {"a": (x, y)}, max_rows=None)
    for lag in range(1, 15):
        r = found[("a", lag)]
        if n < 3 * lag + 2:
            assert r["f"] is None
        else:
            assert r["f"] == pytest.approx(least_squares(x, y, lag)[0], rel=1e-6)


def test_shift_scale_and_spikes(spark):
    x, y = simulated(80, 7)
    spiked = y.copy()
    spiked[0] = 1e5
    series = {"plain": (x, y), "moved": (x * 1e-3 + 1e6, y * 50 - 1e7), "spiked": (x, spiked)}
    found = all_lags(spark, series)
    for lag in (1, 5, 14):
        assert found[("moved", lag)]["f"] == pytest.approx(found[("plain", lag)]["f"], rel=1e-4)
        assert found[("spiked", lag)]["f"] == pytest.approx(least_squares(x, spiked, lag)[0], rel=1e-4)


def test_constant_and_missing_values(spark):
    x, y = simulated(50, 8)
    found = all_lags(spark, {"flat_x": (np.ones(50), y), "flat_y": (x, np.ones(50)), "gaps": (x, y)})
    assert all(found[(k, lag)]["p"] is None for k in ("flat_x", "flat_y") for lag in range(1, 15))
    df = frame(spark, {"gaps": (x, y)}).withColumn("v", F.when(F.col("d") % 10 != 3, F.col("v")))
    r = causality.granger_lag(df, ["k"], ["d"], "v", "w", 2).first()
    kept = [t for t in range(50) if t % 10 != 3]
    assert r["f"] == pytest.approx(least_squares(x[kept], y[kept], 2)[0], rel=1e-9)


def test_exact_dependence_wins(spark):
    x, _ = simulated(60, 9)
    y = np.concatenate([[0.0], x[:-1]])
    best = causality.granger_scan(frame(spark, {"a": (x, y)}), ["k"], ["d"], "v", "w").first()
    assert best["lag"] == 1 and best["p"] < 1e-12 and best["f"] > 1e6


def test_scan_takes_smallest_p(spark):
    series = {"a": simulated(70, 10), "b": simulated(70, 11, 0.0)}
    best = {r["k"]: r for r in causality.granger_scan(frame(spark, series), ["k"], ["d"], "v", "w").collect()}
    for k, (x, y) in series.items():
        options = [(least_squares(x, y, lag)[1], lag) for lag in range(1, 15)]
        assert best[k]["lag"] == min(options)[1]
        assert best[k]["p"] == pytest.approx(min(options)[0], rel=1e-7)


def test_scan_without_usable_lag(spark):
    best = causality.granger_scan(frame(spark, {"a": ([1, 2, 3], [3, 1, 2])}), ["k"], ["d"], "v", "w").first()
    assert (best["f"], best["p"], best["lag"], best["n"]) == (1.0, 1.0, None, None)


def test_panel_handles_drivers_separately(spark):
    x, y = simulated(60, 12)
    df = frame(spark, {"a": (x, y)}).withColumn("u", F.when(F.col("d") < 40, F.sin(F.col("d") * 1.7)))
    found = {r["driver"]: r for r in causality.granger_panel(df, ["k"], ["d"], ["v", "u"], "w", 3).collect()}
    u = np.sin(np.arange(40) * 1.7)
    # a pure sine is determined by its last two values, so only lag 1 and 2 are determined
    options = [(least_squares(u, y[:40], lag)[1], lag) for lag in (1, 2)]
    assert found["u"]["p"] == pytest.approx(min(options)[0], rel=1e-6)
    assert found["v"]["p"] == pytest.approx(min(least_squares(x, y, lag)[1] for lag in (1, 2, 3)), rel=1e-8)
    wide = causality.wide_result(causality.granger_panel(df, ["k"], ["d"], ["v", "u"], "w", 3), ["k"], ["v", "u"])
    assert wide.columns == ["k", "Causation_v_F", "Causation_v_p", "Causation_u_F", "Causation_u_p"]
    assert wide.first()["Causation_v_p"] == pytest.approx(found["v"]["p"])


@pytest.mark.parametrize("max_rows", [None, 90])
def test_pooled_is_one_series(spark, max_rows):
    series = {"a": simulated(120, 13), "b": simulated(100, 14)}
    x = np.concatenate([series[k][0] for k in "ab"])
    y = np.concatenate([series[k][1] for k in "ab"])
    found = causality.granger_pooled(frame(spark, series), ["k", "d"], "v", "w", 6, max_rows=max_rows).collect()
    assert len(found) == 6
    for r in found:
        assert r["f"] == pytest.approx(least_squares(x, y, r["lag"])[0], rel=1e-8)


def test_jitter_is_small_and_repeatable(spark):
    series = {"a": simulated(60, 15), "flat": (np.ones(60), simulated(60, 16)[1])}
    first, second = (all_lags(spark, series, 3, jitter_seed=1) for _ in range(2))
    plain = all_lags(spark, series, 3)
    for lag in (1, 2, 3):
        assert first[("a", lag)]["f"] == second[("a", lag)]["f"]
        assert first[("a", lag)]["f"] == pytest.approx(plain[("a", lag)]["f"], rel=1e-3)
        assert plain[("flat", lag)]["f"] is None and first[("flat", lag)]["f"] is not None


def test_bad_arguments(spark):
    df = frame(spark, {"a": ([1], [1])})
    with pytest.raises(ValueError):
        causality.granger_all_lags(df, ["k"], ["d"], ["v"], "w", [0])
    with pytest.raises(ValueError):
        causality.granger_all_lags(df, ["k"], ["d"], ["v"], "w", [1], dof_mode="other")
    with pytest.raises(ValueError):
        causality.granger_all_lags(df.withColumnRenamed("k", "x"), ["x"], ["d"], ["v"], "w")


# Worked values: scale, key, months, then (F, p, lag) for both degrees-of-freedom modes.
GOLDEN = [
    ("0.001", "1-URGENT", 77, (1.041462, 0.380012, 3), (1.026146, 0.386710, 3)),
    ("0.001", "2-HIGH", 77, (1.941523, 0.114276, 4), (1.911653, 0.119249, 4)),
    ("0.001", "3-MEDIUM", 78, (0.046884, 0.829173, 1), (0.046259, 0.830298, 1)),
    ("0.001", "4-NOT SPECIFIED", 75, (2.076946, 0.043368, 12), (2.023691, 0.049242, 12)),
    ("0.001", "5-LOW", 79, (1.250555, 0.267016, 1), (1.234100, 0.270160, 1)),
    ("0.01", "1-URGENT", 80, (4.619106, 0.034801, 1), (4.559117, 0.035966, 1)),
    ("0.01", "2-HIGH", 79, (0.867353, 0.568938, 10), (0.849652, 0.584635, 10)),
    ("0.01", "3-MEDIUM", 79, (1.394781, 0.254504, 2), (1.375675, 0.259230, 2)),
    ("0.01", "4-NOT SPECIFIED", 80, (0.308457, 0.580259, 1), (0.304452, 0.582724, 1)),
    ("0.01", "5-LOW", 79, (1.818223, 0.181583, 1), (1.794299, 0.184448, 1)),
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_golden_scan(spark, scale):
    from workload import tables
    monthly = tables.monthly_orders(spark, f"{SF}/sf{scale}")
    for mode, at in (("reference", 3), ("standard", 4)):
        found = {r["k"]: r for r in causality.granger_scan(
            monthly, ["k"], ["d"], "price", "orders", dof_mode=mode).collect()}
        for row in (g for g in GOLDEN if g[0] == scale):
            f, p, lag = row[at]
            r = found[row[1]]
            assert (round(r["f"], 6), round(r["p"], 6), r["lag"]) == (f, p, lag)
            assert r["n"] == row[2] - lag


@pytest.mark.parametrize("n, max_rows", [(300, None), (3000, None), (20_000, None), (3000, 400), (20_000, 4000)])
def test_trending_series_keep_every_lag(spark, n, max_rows):
    """Twice-summed noise: levels are nearly collinear, and more so the longer the series."""
    rnd = np.random.default_rng(n)
    x, y = rnd.normal(size=n).cumsum().cumsum(), rnd.normal(size=n)
    y[1:] += 0.3 * np.diff(np.diff(x, prepend=0), prepend=0)[:-1]
    y = y.cumsum().cumsum()
    found = all_lags(spark, {"t": (x, y)}, max_rows=max_rows)
    dx, dy = np.diff(x, prepend=0), np.diff(y, prepend=0)
    for lag in range(1, 15):
        # the same space in a well-conditioned form: level and differences, target differenced
        own = [(y - y.mean())[lag - 1:-1], *[dy[lag - k:-k] for k in range(1, lag)]]
        other = [(x - x.mean())[lag - 1:-1], *[dx[lag - k:-k] for k in range(1, lag)]]

        def rss(columns):
            a = np.column_stack([np.ones(n - lag), *[c / c.std() for c in columns]])
            q, _ = np.linalg.qr(a)
            target = dy[lag:]
            for _ in range(2):
                target = target - q @ (q.T @ target)
            return float((target ** 2).sum())

        r0, r1 = rss(own), rss(own + other)
        f = ((r0 - r1) / lag) / (r1 / (n - 3 * lag))
        r = found[("t", lag)]
        assert r["f"] == pytest.approx(f, rel=1e-6)
        assert r["p"] == pytest.approx(float(f_upper_tail(f, lag, n - 3 * lag - 1)), rel=1e-5, abs=1e-12)


def test_rows_move_once_for_all_drivers(spark):
    wide = spark.range(1000).selectExpr("id % 7 AS k", "id AS d", "rand(1) AS a", "rand(2) AS b", "rand(3) AS c", "rand(4) AS y")
    found = causality.granger_panel(wide, ["k"], ["d"], ["a", "b", "c"], "y", max_lag=2, max_rows=None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Generate"):]
    assert "Exchange hashpartitioning(k" in below
    window_parts = plan[:plan.index("Generate")].split("Window")
    assert len(window_parts) > 1 and all("Exchange" not in part for part in window_parts[1:])


def test_wide_result_of_all_drivers_at_once(spark):
    x, y = simulated(70, 21)
    df = frame(spark, {"a": (x, y), "b": simulated(40, 22), "short": simulated(4, 23)}).withColumns({
        "u": F.sin(F.col("d") * F.col("d")), "t": F.col("v") * F.col("d")})
    df = df.unionByName(df.where("k = 'b'").withColumn("k", F.lit(None).cast("string")))
    for options in ({}, {"unique": True}, {"max_rows": 30}):
        wide = causality.granger_wide(df, ["k"], ["d"], ["v", "u", "t"], "w", 3, **options)
        single = causality.wide_result(causality.granger_panel(df, ["k"], ["d"], ["v", "u", "t"], "w", 3), ["k"], ["v", "u", "t"])
        assert wide.columns == single.columns
        found, expected = ({r["k"]: r[1:] for r in t.collect()} for t in (wide, single))
        assert found.keys() == expected.keys() == {"a", "b", "short", None}
        for k, row in expected.items():
            assert found[k] == pytest.approx(row, rel=1e-9)


def test_wide_result_of_drivers_with_gaps_of_their_own(spark):
    df = frame(spark, {"a": simulated(70, 24)}).withColumn("u", F.when(F.col("d") % 9 > 0, F.sin(F.col("d") * F.col("d"))))
    found = causality.granger_wide(df, ["k"], ["d"], ["v", "u"], "w", 3).first()
    panel = {r["driver"]: r for r in causality.granger_panel(df, ["k"], ["d"], ["v", "u"], "w", 3).collect()}
    assert found["Causation_u_p"] == pytest.approx(panel["u"]["p"], rel=1e-9)
    assert found["Causation_v_F"] == pytest.approx(panel["v"]["f"], rel=1e-9)


def test_rows_are_not_repeated_per_driver(spark):
    wide = spark.range(1000).selectExpr("id % 7 AS k", "id AS d", "rand(1) AS a", "rand(2) AS b", "rand(4) AS y")
    found = causality.granger_wide(wide, ["k"], ["d"], ["a", "b"], "y", max_lag=2, max_rows=None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    # n, then 4 moments and the sums of two drivers, without repeating what only y enters
    line = next(x for x in plan.splitlines() if "Aggregate" in x and "__sums_x1" in x)
    assert line.count("sum(cy#") == 2  # one aggregate, used in two arrays


def test_saved_panel_is_neither_shuffled_nor_sorted(spark):
    from seriesloom.sources.sinks import save_panel, saved_panel
    rows = [(f"k{k % 5}" if k else None, t, float((k * t * 7919) % 101), float((t * t * 31) % 97), float((k + 3) * t % 89))
            for k in range(6) for t in range(60)]
    df = spark.createDataFrame(rows, "k string, d int, v double, u double, w double").repartition(7)
    save_panel(df, "saved_panel_test", ["k"], ["d"], buckets=4, mode="overwrite")
    table = saved_panel(spark, "saved_panel_test")
    assert sorted(map(tuple, table.collect()), key=str) == sorted(rows, key=str)
    wide = causality.granger_wide(table.where("k <> 'k1' OR k IS NULL"), ["k"], ["d"], ["v", "u"], "w", 3, max_rows=None, unique=True)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    # Below the last window there is the scan alone; what moves above is one row per series.
    below = lines[windows[-1]:]
    below = below[:next(i for i, line in enumerate(below) if "Scan" in line)]
    assert windows and not any("Exchange" in line or "Sort [" in line for line in below)
    first = lines[windows[0]:windows[-1]]
    assert sum("Exchange" in line for line in lines) <= 2 and not any("Exchange" in line for line in first[:3])
    spark.sql("DROP TABLE saved_panel_test")
