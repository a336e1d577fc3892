"""Series operators: worked rows, and equality of the plain and the block-wise way."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import series

DAY = date(2020, 1, 1)


def one_series(spark, values):
    rows = [("a", DAY + timedelta(days=i), v) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, d date, v long").repartition(3)


def column(df, name):
    return [r[name] for r in df.orderBy("k", "d").collect()]


def test_growth_counts_from_zero(spark):
    assert column(series.growth(one_series(spark, [1, 3, 3, 2]), ["k"], ["d"], "v"), "growth") == [1, 2, 0, -1]


def test_growth_keeps_doubles_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1, 1.5), ("a", 2, None), ("a", 3, 4.0)], "k string, d int, v double")
    assert column(series.growth(df, ["k"], ["d"], "v"), "growth") == [1.5, None, None]


def test_growth_resums_to_last_value(spark):
    values = [random.Random(2).randint(0, 99) for _ in range(50)]
    assert sum(column(series.growth(one_series(spark, values), ["k"], ["d"], "v"), "growth")) == values[-1]


@pytest.mark.parametrize("values, expected", [
    (range(1, 17), {0: 15, 15: 16}), ([9, 1, 2], {0: 2}), ([7], {0: 7})])
def test_peak_chunks(spark, values, expected):
    out = series.next_peak(one_series(spark, list(values)), ["k"], ["d"], "v", "peak")
    assert {(r["d"] - DAY).days: r["peak"] for r in out.collect()} == expected


def test_peak_sliding(spark):
    out = series.next_peak(one_series(spark, [9, 1, 2]), ["k"], ["d"], "v", "peak", mode="sliding")
    assert column(out, "peak") == [2, 2, 2]


def test_chunks_are_part_of_sliding(spark):
    df = one_series(spark, [random.Random(3).randint(0, 99) for _ in range(100)])
    chunk = series.next_peak(df, ["k"], ["d"], "v", "peak")
    sliding = series.next_peak(df, ["k"], ["d"], "v", "peak", mode="sliding")
    all_rows = column(sliding, "peak")
    assert column(chunk, "peak") == all_rows[::15]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        series.next_peak(one_series(spark, [1]), ["k"], ["d"], "v", mode="other")


def test_lags_leave_out_incomplete_rows(spark):
    df = one_series(spark, [5, 6, 7, 8])
    rows = series.lag_features(df, ["k"], ["d"], ["v"], 2).orderBy("d").collect()
    assert [(r["v"], r["v_lag1"], r["v_lag2"]) for r in rows] == [(7, 6, 5), (8, 7, 6)]
    assert series.lag_features(df, ["k"], ["d"], ["v"], 2, keep_incomplete=True).count() == 4


def test_collect_series_is_ordered_and_aligned(spark):
    df = spark.createDataFrame([("a", 3, 30, 1), ("a", 1, 10, 2), ("a", 2, None, 3), ("b", 1, 5, 4)],
                               "k string, d int, v int, w int")
    rows = {r["k"]: r for r in series.collect_series(df, ["k"], ["d"], ["v", "w"]).collect()}
    assert (rows["a"]["v"], rows["a"]["w"], rows["a"]["n"]) == ([10, 30], [2, 1], 2)
    assert rows["b"]["v"] == [5]


def test_collect_series_continues_in_segments(spark):
    out = series.collect_series(one_series(spark, list(range(25))), ["k"], ["d"], ["v"], segment_rows=10)
    parts = {r["segment"]: r["v"] for r in out.collect()}
    assert parts == {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}


def skewed(spark, seed=5):
    """One key with most rows, exact copies, ties and a NULL key."""
    rnd = random.Random(seed)
    rows = [("hot", rnd.randint(0, 40), rnd.randint(0, 9)) for _ in range(400)]
    rows += [("hot", 20, 4)] * 150
    rows += [(None, rnd.randint(0, 30), rnd.randint(0, 9)) for _ in range(90)]
    rows += [(f"k{i % 20}", rnd.randint(0, 30), rnd.randint(0, 9)) for i in range(200)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, d int, v int").repartition(7)


def brute_force(rows):
    groups = defaultdict(list)
    for k, d, v in rows:
        groups[k].append((d, v))
    return {k: sorted(items) for k, items in groups.items()}


def counted(rows):
    out = defaultdict(int)
    for r in rows:
        out[tuple(r)] += 1
    return out


@pytest.mark.parametrize("max_rows", [None, 1_000_000, 60, 7])
def test_skewed_growth_equals_brute_force(spark, max_rows):
    rows, df = skewed(spark)
    out = series.growth(df, ["k"], ["d"], "v", max_rows=max_rows).select("k", "d", "v", "growth").collect()
    expected = [(k, d, v, v - (items[i - 1][1] if i else 0))
                for k, items in brute_force(rows).items() for i, (d, v) in enumerate(items)]
    assert counted(out) == counted(expected)


@pytest.mark.parametrize("max_rows", [None, 60, 7])
@pytest.mark.parametrize("mode", ["chunk", "sliding"])
def test_skewed_peaks_equal_brute_force(spark, mode, max_rows):
    rows, df = skewed(spark)
    out = series.next_peak(df, ["k"], ["d"], "v", "peak", mode=mode, max_rows=max_rows)
    expected = []
    for k, items in brute_force(rows).items():
        for i, (d, v) in enumerate(items):
            if mode == "sliding" or i % 15 == 0:
                expected.append((k, d, v, max([w for _, w in items[i + 1:i + 15]], default=v)))
    assert counted(out.select("k", "d", "v", "peak").collect()) == counted(expected)


@pytest.mark.parametrize("max_rows", [None, 60, 7])
def test_skewed_lags_equal_brute_force(spark, max_rows):
    rows, df = skewed(spark)
    out = series.lag_features(df, ["k"], ["d"], ["v"], 5, max_rows=max_rows)
    expected = [(k, d, v, *[items[i - j][1] for j in range(1, 6)])
                for k, items in brute_force(rows).items() for i, (d, v) in enumerate(items) if i >= 5]
    assert counted(out.select("k", "d", "v", *[f"v_lag{j}" for j in range(1, 6)]).collect()) == counted(expected)


@pytest.mark.parametrize("horizon, max_rows", [(33, None), (50, 60), (365, 7), (365, None)])
def test_wide_peaks_equal_brute_force(spark, horizon, max_rows):
    rows, df = skewed(spark)
    rows = [(k, d, None if v == 9 else v) for k, d, v in rows]
    df = df.withColumn("v", F.nullif("v", F.lit(9)))
    for mode in ("sliding", "chunk"):
        out = series.next_peak(df, ["k"], ["d"], "v", "peak", horizon, mode, max_rows=max_rows)
        expected = []
        groups = defaultdict(list)
        for k, d, v in rows:
            groups[k].append((d, v))
        for k, items in groups.items():
            items.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
            for i, (d, v) in enumerate(items):
                if mode == "sliding" or i % (horizon + 1) == 0:
                    ahead = [w for _, w in items[i + 1:i + 1 + horizon] if w is not None]
                    expected.append((k, d, v, max(ahead, default=v)))
        assert counted(out.select("k", "d", "v", "peak").collect()) == counted(expected)


@pytest.mark.parametrize("max_rows", [3, 20])
def test_halo_reaches_over_blocks_that_are_shorter_than_it(spark, max_rows):
    """Blocks of a few rows hand on rows to several neighbours, in both directions."""
    df = one_series(spark, list(range(60)))
    out = series.over_series(df, ["k"], ["d"], lambda w: {
        "far": F.lag("v", 9).over(w), "ahead": F.sum("v").over(w.rowsBetween(1, 12))}, before=9, after=12, max_rows=max_rows)
    rows = out.orderBy("v").collect()
    assert [r.far for r in rows] == [None] * 9 + list(range(51))
    assert [r.ahead for r in rows] == [sum(range(v + 1, min(60, v + 13))) or None for v in range(60)]


def test_long_rows_are_stored_once_and_every_window_has_a_block(spark, monkeypatch):
    stored = []
    original = series.written_table

    def watched(df):
        stored.append(df.columns)
        return original(df)

    monkeypatch.setattr(series, "written_table", watched)
    _, df = skewed(spark)
    plan = series.growth(df, ["k"], ["d"], "v", max_rows=60)._jdf.queryExecution().optimizedPlan().toString()
    assert [c for c in stored if "v" in c] == [["k", "d", "v", "__row_id", "__block", "__index"]]
    windows = [line for line in plan.splitlines() if "Window [" in line and "lag(" in line]
    assert len(windows) == 3  # short series, inside blocks, borders
    assert sum("__block" in line for line in windows) == 2


def test_ties_are_decided_by_numbers_first_and_text_by_a_hash(spark):
    df = spark.createDataFrame([("a", 1, "x" * 5000, 2), ("a", 1, "y", 1), ("a", 1, "z", 3)], "k string, d int, t string, n int")
    for max_rows in (None, 1):
        out = series.over_series(df, ["k"], ["d"], lambda w: {"p": F.lag("n", 1).over(w)}, before=1, max_rows=max_rows)
        assert sorted((r.n, r.p) for r in out.collect()) == [(1, None), (2, 1), (3, 2)]


def test_skewed_segments_equal_brute_force(spark):
    rows, df = skewed(spark)
    out = series.collect_series(df, ["k"], ["d"], ["v"], segment_rows=50, max_rows=40).collect()
    parts = {(r["k"], r["segment"]): r["v"] for r in out}
    for k, items in brute_force(rows).items():
        joined = [v for s in range((len(items) + 49) // 50) for v in parts[(k, s)]]
        assert joined == [v for _, v in items]


def test_result_does_not_depend_on_partitioning(spark):
    _, df = skewed(spark)
    results = []
    for n in (1, 5, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(counted(series.growth(df.repartition(n), ["k"], ["d"], "v", max_rows=50).select(
            "k", "d", "v", "growth").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_short_series_take_one_shuffle(spark):
    df = series.growth(one_series(spark, [1, 2]), ["k"], ["d"], "v", max_rows=None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_multi_key_series(spark):
    df = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 2, 8), ("a", 2, 1, 7)], "k string, j int, d int, v int")
    for max_rows in (None, 1):
        out = series.growth(df, ["k", "j"], ["d"], "v", max_rows=max_rows)
        assert sorted((r["j"], r["d"], r["growth"]) for r in out.collect()) == [(1, 1, 5), (1, 2, 3), (2, 1, 7)]


def test_shared_folder_is_the_configured_one(spark):
    from seriesloom.storage import shared_folder, written_table
    assert shared_folder(spark).endswith("shared")
    stored = written_table(spark.range(5).withColumn("v", F.rand(1)))
    assert stored.inputFiles()[0].startswith("file:") and "/shared/" in stored.inputFiles()[0]
    assert stored.count() == 5


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from seriesloom.storage import shared_folder
    settings = {"spark.master": "k8s://host"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: settings.get(name, default)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)
    settings["spark.checkpoint.dir"] = "s3://bucket/shared/"
    assert shared_folder(session) == "s3://bucket/shared"
