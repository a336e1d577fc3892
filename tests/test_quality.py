"""Profiles and key validation."""

from datetime import date

from pyspark.sql import functions as F

from seriesloom.operators import quality


def sample(spark):
    return spark.createDataFrame(
        [(1, 2.0, "a", date(2020, 1, 1)), (None, 4.0, "A", date(2020, 1, 1)), (1, 9.0, None, date(2020, 1, 2))],
        "i int, x double, s string, d date")


def test_distinct_counts_null_as_a_value(spark):
    found = {r["column"]: r["distinct"] for r in quality.distinct_counts(sample(spark)).collect()}
    assert found == {"i": 2, "x": 3, "s": 3, "d": 2}
    near = {r["column"]: r["distinct"] for r in quality.approx_distinct_counts(sample(spark)).collect()}
    assert near == found


def test_describe_covers_numbers_only(spark):
    found = {r["column"]: r for r in quality.describe(sample(spark)).collect()}
    assert (found["x"]["count"], found["x"]["mean"], found["x"]["min"], found["x"]["max"]) == (3, 5.0, 2.0, 9.0)
    assert abs(found["x"]["stddev"] - 13 ** 0.5) < 1e-12
    assert found["i"]["count"] == 2 and found["s"]["count"] is None and found["d"]["mean"] is None
    assert found["d"]["type"] == "date"


def test_profile_of_several_datasets(spark):
    out = quality.profile({"one": sample(spark), "two": sample(spark).select("s"), "none": sample(spark).where("false")})
    found = {(r["dataset"], r["column"]): r for r in out.collect()}
    assert len(found) == 9
    assert found[("one", "i")]["distinct"] == 2 and found[("two", "s")]["distinct"] == 3
    assert found[("none", "x")]["distinct"] == 0 and found[("none", "x")]["count"] == 0
    near = quality.profile({"one": sample(spark)}, approximate=True)
    assert {r["column"]: r["distinct"] for r in near.collect()} == {"i": 2, "x": 3, "s": 3, "d": 2}


def test_unmatched_keys(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "k string")
    words = spark.createDataFrame([("A",), ("b",)], "w string")
    misses = quality.unmatched_keys(keys, "k", words, "w")
    assert [r["k"] for r in misses.collect()] == ["c"] and misses.count() == 1
    upper = keys.select(F.upper("k").alias("k"))
    assert sorted(r["k"] for r in quality.unmatched_keys(upper, "k", words, "w").collect()) == ["A", "B", "C"]
    assert [r["k"] for r in quality.unmatched_keys(upper, "k", words, "w", lower_input=True).collect()] == ["c"]


def test_sample_is_ordered(spark):
    misses = spark.range(100).selectExpr("cast(id as string) AS k").repartition(9)
    assert [r["k"] for r in quality.unmatched_sample(misses).collect()] == sorted(str(i) for i in range(100))[:10]
