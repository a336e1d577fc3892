"""Scalar functions and feature operators on worked rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import scalar as S
from seriesloom.operators import features


def values(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c")).alias("out")).collect()]


def test_labels(spark):
    given = ["Adams County", "Sitka City and Borough", "Orleans Parish", "San County Area", None]
    assert values(spark, given, S.corrected_label) == ["adams", "sitka city and", "orleans parish", "san coun", None]


def test_labels_with_own_suffixes(spark):
    assert values(spark, ["Orleans Parish", "X County"], lambda c: S.corrected_label(c, [(" parish", 7)])) == [
        "orleans", "x county"]


def test_place_codes(spark):
    given = ["01001", "1001", "", "NYC", None, "36"]
    assert values(spark, given, lambda c: F.array(*S.place_code_parts(c))) == [
        [1, 1], [1, 1], [None, None], [None, None], [None, None], [None, 36]]


def test_block_codes(spark):
    assert values(spark, [10010201001], S.padded_block_code, "long") == ["010010201001"]
    assert values(spark, ["10010201001", "0100102010015"], S.padded_block_code) == ["010010201001", "0100102010015"]
    assert values(spark, [10010201001, 999999999999, 5, 1234567890123],
                  lambda c: F.array(*S.block_code_parts(c)), "long") == [[1, 1], [99, 999], [0, 0], [12, 345]]
    assert values(spark, ["10010201001", "010010201001", "39AB", None],
                  lambda c: F.array(*S.block_code_parts(c))) == [[1, 1], [1, 1], [0, 0], [None, None]]


def test_dates(spark):
    assert values(spark, ["2020-03-01T00:00:00-05:00", "junk", "2020-03", None], S.local_date) == [
        date(2020, 3, 1), None, None, None]
    assert values(spark, ["03/25/2020", "25/03/2020"], lambda c: S.parsed_date(c, "MM/dd/yyyy")) == [
        date(2020, 3, 25), None]


def test_date_is_independent_of_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert values(spark, ["2020-03-01T00:00:00-05:00"], S.local_date) == [date(2020, 3, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_density_share_factor_and_temperature(spark):
    row = spark.range(1).select(
        S.density(F.lit(5000), F.lit(2500000)), S.density(F.lit(5000), F.lit(0)),
        S.share_pct(F.lit(30), F.lit(120)), S.share_pct(F.lit(30), F.lit(0)),
        S.exposure_factor(F.lit(25.0), F.lit(20.0)),
        S.avg_temp(F.lit(80.0), F.lit(60.0)), S.avg_temp(F.lit(80.0), F.lit(60.0), "mean")).first()
    assert list(row) == [20.0, None, 25.0, None, 500.0, 110.0, 70.0]
    with pytest.raises(ValueError):
        S.avg_temp(F.lit(1), F.lit(2), "other")


def test_region_and_items(spark):
    assert values(spark, ["US-NY"], S.region_suffix) == ["NY"]
    assert values(spark, ["1,2,,3"], S.text_items) == [["1", "2", "", "3"]]
    assert values(spark, ["a.b"], lambda c: S.text_items(c, ".")) == [["a", "b"]]


def normalized(spark, items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v double")
    return [r["v_norm"] for r in features.minmax_normalize(df, ["v"]).orderBy("i").collect()]


def test_minmax(spark):
    assert normalized(spark, [2.0, 4.0, 6.0]) == [0.0, 500.0, 1000.0]
    assert normalized(spark, [5.0, 5.0]) == [None, None]
    assert normalized(spark, []) == []
    assert normalized(spark, [None, 1.0, 3.0]) == [None, 0.0, 1000.0]


def test_minmax_several_columns_use_one_aggregate(spark):
    df = spark.range(10).select(F.col("id").alias("a"), (F.col("id") * 2.5).alias("b"))
    out = features.minmax_normalize(df, ["a", "b"])
    assert [tuple(r) for r in out.where("a = 9").select("a_norm", "b_norm").collect()] == [
        (1000.0, 1000.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("scalar-subquery") >= 1 and "Join" not in plan.split("Subquery")[0]


def test_density_operator(spark):
    people = spark.createDataFrame([(1, 1, 5000), (1, 2, 10)], "s int, c int, Population int")
    land = spark.createDataFrame([(1, 1, 2000000), (1, 1, 500000), (1, 2, 0)], "s int, c int, amount_land long")
    out = {r["c"]: r for r in features.density(people, land, ["s", "c"]).collect()}
    assert out[1]["Population_Density"] == 20.0 and out[1]["amount_land"] == 2500000
    assert out[2]["Population_Density"] is None
