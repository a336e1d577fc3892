"""Enrichment joins."""

from seriesloom.operators import enrich


def ports(spark):
    return spark.createDataFrame([("A", "x", 1), ("B", "y", 2)], "ident string, name string, n int")


def test_two_roles(spark):
    legs = spark.createDataFrame([("A", "B"), ("B", "B"), ("A", "C")], "origin string, destination string")
    out = enrich.enrich_role(legs, ports(spark), "origin", "ident", "origin")
    out = enrich.enrich_role(out, ports(spark), "destination", "ident", "destination")
    assert out.columns == ["origin", "destination", "origin_name", "origin_n", "destination_name", "destination_n"]
    assert sorted(tuple(r) for r in out.collect()) == [("A", "B", "x", 1, "y", 2), ("B", "B", "y", 2, "y", 2)]


def test_small_side_is_measured(spark):
    small = enrich.small_side(ports(spark))
    large = enrich.small_side(ports(spark), max_bytes=10)
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in large._jdf.queryExecution().analyzed().toString().lower()
    assert small.count() == large.count() == 2
    assert enrich.small_side(ports(spark).where("false")).count() == 0


def test_named_and_shared_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "l int, v string")
    right = spark.createDataFrame([(1, "c")], "r int, w string")
    out = enrich.join_named(left, right, {"l": "r"})
    assert out.columns == ["l", "v", "w"] and [tuple(r) for r in out.collect()] == [(1, "a", "c")]
    shared = enrich.join_shared(left, right.withColumnRenamed("r", "l"), ["l"])
    assert shared.columns == ["l", "v", "w"] and shared.count() == 1


def test_chain(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "code int, v int")
    places = spark.createDataFrame([(1, "s", "c"), (2, "s", "d")], "code int, state string, county string")
    dense = spark.createDataFrame([("s", "c", 5.0)], "state string, county string, dens double")
    out = enrich.enrich_chain(fact, places, ["code"], dense, ["state", "county"])
    assert [(r["code"], r["v"], r["dens"]) for r in out.collect()] == [(1, 10, 5.0)]
