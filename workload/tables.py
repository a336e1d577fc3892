"""Source tables of the pipelines, derived by Spark from the star-schema test tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.plans import ingest


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; its footer is read once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(column: str) -> Column:
    return F.trunc(column, "month")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per nation with its region; place codes are region + 1 and nation number."""
    return (table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", "r_name", (F.col("n_regionkey") + 1).alias("state_no")))


def cases_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative orders and finished orders per nation and month, as case rows."""
    monthly = (table(spark, sf, "orders")
               .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
               .groupBy(month("o_orderdate").alias("Date"), F.col("c_nationkey").alias("nk"))
               .agg(F.count(F.lit(1)).alias("c"),
                    F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f")))
    # Bounded window: one row per nation and calendar month.
    so_far = Window.partitionBy("nk").orderBy("Date")
    return (monthly.join(nations(spark, sf), F.col("nk") == F.col("n_nationkey"))
            .select("Date", F.col("n_name").alias("County"), F.col("r_name").alias("State"),
                    F.concat(F.lpad(F.col("state_no").cast("string"), 2, "0"),
                             F.lpad(F.col("nk").cast("string"), 3, "0")).alias("fips_code"),
                    F.sum("c").over(so_far).alias("Confirmed_Cases"),
                    F.sum("f").over(so_far).alias("Deaths")))


def us_cases(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.us_cases(cases_raw(spark, sf), date_format=None, max_rows=None)


def global_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and finished orders per region and month."""
    return (table(spark, sf, "orders")
            .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(month("o_orderdate").alias("Date"), F.col("r_name").alias("Country"))
            .agg(F.count(F.lit(1)).alias("Cases"),
                 F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("Deaths"))
            .withColumns({"Geo_id": F.substring("Country", 1, 2), "Terr_code": F.substring("Country", 1, 3)}))


def global_cases(spark: SparkSession, sf: str, mode: str = "chunk") -> DataFrame:
    return ingest.global_cases(global_raw(spark, sf), date_format=None, mode=mode, max_rows=None)


def block_code(state_no: str, nation: str, supplier: str) -> Column:
    """Twelve digits: two of the region, three of the nation, seven of the supplier; as a number."""
    return (F.col(state_no).cast("long") * 10_000_000_000 + F.col(nation).cast("long") * 10_000_000
            + F.col(supplier) % 10_000_000)


def placed(df: DataFrame, spark: SparkSession, sf: str, nation_key: str) -> DataFrame:
    """Attach nation and region one after the other, each small by its file size."""
    return (df.join(table(spark, sf, "nation"), F.col(nation_key) == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("state_no", F.col("n_regionkey") + 1))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return placed(table(spark, sf, "supplier"), spark, sf, "s_nationkey")


def supplied_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with supplier, nation and region."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return placed(items, spark, sf, "s_nationkey")


def mobility_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: its quantity as devices, split by return flag."""
    quantity = F.col("l_quantity").cast("long")

    def flagged(flag: str) -> Column:
        return F.when(F.col("l_returnflag") == flag, quantity).otherwise(0)

    return (supplied_items(spark, sf)
            .select(block_code("state_no", "n_nationkey", "s_suppkey").alias("origin_census_block_group"),
                    F.concat(month("l_shipdate").cast("string"),
                             F.lit("T00:00:00-05:00")).alias("date_range_start"),
                    quantity.alias("device_count"),
                    flagged("R").alias("completely_home_device_count"),
                    flagged("A").alias("full_time_work_behavior_devices"),
                    flagged("N").alias("part_time_work_behavior_devices"),
                    F.col("l_linenumber").alias("distance_traveled_from_home")))


def area_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return nations(spark, sf).select(
        F.col("state_no").alias("state_fips"), F.col("n_nationkey").alias("county_fips"),
        F.col("r_name").alias("state"), F.col("n_name").alias("county"), F.lit("H1").alias("class_code"))


def population_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Customers per nation as heads, plus one total row per region as the source files have."""
    heads = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("heads"))
    placed = heads.join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    counties = placed.select(
        F.col("state_no").alias("STATE"), F.col("n_nationkey").alias("COUNTY"), F.col("r_name").alias("STNAME"),
        F.concat("n_name", F.lit(" County")).alias("CTYNAME"), F.col("heads").alias("POPESTIMATE2019"))
    states = placed.groupBy("state_no", "r_name").agg(F.sum("heads").alias("heads")).select(
        "state_no", F.lit(0), "r_name", "r_name", "heads")
    return counties.union(states)


def land_raw(spark: SparkSession, sf: str) -> DataFrame:
    return suppliers(spark, sf).select(
        block_code("state_no", "n_nationkey", "s_suppkey").alias("census_block_group"),
        (F.col("s_suppkey") + 1).alias("amount_land"))


def population_density(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.population_density(population_raw(spark, sf), land_raw(spark, sf))


def social_distancing(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.social_distancing(
        mobility_raw(spark, sf), area_dictionary(spark, sf), population_density(spark, sf))


def climate_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price, quantity, tax and discount per month, region and line status (F stands for US).

    Means are taken from integer sums, so they do not depend on the order of addition.
    """
    rows = F.count(F.lit(1))

    def hundredths(column: str) -> Column:
        return F.sum(F.round(F.col(column) * 100).cast("long")) / rows

    return (supplied_items(spark, sf)
            .groupBy(month("l_shipdate").alias("time"), F.col("r_name").alias("Province/State"),
                     F.when(F.col("l_linestatus") == "F", "US").otherwise("XX").alias("Country/Region"))
            .agg(hundredths("l_tax").alias("precipIntensity"), hundredths("l_discount").alias("windSpeed"),
                 (hundredths("l_extendedprice") / 100000).alias("temperatureHigh"),
                 (F.sum(F.col("l_quantity").cast("long")) / rows).alias("temperatureLow")))


def climate(spark: SparkSession, sf: str, avg_mode: str = "reference") -> DataFrame:
    return ingest.climate(climate_raw(spark, sf), avg_mode=avg_mode)


def flights_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: from the supplier's nation to the customer's."""
    return (table(spark, sf, "lineitem")
            .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.concat(F.lit("A"), "s_nationkey").alias("origin"),
                    F.concat(F.lit("A"), "c_nationkey").alias("destination"),
                    month("l_shipdate").cast("string").alias("day")))


def iso_country(region: str) -> Column:
    return F.when(F.col(region) == "AMERICA", "US").otherwise(F.substring(region, 1, 2))


def airports(spark: SparkSession, sf: str) -> DataFrame:
    place = nations(spark, sf).withColumn("iso_country", iso_country("r_name"))
    return place.select(
        F.concat(F.lit("A"), "n_nationkey").alias("ident"), F.lit("large_airport").alias("type"),
        F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).cast("double").alias("latitude_deg"),
        (F.col("n_nationkey") * -2.5).cast("double").alias("longitude_deg"), "iso_country",
        F.concat("iso_country", F.lit("-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso_region"))


def countries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_name").alias("name"), iso_country("r_name").alias("alpha-2"))


def air_traffic(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.air_traffic(flights_raw(spark, sf), airports(spark, sf), countries(spark, sf))


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per priority and day: ``k, d, v``."""
    return (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"),
                                               F.col("o_orderdate").cast("date").alias("d"))
            .agg(F.count(F.lit(1)).alias("v")))


def monthly_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order value and order count per priority and month: ``k, d, price, orders``."""
    return (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), month("o_orderdate").alias("d"))
            .agg(F.sum("o_totalprice").alias("price"), F.count(F.lit(1)).alias("orders")))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as series per type: five types share all rows, so every series is long."""
    return table(spark, sf, "events").select("event_type", "ts", "event_id", "user_id", "value")
