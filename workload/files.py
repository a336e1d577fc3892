"""Queries that go through files: whole tables written as CSV to the shared folder and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.plans import analysis
from seriesloom.plans.run import TABLES, load_tables, run_all
from seriesloom.sources.readers import read_csv, read_csv_tree, read_positional_csv
from seriesloom.sources.sinks import save_panel, save_parquet, save_result, saved_panel
from seriesloom.storage import new_path, written_table
from workload import tables as W


def written_csv(df: DataFrame, header: bool = True, tree: str | None = None, path: str | None = None) -> str:
    """Write ``df`` as CSV and return its path; ``tree`` names a column whose values become folders."""
    path = path or new_path(df.sparkSession)
    writer = df.write.mode("append").option("header", header).option("escape", '"')
    (writer.partitionBy(tree) if tree else writer).csv(path)
    return path


def csv_header(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one folder with two column orders, and a column that is not wanted."""
    orders = W.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    path = written_csv(orders.where("o_orderkey % 2 = 0"))
    written_csv(orders.where("o_orderkey % 2 <> 0").select(
        "o_totalprice", "o_orderstatus", "o_orderkey", "o_orderpriority"), path=path)
    return read_csv(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")


def csv_quoted_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of folders; ``props`` is JSON text full of quotes and commas."""
    events = W.table(spark, sf, "events").select("event_id", "user_id", "value", "props", "event_type")
    return read_csv_tree(spark, written_csv(events, tree="event_type"),
                         "event_id long, user_id long, value double, props string")


def csv_positional(spark: SparkSession, sf: str) -> DataFrame:
    customers = W.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return read_positional_csv(spark, written_csv(customers, header=False), "k long, name string, nation int")


def saved_table(spark: SparkSession, sf: str) -> DataFrame:
    """Saved as a managed table, partitioned by a key, and read by name."""
    name = f"seriesloom_saved_{zlib.crc32(sf.encode())}"
    save_result(W.monthly_orders(spark, sf).select("d", "orders", "k"), name, mode="overwrite", partition_by=["k"])
    return spark.table(name)


def saved_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark)
    save_parquet(W.daily_orders(spark, sf), path)
    return spark.read.parquet(path)


def saved_panel_causality(spark: SparkSession, sf: str) -> DataFrame:
    """The joined panel as a table bucketed and sorted by place and month, read back and tested."""
    name = f"seriesloom_panel_{zlib.crc32(sf.encode())}"
    joined = analysis.cases_with_mobility(W.us_cases(spark, sf), W.social_distancing(spark, sf))
    save_panel(joined.select("fips_code", "Date", *analysis.NORMALIZED), name, ["fips_code"], ["Date"], buckets=8, mode="overwrite")
    # one row per place and calendar month
    return analysis.panel_causality(saved_panel(spark, name), max_rows=None, unique=True)


# The source files of the whole run, as the pipelines expect them: how each is written.
def _cases(spark: SparkSession, sf: str) -> str:
    day = F.date_format("Date", "MM/dd/yyyy")
    return written_csv(W.cases_raw(spark, sf).select(
        day, "County", "State", "fips_code", "Confirmed_Cases", "Deaths"), header=False)


def _world(spark: SparkSession, sf: str) -> str:
    day = F.date_format("Date", "MM/dd/yyyy")
    return written_csv(W.global_raw(spark, sf).select(
        day, F.day("Date"), F.month("Date"), F.year("Date"), "Cases", "Deaths", "Country", "Geo_id", "Terr_code"), header=False)


def _mobility(spark: SparkSession, sf: str) -> str:
    return written_csv(W.mobility_raw(spark, sf).withColumns({
        "date_range_end": F.col("date_range_start"), "at_home_by_each_hour": F.lit("1,2,3"),
        "part": F.substring("date_range_start", 1, 4)}), tree="part")


SOURCES = {
    "covid_cases_us": _cases, "covid_cases_global": _world, "social_distancing_us": _mobility,
    "area_dictionary": lambda spark, sf: written_csv(W.area_dictionary(spark, sf)),
    "population_data": lambda spark, sf: written_csv(W.population_raw(spark, sf)),
    "geographic_data": lambda spark, sf: written_csv(W.land_raw(spark, sf)),
    "climate": lambda spark, sf: written_csv(W.climate_raw(spark, sf)),
    "air_traffic": lambda spark, sf: written_csv(
        W.flights_raw(spark, sf).withColumn("part", F.substring("day", 1, 4)), tree="part"),
    "airport_codes": lambda spark, sf: written_csv(W.airports(spark, sf)),
    "countries_mapping": lambda spark, sf: written_csv(W.countries(spark, sf)),
}


def csv_sources(spark: SparkSession, sf: str, names: Iterable[str] = tuple(SOURCES)) -> dict[str, str]:
    """Write the named source files anew; their paths by name."""
    return {name: SOURCES[name](spark, sf) for name in names}


def loaded(name: str):
    """One of the six tables, loaded from the CSV files it needs."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return load_tables(spark, csv_sources(spark, sf, TABLES[name][0]), [name])[name]
    return run


def causality_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Cases and weather from CSV files, joined per state and tested as one series."""
    tables = load_tables(spark, csv_sources(spark, sf, ("covid_cases_us", "climate")), ("us_cases", "climate"))
    panel = written_table(analysis.cases_with_climate(tables["us_cases"], tables["climate"]))
    return analysis.climate_causality(panel)


def whole_run(name: str, max_lag: int = 14):
    """One result of the whole run from CSV files."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return run_all(spark, csv_sources(spark, sf), max_lag)[name]
    return run
