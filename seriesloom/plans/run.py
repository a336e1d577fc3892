"""The whole run: load six tables, profile four, three analyses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from seriesloom.operators.causality import MAX_LAG
from seriesloom.operators.quality import profile
from seriesloom.plans import analysis, ingest
from seriesloom.sources import schemas
from seriesloom.sources.readers import read_csv, read_csv_tree, read_positional_csv
from seriesloom.storage import written_table


def _density(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    return ingest.population_density(
        read_csv(spark, paths["population_data"], schemas.POPULATION),
        read_csv(spark, paths["geographic_data"], schemas.LAND))


def _us_cases(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    return ingest.us_cases(read_positional_csv(spark, paths["covid_cases_us"], schemas.CASES_US))


def _global_cases(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    return ingest.global_cases(read_positional_csv(spark, paths["covid_cases_global"], schemas.CASES_GLOBAL))


def _social_distancing(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    return ingest.social_distancing(
        read_csv_tree(spark, paths["social_distancing_us"], schemas.MOBILITY),
        read_csv(spark, paths["area_dictionary"], schemas.AREA_DICTIONARY), _density(spark, paths))


def _climate(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    return ingest.climate(read_csv(spark, paths["climate"], schemas.CLIMATE))


def _air_traffic(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    return ingest.air_traffic(
        read_csv_tree(spark, paths["air_traffic"], schemas.AIR_TRAFFIC),
        read_csv(spark, paths["airport_codes"], schemas.AIRPORTS),
        read_csv(spark, paths["countries_mapping"], schemas.COUNTRIES))


# Each table, the files it needs and how it is loaded.
TABLES = {
    "population_density": (("population_data", "geographic_data"), _density),
    "us_cases": (("covid_cases_us",), _us_cases),
    "global_cases": (("covid_cases_global",), _global_cases),
    "social_distancing": (("social_distancing_us", "area_dictionary", "population_data", "geographic_data"), _social_distancing),
    "climate": (("climate",), _climate),
    "air_traffic": (("air_traffic", "airport_codes", "countries_mapping"), _air_traffic),
}


def load_tables(spark: SparkSession, paths: Mapping[str, str], names: Iterable[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The six tables, or those named, lazily, from the files named in ``paths``."""
    return {name: TABLES[name][1](spark, paths) for name in names}


def run_all(spark: SparkSession, paths: Mapping[str, str], max_lag: int = MAX_LAG) -> dict[str, DataFrame]:
    """Every table and result by name.

    The loaded tables are stored as parquet in the shared folder: each is read several times
    below, and raw CSV is then parsed once and later scans read single columns.
    """
    tables = {name: written_table(df) for name, df in load_tables(spark, paths).items()}
    weather_panel = written_table(analysis.cases_with_climate(tables["us_cases"], tables["climate"]))
    return {
        **tables,
        "profile": profile({
            "COVID 19 cases": tables["us_cases"], "Social Distancing": tables["social_distancing"],
            "Climate": tables["climate"], "Air Traffic": tables["air_traffic"]}),
        "Cases_and_SD": analysis.normalized_panel(tables["us_cases"], tables["social_distancing"]),
        "granger_result_table": analysis.mobility_causality(
            tables["us_cases"], tables["social_distancing"], max_lag),
        "Cases_and_Climate": weather_panel,
        "climate_causality": analysis.climate_causality(weather_panel, max_lag),
        "climate_causality_by_state": analysis.climate_causality_by_state(weather_panel, max_lag),
        "Air_Traffic_Cases": analysis.inbound_flights(tables["global_cases"], tables["air_traffic"]),
    }
