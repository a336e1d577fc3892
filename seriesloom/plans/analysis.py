"""The three analyses on the ingested tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import scalar as S
from seriesloom.operators import causality, enrich, features
from seriesloom.operators.causality import MAX_LAG
from seriesloom.operators.series import MAX_SERIES_ROWS
from seriesloom.plans.ingest import FACTORS
from seriesloom.storage import written_table

# Target, drivers and prefix of the result columns.
TARGET = "Growth_Rate"
NORMALIZED = (TARGET, *FACTORS)


def cases_with_mobility(cases: DataFrame, mobility: DataFrame) -> DataFrame:
    """Case rows joined to the mobility rows of the same date and county."""
    return enrich.join_shared(cases, mobility.drop("State", "County"), ["Date", "fips_state", "fips_county"])


def normalized_panel(cases: DataFrame, mobility: DataFrame) -> DataFrame:
    """Joined panel with growth and factors rescaled to 0..1000 over the whole table.

    The panel (one row per place and day) is stored, as the extremes and the result both read it.
    """
    return features.minmax_normalize(written_table(cases_with_mobility(cases, mobility)), NORMALIZED)


def mobility_causality(cases: DataFrame, mobility: DataFrame, max_lag: int = MAX_LAG,
                       dof_mode: str = "reference") -> DataFrame:
    """F and p per place code for each mobility factor: ``fips_code, Causation_<x>_norm_F/_p``.

    F and p do not change when a column is rescaled, so the raw columns are tested. The joined
    panel has one row per place and day; it is stored once, as several jobs read it.
    """
    panel = written_table(cases_with_mobility(cases, mobility).select("fips_code", "Date", *NORMALIZED))
    found = causality.granger_panel(panel, ["fips_code"], ["Date"], list(FACTORS), TARGET, max_lag, dof_mode)
    named = found.withColumn("driver", F.concat("driver", F.lit("_norm")))
    return causality.wide_result(named, ["fips_code"], [f"{x}_norm" for x in FACTORS])


def panel_causality(panel: DataFrame, max_lag: int = MAX_LAG, dof_mode: str = "reference",
                    max_rows: int | None = MAX_SERIES_ROWS, unique: bool = False) -> DataFrame:
    """As ``mobility_causality``, on a panel saved before, with all factors tested in one pass.

    A panel saved in buckets of places, sorted by place and date, is neither shuffled nor sorted if it has one row
    per place and date (``unique``) and so few that no series is measured (``max_rows=None``).
    """
    named = panel.withColumnsRenamed({x: f"{x}_norm" for x in FACTORS})
    return causality.granger_wide(named, ["fips_code"], ["Date"], [f"{x}_norm" for x in FACTORS], TARGET, max_lag, dof_mode,
                                  max_rows, unique)


def cases_by_state(cases: DataFrame) -> DataFrame:
    """Sums per date and state where growth is not zero."""
    totals = cases.groupBy("Date", "State").agg(
        F.sum("Growth_Rate").alias("growth_rate"), F.sum("Confirmed_Cases").alias("confirmed_cases"),
        F.sum("Deaths").alias("deaths"))
    return totals.where(F.col("growth_rate") != 0)


def cases_with_climate(cases: DataFrame, weather: DataFrame) -> DataFrame:
    """State sums joined to the weather rows of the same date and state."""
    return enrich.join_shared(cases_by_state(cases), weather, ["Date", "State"])


def climate_causality(panel: DataFrame, max_lag: int = MAX_LAG, dof_mode: str = "reference") -> DataFrame:
    """Temperature against growth with all states as one series, ordered by state and date."""
    return causality.granger_pooled(panel, ["State", "Date"], "Avg_Temp", "growth_rate", max_lag, dof_mode)


def climate_causality_by_state(panel: DataFrame, max_lag: int = MAX_LAG,
                               dof_mode: str = "reference") -> DataFrame:
    """Temperature against growth, one series per state; best lag each."""
    return causality.granger_scan(panel, ["State"], ["Date"], "Avg_Temp", "growth_rate", max_lag, dof_mode)


def inbound_flights(worldwide: DataFrame, traffic: DataFrame, country: str = "US") -> DataFrame:
    """Flights into one country with the case rows of their origin country on that date.

    The case side, one row per country and day, is measured and broadcast if small: then no flight moves.
    """
    inbound = traffic.where(F.col("destination_iso_country") == country).withColumnRenamed("date", "__date")
    joined = enrich.small_side(worldwide).join(
        inbound, (F.col("Date") == F.col("__date")) & (F.col("origin_country") == F.col("Country")), "inner")
    return joined.drop("__date").withColumn(
        "destination_region", S.region_suffix(F.col("destination_region")))
