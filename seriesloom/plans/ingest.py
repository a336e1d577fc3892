"""From raw tables to the six analysis tables.

Lazy but for two measurements: the length of series and the size of the airport dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import scalar as S
from seriesloom.operators import enrich, features, series
from seriesloom.operators.series import MAX_SERIES_ROWS
from seriesloom.sources.readers import typed
from seriesloom.sources.schemas import CASE_DATE_FORMAT

# Summed measures, and the columns derived from them.
MEASURES = ("completely_home_device_count", "device_count", "distance_traveled_from_home",
            "full_time_work_behavior_devices", "part_time_work_behavior_devices")
SHARES = {"percent_at_home": "completely_home_device_count",
          "percent_full_time_work": "full_time_work_behavior_devices",
          "percent_part_time_work": "part_time_work_behavior_devices"}
FACTORS = {"Social_Dist_Factor_Home": "percent_at_home",
           "Social_Dist_Factor_Full_Work": "percent_full_time_work",
           "Social_Dist_Factor_Part_Work": "percent_part_time_work"}
# Airport attributes and their names in the result.
AIRPORT_NAMES = {"type": "type", "name": "airport_name", "latitude_deg": "latitude_deg",
                 "longitude_deg": "longitude_deg", "iso_region": "region", "iso_country": "iso_country"}
ROLE_COLUMNS = ("type", "airport_name", "latitude_deg", "longitude_deg", "region", "country")


def population_density(population: DataFrame, land: DataFrame) -> DataFrame:
    """Heads per hectare and county: ``amount_land, State, County, Population, Population_Density``."""
    people = (population.select("STATE", "COUNTY", "STNAME", "CTYNAME", "POPESTIMATE2019")
              .toDF("statecode", "countycode", "State", "County", "Population")
              .where(F.col("State") != F.col("County"))
              .withColumn("State", F.lower("State")))
    people = features.correct_labels(people, "County")
    blocks = features.split_block_code(
        land.select("census_block_group", "amount_land"), "census_block_group", "statecode", "countycode")
    dense = features.density(people, blocks, ["statecode", "countycode"])
    return dense.select("amount_land", "State", "County", "Population", "Population_Density")


def us_cases(raw: DataFrame, date_format: str | None = CASE_DATE_FORMAT, drop_blank_keys: bool = False,
             max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Daily growth per place code.

    Rows without a code form one series, whatever their county; ``drop_blank_keys`` leaves them
    out. ``date_format=None`` takes a Date column that is a date already.
    """
    rows = typed(raw, {"Confirmed_Cases": "long", "Deaths": "long"},
                 {"Date": date_format} if date_format else None)
    rows = rows.withColumns({"County": F.lower("County"), "State": F.lower("State")})
    if drop_blank_keys:
        rows = rows.where(F.coalesce(F.trim("fips_code"), F.lit("")) != "")
    grown = series.growth(rows, ["fips_code"], ["Date", "County", "State"], "Confirmed_Cases",
                          "Growth_Rate", max_rows=max_rows)
    coded = features.split_place_code(grown, "fips_code")
    return coded.select("Date", "County", "State", "fips_code", "Confirmed_Cases", "Deaths",
                        "Growth_Rate", "fips_state", "fips_county")


def global_cases(raw: DataFrame, date_format: str | None = CASE_DATE_FORMAT, mode: str = "chunk",
                 max_rows: int | None = MAX_SERIES_ROWS) -> DataFrame:
    """Cases per territory with the peak of the following 14 rows."""
    rows = typed(raw, {"Cases": "long", "Deaths": "long"}, {"Date": date_format} if date_format else None)
    rows = rows.select("Date", "Cases", "Deaths", F.lower("Country").alias("Country"), "Geo_id", "Terr_code")
    return series.next_peak(rows, ["Terr_code"], ["Date", "Country", "Geo_id"], "Cases", "Max_Peak",
                            mode=mode, max_rows=max_rows)


def social_distancing(mobility: DataFrame, area_dictionary: DataFrame, dense: DataFrame) -> DataFrame:
    """Device shares and density-weighted factors per date and county.

    Devices are summed before any join, so the raw rows are shuffled as partial sums only;
    dictionary and density are joined to each other first. Labels are lower-cased on both sides.
    """
    coded = mobility.select(
        S.local_date(F.col("date_range_start")).alias("Date"),
        *[part.alias(name) for part, name in zip(
            S.block_code_parts(F.col("origin_census_block_group")), ("fips_state", "fips_county"))],
        *MEASURES)
    totals = coded.groupBy("Date", "fips_state", "fips_county").agg(
        *[F.sum(c).cast("long").alias(c) for c in MEASURES])
    totals = features.shares(totals, SHARES, "device_count")
    places = area_dictionary.withColumnsRenamed(
        {"state_fips": "fips_state", "county_fips": "fips_county", "state": "State", "county": "County"})
    places = places.drop("class_code").withColumns({"State": F.lower("State"), "County": F.lower("County")})
    extra = [c for c in places.columns if c not in ("State", "County", "fips_state", "fips_county")]
    joined = enrich.enrich_chain(totals, places, ["fips_state", "fips_county"],
                                 dense.drop("amount_land"), ["State", "County"])
    weighted = features.exposure_factors(joined, FACTORS, "Population_Density")
    return weighted.select("State", "County", "fips_state", "fips_county", *extra, "Date", *MEASURES,
                           *SHARES, "Population", "Population_Density", *FACTORS)


def climate(raw: DataFrame, country: str = "US", avg_mode: str = "reference") -> DataFrame:
    """Daily weather per state of one country."""
    return raw.where(F.col("`Country/Region`") == country).select(
        S.local_date(F.col("time")).alias("Date"),
        F.lower("`Province/State`").alias("State"), F.col("precipIntensity").alias("Precipitation"),
        "windSpeed", "temperatureHigh", "temperatureLow",
        S.avg_temp(F.col("temperatureHigh"), F.col("temperatureLow"), avg_mode).alias("Avg_Temp"))


def air_traffic(flights: DataFrame, airports: DataFrame, countries: DataFrame) -> DataFrame:
    """Flights with airport and country attributes of both ends.

    Airports get their country once; the flights then meet that one dimension in two roles,
    destination first, so that a filter on the destination removes flights early.
    """
    legs = flights.select(
        "origin", "destination", S.local_date(F.col("day")).alias("date")).na.drop()
    named = countries.select(F.col("`alpha-2`").alias("iso_country"), F.lower("name").alias("country"))
    places = enrich.join_shared(airports.select("ident", *AIRPORT_NAMES), named, ["iso_country"])
    places = enrich.small_side(places.withColumnsRenamed(AIRPORT_NAMES))
    joined = enrich.enrich_role(legs, places, "destination", "ident", "destination")
    joined = enrich.enrich_role(joined, places, "origin", "ident", "origin")
    return joined.select(
        "destination_iso_country", "origin_iso_country", "origin", "destination", "date",
        *[f"{role}_{c}" for role in ("origin", "destination") for c in ROLE_COLUMNS])
