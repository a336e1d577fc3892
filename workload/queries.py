"""The registered queries. Doubles are rounded to six places for comparison with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions import scalar as S
from seriesloom.functions.fdist import f_tail
from seriesloom.operators import causality, enrich, features, quality, series
from seriesloom.plans import analysis
from seriesloom.storage import written_table
from workload import files
from workload import tables as W

Query = Callable[[SparkSession, str], DataFrame]

# Rows of one event series per task in the event queries: small, so that the
# block-wise way is used at every scale of the test tables.
EVENT_BLOCK_ROWS = 1000


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (and no negative zero); other columns unchanged."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


# --- sources, projections, filters -------------------------------------------------

def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    events = W.table(spark, sf, "events")
    return events.select("event_id", F.nullif("event_type", F.lit("error")).alias("et")).na.drop()


def filter_col_ne_col(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = W.table(spark, sf, "orders"), W.table(spark, sf, "customer")
    joined = enrich.join_named(orders, customer, {"o_custkey": "c_custkey"})
    return joined.where(F.left("o_orderpriority", F.lit(1)) != F.col("c_nationkey").cast("string")).select("o_orderkey")


def correct_labels(spark: SparkSession, sf: str) -> DataFrame:
    ending = (F.when(F.col("c_custkey") % 4 == 0, " County").when(F.col("c_custkey") % 4 == 1, " Borough")
              .when(F.col("c_custkey") % 4 == 2, " City and Borough").otherwise(" Parish"))
    named = W.table(spark, sf, "customer").select("c_custkey", F.concat("c_name", ending).alias("label"))
    return features.correct_labels(named, "label")


def split_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.table(spark, sf, "customer").select(
        "c_custkey", ((F.col("c_custkey") * 70000019) % 1000000000000).alias("block"),
        F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 13 == 0, "NYC")
        .otherwise((F.col("c_custkey") * 37).cast("string")).alias("place"))
    coded = features.split_block_code(rows, "block", "st12", "co12")
    return features.split_place_code(coded, "place", "st5", "co5").select("c_custkey", "st12", "co12", "st5", "co5")


def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written as text (a seventh of them with day and month swapped) and read back."""
    text = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy"))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00-05:00"))
    return W.table(spark, sf, "orders").select(
        "o_orderkey", S.parsed_date(text, "MM/dd/yyyy").alias("d1"), S.local_date(stamp).alias("d2"))


def array_split(spark: SparkSession, sf: str) -> DataFrame:
    words = S.text_items(F.col("p_name"), " ")
    return W.table(spark, sf, "part").select(
        "p_partkey", F.get(words, F.lit(0)).alias("w1"), F.get(words, F.lit(1)).alias("w2"),
        F.size(words).cast("long").alias("n"))


# --- series -------------------------------------------------------------------------

def growth(spark: SparkSession, sf: str) -> DataFrame:
    return W.us_cases(spark, sf).select(
        "fips_code", F.col("Date").alias("d"), F.col("Confirmed_Cases").alias("cases"),
        F.col("Growth_Rate").alias("growth"))


def event_growth(spark: SparkSession, sf: str) -> DataFrame:
    grown = series.growth(W.event_rows(spark, sf), ["event_type"], ["ts", "event_id"], "value",
                          max_rows=EVENT_BLOCK_ROWS)
    return rounded(grown.select("event_type", "event_id", "growth"))


def next_peak(mode: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        # max_rows=None: one row per priority and calendar day
        return series.next_peak(W.daily_orders(spark, sf), ["k"], ["d"], "v", "peak", mode=mode, max_rows=None)
    return run


def event_peak(mode: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        peaks = series.next_peak(W.event_rows(spark, sf), ["event_type"], ["ts", "event_id"], "value", "peak",
                                 mode=mode, max_rows=EVENT_BLOCK_ROWS)
        return peaks.select("event_type", "event_id", "value", "peak")
    return run


def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    lagged = series.lag_features(W.daily_orders(spark, sf), ["k"], ["d"], ["v"], 3, max_rows=None)
    return lagged.withColumnsRenamed({"v_lag1": "l1", "v_lag2": "l2", "v_lag3": "l3"})


def event_peak_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value among the next 365 events of a type."""
    peaks = series.next_peak(W.event_rows(spark, sf), ["event_type"], ["ts", "event_id"], "value", "peak", horizon=365,
                             mode="sliding", max_rows=EVENT_BLOCK_ROWS)
    return peaks.select("event_type", "event_id", "value", "peak")


def event_lags(spark: SparkSession, sf: str) -> DataFrame:
    lagged = series.lag_features(W.event_rows(spark, sf), ["event_type"], ["ts", "event_id"], ["value", "user_id"], 2,
                                 max_rows=EVENT_BLOCK_ROWS)
    return lagged.drop("ts")


def joined_series(df: DataFrame, keys: list[str], column: str, separator: str = ",") -> DataFrame:
    text = F.array_join(F.transform(column, lambda v: v.cast("string")), separator)
    return df.select(*keys, "segment", text.alias("series"), "n")


def collect_series(spark: SparkSession, sf: str) -> DataFrame:
    # max_rows=None: one row per place and calendar month
    packed = series.collect_series(W.us_cases(spark, sf), ["fips_code"], ["Date"], ["Growth_Rate"], max_rows=None)
    return joined_series(packed, ["fips_code"], "Growth_Rate")


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    packed = series.collect_series(W.event_rows(spark, sf), ["event_type"], ["ts", "event_id"], ["event_id"],
                                   segment_rows=300, max_rows=EVENT_BLOCK_ROWS)
    return joined_series(packed, ["event_type"], "event_id")


# --- features and tables -------------------------------------------------------------

def minmax_normalize(spark: SparkSession, sf: str) -> DataFrame:
    orders = W.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    scaled = features.minmax_normalize(orders, ["o_totalprice", "o_custkey"])
    return rounded(scaled.select("o_orderkey", "o_totalprice_norm", "o_custkey_norm"))


def density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.population_density(spark, sf))


def us_cases(spark: SparkSession, sf: str) -> DataFrame:
    return W.us_cases(spark, sf)


def global_cases(spark: SparkSession, sf: str) -> DataFrame:
    return W.global_cases(spark, sf)


def global_cases_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return W.global_cases(spark, sf, "sliding")


def mobility_factor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.social_distancing(spark, sf))


def weather_feature(spark: SparkSession, sf: str) -> DataFrame:
    both = W.climate(spark, sf).select("Date", "State", "Precipitation", "windSpeed", "temperatureHigh",
                                       "temperatureLow", F.col("Avg_Temp").alias("avg_ref"))
    return both.withColumn("avg_mean", S.avg_temp(F.col("temperatureHigh"), F.col("temperatureLow"), "mean"))


def air_traffic(spark: SparkSession, sf: str) -> DataFrame:
    return W.air_traffic(spark, sf)


def flights_two_role(spark: SparkSession, sf: str) -> DataFrame:
    return W.air_traffic(spark, sf).groupBy(
        F.col("date").alias("d"), F.col("origin_airport_name").alias("origin_name"), "origin_country",
        F.col("destination_airport_name").alias("destination_name"), "destination_country",
    ).agg(F.count(F.lit(1)).alias("n"))


def inbound_with_cases(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.inbound_flights(W.global_cases(spark, sf), W.air_traffic(spark, sf))


def cases_by_region_nonzero(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.cases_by_state(W.us_cases(spark, sf))


def cases_x_mobility(spark: SparkSession, sf: str) -> DataFrame:
    joined = analysis.cases_with_mobility(W.us_cases(spark, sf), W.social_distancing(spark, sf))
    return rounded(joined.select("Date", "fips_code", "Growth_Rate", "percent_at_home", "Social_Dist_Factor_Home"))


def normalized_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = analysis.normalized_panel(W.us_cases(spark, sf), W.social_distancing(spark, sf))
    return rounded(panel.select("Date", "fips_code", *[f"{c}_norm" for c in analysis.NORMALIZED]))


def cases_x_climate(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.cases_with_climate(W.us_cases(spark, sf), W.climate(spark, sf)).select(
        "Date", "State", "growth_rate", "confirmed_cases", "deaths", "Avg_Temp")


# --- quality --------------------------------------------------------------------------

def profiled_events(spark: SparkSession, sf: str) -> DataFrame:
    return W.table(spark, sf, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))


def profile_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return quality.distinct_counts(profiled_events(spark, sf))


def profile_describe(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.describe(profiled_events(spark, sf)).where(F.col("count").isNotNull())
    return rounded(found.drop("type"))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    # Derived tables are stored, as a profile reads each dataset once per column type.
    found = quality.profile({
        "cases": written_table(W.us_cases(spark, sf)), "climate": written_table(W.climate(spark, sf)),
        "orders": W.table(spark, sf, "orders")})
    return rounded(found)


def unmatched_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unmatched_keys(W.table(spark, sf, "documents"), "doc_id", W.table(spark, sf, "labels"), "doc_id",
                                  lower_dictionary=False)


def unmatched_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-cased names made from the documents' sources, checked against brand names of the parts."""
    number = F.substring("source", 4, 9).cast("int") + 16
    names = W.table(spark, sf, "documents").select(F.concat(F.lit("BRAND#"), number.cast("string")).alias("name"))
    return quality.unmatched_keys(names, "name", W.table(spark, sf, "part"), "p_brand", lower_input=True)


def unmatched_sample(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unmatched_sample(unmatched_keys(spark, sf))


# --- files ----------------------------------------------------------------------------

def rounded_result(query: Query) -> Query:
    return lambda spark, sf: rounded(query(spark, sf))


# --- causality ------------------------------------------------------------------------

def f_tail_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    """Upper tail of F(2, d) for every line item, where it has a closed form."""
    rows = W.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 10).alias("f"),
        (F.col("l_suppkey") + 1).cast("double").alias("d2"))
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "d2", "f",
                               f_tail("f", F.lit(2.0), "d2").alias("p")))


def granger_lag1(spark: SparkSession, sf: str) -> DataFrame:
    # max_rows=None here and below: one row per key and calendar month
    found = causality.granger_lag(W.monthly_orders(spark, sf), ["k"], ["d"], "price", "orders", 1, max_rows=None)
    return rounded(found.select("k", "n", "f", "p"))


def granger_all_lags(spark: SparkSession, sf: str) -> DataFrame:
    found = causality.granger_all_lags(W.monthly_orders(spark, sf), ["k"], ["d"], ["price"], "orders", max_rows=None)
    return rounded(found.select("k", F.inline("results")))


def granger_scan(dof_mode: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(causality.granger_scan(W.monthly_orders(spark, sf), ["k"], ["d"], "price", "orders",
                                              dof_mode=dof_mode, max_rows=None))
    return run


def granger_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analysis.mobility_causality(W.us_cases(spark, sf), W.social_distancing(spark, sf)))


def climate_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Stored once: the tests read it several times."""
    return written_table(analysis.cases_with_climate(W.us_cases(spark, sf), W.climate(spark, sf)))


def granger_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analysis.climate_causality(climate_panel(spark, sf)))


def granger_by_state(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analysis.climate_causality_by_state(climate_panel(spark, sf)))


def granger_events(spark: SparkSession, sf: str) -> DataFrame:
    """Five long event series, tested block by block at lags 1 to 3."""
    found = causality.granger_all_lags(W.event_rows(spark, sf), ["event_type"], ["ts", "event_id"], ["user_id"],
                                       "value", [1, 2, 3], max_rows=EVENT_BLOCK_ROWS)
    return rounded(found.select("event_type", F.inline("results")))


def granger_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals of value and count per priority: trending series."""
    months = W.monthly_orders(spark, sf)
    # one row per priority and calendar month
    so_far = Window.partitionBy("k").orderBy("d")
    totals = months.select("k", "d", F.sum("price").over(so_far).alias("price"),
                           F.sum("orders").over(so_far).cast("double").alias("orders"))
    found = causality.granger_lag(totals, ["k"], ["d"], "price", "orders", 1, max_rows=None)
    return rounded(found.select("k", "n", "f", "p"))


QUERIES: dict[str, Query] = {
    "drop_nulls": drop_nulls,
    "filter_col_ne_col": filter_col_ne_col,
    "correct_labels": correct_labels,
    "split_codes": split_codes,
    "parsed_dates": parsed_dates,
    "array_split": array_split,
    "growth": growth,
    "event_growth": event_growth,
    "next_peak_chunk": next_peak("chunk"),
    "next_peak_sliding": next_peak("sliding"),
    "event_peak_chunk": event_peak("chunk"),
    "event_peak_sliding": event_peak("sliding"),
    "event_peak_wide": event_peak_wide,
    "lag_features": lag_features,
    "event_lags": event_lags,
    "collect_series": collect_series,
    "event_series": event_series,
    "minmax_normalize": minmax_normalize,
    "density": density,
    "us_cases": us_cases,
    "global_cases": global_cases,
    "global_cases_sliding": global_cases_sliding,
    "mobility_factor": mobility_factor,
    "weather_feature": weather_feature,
    "air_traffic": air_traffic,
    "flights_two_role": flights_two_role,
    "inbound_with_cases": inbound_with_cases,
    "cases_by_region_nonzero": cases_by_region_nonzero,
    "cases_x_mobility": cases_x_mobility,
    "normalized_panel": normalized_panel,
    "cases_x_climate": cases_x_climate,
    "profile_distinct": profile_distinct,
    "profile_describe": profile_describe,
    "profile": profile,
    "unmatched_keys": unmatched_keys,
    "unmatched_labels": unmatched_labels,
    "unmatched_sample": unmatched_sample,
    "f_tail_closed_form": f_tail_closed_form,
    "granger_lag1": granger_lag1,
    "granger_all_lags": granger_all_lags,
    "granger_scan": granger_scan("reference"),
    "granger_scan_standard": granger_scan("standard"),
    "granger_panel": granger_panel,
    "granger_pooled": granger_pooled,
    "granger_by_state": granger_by_state,
    "granger_events": granger_events,
    "granger_totals": granger_totals,
    "saved_panel_causality": rounded_result(files.saved_panel_causality),
    "csv_climate": files.loaded("climate"),
    "csv_climate_causality": rounded_result(files.causality_from_csv),
    "csv_header": files.csv_header,
    "csv_quoted_tree": files.csv_quoted_tree,
    "csv_positional": files.csv_positional,
    "saved_table": files.saved_table,
    "saved_files": files.saved_files,
    "csv_density": rounded_result(files.loaded("population_density")),
    "csv_us_cases": files.loaded("us_cases"),
    "csv_global_cases": files.loaded("global_cases"),
    "csv_mobility_factor": rounded_result(files.loaded("social_distancing")),
    "csv_air_traffic": files.loaded("air_traffic"),
    "run_all_causality": rounded_result(files.whole_run("granger_result_table")),
    "run_all_flights": files.whole_run("Air_Traffic_Cases"),
}
