"""Data quality: dataset profiles and key validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: number of unmatched keys shown in a report.
SAMPLE_KEYS = 10


def _distinct_type(dtype: T.DataType) -> str:
    """Common type in which values of this type can be told apart without loss."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return "string"
    return dtype.simpleString()


def distinct_counts(df: DataFrame) -> DataFrame:
    """``column, distinct``: exact number of different values, NULL being one of them.

    Columns of one type share a pass over narrow (column, value) rows. Repeats vanish before
    the shuffle, and every column is spread over all tasks by its values.
    """
    by_type: dict[str, list[str]] = {}
    for field in df.schema.fields:
        by_type.setdefault(_distinct_type(field.dataType), []).append(field.name)
    counts = []
    for dtype, names in by_type.items():
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(dtype).alias("value")) for c in names]))
        values = df.select(cells.alias("__cell")).select("__cell.column", "__cell.value").distinct()
        found = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        counts.append(found)
    return reduce(DataFrame.unionByName, counts)


def approx_distinct_counts(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """``column, distinct`` estimated in one pass without a shuffle of values."""
    cells = [F.struct(
        F.lit(c).alias("column"),
        (F.approx_count_distinct(f"`{c}`", rsd)
         + F.when(F.count(F.lit(1)) > F.count(f"`{c}`"), 1).otherwise(0)).alias("distinct"))
        for c in df.columns]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def describe(df: DataFrame) -> DataFrame:
    """``column, type, count, mean, stddev, min, max``; statistics for numeric columns only.

    All columns come from one aggregate, reshaped to rows afterwards.
    """
    cells = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        number = c.cast("double") if isinstance(field.dataType, T.NumericType) else None
        none = F.lit(None).cast("double")
        cells.append(F.struct(
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            (F.count(c) if number is not None else F.lit(None).cast("long")).alias("count"),
            (F.avg(number) if number is not None else none).alias("mean"),
            (F.stddev_samp(number) if number is not None else none).alias("stddev"),
            (F.min(number) if number is not None else none).alias("min"),
            (F.max(number) if number is not None else none).alias("max")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def profile(datasets: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """``dataset, column, type, distinct, count, mean, stddev, min, max`` for every column.

    A dataset is read once for the statistics and once per column type; store a derived one first.
    """
    parts = []
    for name, df in datasets.items():
        distinct = approx_distinct_counts(df) if approximate else distinct_counts(df)
        both = describe(df).join(distinct, "column", "left")
        parts.append(both.select(
            F.lit(name).alias("dataset"), "column", "type",
            F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
            "count", "mean", "stddev", "min", "max"))
    return reduce(DataFrame.unionByName, parts)


def unmatched_keys(df: DataFrame, key: str, dictionary: DataFrame, dictionary_key: str,
                   lower_dictionary: bool = True, lower_input: bool = False) -> DataFrame:
    """Distinct values of ``key`` missing in the dictionary, as a column named ``key``.

    Repeats are removed on both sides before the shuffle, so a frequent key or word costs one row per task.
    """
    wanted = F.lower(key) if lower_input else F.col(key)
    known = F.lower(dictionary_key) if lower_dictionary else F.col(dictionary_key)
    keys = df.select(wanted.alias(key)).distinct()
    words = dictionary.select(known.alias("__known")).distinct()
    return keys.join(words, F.col(key) == F.col("__known"), "left_anti")


def unmatched_sample(misses: DataFrame, size: int = SAMPLE_KEYS) -> DataFrame:
    """The first ``size`` misses in key order."""
    return misses.orderBy(*misses.columns).limit(size)
