"""Joins that enrich facts with dimensions.

Dimensions are joined to each other before they meet the fact table, so that the large side
is joined once per role. Spark cannot tell the size of such a joined dimension beforehand and
would shuffle the fact table; so it is measured, and broadcast only if it is small. Otherwise
Spark shuffles and, with adaptive execution, splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Largest dimension that is broadcast, in bytes of its values written as JSON.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def small_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcasting if its measured size allows it, else unchanged."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def join_shared(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on columns of the same name; the keys appear once."""
    return left.join(right, list(keys), "inner")


def join_named(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Inner join on ``{left column: right column}``; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({r: f"__right_{r}" for r in pairs.values()})
    same = F.lit(True)
    for l, r in pairs.items():
        same = same & (F.col(f"`{l}`") == F.col(f"`__right_{r}`"))
    return left.join(renamed, same, "inner").drop(*[f"__right_{r}" for r in pairs.values()])


def enrich_role(fact: DataFrame, dimension: DataFrame, key: str, dimension_key: str, prefix: str) -> DataFrame:
    """Attach a dimension in one role: its columns arrive as ``<prefix>_<column>``."""
    role = dimension.select(
        F.col(dimension_key).alias("__role_key"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in dimension.columns if c != dimension_key])
    return fact.join(role, F.col(key) == F.col("__role_key"), "inner").drop("__role_key")


def enrich_chain(fact: DataFrame, dimension: DataFrame, dimension_keys: Sequence[str],
                 measure: DataFrame, measure_keys: Sequence[str]) -> DataFrame:
    """Fact to dimension to measure: the two small tables are joined first."""
    return fact.join(dimension.join(measure, list(measure_keys), "inner"), list(dimension_keys), "inner")
