"""Feature operators: rescaling, labels and codes, density, shares and exposure factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import scalar as S

# Fixed value: upper end of the rescaled range.
NORM_SCALE = 1000.0


def minmax_normalize(df: DataFrame, columns: Sequence[str], scale: float = NORM_SCALE,
                     suffix: str = "_norm") -> DataFrame:
    """Add ``<column>_norm`` in 0..scale, from the smallest and largest value of the table.

    One aggregate serves all columns; its single row enters as a scalar subquery. A
    constant column gives NULL.
    """
    bounds = df.agg(F.struct(*[
        agg(F.col(c).cast("double")).alias(f"{name}_{i}")
        for i, c in enumerate(columns) for name, agg in (("lo", F.min), ("hi", F.max))]).alias("bounds")).scalar()
    scaled = {}
    for i, c in enumerate(columns):
        lo, hi = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        scaled[c + suffix] = F.try_divide(F.col(c).cast("double") - lo, hi - lo) * scale
    return df.withColumns(scaled)


def correct_labels(df: DataFrame, column: str,
                   suffixes: Sequence[tuple[str, int]] = S.LABEL_SUFFIXES) -> DataFrame:
    """Replace ``column`` by its lower-cased form without administrative suffix."""
    return df.withColumn(column, S.corrected_label(F.col(column), suffixes))


def split_place_code(df: DataFrame, column: str, state: str = "fips_state",
                     county: str = "fips_county") -> DataFrame:
    """Add state and county numbers of a variable-length place code."""
    parts = S.place_code_parts(F.col(column))
    return df.withColumns({state: parts[0], county: parts[1]})


def split_block_code(df: DataFrame, column: str, state: str = "fips_state",
                     county: str = "fips_county") -> DataFrame:
    """Add state and county numbers of a twelve-digit block code; ``column`` becomes padded text."""
    parts = S.block_code_parts(F.col(column))
    return df.withColumns({state: parts[0], county: parts[1], column: S.padded_block_code(F.col(column))})


def density(population: DataFrame, land: DataFrame, keys: Sequence[str], heads: str = "Population",
            area: str = "amount_land", out: str = "Population_Density") -> DataFrame:
    """Sum land per key, join the population on it and add heads per 10,000 units of area."""
    per_key = land.groupBy(*keys).agg(F.sum(area).cast("long").alias(area))
    joined = per_key.join(population, list(keys), "inner")
    return joined.withColumns({heads: F.col(heads).cast("long"),
                               out: S.density(F.col(heads).cast("long"), F.col(area))})


def shares(df: DataFrame, parts: dict[str, str], total: str) -> DataFrame:
    """Add percentages of ``total``: ``{output column: part column}``."""
    return df.withColumns({out: S.share_pct(F.col(p), F.col(total)) for out, p in parts.items()})


def exposure_factors(df: DataFrame, factors: dict[str, str], dens: str) -> DataFrame:
    """Add share times density: ``{output column: share column}``."""
    return df.withColumns({out: S.exposure_factor(F.col(s), F.col(dens)) for out, s in factors.items()})
