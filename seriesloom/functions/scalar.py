"""Column expressions used by the panel operators. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A label that contains the text loses that many characters at its end.
LABEL_SUFFIXES: tuple[tuple[str, int], ...] = ((" county", 7), (" borough", 8))
# Code layouts.
BLOCK_CODE_DIGITS = 12
COUNTY_DIGITS = 3
STATE_DIGITS = 2
# Fixed value: square metres per hectare.
AREA_UNIT = 10000


def corrected_label(label: Column, suffixes: Sequence[tuple[str, int]] = LABEL_SUFFIXES) -> Column:
    """Lower-cased label without its administrative suffix (first matching entry wins)."""
    low = F.lower(label)
    branches = None
    for text, cut in suffixes:
        shorter = F.substr(low, F.lit(1), F.length(low) - cut)
        branches = (F.when(low.contains(text), shorter) if branches is None
                    else branches.when(low.contains(text), shorter))
    return low if branches is None else branches.otherwise(low)


def place_code_parts(code: Column) -> tuple[Column, Column]:
    """(state, county) numbers of a code whose last three characters name the county."""
    state = F.substr(code, F.lit(1), F.greatest(F.length(code) - COUNTY_DIGITS, F.lit(0)))
    county = F.right(code, F.lit(COUNTY_DIGITS))
    return state.try_cast("int"), county.try_cast("int")


def padded_block_code(code: Column) -> Column:
    """Block code as text of twelve digits, from a number or from text."""
    text = code.cast("string")
    short = F.length(text) < BLOCK_CODE_DIGITS
    return F.when(short, F.lpad(text, BLOCK_CODE_DIGITS, "0")).otherwise(text)


def block_code_parts(code: Column) -> tuple[Column, Column]:
    """(state, county) numbers of a block code: digits 1-2 and 3-5 of twelve.

    Codes that are numbers of at most twelve digits are taken apart by arithmetic, which costs a
    fraction of padding and cutting text; anything else goes through the padded text.
    """
    number = code.try_cast("long")
    regular = number.between(0, 10 ** BLOCK_CODE_DIGITS - 1)
    text = padded_block_code(code)

    def digits(start: int, count: int) -> Column:
        rest = 10 ** (BLOCK_CODE_DIGITS - start + 1 - count)
        part = F.call_function("div", number, F.lit(rest)) % 10 ** count
        return F.when(regular, part.cast("int")).otherwise(F.substring(text, start, count).try_cast("int"))

    return digits(1, STATE_DIGITS), digits(1 + STATE_DIGITS, COUNTY_DIGITS)


def parsed_date(text: Column, fmt: str) -> Column:
    """Date in the given format; NULL if the text does not fit."""
    return F.try_to_date(text, fmt)


def local_date(text: Column) -> Column:
    """Date of a timestamp text such as 2020-03-01T00:00:00-05:00, whatever the session zone.

    A cast reads year-month-day text without a formatter; shorter text is not taken for a date.
    """
    day = F.substring(text.cast("string"), 1, 10)
    return F.when(F.length(day) == 10, day.try_cast("date"))


def density(population: Column, area: Column) -> Column:
    """Heads per 10,000 units of area; NULL where the area is zero."""
    return F.try_divide(population.cast("double") * AREA_UNIT, area.cast("double"))


def share_pct(part: Column, total: Column) -> Column:
    """Percentage of ``total``; NULL where the total is zero."""
    return F.try_divide(part.cast("double"), total.cast("double")) * 100


def exposure_factor(share: Column, dens: Column) -> Column:
    """Share weighted by density."""
    return share * dens


def avg_temp(high: Column, low: Column, mode: str = "reference") -> Column:
    """``reference`` halves the low only; ``mean`` is the mean of both."""
    if mode == "reference":
        return high + low / 2
    if mode == "mean":
        return (high + low) / 2
    raise ValueError(f"unknown mode {mode!r}")


def region_suffix(region: Column) -> Column:
    """Two-letter region behind the country prefix: US-NY gives NY."""
    return F.substring(region, 4, 2)


def text_items(text: Column, sep: str = ",") -> Column:
    """Items of a separated text as an array; ``sep`` is taken literally."""
    return F.split(text, "\\Q" + sep + "\\E")
