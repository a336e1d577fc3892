"""Upper tail of F against closed forms and direct integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.fdist import f_tail, f_upper_tail, log_gamma


def test_log_gamma():
    x = np.array([0.5, 1.0, 2.5, 7.0, 15.9, 16.1, 300.0, 1e6])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


def test_two_numerator_degrees_have_a_closed_form():
    f = np.random.default_rng(0).gamma(1, 1, 500)
    for d2 in (1, 2, 7, 60, 1000, 10**6):
        assert np.allclose(f_upper_tail(f, 2, d2), np.exp(-d2 / 2 * np.log1p(2 * f / d2)), rtol=1e-9, atol=1e-12)


def test_against_integration():
    for d1, d2, f in ((1, 5, 0.3), (3, 67, 1.04), (12, 35, 2.1), (14, 19, 0.9), (7, 400, 3.3)):
        angles = np.linspace(math.atan(math.sqrt(d1 * f / d2)), math.pi / 2, 20001)
        density = np.sin(angles) ** (d1 - 1) * np.cos(angles) ** (d2 - 1)
        weights = np.full(20001, 2.0)
        weights[1::2] = 4.0
        weights[[0, -1]] = 1.0
        area = (weights * density).sum() * (angles[1] - angles[0]) / 3
        scale = 2 * math.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2))
        assert abs(f_upper_tail(f, d1, d2) - area * scale) < 1e-10


def test_borders():
    out = f_upper_tail([0.0, -1.0, np.nan, 1e300, 1.0], [1, 1, 1, 1, 1], [5, 5, 5, 5, 0])
    assert out[0] == out[1] == 1.0 and np.isnan(out[2]) and out[3] == 0.0 and np.isnan(out[4])


def test_many_rows_stay_accurate():
    assert abs(f_upper_tail(1.2, 14, 10**11) - f_upper_tail(1.2, 14, 10**8)) < 1e-6


def test_column_function(spark):
    df = spark.createDataFrame([(1.5, 2.0, 10.0), (None, 2.0, 10.0)], "f double, a double, b double")
    out = [r[0] for r in df.select(f_tail("f", "a", F.col("b"))).collect()]
    assert abs(out[0] - (1 + 3 / 10) ** -5) < 1e-14 and out[1] is None


def test_huge_degrees_of_freedom_approach_the_chi_square_limit():
    f = np.array([0.3, 0.9, 1.5, 2.5])
    for d1 in (1, 2, 14, 40):
        limit = f_upper_tail(f, d1, 1e15)
        near = f_upper_tail(f, d1, 1e12)
        assert np.abs(near - limit).max() < 1e-9
        if d1 == 2:  # the exponential distribution
            assert np.abs(near - np.exp(-f)).max() < 1e-9
    # even d1: a finite sum
    half = 7 * f
    exact = np.exp(-half) * sum(half ** k / float(math.factorial(k)) for k in range(7))
    assert np.abs(f_upper_tail(f, 14, 1e12) - exact).max() < 1e-9


def test_ways_agree_where_they_meet():
    f = np.array([0.9, 0.9999, 1.0, 1.0002, 1.1])
    for d1, d2 in ((14, 2e7), (3, 2e7), (2e6, 2e6), (2e6, 8e6), (2e7, 9)):
        below, above = f_upper_tail(f, d1 * 0.999999, d2 * 0.999999), f_upper_tail(f, d1 * 1.000001, d2 * 1.000001)
        assert np.abs(below - above).max() < 1e-5
    assert f_upper_tail(1.0, 1e12, 1e12) == pytest.approx(0.5, abs=1e-9)


def test_no_finite_input_is_undefined():
    f, d1, d2 = np.meshgrid([0.0, 1e-9, 0.5, 1.0, 3.0, 1e6, 1e12], [1, 14, 1e4, 1e7, 1e12], [1, 30, 1e5, 1e8, 1e12])
    p = f_upper_tail(f, d1, d2)
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()
