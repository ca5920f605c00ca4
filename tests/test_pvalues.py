"""Scalar tails against published values."""

from __future__ import annotations

import math

import numpy as np
import pytest

from assayer.functions import pvalues as PV
from assayer.operators.models import gaussian_criteria


@pytest.mark.parametrize(("t", "df", "p"), [
    (3.464742732111309, 119974, 0.0005309242364230516),
    (-1.397245220948049, 119974, 0.1623424263731701),
])
def test_t_tail(t, df, p):
    assert PV.t_two_sided(t, df) == pytest.approx(p, rel=1e-8)


def test_correlation_tail():
    r, n = 0.002123439041390142, 429539
    assert PV.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) == pytest.approx(0.16401841010502, rel=1e-8)


def test_t_interval():
    mean, error = 0.009091099569074897, 0.0004390710038099625
    margin = PV.t_quantile(0.975, 429540) * error
    assert (mean - margin, mean + margin) == pytest.approx((0.008230533790035575, 0.009951665348114218), rel=1e-8)


def test_small_tables_of_distributions():
    assert PV.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert PV.f_upper(4.0, 2, 30) == pytest.approx(0.0288446233, rel=1e-7)
    assert PV.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert PV.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503, rel=1e-6)


def test_shapiro_published_example():
    w, p = PV.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.7888, abs=1e-4)
    assert p == pytest.approx(0.006704, abs=1e-5)
    assert PV.shapiro_wilk(np.array([1.0, 1.0, 1.0])) == (1.0, 1.0)


def test_information_criteria():
    aic, bic = gaussian_criteria(120000, 0.0950224570212999, 26)
    assert aic == pytest.approx(-224276.83817952126)
    assert bic == pytest.approx(-224024.76175695538)


def test_tails_keep_their_digits_for_large_samples():
    """Against the normal limit with its first correction, and an F tail against its chi-square limit."""
    for df in (1e9, 1e10, 1e11):
        z = 2.5
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        want = PV.normal_two_sided(z) + density * (z**3 + z) / (2 * df)
        assert PV.t_two_sided(z, df) == pytest.approx(want, rel=1e-9)
        assert PV.f_upper(3.0, 2, df) == pytest.approx(math.exp(-3.0) * (1 + 9 / df), rel=1e-8)
        assert PV.t_quantile(0.975, df) == pytest.approx(1.959963984540054, rel=1e-8)
    assert PV.f_upper(1.0, 1e9, 1e9) == pytest.approx(0.5, abs=1e-4)


def test_fisher_follows_the_spread_and_not_the_counts():
    from math import comb

    for a, b, c, d in ((3, 7, 9, 2), (0, 5, 6, 1), (12, 30, 25, 8), (1, 0, 0, 1)):
        row, column, total = a + b, a + c, a + b + c + d
        weights = {k: comb(column, k) * comb(total - column, row - k) for k in range(max(0, row + column - total), min(row, column) + 1)}
        want = sum(w for w in weights.values() if w <= weights[a] * (1 + 1e-7)) / sum(weights.values())
        assert PV.fisher_two_sided(a, b, c, d) == pytest.approx(want, rel=1e-9)
    assert 0.9 < PV.fisher_two_sided(10**9, 10**9, 10**9, 10**9) <= 1.0
    assert PV.fisher_two_sided(10**6, 10**6 + 4000, 10**6 + 4000, 10**6) < 0.01
