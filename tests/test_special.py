import math

import pytest

from ouzel.functions import special as sp


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (1.96, 1e7, 0.05), (12.706, 1, 0.05), (2.576, 1e7, 0.01)])
def test_t(t, df, p):
    assert sp.t_two_sided(t, df) == pytest.approx(p, abs=2e-4)
    assert sp.t_quantile(1 - p / 2, df) == pytest.approx(t, abs=2e-3)


@pytest.mark.parametrize("f,a,b,p", [(4.96, 1, 10, 0.05), (3.89, 2, 12, 0.05), (2.71, 5, 20, 0.05)])
def test_f(f, a, b, p):
    assert sp.f_sf(f, a, b) == pytest.approx(p, abs=1e-3)


@pytest.mark.parametrize("x,df,p", [(3.841, 1, 0.05), (18.307, 10, 0.05), (0.0, 3, 1.0), (124.342, 100, 0.05)])
def test_chi2(x, df, p):
    assert sp.chi2_sf(x, df) == pytest.approx(p, abs=1e-4)


def test_f_is_squared_t():
    assert sp.f_sf(2.5**2, 1, 17) == pytest.approx(sp.t_two_sided(2.5, 17), rel=1e-12)


def test_normal():
    assert sp.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert sp.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_mann_whitney_exact_counts_all_arrangements():
    import itertools

    n1, n2 = 4, 5
    us = []
    for ranks in itertools.combinations(range(1, n1 + n2 + 1), n1):
        us.append(sum(ranks) - n1 * (n1 + 1) / 2)
    for u in range(n1 * n2 + 1):
        upper = max(u, n1 * n2 - u)
        expected = min(1, 2 * sum(x >= upper for x in us) / len(us))
        assert sp.mann_whitney_exact(u, n1, n2) == pytest.approx(expected)


def test_extremes_stay_in_range():
    assert sp.t_two_sided(1e6, 5) >= 0 and sp.f_sf(math.inf, 2, 3) == 0.0
