"""Estimators against published coefficients of two public monthly series."""

from __future__ import annotations

import numpy as np

from strandwork.models import linear as L

# Monthly counts of two arms from October 2021 to April 2026, and of one total from January 2019 to December 2025.
TREATED = [2, 4, 4, 2, 4, 5, 4, 5, 3, 3, 3, 6, 5, 7, 6, 4, 5, 6, 5, 5, 7, 3, 6, 5, 5, 12, 5, 4, 4, 5, 8, 5, 0, 0, 0, 0, 14, 9, 7, 7, 9, 7, 13, 11, 16, 13, 9, 13, 14, 10, 8, 23, 11, 23, 6]
CONTROL = [3, 5, 2, 3, 3, 7, 7, 3, 7, 4, 7, 4, 0, 3, 3, 2, 2, 0, 2, 3, 8, 3, 1, 5, 1, 4, 0, 0, 1, 1, 3, 3, 1, 0, 0, 0, 7, 12, 8, 5, 8, 5, 6, 4, 9, 7, 7, 9, 7, 10, 2, 10, 4, 6, 4]
TOTAL = [40, 39, 29, 32, 40, 37, 36, 33, 31, 45, 45, 44, 42, 34, 52, 36, 49, 62, 70, 63, 53, 64, 67, 61, 78, 78, 91, 77, 99, 86, 83, 67, 83, 72, 94, 94, 101, 94, 89, 80, 91, 116, 106, 120, 108, 120, 118, 111, 137, 137, 138, 122, 128, 146, 131, 133, 137, 118, 155, 122, 165, 125, 157, 177, 177, 152, 187, 180, 144, 169, 164, 151, 229, 174, 209, 209, 217, 193, 281, 261, 213, 272, 227, 265]
BREAK, TOTAL_BREAK = 33, 66  # positions of July 2024


def arms(y):
    x, names = L.its_design(len(y), BREAK)
    dummies, more = L.month_dummies(10, len(y))
    return L.ols_hac(np.column_stack([x, dummies]), np.array(y, float), names + more, 3)


def total_design():
    x, names = L.its_design(len(TOTAL), TOTAL_BREAK)
    dummies, more = L.month_dummies(1, len(TOTAL))
    return np.column_stack([x, dummies]), np.array(TOTAL, float), names + more


def close(fit, term, estimate, se, digits):
    i = fit.names.index(term)
    assert round(float(fit.beta[i]), digits) == estimate and round(float(fit.se[i]), digits) == se


def test_segmented_arms_and_their_difference():
    control, difference = arms(CONTROL), arms(np.array(TREATED) - np.array(CONTROL))
    for term, estimate, se in (("time", -0.10655047, 0.03244617), ("post", 3.36651869, 1.79878907), ("time_after", 0.24376646, 0.13899684)):
        close(control, term, estimate, se, 8)
    for term, estimate, se in (("time", 0.17344805, 0.03908300), ("post", -4.66365639, 1.57286260), ("time_after", 0.23133310, 0.10003700)):
        close(difference, term, estimate, se, 8)


def test_stacked_trends_before_the_break():
    n = BREAK
    t = np.arange(n)
    dummies, more = L.month_dummies(10, n)
    block = lambda arm: np.column_stack([np.ones(n), t, np.full(n, arm), arm * t, dummies])
    x, y = np.vstack([block(1.0), block(0.0)]), np.array(TREATED[:n] + CONTROL[:n], float)
    fit = L.ols_stacked_hac(x, y, np.tile(t, 2), ["intercept", "time", "treated", "treated_time", *more], 3)
    close(fit, "treated", -0.78966132, 0.86392366, 8)
    close(fit, "treated_time", 0.15541444, 0.04762495, 8)
    w, df, p = fit.wald(["treated", "treated_time"])
    assert df == 2 and round(w, 6) == 19.780493 and round(p, 8) == 0.00005067


def test_total_by_three_models():
    x, y, names = total_design()
    for fit, rows in (
        (L.ols_hac(x, y, names, 3), (("time", 2.0861, 0.0753), ("post", -5.1224, 7.6605), ("time_after", 4.3330, 0.7125))),
        (L.prais_winsten(x, y, names), (("time", 2.0913, 0.0825), ("post", -5.8409, 6.7627), ("time_after", 4.3547, 0.5989))),
        (L.poisson_series(x, y, names, 3), (("time", 0.0241, 0.0012), ("post", -0.1482, 0.0486), ("time_after", 0.0083, 0.0029))),
    ):
        for row in rows:
            close(fit, *row, 4)
    assert round(L.prais_winsten(x, y, names).extra["rho"], 3) == -0.159
    assert round(L.poisson_series(x, y, names, 3).extra["dispersion"], 2) == 1.75
