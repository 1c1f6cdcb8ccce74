"""Charge detection and overlapping isotope patterns."""

from __future__ import annotations

import numpy as np
import pytest

from massloom.functions.sequence import NEUTRON, PROTON
from massloom.operators import features


def pattern(mass, z, height):
    a = features.averagine_pattern(mass)
    return [(mass / z + PROTON + k * NEUTRON / z, height * x / a.max()) for k, x in enumerate(a)]


def scan(*parts, tolerance=3e-6):
    peaks = sorted(p for part in parts for p in part)
    out = []
    for m, i in peaks:
        if out and m - out[-1][0] <= m * tolerance:
            out[-1] = (out[-1][0], out[-1][1] + i)
        else:
            out.append((m, i))
    return np.array([p[0] for p in out]), np.array([p[1] for p in out])


@pytest.mark.parametrize("z", [1, 2, 3, 4, 5])
def test_the_repeat_gives_the_charge(z):
    mz, i = scan(pattern(600.0 * z, z, 100.0))
    keep = mz < mz[0] + 3.2
    assert features.charge_order(mz[keep], i[keep])[0] == z
    assert features.charge_order(mz[:1], i[:1]) == []


def test_two_overlapping_patterns_are_both_found():
    one, two = 1400.7, 2103.0 + 0.35
    mz, i = scan(pattern(one, 2, 1000.0), pattern(two, 3, 700.0))
    got = features.overlapping_features(mz, i)
    assert {(round(m, 1), z) for m, z, *_ in got[:2]} == {(round(one, 1), 2), (round(two, 1), 3)}
    amounts = {z: t for _, z, t, *_ in got[:2]}
    inside = lambda p: sum(a for m, a in p if abs(m - mz[np.argmax(i)]) <= features.REACH)
    assert abs(amounts[2] / inside(pattern(one, 2, 1000.0)) - 1) < 0.01 and abs(amounts[3] / inside(pattern(two, 3, 700.0)) - 1) < 0.01


def test_patterns_that_share_peaks_are_taken_apart():
    # the second isotope of one is the first of the other
    one = 1200.6
    two = 2 * (one / 2 + NEUTRON / 2)
    mz, i = scan(pattern(one, 2, 1000.0), pattern(two, 2, 900.0))
    got = features.overlapping_features(mz, i)
    assert {(round(m, 1), z) for m, z, *_ in got[:2]} == {(round(one, 1), 2), (round(two, 1), 2)}
    alone = features.overlapping_features(*scan(pattern(one, 2, 1000.0)))
    assert [(round(m, 1), z) for m, z, *_ in alone] == [(round(one, 1), 2)]


def test_single_patterns_agree_with_the_greedy_fit(spark):
    rows = []
    for k, (mass, z) in enumerate([(900.5, 1), (1500.8, 2), (2500.2, 3)]):
        mz, i = scan(pattern(mass, z, 500.0))
        rows.append(("f", k, 1, 60.0 * k, mz.tolist(), i.tolist()))
    df = spark.createDataFrame(rows, "file string, scan int, ms_level int, rt double, mz array<double>, intensity array<double>")
    view = lambda d: sorted((r.scan, round(r.mono_mass, 2), r.charge) for r in d.collect())
    assert view(features.detect_features(df, overlap=True)) == view(features.detect_features(df)) == [(0, 900.5, 1), (1, 1500.8, 2), (2, 2500.2, 3)]
