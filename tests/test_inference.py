"""Detectors of parameter inference on made spectra, and their sums against loops."""

from __future__ import annotations

import numpy as np
import pytest

from massloom.functions.sequence import PROTON, RESIDUE_MASS, WATER
from massloom.operators import inference

SCHEMA = "file string, scan int, ms_level int, charge int, precursor_mz double, mz array<double>, intensity array<double>"


def made(n=120, reporters=(), last="KR", phospho=False, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        pmz = float(rng.uniform(400, 900))
        peaks = list(zip(rng.uniform(100, 1500, 60), rng.uniform(1, 20, 60))) + [(700.0, 100.0)]
        peaks += [(m, float(rng.uniform(40, 80))) for m in reporters]
        m = RESIDUE_MASS[last[k % len(last)]] + WATER if last else 0.0
        peaks += [(m + PROTON, float(rng.uniform(30, 60))), ((pmz - PROTON) * 2 + PROTON - m, float(rng.uniform(30, 60)))] if last else []
        peaks += [(pmz - inference.PHOSPHO_LOSS / 2, float(rng.uniform(50, 90)))] if phospho else []
        peaks.sort()
        rows.append(("f", k, 2, 2, pmz, [float(p[0]) for p in peaks], [float(p[1]) for p in peaks]))
    return rows


def test_sums_equal_a_loop(spark):
    rows = made(20, reporters=inference.REPORTERS["TMT 2-plex"], phospho=True) + [("f", 99, 2, 2, 500.0, [], [])]
    got = {(r.detector, r.ion): r for r in inference.detector_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.05).collect()}
    places = inference.detector_places()
    assert len(got) == len(places)
    for d, ion, kind, v in places:
        shares = []
        for *_, z, pmz, mz, i in rows[:-1]:
            x = v if kind == "fixed" else pmz - v / z if kind == "loss" else (pmz - PROTON) * z + PROTON - v
            shares.append(sum(b for a, b in zip(mz, i) if x - 0.05 <= a <= x + 0.05) / max(i))
        r = got[d, ion]
        assert r.n == 20 and abs(r.total - sum(shares)) < 1e-9 and abs(r.squares - sum(s * s for s in shares)) < 1e-9


@pytest.mark.parametrize(("last", "enzyme"), [("KR", "trypsin"), ("K", "lys-c"), ("R", "arg-c"), ("", None)])
def test_enzymes(spark, last, enzyme):
    got = inference.infer_parameters(spark.createDataFrame(made(last=last), SCHEMA))
    assert got["enzyme"] == enzyme and not got["phospho"] and not any(got["reporters"].values()) and got["mass_errors"]["precursor_ppm"] is None


def test_reporters_and_phosphorylation(spark):
    six, ten = inference.REPORTERS["TMT 6-plex"], inference.REPORTERS["TMT 10-plex"]
    got = inference.infer_parameters(spark.createDataFrame(made(reporters=six, phospho=True), SCHEMA), 0.003)
    assert got["reporters"]["TMT 6-plex"] and not got["reporters"]["TMT 10-plex"] and not got["reporters"]["iTRAQ 4-plex"] and got["phospho"]
    both = inference.infer_parameters(spark.createDataFrame(made(reporters=sorted({*six, *ten})), SCHEMA), 0.003)["reporters"]
    assert both["TMT 6-plex"] and both["TMT 10-plex"]


def test_welch():
    a, b = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 1, 2, 1])
    want = (a.mean() - b.mean()) / np.sqrt(a.var(ddof=1) / 4 + b.var(ddof=1) / 5)
    assert abs(inference.welch((4, a.sum(), (a**2).sum()), (5, b.sum(), (b**2).sum())) - want) < 1e-12
    assert inference.welch((1, 1.0, 1.0), (5, 1.0, 1.0)) == 0.0
