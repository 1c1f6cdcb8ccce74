"""The DIA analysis on a made run, and its kernels against plain loops."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON, RESIDUE_MASS, WATER
from massloom.operators import dia, dia_run, digestion, joins

SCHEMA = "file string, scan int, ms_level int, precursor_mz double, rt double, zstates array<struct<charge:int,mh:double>>, iso_lo double, iso_hi double, mz array<double>, intensity array<double>"


def test_overlap_join_equals_the_nested_loop(spark):
    rng = np.random.default_rng(1)
    sides = [[(i, float(lo), float(lo + w)) for i, (lo, w) in enumerate(zip(rng.uniform(-50, 50, n), rng.choice([0, 0.01, 1, 2, 7, 40, 300], n) * rng.uniform(0.5, 1, n)))] for n in (150, 120)]
    sides[0] += [(900, None, 1.0), (901, 5.0, 4.0), (902, 0.0, 0.0), (903, -8.0, 8.0)]
    sides[1] += [(902, 0.0, 0.0), (904, 8.0, 9.0), (905, 1.0, None)]
    a, b = spark.createDataFrame(sides[0], "i long, a double, b double"), spark.createDataFrame(sides[1], "j long, c double, d double")
    for base in (1.0, 0.01):
        got = joins.overlap_join(a, b, "a", "b", "c", "d", base=base)
        assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, x, y in sides[0] for j, u, v in sides[1] if None not in (x, y, u, v) and x <= y and u <= v and max(x, u) <= min(y, v))
    assert joins.overlap_join(a.limit(0), b, "a", "b", "c", "d").count() == 0


def test_nearest_join_equals_the_loop_and_makes_no_pairs(spark):
    rng = np.random.default_rng(3)
    left = [(i, "ab"[i % 2], float(rng.integers(-40, 40)) / 4) for i in range(80)] + [(900, "a", None), (901, "c", 1.0), (902, "a", 500.0)]
    right = [("ab"[j % 2], float(rng.integers(-48, 48)) / 4, int(rng.integers(0, 9)) * 100 + j % 100) for j in range(150)] + [("a", None, 1)]
    l, r = spark.createDataFrame(left, "i long, g string, x double"), spark.createDataFrame(right, "g string, y double, t long")
    found = joins.nearest_join(l, r, "i", "x", "y", 1.0, ["g"], ["t"])
    want = {}
    for i, g, x in left:
        near = [(abs(x - y), t, y) for h, y, t in right if h == g and x is not None and y is not None and abs(x - y) <= 1.0]
        want[i] = min(near)[1:] if near else (None, None)
    assert {q.i: (q.t, q.y) for q in found.collect()} == want
    # 400 left and 400 right rows at one place: the old join made a row for each of the 160,000 pairs
    many = joins.nearest_join(spark.range(400).select("id", F.lit(0.0).alias("x")), spark.range(400).select(F.lit(0.5).alias("y"), F.col("id").alias("t")), "id", "x", "y", 1.0, (), ["t"])
    assert {q.t for q in many.collect()} == {0} and many.count() == 400
    assert not any("__bin" in line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


@pytest.mark.parametrize("exact", [False, True])
def test_feature_matches_equal_the_loop(spark, exact):
    rng = np.random.default_rng(4)
    asked = [(i, float(400 + rng.integers(0, 400) / 50), float(rng.integers(0, 40) / 4)) for i in range(120)] + [(900, None, 1.0), (901, 401.0, None)]
    known = [(j, int(j % 4 + 1), float(400 + b / 50), float(400 + m / 50), float(f), float(f + w)) for j, (b, m, f, w) in enumerate(zip(rng.integers(0, 400, 60), rng.integers(0, 400, 60), rng.integers(0, 10, 60), rng.integers(-2, 6, 60)))]
    known += [(900, 1, None, 401.0, 0.0, 9.0), (901, 1, 401.0, None, 0.0, 9.0)]
    s, f = spark.createDataFrame(asked, "spec_id long, precursor_mz double, rt_time double"), spark.createDataFrame(known, "feature_id long, charge int, base_mz double, mono_mz double, first_rt double, last_rt double")
    found = joins.match_features(s, f, 100.0, 0.5, exact)
    want = set()
    for i, x, t in asked:
        for j, z, base, mono, first, last in known:
            if x is not None and t is not None and first - 0.5 <= t <= last + 0.5:
                near = base is not None and base * (1 - 1e-4) <= x <= base * (1 + 1e-4)
                if near or (not exact and mono is not None and mono - 0.05 <= x <= mono + {1: 3.10, 2: 2.10}.get(z, 4.0 / z)):
                    want.add((i, j))
    got = [(r.spec_id, r.feature_id) for r in found.collect()]
    assert sorted(got) == sorted(want) and found.columns == [*s.columns, *f.columns]
    # time is part of the key, and pairs go through no aggregate afterwards
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Join" in line and "__late" in line for line in plan) and not any("Aggregate" in line for line in plan[: next(k for k, line in enumerate(plan) if "Join" in line)])


def test_overlap_join_visits_few_levels(spark):
    """Widths from 0.01 to 1.28 were eight levels, each another copy of every interval."""
    rows = spark.range(400).select(F.col("id").alias("i"), (F.col("id") % 20 / 10).alias("a"), (F.col("id") % 20 / 10 + 0.01 * F.pow(F.lit(2.0), F.col("id") % 8)).alias("b"))
    plan = joins.overlap_join(rows, rows.toDF("j", "c", "d"), "a", "b", "c", "d", base=0.01)._jdf.queryExecution().optimizedPlan().toString()
    levels = [len(x.split(",")) for x in re.findall(r"filter\(\[([0-9, ]+)\]", plan)]
    assert levels and max(levels) <= 4


def ions(seq):
    m = np.array([RESIDUE_MASS[c] for c in seq])
    b = np.cumsum(m)[:-1]
    return np.concatenate([b, m.sum() - b + WATER]) + PROTON


def mass(seq):
    return sum(RESIDUE_MASS[c] for c in seq) + WATER


PEPTIDES = {"AGDEFLLK": 6, "GGHWLLAAK": 14, "AEDGGTTSSR": 25}


def run_of(cycles=30, windows=((400, 450), (450, 500), (500, 550)), given=True):
    """Peptides elute as bells around their cycles; every cycle has an MS1 scan and one MS2 scan for each window."""
    rng = np.random.default_rng(7)
    rows, scan = [], 0
    for c in range(cycles):
        scan += 1
        height = {s: 1e5 * math.exp(-((c - at) ** 2) / 3) for s, at in PEPTIDES.items()}
        peaks = [(mass(s) / 2 + PROTON + k / 2, h * a) for s, h in height.items() for k, a in enumerate((1.0, 0.6, 0.2)) if h > 10]
        peaks += list(zip(rng.uniform(350, 600, 40), rng.uniform(10, 500, 40)))
        peaks.sort()
        rows.append(("f", scan, 1, None, float(c), [], None, None, [float(p[0]) for p in peaks], [float(p[1]) for p in peaks]))
        for lo, hi in windows:
            scan += 1
            peaks = [(m, h * (0.5 + 0.05 * i)) for s, h in height.items() if lo <= mass(s) / 2 + PROTON < hi and h > 10 for i, m in enumerate(ions(s))]
            peaks += list(zip(rng.uniform(100, 1000, 15), rng.uniform(5, 60, 15)))
            peaks.sort()
            rows.append(("f", scan, 2, (lo + hi) / 2.0, c + 0.1, [], float(lo) if given else None, float(hi) if given else None, [float(p[0]) for p in peaks], [float(p[1]) for p in peaks]))
    return rows


@pytest.fixture(scope="module")
def index(spark):
    proteins = spark.createDataFrame([("p1", "MKAGDEFLLKVVNSTRPEEPTIDEKGGHWLLAAKSSTTYYRAADDFFK"), ("p2", "LLNNQQWWKAEDGGTTSSRVVLLIIKPPGGHHEEK")], "protein_id string, residues string")
    return digestion.build_index(proteins, mods_spec="", decoy="peptide-reverse", min_length=5)


def test_windows_are_inferred_from_the_gaps(spark):
    _, ms2 = dia_run.with_cycles(spark.createDataFrame(run_of(3, given=False), SCHEMA))
    got = {(r.precursor_mz, r.win_lo, r.win_hi) for r in dia_run.with_windows(ms2).collect()}
    assert got == {(425.0, 400.0, 450.0), (475.0, 450.0, 500.0), (525.0, 500.0, 550.0)}
    assert sorted({(r.cycle, r.ms1_scan) for r in ms2.collect()}) == [(1, 1), (2, 5), (3, 9)]


def test_candidates_lie_in_their_windows(spark, index):
    _, ms2 = dia_run.with_cycles(spark.createDataFrame(run_of(3), SCHEMA))
    got = dia_run.window_candidates(dia_run.with_windows(ms2), index, (2, 3)).collect()
    want = {(lo, z, p.mod_sequence, p.is_decoy) for p in index.collect() for lo, hi in ((400, 450), (450, 500), (500, 550)) for z in (2, 3) if lo <= p.mass / z + PROTON <= hi}
    assert {(r.win_lo, r.charge, r.mod_sequence, r.is_decoy) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("clean", [False, True])
def test_peptides_are_found_where_they_elute(spark, index, clean, monkeypatch):
    monkeypatch.setattr(dia_run, "CYCLES", 4)
    predicted = spark.createDataFrame([(s, float(at)) for s, at in PEPTIDES.items()] + [("VVLLIIK", 0.0), ("SSTTYYR", 29.0)], "sequence string, predicted_rt double")
    rows = dia_run.dia_run(spark.createDataFrame(run_of(), SCHEMA), index, predicted, keep_all=True, clean=clean).toPandas()
    for s, at in PEPTIDES.items():
        mine = rows[(rows["sequence"] == s) & ~rows["is_decoy"] & (rows["charge"] == 2)]
        top = mine.loc[mine["ensemble score"].idxmax()]
        assert abs(top["cycle"] - 1 - at) <= 2 and top["coelute_ms1"] > 0.9 and top["coelute_ms2"] > 0.9 and top["coelute_ms1_ms2"] > 0.9
        assert top["fragment_p"] >= mine["fragment_p"].quantile(0.3) and top["rt_diff"] < 0.2
    assert set(dia_run.FEATURES) <= set(rows.columns) and not rows[list(dia_run.FEATURES)].isna().any().any()


def test_filter_keeps_what_reaches_the_best_and_weights_are_chosen(spark, index):
    spectra = spark.createDataFrame(run_of(10), SCHEMA)
    every = dia_run.dia_run(spectra, index, keep_all=True).toPandas()
    kept = dia_run.dia_run(spectra, index).toPandas()
    for _, g in every.groupby(["spec_id", "is_decoy"]):
        base = g.loc[g["xcorr rank"].idxmin(), "ensemble score"]
        mine = kept[(kept["spec_id"] == g["spec_id"].iloc[0]) & (kept["is_decoy"] == g["is_decoy"].iloc[0])]
        assert len(mine) == (g["ensemble score"] >= base - 1e-6).sum()
    assert dia_run.dia_run(spectra.where("ms_level = 1"), index).count() == 0


def test_kernels_against_loops():
    rng = np.random.default_rng(3)
    mz, value = np.sort(rng.uniform(100, 101, 300)), rng.uniform(1, 9, 300)
    asked = rng.uniform(99.9, 101.1, 200)
    for x, got in zip(asked, dia_run.nearest(mz, value, asked, 20.0, -1.0)):
        k = min(range(300), key=lambda i: (abs(mz[i] - x), mz[i]))
        assert got == (value[k] if abs(mz[k] - x) * 1e6 / max(mz[k], x) <= 20 else -1.0)
    intensity = rng.uniform(1, 1e6, 800)
    order = np.sort(intensity)[::-1]
    take = range(20, 20 + int(780 * 0.2))
    slope, intercept = np.polyfit([math.log(1 + order[k]) for k in take], [math.log(1 + k) for k in take], 1)
    assert np.allclose(dia_run.rank_fit(intensity), (slope, intercept)) and dia_run.rank_fit(intensity[:499]) is None
    a, b = rng.uniform(0, 1, (3, 5)), rng.uniform(0, 1, (4, 5))
    cos = lambda p, q: float(p @ q / math.sqrt((p @ p) * (q @ q)))
    want = [sum(sorted((cos(x[i], x[j]) for i in range(len(x)) for j in range(i)), reverse=True)[:3]) / 3 for x in (a, b)]
    assert np.allclose(dia_run.cosine_means(a, b, 3), [*want, sum(sorted((cos(a[0], q) for q in b), reverse=True)[:3]) / 3])
    evidence = np.zeros(50)
    evidence[[5, 9, 20, 30]] = [1.0, 2.0, 3.0, 4.0]
    got = dia_run.fragment_scores(evidence, np.array([5, 9, 12, 40]), np.array([5, 12]), np.array([9, 40]))
    p = 4 / 26
    assert abs(got[0] + math.log(sum(math.comb(4, j) * p**j * (1 - p) ** (4 - j) for j in (2, 3, 4)))) < 1e-12
    assert abs(got[1] - (math.log(2) + math.log(5))) < 1e-12


def test_traces_by_columns_equal_the_kernel(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 1, (3, 5)), rng.uniform(0, 1, (4, 5))
    rows = [(1, "ms1", k, t.tolist()) for k, t in enumerate(a)] + [(1, "ms2", k, t.tolist()) for k, t in enumerate(b)]
    got = dia.coelution(spark.createDataFrame(rows, "psm_id long, kind string, ion int, trace array<double>")).first()
    assert np.allclose([got.ms1, got.ms2, got.ms1_ms2], dia_run.cosine_means(a, b, 3))
