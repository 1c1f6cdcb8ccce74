"""Features, inference, DIA scores, whole analyses and streams."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions.sequence import NEUTRON, PROTON
from massloom.operators import dia, features, inference
from massloom.plans import pipelines
from massloom.streaming import incoming
from tests.test_search import PROTEINS, SCHEMA, spectrum


def pattern(mass, z, height):
    p = features.averagine_pattern(mass)
    return [(mass / z + PROTON + k * NEUTRON / z, height * a) for k, a in enumerate(p)]


def test_centroid_and_smoothing():
    x = np.linspace(0, 10, 101)
    y = np.exp(-((x - 5.03) ** 2)) * 10
    mz, i = centroid = features.centroid(x, y)
    assert len(mz) == 1 and abs(mz[0] - 5.03) < 1e-2 and abs(i[0] - 10) < 0.01 and centroid
    assert np.allclose(features.savitzky_golay(x**2)[4:-4], (x**2)[4:-4])


def test_features_are_found_and_traced(spark):
    scans = []
    for k in range(6):
        peaks = sorted(pattern(1500.0, 2, 100.0 + 10 * k if k != 3 else 0.0) + pattern(2100.0, 3, 50.0)) if k < 5 else [(400.0, 1.0)]
        peaks = [p for p in peaks if p[1] > 0]
        scans.append(("f", k + 1, 1, None, 60.0 * k, [], None, None, [float(p[0]) for p in peaks], [float(p[1]) for p in peaks]))
    ms2 = [("f", 50, 2, 1500.0 / 2 + PROTON, 130.0, [], None, None, [100.0], [1.0]), ("f", 51, 2, 900.0, 130.0, [], None, None, [100.0], [1.0])]
    spectra = spark.createDataFrame(scans + ms2, SCHEMA)
    found = features.detect_features(spectra)
    got = {(r.scan, r.charge, round(r.mono_mass, 2)) for r in found.collect()}
    assert {(1, 2, 1500.0), (1, 3, 2100.0), (5, 2, 1500.0)} <= got and (4, 2, 1500.0) not in got
    traces = {r.charge: r for r in features.trace_features(found).collect()}
    assert set(traces) == {2, 3} and traces[2].n_scans == 4 and traces[3].n_scans == 5 and traces[2].apex_rt == 4.0
    matched, rest = pipelines.assign_features(spectra)
    assert [(r.scan, r.zstates[0].charge) for r in matched.collect()] == [(50, 2)] and [r.scan for r in rest.collect()] == [51]
    assert features.drop_contaminants(features.trace_features(found), 1.0).count() == 0


def test_normal_uniform_fit():
    rng = np.random.default_rng(0)
    d = np.concatenate([rng.normal(1.0, 2.0, 4000), rng.uniform(-50, 50, 1000)])
    mu, sigma = inference.fit_normal_uniform(d)
    assert abs(mu - 1) < 0.2 and abs(sigma - 2) < 0.2


def test_mass_errors_and_detectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        group = k // 2
        base = np.random.default_rng(group).uniform(200, 1200, 30)
        mz = np.sort(np.append(base * (1 + rng.normal(0, 5e-6, 30)), list(inference.REPORTERS["iTRAQ 4-plex"])))
        precursor = (500 + group * 1.1) * (1 + rng.normal(0, 4e-6))
        rows.append(("f", k, 2, float(precursor), 2, [float(x) for x in mz], [100.0] * 34))
    spectra = spark.createDataFrame(rows, "file string, scan int, ms_level int, precursor_mz double, charge int, mz array<double>, intensity array<double>")
    got = inference.mass_errors(spectra, least_pairs=100)
    assert 2 < got["precursor_sigma"] < 6 and 3 < got["fragment_sigma"] < 7 and got["precursor_ppm"] == pytest.approx(got["precursor_sigma"] * inference.PRECURSOR_FACTOR)
    assert inference.mass_errors(spectra.limit(10))["precursor_ppm"] is None
    kits = inference.reporter_ions(spectra)
    assert kits["iTRAQ 4-plex"] and not kits["TMT 6-plex"]
    assert abs(inference.phospho_score(spectra)["share"]) <= 1 and set(inference.silac_labels(spectra)) == set(inference.SILAC)


def test_fragment_scores(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "b", 2.0), (1, "y", 1.0)], "psm long, ion string, intensity double")
    assert dia.static_fragment_score(rows, ["psm"]).first().static_fragment == pytest.approx(math.log(2) + math.log(6) + math.log(2))
    d = spark.createDataFrame([(10, 3, 0.1), (10, 0, 0.1)], "n int, k int, p double")
    got = [r.dynamic_fragment for r in dia.dynamic_fragment_score(d, "n", "k", "p").orderBy(F.desc("k")).collect()]
    tail = sum(math.comb(10, j) * 0.1**j * 0.9 ** (10 - j) for j in range(3, 11))
    assert got[0] == pytest.approx(-math.log(tail)) and got[1] == 0


def test_fragment_scores_of_many_trials(spark):
    began = time.monotonic()
    rows = spark.range(20_000).select(F.lit(400).alias("n"), (F.col("id") % 300 + 1).cast("int").alias("k"), (F.lit(0.001) + F.col("id") * 1e-5).alias("p"))
    odd = spark.createDataFrame([(5, 6, 0.1), (5, 5, 0.0), (None, 1, 0.5), (5, None, 0.5)], "n int, k int, p double")
    got = {(r.n, r.k, r.p): r.dynamic_fragment for r in dia.dynamic_fragment_score(rows.unionByName(odd), "n", "k", "p").collect()}
    # every term by lambdas took minutes
    assert time.monotonic() - began < 40
    for (n, k, p), score in [x for x in got.items() if x[0][0] == 400][::997]:
        a, b = p.as_integer_ratio()
        tail = sum(math.comb(n, j) * a**j * (b - a) ** (n - j) for j in range(k, n + 1))
        assert score == pytest.approx(n * math.log(b) - math.log(tail), rel=1e-8, abs=1e-8)
    assert got[(5, 5, 0.0)] == pytest.approx(-5 * math.log(1e-12)) and got[(5, None, 0.5)] == 0
    assert [got[k] for k in ((5, 6, 0.1), (None, 1, 0.5))] == [None, None]


def test_weights_are_chosen(spark):
    rng = np.random.default_rng(2)
    rows = [(i, bool(i % 2), float(rng.normal()), 0.0, 0.0, float(rng.normal() + (4 if i % 2 == 0 else 0)), 0.0) for i in range(200)]
    psms = spark.createDataFrame(rows, "peptide long, is_decoy boolean, tailor double, rt double, prec double, frag double, elu double")
    w = dia.choose_weights(psms, ["tailor", "rt", "prec", "frag", "elu"], ["peptide"], F.col("is_decoy"), grid=(1.0, 4.0), limit=0.1)
    assert w[3] == 4.0 and dia.targets_at(psms, "frag", ["peptide"], F.col("is_decoy"), 0.1) > 50


def test_whole_run_and_confidence(spark, tmp_path):
    (tmp_path / "p.fasta").write_text("".join(f">{n} x\n{s}\n" for n, s in PROTEINS))
    spark.createDataFrame([spectrum(k, s) for k, s in enumerate(["AGDEFLLK", "GGHWLLAAK", "AEDGGTTSSR"])], SCHEMA).write.parquet(str(tmp_path / "s.parquet"))
    got = pipelines.run_all(spark, str(tmp_path / "s.parquet"), str(tmp_path / "p.fasta"), str(tmp_path / "index"), q_limit=1.0, index_options={"mods_spec": "", "decoy": "peptide-reverse", "min_length": 5}, search_options={"kind": "mass", "window": 3.0, "min_peaks": 1})
    assert sorted(r.sequence for r in got["confidence"].collect()) == ["AEDGGTTSSR", "AGDEFLLK", "GGHWLLAAK"]
    counts = {r.protein: r.score for r in got["counts"].collect()}
    assert set(counts) == {"p1", "p2"} and sum(counts.values()) == pytest.approx(1)
    proteins = spark.createDataFrame(PROTEINS, "protein_id string, residues string")
    assert pipelines.spectral_counts(got["confidence"], proteins, "EMPAI", None).count() == 2
    with pytest.raises(ValueError):
        pipelines.spectral_counts(got["confidence"], proteins, "X")
    peptides = pipelines.generate_peptides(proteins, decoy="peptide-reverse")
    assert peptides.where("not is_decoy and sequence = 'AGDEFLLK'").count() == 1 and peptides.where("is_decoy and protein_ids like 'decoy_%'").count() > 0


def stream_of(spark, tmp_path):
    for k, seq in enumerate(["AGDEFLLK", "GGHWLLAAK", "AGDEFLLK"]):
        spark.createDataFrame([spectrum(k, seq)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return incoming.read_incoming(spark, str(tmp_path / "in"))


def test_incoming_spectra_are_searched(spark, tmp_path):
    from massloom.operators import digestion

    digestion.build_index(spark.createDataFrame(PROTEINS, "protein_id string, residues string"), mods_spec="", decoy="none", min_length=5).write.parquet(str(tmp_path / "index"))
    query = incoming.search_incoming(stream_of(spark, tmp_path), spark.read.parquet(str(tmp_path / "index")), str(tmp_path / "out"), str(tmp_path / "c1"), available_now=True, kind="mass", window=3.0)
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("`xcorr rank` = 1").count() == 3


def test_arrivals_are_counted(spark, tmp_path):
    timed = stream_of(spark, tmp_path).withColumn("arrived", F.timestamp_seconds(F.col("scan") * 40))
    query = incoming.arrival_counts(timed).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c3")).outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("select * from arrivals").collect()) == [1, 2]


def test_previous_spectrum_of_a_bin(spark, tmp_path):
    query = incoming.previous_in_bin(stream_of(spark, tmp_path)).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start()
    try:
        for _ in range(60):
            found = [(r.scan, r.prev_scan) for r in spark.sql("select * from pairs").collect()]
            if found:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert found == [(2, 0)]


def test_mix_max_estimates_the_null_share(spark):
    null = [(k + 0.5) / 1000 for k in range(1000)]
    rows = [(k, p, 1 - p, True) for k, p in enumerate(null)]
    rows += [(k, p, 1 - p, False) for k, p in enumerate([null[i] + 1e-4 for i in range(1000) if i % 10 < 3] + [1e-6 * (k + 1) for k in range(700)])]
    matches = spark.createDataFrame(rows, "scan int, `exact p-value` double, `xcorr score` double, is_decoy boolean")
    for score in ("exact p-value", "xcorr score"):
        got, want, half = ({r.scan: r["mix-max q-value"] for r in pipelines.assign_confidence(matches, "mix-max", score, pi0=x).collect()} for x in (None, 0.3, 0.5))
        assert max(abs(got[k] - want[k]) for k in want) < 0.01 < max(abs(half[k] - want[k]) for k in want)


def test_traces_cross_slice_edges(spark):
    rows = [("f", s, s / 10, 1000.0 + (0.002 if s % 2 else -0.002), 2, 10.0 + s, 500.0, 0.9) for s in range(4)]
    found = spark.createDataFrame(rows, "file string, scan int, rt double, mono_mass double, charge int, intensity double, base_peak double, correlation double")
    assert [r.n_scans for r in features.trace_features(found).collect()] == [4]
