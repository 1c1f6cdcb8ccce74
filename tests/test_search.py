"""Scoring, search, localisation and cascade on made spectra."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON, RESIDUE_MASS, WATER
from massloom.operators import digestion, search
from massloom.sources.spectra import spectrum_charges

PROTEINS = [("p1", "MKAGDEFLLKVVNSTRPEEPTIDEKGGHWLLAAKSSTTYYRAADDFFK"), ("p2", "LLNNQQWWKAEDGGTTSSRVVLLIIKPPGGHHEEK")]


def ions(seq, charge=1):
    m = np.array([RESIDUE_MASS[c] for c in seq])
    b = np.cumsum(m)[:-1]
    return np.sort(np.concatenate([b, m.sum() - b + WATER]) / charge + PROTON)


def mass(seq):
    return sum(RESIDUE_MASS[c] for c in seq) + WATER


def spectrum(scan, seq, shift=0.0):
    mz = ions(seq)
    m = mass(seq) + shift
    return ("f", scan, 2, m / 2 + PROTON, 1.0, [(2, m + PROTON)], None, None, mz.tolist(), np.linspace(50, 100, len(mz)).tolist())


SCHEMA = "file string, scan int, ms_level int, precursor_mz double, rt double, zstates array<struct<charge:int,mh:double>>, iso_lo double, iso_hi double, mz array<double>, intensity array<double>"


def test_preprocess_steps():
    mz, i = np.array([100.0, 100.001, 300.0, 500.0, 5000.0]), np.array([4.0, 9.0, 100.0, 0.01, 900.0])
    root = search.preprocess(mz, i, 500.0, 2, stop_after="square-root")
    at = search.bins_of(mz)
    assert root[at[0]] == 3 and root[at[2]] == 10 and root[at[4]] == 0
    grass = search.preprocess(mz, i, 500.0, 2, stop_after="remove-grass")
    assert grass[at[3]] == 0 and grass[at[0]] == 3
    ten = search.preprocess(mz, i, 500.0, 2, stop_after="ten-bin")
    assert ten[at[0]] == ten[at[2]] == 25e6
    full = search.preprocess(mz, i, 500.0, 2)
    assert full[at[0]] == 25e6 and full[at[0] + 1] == np.trunc(-25e6 / 150)
    assert search.preprocess(mz, i, 300.0, 2, remove_precursor=1.0, stop_after="square-root")[at[2]] == 0
    assert len(search.preprocess(np.zeros(0), np.zeros(0), 1.0, 1)) == 1


def test_null_distribution_is_exact():
    seq = "GASP"
    freq = {r: 1.0 for r in "GASPV"}
    null = search.NullScores(ions(seq), np.array([5.0, 9, 3, 8, 7, 6]), mass(seq) / 2 + PROTON, 2, {}, freq)
    units = {r: int(round(RESIDUE_MASS[r] / search.UNIT_WIDTH)) for r in freq}
    total = sum(units[c] for c in seq)
    e, p, offset = null.tail(total)
    chance = {}
    for n in range(1, 7):
        for w in itertools.product(freq, repeat=n):
            cuts = np.cumsum([units[c] for c in w])
            if cuts[-1] == total:
                s = int(e[cuts[:-1]].sum())
                chance[s] = chance.get(s, 0) + len(freq) ** -n
    all_ = sum(chance.values())
    for s in chance:
        want = (sum(v for k, v in chance.items() if k > s) + chance[s] / 2) / all_
        assert abs(p[s + offset] - want) < 1e-9
    score, q = null.rate(seq, [])
    assert q == min(p[s + offset] for s in chance) or q <= 0.2


def test_combined_p(spark):
    p = spark.range(1).select(search.combined_p(F.lit(0.01)).alias("a"), search.combined_p(F.lit(1.0)).alias("b"), search.combined_p(F.lit(0.0)).alias("c")).first()
    assert 0.01 < p.a < 0.2 and p.b == 1.0 and p.c == 0.0


def test_residue_evidence_prefers_the_true_sequence():
    seq = "AGDEFLLK"
    steps = {r: int(round(RESIDUE_MASS[r] / search.UNIT_WIDTH)) for r in "AGDEFLKSTV"}
    total = sum(steps[c] for c in seq)
    m = search.residue_evidence(ions(seq), np.ones(14), total, steps, 0.05)
    right = search.residue_evidence_p(m, sorted(steps), steps, seq)
    wrong = search.residue_evidence_p(m, sorted(steps), steps, "LLKAGDEF")
    assert right[0] > wrong[0] and right[1] < 0.01 < wrong[1] + 0.01


@pytest.fixture(scope="module")
def index(spark):
    proteins = spark.createDataFrame(PROTEINS, "protein_id string, residues string")
    return digestion.build_index(proteins, mods_spec="", decoy="peptide-reverse", min_length=5)


def test_search_finds_the_peptides(spark, index):
    seqs = ["AGDEFLLK", "GGHWLLAAK", "AEDGGTTSSR"]
    rows = spark.createDataFrame([spectrum(k, s) for k, s in enumerate(seqs)], SCHEMA)
    got = search.search(spectrum_charges(rows), index, kind="mass", window=3.0, score="exact")
    best = {r.scan: r for r in got.where("not is_decoy and `xcorr rank` = 1").collect()}
    assert [best[k].sequence for k in range(3)] == seqs
    for k, s in enumerate(seqs):
        assert best[k]["b/y ions matched"] == best[k]["b/y ions total"] == len(set(search.by_bins(s, [], {}))) and best[k]["exact p-value"] < 1e-3
    assert search.search(spectrum_charges(rows.limit(0)), index, kind="mass", window=3.0).count() == 0


def by_rows(spectra, index, min_candidates, **scoring):
    """The search as rows: padded candidates, scored pair by pair, ranked by the column operators."""
    from massloom.operators.joins import mass_windows
    from massloom.operators.ranking import delta_scores, tailor_scores, top_n

    named = spectra.withColumn("spec_id", F.xxhash64("file", "scan", "charge"))
    w = mass_windows(named, "mass", 3.0).select("spec_id", F.col("windows")[0]["lo"].alias("lo"), F.col("windows")[0]["hi"].alias("hi")).collect()
    peptides = sorted(index.collect(), key=lambda r: (r.mass, r.mod_sequence, r.is_decoy))
    rows = []
    for s in w:
        mine = [p for p in peptides if s.lo <= p.mass <= s.hi]
        more = [p for p in peptides if p.mass > s.hi][: max(0, min_candidates - len(mine))] if mine else []
        rows += [(s.spec_id, p.mod_sequence, p.is_decoy, p in mine) for p in mine + more]
    pairs = named.sparkSession.createDataFrame(rows, "spec_id long, mod_sequence string, is_decoy boolean, active boolean")
    scored = search.score_candidates(named, pairs.join(index, ["mod_sequence", "is_decoy"]), **scoring)
    by, tie = ["spec_id", "is_decoy"], ["mod_sequence"]
    rated = tailor_scores(scored, by, "xcorr score", tie, out="tailor score").where("active")
    return top_n(delta_scores(rated, by, "xcorr score", 5, tie), by, "xcorr score", 5, tie, out="xcorr rank").join(named.select("spec_id", "scan", "charge"), "spec_id")


@pytest.mark.parametrize("block", [2.0, 300.0])
def test_blocks_equal_pairs(spark, index, block):
    seqs = ["AGDEFLLK", "GGHWLLAAK", "AEDGGTTSSR", "VVNSTRPEEPTIDEK"]
    rows = spectrum_charges(spark.createDataFrame([spectrum(k, s, shift=0.3 * k) for k, s in enumerate(seqs)], SCHEMA), (2, 3))
    rows = rows.unionByName(rows.withColumn("charge", F.lit(3)).withColumn("scan", F.col("scan") + 10))
    columns = ["scan", "charge", "is_decoy", "mod_sequence", "xcorr rank", "b/y ions matched", "b/y ions total", "b/y ion repeat match", "xcorr score", "tailor score", "delta_cn", "delta_lcn", "exact p-value"]
    for least in (30, 0):
        want = by_rows(rows, index, least).withColumn("exact p-value", F.lit(0.0))
        got = search.search(rows, index, kind="mass", window=3.0, min_candidates=least, block=block).withColumn("exact p-value", F.lit(0.0))
        view = lambda df: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
        assert view(got) == view(want) and got.count() > 0


def test_p_values_of_blocks_equal_single_ones(spark, index):
    seqs = ["AGDEFLLK", "GGHWLLAAK"]
    rows = spectrum_charges(spark.createDataFrame([spectrum(k, s) for k, s in enumerate(seqs)], SCHEMA))
    got = search.search(rows, index, kind="mass", window=20.0, score="combined", tolerance=0.05).collect()
    assert {r.scan for r in got if not r.is_decoy and r["xcorr rank"] == 1 and r.sequence == seqs[r.scan]} == {0, 1}
    from massloom.operators.massblocks import _frequencies

    weights = _frequencies(index)
    steps = {r: int(round(RESIDUE_MASS[r] / search.UNIT_WIDTH)) for r in weights}
    for r in got:
        one = spectrum(r.scan, seqs[r.scan])
        mz, intensity = np.array(one[8]), np.array(one[9])
        null = search.NullScores(mz, intensity, one[3], 2, {}, weights)
        score, p = null.rate(r.sequence, [])
        assert abs(r["refactored xcorr"] - score) < 1e-9 and abs(r["exact p-value"] - p) < 1e-12
        unit = sum(steps[c] for c in r.sequence)
        grid = np.round(search.residue_evidence(mz, intensity, unit, steps, 0.05) * 10).astype(int)
        ends = np.cumsum([steps[c] for c in r.sequence])
        s = sum(int(grid[sorted(steps).index(c), e]) for c, e in zip(r.sequence, ends))
        q = float(search.residue_tail(grid, sorted(steps), steps, weights)[s])
        assert abs(r["res-ev score"] - s / 10) < 1e-9 and abs(r["res-ev p-value"] - q) < 1e-12
        want = spark.range(1).select(search.combined_p(F.lit(p * q))).first()[0] if q > 0 else p
        assert abs(r["combined p-value"] - want) < 1e-12
    with pytest.raises(ValueError):
        search.search(rows, index, score="none")


def test_residue_tail_counts_all_sequences():
    steps = {"A": 1, "B": 2, "C": 3}
    grid = np.random.default_rng(1).integers(0, 4, (3, 8))
    weights = {"A": 2.0, "B": 1.0, "C": 1.0}
    chance = {}
    for n in range(1, 8):
        for w in itertools.product("ABC", repeat=n):
            ends = np.cumsum([steps[c] for c in w])
            if ends[-1] == 7:
                s = sum(grid["ABC".index(c), e] for c, e in zip(w, ends))
                chance[s] = chance.get(s, 0) + float(np.prod([weights[c] / 4 for c in w]))
    tail = search.residue_tail(grid, list("ABC"), steps, weights)
    for s in chance:
        assert abs(tail[s] - sum(v for k, v in chance.items() if k >= s) / sum(chance.values())) < 1e-12


def test_localize(spark, index):
    seq, shift = "AGDEFLLK", 79.97
    m = np.array([RESIDUE_MASS[c] for c in seq])
    m[3] += shift
    b = np.cumsum(m)[:-1]
    mz = np.sort(np.concatenate([b, m.sum() - b + WATER]) + PROTON)
    spec = spark.createDataFrame([(1, 2, float((m.sum() + WATER) / 2 + PROTON), float(m.sum() + WATER), mz.tolist(), [10.0] * len(mz))], "spec_id long, charge int, precursor_mz double, neutral_mass double, mz array<double>, intensity array<double>")
    psms = spark.createDataFrame([(1, seq, None, mass(seq))], "spec_id long, sequence string, mods array<struct<place:int,delta:double>>, mass double")
    assert search.localize(psms, spec).first().place == 3


def test_cascade_takes_spectra_out(spark, index):
    rows = spark.createDataFrame([spectrum(k, s) for k, s in enumerate(["AGDEFLLK", "GGHWLLAAK", "AEDGGTTSSR"])], SCHEMA)
    got = search.cascade(spectrum_charges(rows), [index, index], termination=0, q_limit=1.0, kind="mass", window=3.0)
    assert sorted(r.scan for r in got.collect()) == [0, 1, 2] and {r["round"] for r in got.collect()} == {0}


def test_decoys_take_all_attempts(spark):
    ends = [a + b for a in "CDEFGHIKLM" for b in "CDEFGHIKLM"]
    peptides = spark.createDataFrame([(e[0] + "AAB" + e[1],) for e in ends], "sequence string")
    for kind in ("shuffle", "reverse"):
        made = digestion.make_decoys(peptides, kind).collect()
        assert len(made) >= 98  # each try keeps the order in one of three cases
        assert all(sorted(r.decoy) == sorted(r.sequence) and r.decoy != r.sequence for r in made)


def test_peaks_of_many_spectra_equal_the_bins_of_each():
    rng = np.random.default_rng(11)
    made = [(rng.uniform(50, 1500, n), rng.uniform(0, 9, n) * (rng.random(n) < 0.9), float(rng.uniform(100, 800)), int(rng.integers(1, 4))) for n in [0, 1, 3, 40, 200, 0, 7, 500]]
    made += [(np.full(3, 700.0), np.ones(3), 100.0, 1), (np.array([100.0, 100.001, 101.0]), np.zeros(3), 300.0, 2)]
    owner = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
    got = search.ten_bin_peaks(owner, np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.array([m[2] for m in made]), np.array([m[3] for m in made]))
    for k, (mz, intensity, precursor, charge) in enumerate(made):
        want = search.preprocess(mz, intensity, precursor, charge, stop_after="ten-bin")
        mine = got[0] == k
        assert got[1][mine].tolist() == np.flatnonzero(want).tolist() and got[2][mine].tolist() == want[np.flatnonzero(want)].tolist()


def test_search_query_carries_no_places_of_peptides(spark):
    from massloom.plans import contract_search  # noqa: F401
    from massloom.plans.contract import QUERIES

    # places of a peptide in all its proteins went to every block and into every match
    plan = QUERIES["search_xcorr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "locations" not in plan and "collect_set" not in plan
