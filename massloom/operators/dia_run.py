"""The DIA analysis from spectra to a filtered table of matches with features.

Candidates belong to isolation windows, not to scans: each distinct (window, charge) meets the index once, by an
overlap join. Scans are then scored, and what a match needs around it (its window's neighbouring scans and their
MS1 scans) is one grouped pass over blocks of acquisition cycles with a few halo cycles, so that neither a file nor a window comes to one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.sequence import PROTON
from massloom.operators import search as S
from massloom.operators.dia import choose_weights, denoise, ensemble_filter, ensemble_score, isolation_gap
from massloom.operators.joins import asof_join, overlap_join
from massloom.operators.ranking import delta_scores, robust_scale, tailor_scores, top_n
from massloom.session import written

#: Cycles of a block of the grouped pass; ``side`` more stand on either side of it.
CYCLES = 16
#: Fixed values of the MS1 rank fit: the most intense peaks left out, and how many peaks a scan needs and gives at most.
FIT_SKIP, FIT_PEAKS, FIT_SHARE = 20, 500, 0.2
FEATURES = ("precursor_m0", "precursor_m1", "precursor_m2", "rank_m0", "rank_m1", "rank_m2", "coelute_ms1", "coelute_ms2", "coelute_ms1_ms2", "fragment_p", "fragment_match")


def with_cycles(spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(MS1, MS2) spectra with ``cycle``, the number of the last MS1 scan of the file, and MS2 with ``ms1_scan``; MS2 scans before any MS1 go."""
    ms1 = spectra.where("ms_level = 1")
    number = ms1.select("file", "scan").withColumn("cycle", F.row_number().over(Window.partitionBy("file").orderBy("scan")))
    ms1 = ms1.join(number, ["file", "scan"])
    marks = number.select("file", F.col("scan").alias("ms1_scan"), "cycle")
    placed = asof_join(spectra.where("ms_level = 2").select("file", "scan"), marks, ["file"], "scan", "ms1_scan", ["ms1_scan", "cycle"]).where("cycle is not null")
    return ms1, spectra.where("ms_level = 2").join(placed, ["file", "scan"])


def with_windows(ms2: DataFrame) -> DataFrame:
    """Append ``win_lo`` and ``win_hi``: the isolation window in m/z, the file's mean gap of precursors wide where it is not given."""
    gap = isolation_gap(ms2, ["file"], "precursor_mz")
    rows = ms2.join(F.broadcast(gap), "file")  # one row for each file
    given = F.col("iso_hi") - F.col("iso_lo")
    half = F.when(F.coalesce(given, F.lit(0.0)) > 1e-9, F.abs(given)).otherwise(F.coalesce("gap", F.lit(0.0))) / 2
    return rows.withColumn("win_lo", F.col("precursor_mz") - half).withColumn("win_hi", F.col("precursor_mz") + half).drop("gap")


def window_candidates(ms2: DataFrame, index: DataFrame, charges: tuple[int, int] = (2, 3), isotopes: tuple[int, ...] = (0,), tolerance: float = 0.0) -> DataFrame:
    """(win_lo, win_hi, charge, index columns): peptides whose precursor of that charge may lie in an isolation window.

    Windows repeat from cycle to cycle, so they are made distinct first. ``isotopes`` shifts the window by whole units of mass; ``tolerance`` widens a
    peptide to an interval of that many ppm on either side.
    """
    windows = ms2.select("win_lo", "win_hi").distinct().withColumn("charge", F.explode(F.sequence(F.lit(charges[0]), F.lit(charges[1]))))
    shift = F.explode(F.array(*map(F.lit, isotopes)))
    asked = windows.withColumn("__k", shift).withColumn("__lo", (F.col("win_lo") - PROTON) * F.col("charge") + F.col("__k") * S.UNIT_WIDTH).withColumn("__hi", (F.col("win_hi") - PROTON) * F.col("charge") + F.col("__k") * S.UNIT_WIDTH)
    wide = index.withColumn("__a", F.col("mass") * (1 - tolerance / 1e6)).withColumn("__b", F.col("mass") * (1 + tolerance / 1e6))
    found = overlap_join(wide, asked, "__a", "__b", "__lo", "__hi").drop("__a", "__b", "__lo", "__hi", "__k")
    return found.dropDuplicates(["win_lo", "win_hi", "charge", "mod_sequence", "is_decoy"]) if len(isotopes) > 1 else found


def nearest(mz: np.ndarray, value: np.ndarray, asked: np.ndarray, ppm: float, missing: float = 0.0) -> np.ndarray:
    """Value of the peak nearest to each asked m/z, ``missing`` where it is over ``ppm`` away; ``mz`` ascends."""
    if not len(mz):
        return np.full(len(asked), missing)
    right = np.clip(np.searchsorted(mz, asked), 0, len(mz) - 1)
    left = np.maximum(right - 1, 0)
    at = np.where(np.abs(mz[left] - asked) <= np.abs(mz[right] - asked), left, right)
    far = np.abs(mz[at] - asked) * 1e6 / np.maximum(mz[at], asked) > ppm
    return np.where(far, missing, value[at])


def rank_fit(intensity: np.ndarray) -> tuple[float, float] | None:
    """(slope, intercept) of the log rank on the log intensity below the strongest peaks; none for a scan of few peaks."""
    n = len(intensity)
    if n < FIT_PEAKS:
        return None
    take = min(FIT_PEAKS, int((n - FIT_SKIP) * FIT_SHARE))
    x = np.log1p(np.sort(intensity)[::-1])[FIT_SKIP : FIT_SKIP + take]
    y = np.log1p(np.arange(FIT_SKIP, FIT_SKIP + take))
    spread = ((x - x.mean()) ** 2).sum()
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread > 0 else 0.0
    return slope, float(y.mean() - slope * x.mean())


def cosine_means(ms1: np.ndarray, ms2: np.ndarray, best: int) -> tuple[float, float, float]:
    """Mean of the ``best`` cosines between traces (rows) within MS1, within MS2, and of the first MS1 trace with MS2; missing ones are 0."""

    def unit(t: np.ndarray) -> np.ndarray:
        size = np.sqrt((t**2).sum(axis=1, keepdims=True))
        return np.divide(t, size, out=np.zeros_like(t), where=size > 0)

    def mean(values: np.ndarray) -> float:
        return float(np.sort(values)[::-1][:best].sum() / best)

    a, b = unit(ms1), unit(ms2)
    inside = [mean((x @ x.T)[np.triu_indices(len(x), 1)]) for x in (a, b)]
    return inside[0], inside[1], mean(b @ a[0]) if len(a) else 0.0


def fragment_scores(evidence: np.ndarray, ions: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(-ln of the binomial chance of so many matched bins, ln(n!) and ln(1 + sum of squares) of b and of y) on a spectrum's cleaned bins."""
    lit = np.flatnonzero(evidence > 0)
    if not len(lit):
        return 0.0, 0.0
    cover = len(lit) / (lit[-1] - lit[0] + 1)
    seen = lambda bins: evidence[bins[bins < len(evidence)]]
    n, k = len(ions), int((seen(ions) > 0).sum())
    chance = 0.0
    if 0 < cover < 1 and k:
        j = np.arange(k, n + 1)
        lg = np.vectorize(math.lgamma)
        logs = lg(n + 1.0) - lg(j + 1.0) - lg(n - j + 1.0) + j * math.log(cover) + (n - j) * math.log1p(-cover)
        chance = -float(logs.max() + np.log(np.exp(logs - logs.max()).sum()))
    match = 0.0
    for series in (b, y):
        got = seen(series)
        got = got[got > 0]
        match += math.lgamma(1.0 + len(got)) + math.log1p(float((got**2).sum()))
    return max(chance, 0.0), match


def around_matches(psms: DataFrame, ms1: DataFrame, ms2: DataFrame, side: int = 2, best: int = 3, precursor_ppm: float = 20.0, fragment_ppm: float = 20.0, static: dict[str, float] | None = None) -> DataFrame:
    """Append ``FEATURES`` to matches: intensities and ranks of the precursor in MS1, co-elution over ``side`` cycles on either side, fragment scores.

    ``psms`` has file, scan, cycle, charge, win_lo, win_hi, precursor_mz, sequence, mods, mass; ``ms1`` and ``ms2`` have cycle, mz, intensity. Blocks of
    ``CYCLES`` cycles are grouped with their matches; spectra near a block's edge go to both blocks.
    """
    static = dict(static or {})
    block = lambda c: F.floor((c - 1) / CYCLES).cast("int")
    reach = F.array_distinct(F.array(block(F.col("cycle") - side), block(F.col("cycle")), block(F.col("cycle") + side)))
    columns = ["file", "cycle", "scan", "win_lo", "win_hi", "mz", "intensity"]
    one = ms1.select(*(F.lit(None).cast("double").alias(c) if c.startswith("win") else c for c in columns))
    peaks = one.unionByName(ms2.select(*columns)).withColumn("block", F.explode(reach))
    names = [f.name for f in psms.schema.fields]
    rows = psms.withColumn("block", block(F.col("cycle")))
    schema = T.StructType([*psms.schema.fields, *(T.StructField(c, T.DoubleType()) for c in FEATURES)])

    def run(matches: pd.DataFrame, scans: pd.DataFrame) -> pd.DataFrame:
        if not len(matches):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in [*names, *FEATURES]})
        first, second, fits, steps = {}, {}, {}, {}
        for r in scans.itertuples():
            mz, intensity = np.asarray(r.mz, dtype=float), np.asarray(r.intensity, dtype=float)
            order = np.argsort(mz, kind="stable")
            mz, intensity = mz[order], intensity[order]
            if np.isnan(r.win_lo):
                down = np.sort(intensity)
                # ln(1 + peaks at least as intense)
                first[r.cycle] = mz, intensity, np.log1p(len(down) - np.searchsorted(down, intensity, side="left"))
            else:
                second[r.cycle, r.win_lo, r.win_hi] = mz, intensity
        out = []
        for r in matches.itertuples():
            n = len(r.sequence)
            masses = np.array([S.RESIDUE_MASS.get(c, math.nan) + static.get(c, 0.0) for c in r.sequence])
            for m in r.mods if r.mods is not None else ():
                masses[m["place"]] += m["delta"]
            b = np.cumsum(masses)[: n - 1] + PROTON
            y = masses.sum() - np.cumsum(masses)[: n - 1] + S.WATER + PROTON
            mono = r.mass / r.charge + PROTON
            asked = mono + np.arange(3) / r.charge
            mz, intensity, rank = first.get(r.cycle, (np.zeros(0),) * 3)
            if r.cycle not in fits:
                fits[r.cycle] = rank_fit(intensity)
            slope, intercept = fits[r.cycle] or (0.0, 0.0)
            own = nearest(mz, intensity, asked, precursor_ppm)
            ranks = nearest(mz, rank, asked, precursor_ppm, math.log1p(len(mz)))
            cycles = [c for c in range(r.cycle - side, r.cycle + side + 1) if c in first and (c, r.win_lo, r.win_hi) in second]
            ions = np.concatenate([b, y])
            ions = ions[np.isfinite(ions)]
            up = np.array([nearest(*first[c][:2], asked, precursor_ppm) for c in cycles]).reshape(len(cycles), 3).T
            down = np.array([nearest(*second[c, r.win_lo, r.win_hi], ions, fragment_ppm) for c in cycles]).reshape(len(cycles), len(ions)).T
            near = cosine_means(up, down, best)
            at = r.cycle, r.win_lo, r.win_hi
            if (at, r.charge) not in steps:
                steps[at, r.charge] = S.preprocess(*second[at], r.precursor_mz, r.charge, stop_after="ten-bin") / S.TOP
            bins = lambda x: np.unique(S.bins_of(x[np.isfinite(x)]))
            chance, match = fragment_scores(steps[at, r.charge], bins(ions), bins(b), bins(y))
            out.append([*(slope * np.log1p(own) + intercept), *ranks, *near, chance, match])
        return pd.concat([matches[names].reset_index(drop=True), pd.DataFrame(out, columns=list(FEATURES))], axis=1)

    return rows.groupBy("file", "block").cogroup(peaks.groupBy("file", "block")).applyInPandas(run, schema)


def predicted_share(predicted: DataFrame, parts: int = 101) -> DataFrame:
    """(sequence, share): where a predicted retention time lies between the least and the greatest one, in steps of 1 / parts."""
    ends = predicted.agg(F.min("predicted_rt").alias("lo"), F.max("predicted_rt").alias("hi")).first()
    step = ((ends.hi or 0.0) - (ends.lo or 0.0)) / (parts - 1)
    place = F.floor((F.col("predicted_rt") - (ends.lo or 0.0)) / step + 1e-9) + 1 if step > 0 else F.lit(parts)
    return predicted.groupBy("sequence").agg(F.max("predicted_rt").alias("predicted_rt")).select("sequence", (F.least(place, F.lit(parts)) / parts).alias("share"))


def dia_matches(
    spectra: DataFrame, index: DataFrame, predicted: DataFrame | None = None, charges: tuple[int, int] = (2, 3), isotopes: tuple[int, ...] = (0,), top_match: int = 5, clean: bool = False,
    side: int = 2, best: int = 3, precursor_ppm: float = 20.0, fragment_ppm: float = 20.0, static: dict[str, float] | None = None,
) -> DataFrame:
    """The ``top_match`` matches of every MS2 spectrum and charge, targets and decoys apart, with all features.

    ``spectra`` is what the readers give, MS1 and MS2 together; ``clean`` keeps MS2 peaks that the neighbouring scans of the window confirm. ``predicted`` has
    sequence and predicted_rt; without it the retention time difference is 0.
    """
    ms1, ms2 = with_cycles(spectra)
    ms2 = with_windows(ms2)
    if clean:
        kept = ms2.select("file", "scan", "win_lo", "win_hi", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("file", "scan", "win_lo", "win_hi", "p.*")
        good = denoise(kept, ["file", "win_lo", "win_hi"], "scan", "mz", fragment_ppm)
        lists = good.groupBy("file", "scan").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
        ms2 = ms2.drop("mz", "intensity").join(lists, ["file", "scan"]).withColumn("mz", F.transform("p", lambda x: x["mz"])).withColumn("intensity", F.transform("p", lambda x: x["intensity"])).drop("p")
    ms1, ms2 = written(ms1, "ms1"), written(ms2, "ms2")
    found = written(window_candidates(ms2, index, charges, isotopes), "window-candidates")
    asked = ms2.withColumn("charge", F.explode(F.sequence(F.lit(charges[0]), F.lit(charges[1]))))
    asked = asked.withColumn("spec_id", F.xxhash64("file", "scan", "charge")).withColumn("neutral_mass", (F.col("precursor_mz") - PROTON) * F.col("charge"))
    pairs = found.join(asked.select("spec_id", "win_lo", "win_hi", "charge"), ["win_lo", "win_hi", "charge"]).drop("win_lo", "win_hi", "charge")
    scored = S.score_candidates(asked, pairs, static)
    by, tie = ["spec_id", "is_decoy"], ["mod_sequence"]
    rows = delta_scores(tailor_scores(scored, by, "xcorr score", tie, out="tailor score"), by, "xcorr score", top_match, tie)
    rows = top_n(rows, by, "xcorr score", top_match, tie, out="xcorr rank")
    last = Window.partitionBy("file")
    scans = asked.select("spec_id", "file", "scan", "cycle", "charge", "win_lo", "win_hi", "precursor_mz", ((F.col("rt") - F.min("rt").over(last)) / F.greatest(F.max("rt").over(last) - F.min("rt").over(last), F.lit(1e-9))).alias("rt_share"))
    psms = written(rows.join(scans, "spec_id"), "dia-matches")
    out = around_matches(psms, ms1, ms2, side, best, precursor_ppm, fragment_ppm, static)
    if predicted is None:
        return out.withColumn("rt_diff", F.lit(0.0))
    shares = predicted_share(predicted)
    return out.join(shares, "sequence", "left").withColumn("rt_diff", F.coalesce(F.abs(F.col("rt_share") - F.col("share")), F.lit(0.0))).drop("share")


#: Columns of the ensemble score: tailor, difference of retention times, precursor, fragments, elution.
PARTS = ("tailor score", "rt_diff", "precursor", "fragment_p", "elution")


def dia_run(spectra: DataFrame, index: DataFrame, predicted: DataFrame | None = None, weights: tuple[float, ...] | None = (1.0,) * 5, keep_all: bool = False, **options) -> DataFrame:
    """``dia_matches`` with features scaled to their quantiles, ``ensemble score``, and the filter by it.

    Of a spectrum and kind, matches stay that reach the ensemble score of the best one by XCorr. ``weights`` of None are chosen by how many peptides
    they accept.
    """
    rows = dia_matches(spectra, index, predicted, **options)
    rows = rows.withColumn("precursor", F.col("precursor_m0") + F.col("precursor_m1") + F.col("precursor_m2")).withColumn("elution", F.col("coelute_ms1") + F.col("coelute_ms2") + F.col("coelute_ms1_ms2"))
    rows = written(rows, "dia-features")
    scaled = robust_scale(rows.withColumnsRenamed({"tailor score": "tailor_score"}), ["tailor_score", *PARTS[1:]]).withColumnsRenamed({"tailor_score": "tailor score"})
    scaled = written(scaled, "dia-scaled")
    parts = [_plain(c) for c in PARTS]
    if weights is None:
        weights = choose_weights(scaled.withColumnRenamed("tailor score", "tailor_score"), ["tailor_score", *PARTS[1:]], ["sequence"], F.col("is_decoy"))
    out = scaled.withColumn("ensemble score", ensemble_score(*parts, weights=tuple(weights)))
    return out if keep_all else ensemble_filter(out, ["spec_id", "is_decoy"], "ensemble score", [F.col("`xcorr rank`")])


def _plain(name: str) -> Column:
    return F.col(f"`{name}`")
