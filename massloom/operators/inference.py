"""Search parameters from the spectra themselves: mass errors, labels, reporter ions, phosphorylation.

Pairs of successive spectra of one precursor bin are found by ``lag``; their differences of precursor and of
shared fragment masses follow a normal distribution on a uniform floor, whose width is fitted on a bounded, hash-drawn sample of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON, RESIDUE_MASS, WATER

#: Fixed values of the estimator.
AVERAGINE_STEP, PRECURSOR_FACTOR, FRAGMENT_FACTOR, LEAST_PAIRS, MAX_PAIRS = 1.000495, 37.404067, 0.004274, 200, 100_000
#: Masses in Da.
SILAC = {"K+4": 4.025107, "K+6": 6.020129, "K+8": 8.014199, "R+6": 6.020129, "R+10": 10.008269}
REPORTERS = {
    "TMT 2-plex": (126.127726, 127.131081), "TMT 6-plex": (126.127726, 127.124761, 128.134436, 129.131471, 130.141145, 131.138180),
    "TMT 10-plex": (127.131081, 128.128116, 129.137790, 130.134825), "iTRAQ 4-plex": (114.11123, 115.10826, 116.11162, 117.11497), "iTRAQ 8-plex": (113.10787, 118.11201, 119.11530, 121.12200),
}
PHOSPHO_LOSS = 97.976896


def top_fragments(spectra: DataFrame, top: int = 40) -> DataFrame:
    """Append ``bins``: the ``top`` strongest fragments as (bin, mz, intensity scaled to 1), each bin once."""
    peaks = F.zip_with("mz", "intensity", lambda m, i: F.struct(i.alias("i"), m.alias("m")))
    best = F.slice(F.reverse(F.array_sort(peaks)), 1, top)
    most = F.array_max("intensity")
    return spectra.withColumn("bins", F.transform(best, lambda p: F.struct(F.floor(p["m"] / AVERAGINE_STEP).cast("int").alias("bin"), p["m"].alias("mz"), (p["i"] / most).alias("share"))))


def spectrum_pairs(spectra: DataFrame, max_ppm: float = 50.0, max_scans: int = 1000, min_common: int = 20, top: int = 40) -> DataFrame:
    """(file, charge, precursor_a, precursor_b, bins_a, bins_b) of each spectrum and the one before it in its precursor bin.

    Kept if their precursors lie within ``max_ppm``, their scans within ``max_scans``, and ``min_common`` fragment bins are in both.
    """
    mass = (F.col("precursor_mz") - PROTON) * F.col("charge")
    rows = top_fragments(spectra, top).withColumn("pbin", F.floor(mass / AVERAGINE_STEP))
    w = Window.partitionBy("file", "charge", "pbin").orderBy("scan")
    lagged = rows.select("file", "charge", "scan", "precursor_mz", "bins", F.lag(F.struct("scan", "precursor_mz", "bins")).over(w).alias("p")).where("p is not null")
    close = (F.abs(F.col("precursor_mz") - F.col("p.precursor_mz")) <= F.col("precursor_mz") * max_ppm / 1e6) & (F.col("scan") - F.col("p.scan") <= max_scans)
    common = F.size(F.array_intersect(F.transform("bins", lambda b: b["bin"]), F.transform("p.bins", lambda b: b["bin"])))
    return lagged.where(close & (common >= min_common)).select("file", "charge", "scan", F.col("p.precursor_mz").alias("precursor_a"), F.col("precursor_mz").alias("precursor_b"), F.col("p.bins").alias("bins_a"), F.col("bins").alias("bins_b"))


def fragment_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b): fragments alone in a bin on both sides of a pair."""

    def lone(side: str) -> DataFrame:
        rows = pairs.select("file", "charge", "scan", F.explode(side).alias("x")).select("file", "charge", "scan", "x.bin", "x.mz")
        return rows.groupBy("file", "charge", "scan", "bin").agg(F.count("*").alias("n"), F.first("mz").alias("mz")).where("n = 1").drop("n")

    return lone("bins_a").withColumnRenamed("mz", "a").join(lone("bins_b").withColumnRenamed("mz", "b"), ["file", "charge", "scan", "bin"]).select("a", "b")


def fit_normal_uniform(diffs: np.ndarray, rounds: int = 200, least: float = 1e-6) -> tuple[float, float]:
    """(mean, deviation) of the normal part of a normal and uniform mixture, by expectation and maximisation."""
    lo, hi = float(diffs.min()), float(diffs.max())
    width = max(hi - lo, least)
    mu, sigma, share = float(np.median(diffs)), max(float(diffs.std()) / 2, least), 0.5
    for _ in range(rounds):
        normal = share * np.exp(-0.5 * ((diffs - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))
        weight = normal / (normal + (1 - share) / width)
        total = weight.sum()
        if total < 1e-9:
            break
        m = float((weight * diffs).sum() / total)
        s = max(math.sqrt(float((weight * (diffs - m) ** 2).sum() / total)), least)
        done = abs(m - mu) < 1e-9 and abs(s - sigma) < 1e-9
        mu, sigma, share = m, s, float(total / len(diffs))
        if done:
            break
    return mu, sigma


def _drawn(pairs: DataFrame, a: str, b: str) -> np.ndarray:
    """At most ``MAX_PAIRS`` differences in ppm, the first by a hash of the pair."""
    ppm = ((F.col(b) - F.col(a)) / F.col(a) * 1e6).alias("d")
    rows = pairs.select(ppm, F.xxhash64(a, b).alias("h"), a, b).orderBy("h", a, b).limit(MAX_PAIRS).select("d")
    return rows.toPandas()["d"].to_numpy(float)


def mass_errors(spectra: DataFrame, least_pairs: int = LEAST_PAIRS, **options) -> dict[str, float | None]:
    """Suggested precursor tolerance (ppm) and fragment bin width (Da), and the errors they come from; None where pairs are too few or mostly 0."""
    from massloom.session import written

    pairs = written(spectrum_pairs(spectra, **options), "pairs")

    def sigma(diffs: np.ndarray) -> float | None:
        if len(diffs) < least_pairs or (diffs == 0).mean() > 0.5:
            return None
        return fit_normal_uniform(diffs)[1] / math.sqrt(2)

    precursor = sigma(_drawn(pairs, "precursor_a", "precursor_b"))
    fragment = sigma(_drawn(fragment_pairs(pairs), "a", "b"))
    return {"precursor_sigma": precursor, "fragment_sigma": fragment, "precursor_ppm": None if precursor is None else PRECURSOR_FACTOR * precursor, "fragment_bin": None if fragment is None else FRAGMENT_FACTOR * fragment}


def _share_at(place: Column, tolerance: float) -> Column:
    """Summed intensity within ``tolerance`` of a place, as a share of the strongest peak."""
    near = F.aggregate(F.arrays_zip("mz", "intensity"), F.lit(0.0), lambda s, p: s + F.when(F.abs(p["mz"] - place) <= tolerance, p["intensity"]).otherwise(0.0))
    return F.coalesce(near / F.nullif(F.array_max("intensity"), F.lit(0.0)), F.lit(0.0))


def reporter_ions(spectra: DataFrame, tolerance: float = 0.003, t_limit: float = 3.5) -> dict[str, bool]:
    """Which reporter sets stand out: the mean share of each ion against places 0.05 and 0.1 beside it, as a t value over spectra."""
    ions = sorted({m for ms in REPORTERS.values() for m in ms})
    asked = F.array(*map(F.lit, ions))
    beside = F.array(*(F.lit(d) for d in (-0.1, -0.05, 0.05, 0.1)))
    gaps = F.transform(asked, lambda m: _share_at(m, tolerance) - F.aggregate(F.transform(beside, lambda d: _share_at(m + d, tolerance)), F.lit(0.0), lambda s, x: s + x) / 4)
    rows = spectra.where("ms_level = 2").select(F.posexplode(gaps).alias("k", "gap"))
    seen = {r.k: r for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sd")).collect()}  # a row for each ion

    def strong(m: float) -> bool:
        r = seen.get(ions.index(m))
        return r is not None and r["mean"] > 0 and (not r.sd or r["mean"] / (r.sd / math.sqrt(r.n)) > t_limit)

    return {name: all(strong(m) for m in ms) for name, ms in REPORTERS.items()}


def phospho_score(spectra: DataFrame, tolerance: float = 0.05) -> dict[str, float]:
    """Mean share of the precursor's phosphoric acid loss against losses up to 20 Da around it, with its z value."""
    losses = [0.0, -20.0, -15.0, -10.0, -5.0, 5.0, 10.0, 15.0, 20.0]
    shares = F.transform(F.array(*map(F.lit, losses)), lambda d: _share_at(F.col("precursor_mz") - (d + PHOSPHO_LOSS) / F.col("charge"), tolerance))
    rows = spectra.where("ms_level = 2 and charge > 0").select(F.posexplode(shares).alias("k", "share"))
    mean = {r.k: r.m for r in rows.groupBy("k").agg(F.avg("share").alias("m")).collect()}  # nine rows
    base = np.array([mean.get(k, 0.0) for k in range(1, len(losses))])
    return {"share": mean.get(0, 0.0), "control": float(base.mean()), "z": (mean.get(0, 0.0) - float(base.mean())) / max(float(base.std()), 1e-6)}


def silac_counts(spectra: DataFrame, reach: int = 50) -> DataFrame:
    """(distance, n): pairs of precursors within ``reach`` scans by how many mass bins lie between them."""
    from massloom.operators.joins import scan_window_pairs

    mass = (F.col("precursor_mz") - PROTON) * F.col("charge")
    rows = spectra.where("ms_level = 2").select("file", "scan", F.round(mass / AVERAGINE_STEP).cast("long").alias("bin"))
    return scan_window_pairs(rows, ["file"], "scan", reach, "bin").groupBy("distance").agg(F.sum("n").alias("n")).where("distance <= 30")


def silac_labels(spectra: DataFrame, reach: int = 50, z_limit: float = 6.0) -> dict[str, bool]:
    """Which label distances have far more pairs than the other distances up to 30 bins (a table of 31 rows)."""
    counts = {r.distance: r.n for r in silac_counts(spectra, reach).collect()}
    marked = {round(m / AVERAGINE_STEP) for m in SILAC.values()}
    rest = np.array([counts.get(d, 0) for d in range(2, 31) if d not in marked], dtype=float)
    limit = rest.mean() + z_limit * max(rest.std(), 1.0)
    return {name: counts.get(round(m / AVERAGINE_STEP), 0) > limit for name, m in SILAC.items()}


#: Places beside a reporter ion where nothing is expected, and the losses beside the phosphoric one, in Da.
BESIDE, OTHER_LOSSES = (-0.1, -0.05, 0.05, 0.1), (-20.0, -15.0, -10.0, -5.0, 5.0, 10.0, 15.0, 20.0)
#: t values from which on a signal counts.
T_REPORTER, T_PHOSPHO, T_ENZYME = 3.5, 3.5, 2.0


def detector_places() -> list[tuple[str, str, str, float]]:
    """(detector, ion, kind, value): ``fixed`` stands at the value, ``loss`` at precursor m/z - value / charge, ``rest`` at M+H - value."""
    out = []
    for m in sorted({m for ms in REPORTERS.values() for m in ms}):
        out.append(("reporter", f"{m}", "fixed", m))
        out += [("reporter control", f"{m}{d:+}", "fixed", m + d) for d in BESIDE]
    out.append(("phospho", "0.0", "loss", PHOSPHO_LOSS))
    out += [("phospho control", f"{d}", "loss", PHOSPHO_LOSS + d) for d in OTHER_LOSSES]
    for r, m in sorted(RESIDUE_MASS.items()):
        out.append(("y1", r, "fixed", m + WATER + PROTON))
        out.append(("last b", r, "rest", m + WATER))
    return out


def detector_counts(spectra: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(detector, ion, n, total, squares): over spectra with charge, precursor_mz, mz and intensity, the intensity near each place as a share of the strongest peak.

    One pass serves all detectors: a task keeps three sums for each place and sends them once.
    """
    places = detector_places()
    kind, value = np.array([p[2] for p in places]), np.array([p[3] for p in places])

    def run(batches):
        sums = np.zeros((3, len(places)))
        for batch in batches:
            for r in batch.itertuples(index=False):
                mz, intensity = np.asarray(r.mz, dtype=float), np.asarray(r.intensity, dtype=float)
                if not len(mz) or intensity.max() <= 0:
                    continue
                order = np.argsort(mz, kind="stable")
                mz, run_ = mz[order], np.concatenate([[0], np.cumsum(intensity[order])])
                at = np.where(kind == "fixed", value, np.where(kind == "loss", r.precursor_mz - value / r.charge, (r.precursor_mz - PROTON) * r.charge + PROTON - value))
                share = (run_[np.searchsorted(mz, at + tolerance, side="right")] - run_[np.searchsorted(mz, at - tolerance, side="left")]) / intensity.max()
                sums += [np.ones(len(places)), share, share**2]
        yield pd.DataFrame({"detector": [p[0] for p in places], "ion": [p[1] for p in places], "n": sums[0].astype(int), "total": sums[1], "squares": sums[2]})

    rows = spectra.where("charge > 0").select("charge", "precursor_mz", "mz", "intensity")
    parts = rows.mapInPandas(run, "detector string, ion string, n long, total double, squares double")
    return parts.groupBy("detector", "ion").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def welch(a: tuple[float, float, float], b: tuple[float, float, float]) -> float:
    """t value of the difference of two means from (n, total, squares); 0 where either has under two values."""
    if a[0] < 2 or b[0] < 2:
        return 0.0
    mean = [x[1] / x[0] for x in (a, b)]
    spread = [max(0.0, (x[2] - x[0] * m * m) / (x[0] - 1)) / x[0] for x, m in zip((a, b), mean, strict=True)]
    gap = mean[0] - mean[1]
    return gap / math.sqrt(sum(spread)) if sum(spread) > 0 else math.copysign(math.inf, gap) if gap else 0.0


def infer_parameters(spectra: DataFrame, tolerance: float = 0.01, **pairing) -> dict:
    """What the spectra (``spectrum_charges`` rows with ms_level 2) tell of search parameters, in one run.

    ``mass_errors`` as that function gives them; ``reporters`` by set (the 10-plex only with the 6-plex, and the 6-plex alone where the 10-plex's own ions do not stand out);
    ``phospho`` and its t value; ``silac``; ``enzyme``: trypsin, lys-c, arg-c or None, from the ions that the last residue makes, each
    against all other residues.
    """
    rows = {(r.detector, r.ion): (float(r.n), r.total, r.squares) for r in detector_counts(spectra, tolerance).collect()}  # a row for each place

    def summed(keys) -> tuple[float, float, float]:
        return tuple(sum(rows.get(k, (0.0, 0.0, 0.0))[i] for k in keys) for i in range(3))

    def reporter(m: float) -> float:
        return welch(rows.get(("reporter", f"{m}"), (0.0, 0.0, 0.0)), summed([("reporter control", f"{m}{d:+}") for d in BESIDE]))

    found = {name: all(reporter(m) > T_REPORTER for m in ms) for name, ms in REPORTERS.items()}
    found["TMT 10-plex"] &= found["TMT 6-plex"]
    phospho = welch(summed([("phospho", "0.0")]), summed([("phospho control", f"{d}") for d in OTHER_LOSSES]))
    ends = {}
    for r in sorted(RESIDUE_MASS):
        if r not in "OU":
            others = [x for x in RESIDUE_MASS if x not in "OUKR" and x != r]
            ends[r] = sum(welch(summed([(d, r)]), summed([(d, x) for x in others])) > T_ENZYME for d in ("y1", "last b"))
    enzyme = {(True, True): "trypsin", (True, False): "lys-c", (False, True): "arg-c"}.get((ends["K"] > 0, ends["R"] > 0))
    return {"mass_errors": mass_errors(spectra, **pairing), "reporters": found, "phospho": phospho > T_PHOSPHO, "phospho_t": phospho, "silac": silac_labels(spectra), "enzyme": enzyme}
