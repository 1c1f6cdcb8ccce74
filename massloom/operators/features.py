"""MS1 features: centroiding, isotope features of a scan, and their tracing through time.

Detection works on one scan at a time. Tracing depends on order (the strongest feature goes first and uses up
its members), so features are first split into groups that cannot touch each other: charge and runs of mass without
a gap wider than the tolerance. Each group is traced on its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions.sequence import NEUTRON, PROTON
from massloom.operators.lfq import isotope_pattern

_FEATURES = "file string, scan int, rt double, mono_mass double, charge int, intensity double, base_peak double, correlation double"


def centroid(mz: np.ndarray, intensity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima of profile data, placed by the parabola through the three top points."""
    if len(mz) < 3:
        return mz, intensity
    i = np.flatnonzero((intensity[1:-1] > intensity[:-2]) & (intensity[1:-1] >= intensity[2:])) + 1
    a, b, c = intensity[i - 1], intensity[i], intensity[i + 1]
    bend = a - 2 * b + c
    shift = np.where(bend < 0, 0.5 * (a - c) / np.where(bend < 0, bend, 1), 0.0)
    step = np.where(shift >= 0, mz[i + 1] - mz[i], mz[i] - mz[i - 1])
    return mz[i] + shift * step, b - 0.25 * (a - c) * shift


def savitzky_golay(values: np.ndarray, half: int = 4, order: int = 3) -> np.ndarray:
    """Smooth by a local polynomial; the ends repeat their last value."""
    x = np.arange(-half, half + 1)
    weights = np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]
    return np.convolve(np.pad(values, half, mode="edge"), weights[::-1], mode="valid")


def averagine_pattern(mass: float) -> np.ndarray:
    return np.array([a for _, a in isotope_pattern("", mass)])


def scan_features(mz: np.ndarray, intensity: np.ndarray, charges: range = range(1, 6), ppm: float = 10.0, correlation: float = 0.9, depth: int = 3, noise: float = 0.0) -> list[tuple[float, int, float, float, float]]:
    """(mono mass, charge, intensity, base m/z, correlation) of the isotope patterns of one scan.

    The strongest peak left is tried as each of the first ``depth`` isotopes at each charge; the pattern with the best cosine to averagine wins, if that
    reaches ``correlation``, and its peaks are used up.
    """
    left = intensity.astype(float).copy()
    out = []
    for top in np.argsort(-intensity, kind="stable"):
        if left[top] <= noise:
            continue
        best = None
        for z in charges:
            for first in range(depth):
                mono = mz[top] - first * NEUTRON / z
                mass = (mono - PROTON) * z
                if mass <= 0:
                    continue
                pattern = averagine_pattern(mass)
                if first >= len(pattern) or pattern[first] < pattern.max() - 1e-9:
                    continue
                want = mono + np.arange(len(pattern)) * NEUTRON / z
                at = np.clip(np.searchsorted(mz, want), 1, len(mz) - 1) if len(mz) > 1 else np.zeros(len(want), dtype=int)
                if len(mz) > 1:
                    at = np.where(np.abs(mz[at - 1] - want) <= np.abs(mz[at] - want), at - 1, at)
                ok = np.abs(mz[at] - want) <= want * ppm / 1e6
                seen = np.where(ok, left[at], 0.0)
                if (seen > 0).sum() < 2:
                    continue
                cos = float(seen @ pattern / np.sqrt((seen @ seen) * (pattern @ pattern)))
                if cos >= correlation and (best is None or (cos, seen.sum()) > best[0]):
                    best = ((cos, seen.sum()), mass, z, at[ok], seen)
        if best:
            (cos, total), mass, z, used, seen = best
            out.append((float(mass), int(z), float(total), float(mz[top]), cos))
            left[used] = 0
        else:
            left[top] = 0
    return out


#: Grid of the charge detectors in Da, reach of a window on either side of its strongest peak, and candidates that a combination is sought among.
GRID, REACH, CANDIDATES = 0.005, 1.6, 8


def charge_order(mz: np.ndarray, intensity: np.ndarray, charges: range = range(1, 6), ppm: float = 10.0) -> list[int]:
    """Charges by how strongly a window's peaks repeat at their spacing, the strongest first; those without any repeat are left out.

    The peaks, each as wide as the tolerance, go on a grid. Its power spectrum gives the autocorrelation, read at the spacing and with
    the amplitude of the spectrum at the charge's frequency; the product of both decides, so neither multiples of a spacing nor a lone pair of peaks do.
    """
    if len(mz) < 2:
        return []
    size = 1 << int(np.ceil(np.log2((mz[-1] - mz[0] + 2 * REACH + 1) / GRID)))
    signal = np.zeros(size)
    at = np.round((mz - mz[0]) / GRID).astype(int)
    wide = max(1, int(np.ceil(mz[-1] * ppm / 1e6 / GRID)))
    for shift in range(-wide, wide + 1):
        inside = (at + shift >= 0) & (at + shift < size)
        np.maximum.at(signal, at[inside] + shift, np.sqrt(intensity[inside]))
    spectrum = np.fft.rfft(signal)
    repeats = np.fft.irfft(np.abs(spectrum) ** 2, size)
    found = []
    for z in charges:
        lag = NEUTRON / z / GRID
        near = repeats[max(1, int(lag) - 1) : int(lag) + 3].max() / repeats[0]
        tone = np.abs(spectrum[min(len(spectrum) - 1, int(round(size / lag)))]) / np.abs(spectrum[0])
        if near > 0.02:
            found.append((near * tone, z))
    return [z for _, z in sorted(found, key=lambda x: (-x[0], x[1]))]


def _envelope(mz: np.ndarray, mono: float, z: int, ppm: float) -> tuple[np.ndarray, float]:
    """(averagine pattern of a feature on the peaks that are there, highest isotope 1; squares of the isotopes that lack a peak within the window)."""
    pattern = averagine_pattern((mono - PROTON) * z)
    want = mono + np.arange(len(pattern)) * NEUTRON / z
    at = np.clip(np.searchsorted(mz, want), 1, len(mz) - 1)
    at = np.where(np.abs(mz[at - 1] - want) <= np.abs(mz[at] - want), at - 1, at)
    out = np.zeros(len(mz))
    ok = np.abs(mz[at] - want) <= want * ppm / 1e6
    np.add.at(out, at[ok], pattern[ok] / pattern.max())
    gone = ~ok & (want >= mz[0]) & (want <= mz[-1])
    return out, float(((pattern[gone] / pattern.max()) ** 2).sum())


def overlapping_features(mz: np.ndarray, intensity: np.ndarray, charges: range = range(1, 6), ppm: float = 10.0, correlation: float = 0.9, depth: int = 3, isotopes: int = 4, noise: float = 0.0, gain: float = 0.01) -> list[tuple[float, int, float, float, float]]:
    """(mono mass, charge, intensity, base m/z, correlation) of isotope patterns that may share peaks; ``mz`` ascends.

    Around the strongest peak left, charges that repeat there and the first ``isotopes`` places of the peak give candidates. Sets of up to ``depth`` of the best
    candidates are fitted with amounts that are not negative; a larger set is taken where its cosine is better by ``gain``. What the set explains is taken
    off, the rest goes on.
    """
    left = intensity.astype(float).copy()
    out = []
    for top in np.argsort(-intensity, kind="stable"):
        if left[top] <= max(noise, 1e-3 * intensity[top]):
            continue
        lo, hi = np.searchsorted(mz, [mz[top] - REACH, mz[top] + REACH])
        m, i = mz[lo:hi], left[lo:hi]
        tried = []
        for z in charge_order(m[i > noise], i[i > noise], charges, ppm):
            for peak in np.flatnonzero(i > 0.2 * left[top]):
                for first in range(isotopes):
                    mono = m[peak] - first * NEUTRON / z
                    if (mono - PROTON) * z <= 0:
                        continue
                    shape, lost = _envelope(m, mono, z, ppm)
                    if (shape > 0).sum() >= 2 and shape[peak] > 0:
                        tried.append((float(shape @ i / np.sqrt((shape @ shape + lost) * (i @ i))), mono, z, shape, lost))
        # one of each monoisotopic place and charge
        best: dict[tuple[int, int], tuple] = {}
        for t in tried:
            key = (int(round(t[1] / 0.02)), t[2])
            if key not in best or t[0] > best[key][0]:
                best[key] = t
        tried = sorted(best.values(), key=lambda t: (-t[0], t[2], t[1]))[:CANDIDATES]
        chosen, score = None, 0.0
        for n in range(1, depth + 1):
            found = None
            for some in combinations(tried, n):
                shapes = np.stack([t[3] for t in some], axis=1)
                lost = np.array([t[4] for t in some])
                # a missing isotope is a peak of intensity 0
                amount = np.linalg.lstsq(np.vstack([shapes, np.diag(np.sqrt(lost))]), np.append(i, np.zeros(n)), rcond=None)[0]
                if (amount <= 0.02 * amount.max()).any():
                    continue
                fit = shapes @ amount
                cos = float(fit @ i / np.sqrt((fit @ fit + amount**2 @ lost) * (i @ i)))
                if found is None or cos > found[0]:
                    found = (cos, some, amount, shapes)
            if found and found[0] > score + (gain if chosen else 0.0):
                chosen, score = found, found[0]
        if chosen is None or score < correlation:
            left[top] = 0
            continue
        cos, some, amount, shapes = chosen
        for t, a, shape in zip(some, amount, shapes.T, strict=True):
            out.append((float((t[1] - PROTON) * t[2]), int(t[2]), float(a * shape.sum()), float(m[np.argmax(shape)]), cos))
        left[lo:hi] = np.maximum(i - shapes @ amount, 0)
        left[lo:hi][left[lo:hi] < 0.05 * i] = 0
        left[top] = 0
    return out


def detect_features(spectra: DataFrame, profile: bool = False, overlap: bool = False, **options) -> DataFrame:
    """Isotope features of every MS1 scan; rt in minutes. With ``overlap`` patterns may share peaks and charges come from the window's repeats."""
    find = overlapping_features if overlap else scan_features

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                mz, i = np.array(r.mz, dtype=float), np.array(r.intensity, dtype=float)
                if profile:
                    mz, i = centroid(mz, savitzky_golay(i) if len(i) > 9 else i)
                out += [(r.file, r.scan, r.rt, m, z, t, b, c) for m, z, t, b, c in find(mz, i, **options)]
            yield pd.DataFrame(out, columns=["file", "scan", "rt", "mono_mass", "charge", "intensity", "base_peak", "correlation"])

    return spectra.where("ms_level = 1").select("file", "scan", (F.col("rt") / 60).alias("rt"), "mz", "intensity").mapInPandas(run, _FEATURES)


def trace(scan: np.ndarray, mass: np.ndarray, intensity: np.ndarray, ppm: float, gap: int, least: int) -> np.ndarray:
    """Number of the trace that each feature belongs to, or -1; ``scan`` holds positions among the MS1 scans.

    From the strongest feature left, the nearest in mass within ``ppm`` is taken scan by scan to both sides,
    until more than ``gap`` scans in a row lack one. Traces of fewer than ``least`` scans are dropped.
    """
    owner = np.full(len(scan), -1)
    free = np.ones(len(scan), dtype=bool)
    by_scan: dict[int, np.ndarray] = {int(s): np.flatnonzero(scan == s) for s in np.unique(scan)}
    first, last = int(scan.min()), int(scan.max())
    n = 0
    for top in np.argsort(-intensity, kind="stable"):
        if not free[top]:
            continue
        members = [top]
        for step in (1, -1):
            missed, s, near = 0, int(scan[top]) + step, mass[top]
            while first <= s <= last and missed <= gap:
                here = by_scan.get(s, np.zeros(0, dtype=int))
                here = here[free[here] & (np.abs(mass[here] - near) <= near * ppm / 1e6)]
                if len(here):
                    pick = here[np.argmin(np.abs(mass[here] - near))]
                    members.append(pick)
                    near, missed = mass[pick], 0
                else:
                    missed += 1
                s += step
        free[members] = False
        if len(members) >= least:
            owner[members] = n
            n += 1
    return owner


def trace_features(features: DataFrame, ppm: float = 10.0, gap: int = 1, min_scans: int = 3) -> DataFrame:
    """(file, feature_id, charge, mono_mass, base_mz, mono_mz, first_rt, last_rt, apex_rt, intensity, sum_intensity, n_scans).

    Features of one charge whose sorted masses have no gap wider than the tolerance make a group.
    """
    scans = features.select("file", "scan").distinct()
    numbered = scans.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("scan")))
    # groups are found within slices of 50 Da so that no window holds all masses of a file; groups that touch across an edge are joined after
    rows = features.join(numbered, ["file", "scan"]).withColumn("slice", F.floor(F.col("mono_mass") / 50))
    w = Window.partitionBy("file", "charge", "slice").orderBy("mono_mass")
    new = F.coalesce((F.col("mono_mass") - F.lag("mono_mass").over(w) > F.col("mono_mass") * 2 * ppm / 1e6).cast("int"), F.lit(0))
    grouped = rows.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = grouped.groupBy("file", "charge", "slice", "part").agg(F.min("mono_mass").alias("low"), F.max("mono_mass").alias("high"))
    over = Window.partitionBy("file", "charge").orderBy("slice", "part")
    apart = F.coalesce((F.col("low") - F.lag("high").over(over) > F.col("low") * 2 * ppm / 1e6).cast("int"), F.lit(1))
    joined = parts.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = grouped.join(joined.select("file", "charge", "slice", "part", "chain"), ["file", "charge", "slice", "part"])

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["intensity", "position"], ascending=[False, True]).reset_index(drop=True)
        owner = trace(g.position.to_numpy(), g.mono_mass.to_numpy(), g.intensity.to_numpy(), ppm, gap, min_scans)
        out = []
        for k in range(owner.max() + 1 if len(owner) else 0):
            t = g[owner == k]
            best = t.loc[t.intensity.idxmax()]
            z = int(best.charge)
            out.append((best.file, f"{best.file}/{z}/{int(best.slice)}/{int(best.part)}/{k}", z, float(best.mono_mass), float(best.base_peak), float(best.mono_mass / z + PROTON), float(t.rt.min()), float(t.rt.max()), float(best.rt), float(best.intensity), float(t.intensity.sum()), len(t)))
        return pd.DataFrame(out, columns=["file", "feature_id", "charge", "mono_mass", "base_mz", "mono_mz", "first_rt", "last_rt", "apex_rt", "intensity", "sum_intensity", "n_scans"])

    return grouped.groupBy("file", "charge", "chain").applyInPandas(build, "file string, feature_id string, charge int, mono_mass double, base_mz double, mono_mz double, first_rt double, last_rt double, apex_rt double, intensity double, sum_intensity double, n_scans int")


def drop_contaminants(traces: DataFrame, max_minutes: float, min_mass: float = 0.0, max_mass: float = 1e9) -> DataFrame:
    """Traces that elute no longer than ``max_minutes``, within a mass range."""
    return traces.where((F.col("last_rt") - F.col("first_rt") <= max_minutes) & F.col("mono_mass").between(min_mass, max_mass))


def split_by_features(spectra: DataFrame, traces: DataFrame, ppm: float = 10.0, rt: float = 0.5, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) MS2 spectra; a matched one takes charge and mass from each of its features."""
    from massloom.operators.joins import match_features

    ms2 = spectra.where("ms_level = 2")
    asked = ms2.select("file", "scan", "precursor_mz", (F.col("rt") / 60).alias("rt_time"), F.xxhash64("file", "scan").alias("spec_id"))
    hits = match_features(asked, traces.drop("file"), ppm, rt, exact)
    states = hits.groupBy("file", "scan").agg(F.sort_array(F.collect_set(F.struct(F.col("charge"), (F.col("mono_mass") + PROTON).alias("mh")))).alias("found"))
    matched = ms2.join(states, ["file", "scan"]).withColumn("zstates", F.col("found")).drop("found")
    return matched.select(*spectra.columns), ms2.join(states.select("file", "scan"), ["file", "scan"], "left_anti").select(*spectra.columns)
