"""Scoring spectra against peptides: preprocessing, XCorr, Sp, p-values and the search itself.

Candidates come from the binned interval join. Their rows and the spectra's rows are dealt by spectrum
and sorted so that each spectrum stands before its candidates; a task then streams them, holds one
preprocessed spectrum as a numpy array and scores candidates batch by batch, however many there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.sequence import AMMONIA, BIN_OFFSET, BIN_WIDTH, PROTON, RESIDUE_MASS, WATER
from massloom.operators.confidence import competition, tdc_qvalues
from massloom.operators.joins import interval_join, mass_windows
from massloom.operators.ranking import top_n
from massloom.session import written

#: Fixed values of the cross-correlation.
REACH, REGIONS, FLOOR, TOP, SCALE, BEYOND = 75, 10, 0.05, 25_000_000.0, 1e8, 50.0
STEPS = ("remove-precursor", "square-root", "remove-grass", "ten-bin", "xcorr")


def bins_of(mz: np.ndarray, width: float = BIN_WIDTH, offset: float = BIN_OFFSET) -> np.ndarray:
    return np.floor(mz / width + 1 - offset).astype(np.int64)


def preprocess(mz: np.ndarray, intensity: np.ndarray, precursor: float, charge: int, width: float = BIN_WIDTH, offset: float = BIN_OFFSET, remove_precursor: float | None = None, stop_after: str = "xcorr", flanks: bool = False, losses: bool = False) -> np.ndarray:
    """A spectrum as evidence per bin.

    Peaks 50 Da beyond the precursor mass go, optionally those near the precursor m/z too. Intensities are square-rooted
    and the strongest of a bin stays; bins at or below 5 % of the maximum are cleared; ten regions are
    scaled to the same maximum; the mean of the 75 bins on either side is subtracted. ``stop_after`` returns an earlier step.
    """
    keep = mz < (precursor - PROTON) * charge + PROTON + BEYOND
    if remove_precursor is not None:
        keep &= np.abs(mz - precursor) > remove_precursor
    if not len(mz):
        return np.zeros(1)
    end = int(bins_of(np.array([mz.max() + REACH + 1]), width, offset)[0])
    out = np.zeros(end)
    at, value = bins_of(mz[keep], width, offset), intensity[keep]
    if stop_after != "remove-precursor":
        value = np.sqrt(value)
    np.maximum.at(out, at, value)
    if stop_after in ("remove-precursor", "square-root") or not len(at):
        return out
    out[out <= FLOOR * value.max()] = 0
    if stop_after == "remove-grass":
        return out
    lit = at[value > 0]
    size = int(lit.max()) // REGIONS + 1 if len(lit) else 1
    spread = np.zeros(size * REGIONS)
    spread[: min(end, len(spread))] = out[: len(spread)]
    table = spread.reshape(REGIONS, size)
    top = table.max(axis=1, keepdims=True)
    table = np.divide(table * TOP, top, out=np.zeros_like(table), where=top > 0).ravel()
    out[: min(end, len(table))] = table[:end]
    if stop_after == "ten-bin":
        return out
    sums = np.concatenate([[0], np.cumsum(out)])
    i = np.arange(end)
    # the window leaves one bin out on its right, and divides by its full size at the ends too
    around = sums[np.minimum(end, i + REACH)] - sums[np.maximum(0, i - REACH)] - out
    out = out - around / (2 * REACH)
    if flanks:
        side = np.zeros_like(out)
        side[1:] += out[:-1]
        side[:-1] += out[1:]
        out = out + 0.5 * side
    if losses:
        nh3, h2o = int(AMMONIA / width), int(WATER / width)
        loss = np.zeros_like(out)
        loss[nh3:] += out[: end - nh3]
        loss[h2o:] += out[: end - h2o]
        loss[: h2o + 1] = 0
        out = out + 0.2 * loss
    return np.trunc(out)


def ten_bin_peaks(owner: np.ndarray, mz: np.ndarray, intensity: np.ndarray, precursor: np.ndarray, charge: np.ndarray, width: float = BIN_WIDTH, offset: float = BIN_OFFSET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spectrum, bin, evidence) of the bins with evidence, as ``preprocess`` has them after ``ten-bin``, for the peaks of many spectra at once.

    ``owner`` numbers the spectrum of each peak and does not fall; ``precursor`` and ``charge`` go by that number. Work and memory grow with the peaks, not with the bins.
    """
    keep = mz < (precursor[owner] - PROTON) * charge[owner] + PROTON + BEYOND
    owner, at, value = owner[keep], bins_of(mz[keep], width, offset), np.sqrt(intensity[keep])
    keep = value > 0
    owner, at, value = owner[keep], at[keep], value[keep]
    if not len(at):
        return owner, at, value

    def tops(values: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        return first, np.maximum.reduceat(values, first)

    order = np.lexsort((at, owner))
    owner, at, value = owner[order], at[order], value[order]
    first, value = tops(value, owner, at)
    owner, at = owner[first], at[first]
    first, top = tops(value, owner)
    many = np.diff(np.append(first, len(owner)))
    last = at[np.append(first[1:], len(at)) - 1]
    keep = value > np.repeat(FLOOR * top, many)
    region = (at // np.repeat(last // REGIONS + 1, many))[keep]
    owner, at, value = owner[keep], at[keep], value[keep]
    first, top = tops(value, owner, region)
    return owner, at, value * TOP / np.repeat(top, np.diff(np.append(first, len(owner))))


def by_bins(sequence: str, deltas: list[tuple[int, float]], static: dict[str, float], charge: int = 1, width: float = BIN_WIDTH, offset: float = BIN_OFFSET) -> np.ndarray:
    """Bins of the b and y ions at one charge, each once."""
    masses = np.array([RESIDUE_MASS.get(c, math.nan) + static.get(c, 0.0) for c in sequence])
    for place, delta in deltas:
        masses[place] += delta
    b = np.cumsum(masses)[:-1]
    y = masses.sum() - b + WATER
    both = np.concatenate([b, y])
    both = both[np.isfinite(both)]
    return np.unique(np.floor((both + charge * PROTON) / charge / width + 1 - offset).astype(np.int64))


def score_bins(evidence: np.ndarray, bins: np.ndarray) -> tuple[float, int, int]:
    """(sum of evidence, bins with evidence, such bins right after another one)."""
    got = evidence[bins[bins < len(evidence)]]
    hit = got > 0
    return float(got.sum()), int(hit.sum()), int((hit[1:] & hit[:-1]).sum())


def sp_score(intensity: float, matched: int, repeat: int, total: int, beta: float = 0.075) -> float:
    return intensity * matched * (1 + repeat * beta) / total if total else 0.0


def candidates(spectra: DataFrame, index: DataFrame, kind: str = "ppm", window: float = 50.0, isotopes: tuple[int, ...] = (0,), spectrum_id: str = "spec_id") -> DataFrame:
    """(spec_id, index columns) for every peptide within a spectrum's mass windows; each pair once."""
    asked = mass_windows(spectra.select(spectrum_id, "neutral_mass", "charge"), kind, window, isotopes=isotopes)
    ranges = asked.select(spectrum_id, F.explode("windows").alias("w")).select(spectrum_id, "w.lo", "w.hi")
    step = max(0.05, 2 * window if kind != "ppm" else 2 * 2500 * window / 1e6)
    found = interval_join(index, ranges, "mass", "lo", "hi", step)
    return found.drop("lo", "hi").dropDuplicates([spectrum_id, "mod_sequence", "is_decoy"]) if len(isotopes) > 1 else found.drop("lo", "hi")


_SCORE_FIELDS = "`xcorr score` double, `b/y ions matched` int, `b/y ions total` int, `b/y ion repeat match` int"


def score_candidates(spectra: DataFrame, found: DataFrame, static: dict[str, float] | None = None, width: float = BIN_WIDTH, offset: float = BIN_OFFSET, remove_precursor: float | None = None, flanks: bool = False, losses: bool = False, p_value: bool = False) -> DataFrame:
    """Append XCorr and ion counts to candidate rows, and ``exact p-value`` with ``refactored xcorr`` where ``p_value``.

    ``spectra`` has spec_id, charge, precursor_mz, neutral_mass, mz, intensity; ``found`` has spec_id, sequence, mods.
    Doubly charged ions count for charges above 2.
    """
    static = dict(static or {})
    names = found.columns
    spec = F.struct("charge", "precursor_mz", "neutral_mass", "mz", "intensity")
    left = spectra.select("spec_id", F.lit(0).alias("__side"), spec.alias("__spec"))
    right = found.select("spec_id", F.lit(1).alias("__side"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"))
    both = left.unionByName(right, allowMissingColumns=True).repartition("spec_id").sortWithinPartitions("spec_id", "__side")
    fields = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in names)
    extra = ", `refactored xcorr` double, `exact p-value` double" if p_value else ""

    def run(batches):
        evidence, charge, null, at = None, 0, None, None
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            side, ids = col["__side"].to_pylist(), col["spec_id"].to_pylist()
            rows = col["__row"]
            pieces, mods = rows.field("sequence").to_pylist(), rows.field("mods").to_pylist()
            picked, made = [], []
            for k, s in enumerate(side):
                if s == 0:
                    one = col["__spec"][k].as_py()
                    at, charge = ids[k], one["charge"]
                    mz, intensity = np.array(one["mz"]), np.array(one["intensity"])
                    evidence = preprocess(mz, intensity, one["precursor_mz"], charge, width, offset, remove_precursor, flanks=flanks, losses=losses)
                    null = NullScores(mz, intensity, one["precursor_mz"], charge, static) if p_value else None
                elif ids[k] == at:
                    deltas = [(m["place"], m["delta"]) for m in mods[k] or []]
                    total, matched, repeat, size = 0.0, 0, 0, 0
                    for z in (1, 2) if charge > 2 else (1,):
                        bins = by_bins(pieces[k], deltas, static, z, width, offset)
                        t, m, r = score_bins(evidence, bins)
                        total, matched, repeat, size = total + t, matched + m, repeat + r, size + len(bins)
                    row = [total / SCALE, matched, size, repeat]
                    if p_value:
                        row += list(null.rate(pieces[k], deltas))
                    picked.append(k)
                    made.append(row)
            if picked:
                kept = rows.take(pa.array(picked))
                kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                arrays = [kept.field(c) for c in names] + [pa.array([r[j] for r in made], kinds[j]) for j in range(len(made[0]))]
                labels = [*names, "xcorr score", "b/y ions matched", "b/y ions total", "b/y ion repeat match", "refactored xcorr", "exact p-value"]
                yield pa.RecordBatch.from_arrays(arrays, names=labels[: len(arrays)])

    return both.mapInArrow(run, f"{fields}, {_SCORE_FIELDS}{extra}")


#: Fixed values of the exact p-value: unit bins and the integer scale of evidence.
UNIT_WIDTH, UNIT_OFFSET, RESCALE = 1.0005079, 0.40, 20.0


class NullScores:
    """Exact null distribution of the evidence score of one spectrum, by dynamic programming over masses and scores.

    Residues are drawn with the given frequencies. A sequence is grown residue by residue; ``table[mass]`` holds the
    chance of every score, so a column is a few shifted additions in numpy. The p-value of a score counts
    half of its own bin.
    """

    def __init__(self, mz: np.ndarray, intensity: np.ndarray, precursor: float, charge: int, static: dict[str, float], frequencies: dict[str, float] | None = None):
        self.static = static
        self.spectrum = (mz, intensity, precursor, charge)
        weights = frequencies or {r: 1.0 for r in RESIDUE_MASS if r not in "OU"}
        masses: dict[int, float] = {}
        for r, w in weights.items():
            b = int(round((RESIDUE_MASS[r] + static.get(r, 0.0)) / UNIT_WIDTH))
            masses[b] = masses.get(b, 0.0) + w
        total = sum(masses.values())
        self.steps = sorted((b, w / total) for b, w in masses.items())
        self.cache: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def evidence(self, residues: int) -> np.ndarray:
        """Integer evidence of a cut after ``k`` mass units, from the b and y ions (and the doubly charged ones above charge 2)."""
        mz, intensity, precursor, charge = self.spectrum
        base = preprocess(mz, intensity, precursor, charge, UNIT_WIDTH, UNIT_OFFSET) / TOP * 50
        cut = np.arange(residues + 1) * UNIT_WIDTH
        total = np.zeros(residues + 1)
        for z in (1, 2) if charge > 2 else (1,):
            for ion in (cut, residues * UNIT_WIDTH - cut + WATER):
                at = np.floor((ion + z * PROTON) / z / UNIT_WIDTH + 1 - UNIT_OFFSET).astype(np.int64)
                ok = (at >= 0) & (at < len(base))
                total[ok] += base[at[ok]]
        return np.round(total / 50 * RESCALE).astype(np.int64)

    def tail(self, residues: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(evidence, p-value by score + offset, offset) for peptides of so many mass units."""
        known = self.cache.get(residues)
        if known is None:
            e = self.evidence(residues)
            longest = residues // self.steps[0][0] + 1
            inner = np.sort(e[1:-1]) if residues > 1 else np.zeros(0, dtype=np.int64)
            low = int(np.minimum(inner[:longest], 0).sum()) - 1
            high = int(np.maximum(inner[::-1][:longest], 0).sum()) + 1
            size = high - low + 1
            table = np.zeros((residues + 1, size))
            table[0, -low] = 1.0
            for m in range(1, residues + 1):
                column = table[m]
                for b, w in self.steps:
                    if b > m:
                        break
                    column += w * table[m - b]
                shift = int(e[m]) if m < residues else 0
                if shift > 0:
                    column[shift:] = column[:-shift].copy()
                    column[:shift] = 0
                elif shift < 0:
                    column[:shift] = column[-shift:].copy()
                    column[shift:] = 0
            last = table[residues]
            mass = last.sum()
            if mass > 0:
                p = (np.cumsum(last[::-1])[::-1] - last / 2) / mass
            else:
                p = np.ones(size)
            known = (e, np.clip(p, 0, 1), -low)
            if len(self.cache) > 64:
                self.cache.clear()
            self.cache[residues] = known
        return known

    def rate(self, sequence: str, deltas: list[tuple[int, float]]) -> tuple[float, float]:
        """(score, p-value) of one peptide."""
        masses = np.array([RESIDUE_MASS.get(c, 0.0) + self.static.get(c, 0.0) for c in sequence])
        for place, delta in deltas:
            masses[place] += delta
        units = np.round(masses / UNIT_WIDTH).astype(np.int64)
        residues = int(units.sum())
        if residues < 1:
            return 0.0, 1.0
        e, p, offset = self.tail(residues)
        cuts = np.cumsum(units)[:-1]
        score = int(e[np.clip(cuts, 0, residues)].sum())
        at = score + offset
        return score / RESCALE, float(p[at]) if 0 <= at < len(p) else (1.0 if at < 0 else 0.0)


def combined_p(p: Column, m: float = 1.2, n: int = 2) -> Column:
    """The p-value of a product of ``n`` dependent p-values, by the closed form with ``m`` effective ones."""
    y = F.pow(p, F.lit(m / n))
    log = -F.ln(y)
    whole = int(math.floor(m))
    total = F.lit(0.0)
    for i in range(whole):
        total = total + F.pow(log, F.lit(i)) / F.lit(float(math.factorial(i)))
    total = total + F.lit(m - whole) * F.pow(log, F.lit(whole)) / F.lit(float(math.factorial(whole)))
    return F.when(p <= 0, 0.0).otherwise(y * total)


def residue_evidence(mz: np.ndarray, intensity: np.ndarray, residues: int, steps: dict[str, int], tolerance: float) -> np.ndarray:
    """Evidence for each residue to end at each mass unit: pairs of peaks whose gap is the residue's mass.

    The strength of a pair is the sum of its ranks' shares, less the misfit's part of the tolerance; both series count.
    """
    names = sorted(steps)
    out = np.zeros((len(names), residues + 1))
    if not len(mz):
        return out
    rank = np.empty(len(mz))
    rank[np.argsort(intensity, kind="stable")] = np.arange(1, len(mz) + 1) / len(mz)
    total = residues * UNIT_WIDTH
    for series in (0, 1):
        place = mz - PROTON if series == 0 else total - (mz - PROTON - WATER)
        order = np.argsort(place)
        x, r = place[order], rank[order]
        for k, name in enumerate(names):
            gap = RESIDUE_MASS[name]
            near = np.searchsorted(x, x + gap - tolerance)
            far = np.searchsorted(x, x + gap + tolerance, side="right")
            for i in np.flatnonzero(far > near):
                j = np.arange(near[i], far[i])
                fit = 1 - np.abs(x[j] - x[i] - gap) / tolerance
                at = np.round(x[j] / UNIT_WIDTH).astype(int)
                ok = (at > 0) & (at <= residues)
                np.maximum.at(out[k], at[ok], ((r[i] + r[j]) * fit)[ok])
    return out


def residue_tail(grid: np.ndarray, names: list[str], steps: dict[str, int], weights: dict[str, float] | None = None) -> np.ndarray:
    """Chance of at least each summed evidence (integers) among all sequences of a whole mass, residues drawn with ``weights``."""
    residues = grid.shape[1] - 1
    longest = residues // max(1, min(steps.values())) + 1
    size = int(np.sort(grid.max(axis=0))[::-1][:longest].sum()) + 1
    share = np.array([(weights or {}).get(n, 0.0 if weights else 1.0) for n in names])
    share = share / share.sum()
    table = np.zeros((residues + 1, size))
    table[0, 0] = 1.0
    for m in range(1, residues + 1):
        for k, n in enumerate(names):
            b = steps[n]
            if b <= m:
                g = int(grid[k, m])
                table[m, g:] += table[m - b, : size - g] * share[k]
    last = table[residues]
    mass = last.sum()
    return np.cumsum(last[::-1])[::-1] / mass if mass > 0 else np.ones(size)


def residue_evidence_p(matrix: np.ndarray, names: list[str], steps: dict[str, int], sequence: str, scale: float = 10.0) -> tuple[float, float]:
    """(score, p-value): the summed residue evidence of a peptide against all sequences of its mass; ties count in full."""
    grid = np.round(matrix * scale).astype(np.int64)
    row = {n: k for k, n in enumerate(names)}
    at, score = 0, 0
    for c in sequence:
        at += steps[c]
        if at < grid.shape[1]:
            score += int(grid[row[c], at])
    tail = residue_tail(grid, names, steps)
    return score / scale, float(tail[min(score, len(tail) - 1)])


def search(spectra: DataFrame, index: DataFrame, **options) -> DataFrame:
    """Matches of spectra (``spectrum_charges`` rows) and an index: the best ``top_match`` per spectrum with ranks, delta and tailor scores.

    Options: ``kind``, ``window`` and ``isotopes`` of the mass windows, ``score`` (``xcorr``, ``exact``, ``residue-evidence`` or ``combined``), ``separate`` (targets
    and decoys are ranked apart), and those of preprocessing; see ``massblocks.search_blocks``.
    """
    from massloom.operators.massblocks import search_blocks

    return search_blocks(spectra, index, **options)


def localize(psms: DataFrame, spectra: DataFrame, top: int = 1, min_gap: float = 0.5, static: dict[str, float] | None = None, **scoring) -> DataFrame:
    """Place the mass gap between a spectrum and its peptide at each residue (or nowhere) and rank the placements by XCorr.

    ``psms`` has spec_id, sequence, mods, mass; ``spectra`` as for scoring. Gaps below ``min_gap`` are left alone.
    """
    rows = psms.join(spectra.select("spec_id", "neutral_mass"), "spec_id").withColumn("gap", F.col("neutral_mass") - F.col("mass"))
    spots = F.when(F.abs("gap") >= min_gap, F.sequence(F.lit(-1), F.length("sequence") - 1)).otherwise(F.array(F.lit(-1)))
    placed = rows.withColumn("place", F.explode(spots))
    mods = F.coalesce("mods", F.array().cast("array<struct<place:int,delta:double>>"))
    added = F.when(F.col("place") >= 0, F.concat(mods, F.array(F.struct(F.col("place").cast("int").alias("place"), F.col("gap").alias("delta"))))).otherwise(mods)
    scored = score_candidates(spectra, placed.withColumn("mods", added).drop("neutral_mass"), static, **scoring)
    return top_n(scored, ["spec_id", "sequence"], "xcorr score", top, ["place"], out="site rank")


def cascade(spectra: DataFrame, indexes: list[DataFrame], termination: int = 20, q_limit: float = 0.01, score: str = "xcorr score", **options) -> DataFrame:
    """Search one index after another: accepted spectra leave the later rounds, and a round of at most ``termination`` acceptances is the last."""
    left, accepted = spectra, None
    for k, index in enumerate(indexes):
        found = search(left, index, **options).where(F.col("xcorr rank") == 1)
        taken = written(tdc_qvalues(compete(found, score), score, F.col("is_decoy"), out="tdc q-value").where(F.col("tdc q-value") <= q_limit).withColumn("round", F.lit(k)), "accepted")
        accepted = taken if accepted is None else accepted.unionByName(taken)
        if taken.count() <= termination:
            break
        left = left.join(taken.select("file", "scan", "charge"), ["file", "scan", "charge"], "left_anti")
    return accepted


def compete(found: DataFrame, score: str) -> DataFrame:
    """The better of a spectrum's best target and best decoy."""
    order = [F.desc(f"`{score}`"), F.col("mod_sequence")]
    clean = found.withColumnRenamed("is_decoy", "__kind")
    won = competition(clean, ["file", "scan", "charge"], F.col("__kind"), order, F.col("t")[score] >= F.col("d")[score])
    return won.drop("__kind")
