"""Data-independent acquisition: precursor and co-elution features, ensemble score and filter; ``dia_run`` has the whole analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.functions.arrays import normalised_dot, top_k, total
from massloom.functions.sequence import NEUTRON
from massloom.operators.joins import nearest_join


def ensemble_score(tailor: Column, rt_diff: Column, precursor: Column, fragment: Column, elution: Column, weights=(1.0, 1.0, 1.0, 1.0, 1.0)) -> Column:
    """tailor - rt difference - precursor rank + fragment + elution, each with its coefficient."""
    a, b, c, d, e = map(F.lit, weights)
    return a * tailor - b * rt_diff - c * precursor + d * fragment + e * elution


def ensemble_filter(psms: DataFrame, by: list[str], ensemble: str, order: list[Column], slack: float = 1e-6) -> DataFrame:
    """Matches whose ensemble score reaches that of the first row in ``order`` of their spectrum, less ``slack``."""
    first = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return psms.withColumn("__base", F.first(ensemble).over(first)).where(F.col(ensemble) >= F.col("__base") - slack).drop("__base")


def log_ranks(peaks: DataFrame, by: list[str] = ("scan",), intensity: str = "intensity") -> DataFrame:
    """Append ``log_rank`` = ln(1 + number of more intense peaks of the scan)."""
    return peaks.withColumn("log_rank", F.log1p(F.rank().over(Window.partitionBy(*by).orderBy(F.desc(intensity))) - 1))


def rank_regression(peaks: DataFrame, by: list[str] = ("scan",), intensity: str = "intensity") -> DataFrame:
    """(by, slope, intercept) of the log rank on ln(1 + intensity) for each scan."""
    x = F.log1p(F.col(intensity))
    return log_ranks(peaks, list(by), intensity).groupBy(*by).agg(F.regr_slope("log_rank", x).alias("slope"), F.regr_intercept("log_rank", x).alias("intercept"))


def precursor_ranks(psms: DataFrame, peaks: DataFrame, ppm: float = 20.0, isotopes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Append ``precursor_m0..``: the regressed log rank of the nearest MS1 peak at mz + k / z within ``ppm``.

    ``psms`` has psm_id, scan, mz, charge; ``peaks`` has scan, mz, intensity. A missing peak counts as intensity 0.
    """
    fit = rank_regression(peaks)
    out = psms
    widest = 2200 * ppm / 1e6
    for k in isotopes:
        asked = psms.select("psm_id", "scan", (F.col("mz") + F.lit(k * NEUTRON) / F.col("charge")).alias("__x"))
        found = nearest_join(asked, peaks.select("scan", F.col("mz").alias("__y"), F.col("intensity").alias("__i")), "psm_id", "__x", "__y", widest, ["scan"], ["__y"])
        hit = F.when(F.abs(F.col("__x") - F.col("__y")) <= F.col("__x") * ppm / 1e6, F.col("__i")).otherwise(0.0)
        value = found.join(fit, "scan", "left").select("psm_id", (F.coalesce("slope", F.lit(0.0)) * F.log1p(F.coalesce(hit, F.lit(0.0))) + F.coalesce("intercept", F.lit(0.0))).alias(f"precursor_m{k}"))
        out = out.join(value, "psm_id", "left")
    return out


def coelution(traces: DataFrame, by: list[str] = ("psm_id",), kind: str = "kind", trace: str = "trace", order: str = "ion", best: int = 3) -> DataFrame:
    """(by, ms1, ms2, ms1_ms2): the ``best`` cosines between chromatograms over ``best``, within the levels and of the first MS1 trace with all of MS2.

    A match has few traces (its isotopes and fragments), so pairing them within the match is bounded. Too few pairs count as cosines of 0.
    """
    level = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col(kind) == k, F.struct(F.col(order).alias("o"), F.col(trace).alias("t"))))), lambda x: x["t"])
    rows = traces.groupBy(*by).agg(level("ms1").alias("a"), level("ms2").alias("b"))

    def pairs(x: Column, y: Column, same: bool) -> Column:
        nested = F.transform(x, lambda p, i: F.transform(F.slice(y, i + 2, F.greatest(F.size(y) - i - 1, F.lit(0))) if same else y, lambda q: normalised_dot(p, q)))
        return F.flatten(nested)

    def mean(values: Column) -> Column:
        return total(top_k(values, best)) / best

    a, b = F.col("a"), F.col("b")
    return rows.select(*by, mean(pairs(a, a, True)).alias("ms1"), mean(pairs(b, b, True)).alias("ms2"), mean(pairs(F.slice(a, 1, 1), b, False)).alias("ms1_ms2"))


def denoise(peaks: DataFrame, by: list[str], scan_index: str = "scan_index", mz: str = "mz", ppm: float = 20.0) -> DataFrame:
    """Peaks that every existing neighbour scan of the isolation window confirms within ``ppm``."""
    step = 4 * ppm / 1e6
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy(scan_index))
    rows = peaks.withColumn("__k", number).withColumn("__bin", F.floor(F.ln(mz) / step).cast("long"))
    last = rows.groupBy(*by).agg(F.max("__k").alias("__last"))
    other = rows.select(*by, F.col("__k").alias("__ok"), F.col("__bin"), F.col(mz).alias("__omz")).distinct()
    rows = rows.join(last, list(by))
    for shift in (-1, 1):
        asked = rows.withColumn("__ok", F.col("__k") + shift).select("*", F.explode(F.array(F.col("__bin") - 1, F.col("__bin"), F.col("__bin") + 1)).alias("__b"))
        hits = asked.join(other.withColumnRenamed("__bin", "__b"), [*by, "__ok", "__b"]).where(F.abs(F.col(mz) - F.col("__omz")) <= F.col(mz) * ppm / 1e6)
        seen = hits.select(*by, "__k", mz).distinct().withColumn("__seen", F.lit(True))
        edge = F.col("__k") == (1 if shift < 0 else F.col("__last"))
        rows = rows.join(seen, [*by, "__k", mz], "left").where(edge | F.col("__seen")).drop("__seen")
    return rows.select(*peaks.columns)


def isolation_gap(spectra: DataFrame, by: list[str], precursor: str = "precursor_mz") -> DataFrame:
    """(by, gap): mean difference of consecutive distinct precursor m/z."""
    w = Window.partitionBy(*by).orderBy(precursor)
    steps = spectra.select(*by, precursor).distinct().withColumn("__d", F.col(precursor) - F.lag(precursor).over(w))
    return steps.groupBy(*by).agg(F.avg("__d").alias("gap"))


def static_fragment_score(matched: DataFrame, by: list[str], intensity: str = "intensity", series: str = "ion") -> DataFrame:
    """(by, static_fragment): ln(n_b!) + ln(n_y!) + ln(1 + sum of squared intensities of b and of y ions)."""
    rows = matched.groupBy(*by).agg(*(F.count_if(F.col(series) == s).alias(f"n_{s}") for s in "by"), *(F.sum(F.when(F.col(series) == s, F.pow(intensity, F.lit(2))).otherwise(0.0)).alias(f"i_{s}") for s in "by"))

    def log_factorial(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + F.ln(k))

    parts = [log_factorial(F.col(f"n_{s}")) + F.log1p(F.col(f"i_{s}")) for s in "by"]
    return rows.select(*by, (parts[0] + parts[1]).alias("static_fragment"))


def dynamic_fragment_score(psms: DataFrame, trials: str, hits: str, chance: str, out: str = "dynamic_fragment") -> DataFrame:
    """Append -ln of the binomial chance of at least ``hits`` of ``trials`` ions matching at random with ``chance`` each."""

    @F.pandas_udf("double")
    def rated(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
        score = np.full(len(n), np.nan)
        known = np.flatnonzero((n.notna() & k.notna() & p.notna()).to_numpy())
        cases, back = np.unique(np.stack([x.to_numpy(dtype=float)[known] for x in (n, k, p)], axis=1), axis=0, return_inverse=True)
        score[known] = -binomial_tail(*cases.T)[back.ravel()]
        return pd.Series(score).astype(object).where(~np.isnan(score), None)

    k, p = F.col(hits).cast("int"), F.least(F.greatest(F.col(chance), F.lit(1e-12)), F.lit(1 - 1e-12))
    return psms.withColumn(out, F.when(k > 0, rated(F.col(trials).cast("int"), k, p)).otherwise(0.0))


def binomial_tail(n: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln of the chance of at least ``k`` of ``n`` with chance ``p`` each, NaN where ``k`` > ``n``; all cases take one term at a time."""
    total = np.full(len(n), -np.inf)
    if len(n):
        log_factorial = np.cumsum(np.log(np.maximum(np.arange(int(max(n.max(), 0)) + 1), 1)))
        log_p, log_q = np.log(p), np.log1p(-p)
        left, j = np.flatnonzero(n >= k), k.copy()
        while len(left):
            m, i = n[left].astype(np.int64), j[left].astype(np.int64)
            term = log_factorial[m] - log_factorial[i] - log_factorial[m - i] + i * log_p[left] + (m - i) * log_q[left]
            total[left] = np.logaddexp(total[left], term)
            # past the mode terms fall faster and faster: those below 1e-20 of the sum add nothing
            over = (i == m) | ((i > m * p[left] + 1) & (term < total[left] - 50))
            j[left] += 1
            left = left[~over]
    return np.where(n >= k, total, np.nan)


def targets_at(psms: DataFrame, score: str, peptide: list[str], is_decoy: Column, limit: float = 0.01) -> int:
    """How many peptides (their best match each) a score accepts at decoys / targets <= ``limit``."""
    from massloom.operators.confidence import best_per_peptide, score_counts
    from massloom.operators.ordered import running_before, running_extreme

    best = best_per_peptide(psms.withColumn("__decoy", is_decoy), [*peptide, "__decoy"], score)
    before = running_before(score_counts(best, score, F.col("__decoy")), "score", ["targets", "decoys"], descending=True, keep_range=True)
    rated = before.withColumn("fdr", (F.col("decoys_before") + F.col("decoys")) / F.greatest(F.col("targets_before") + F.col("targets"), F.lit(1)))
    rows = running_extreme(rated, "score", "fdr", "q", descending=True)
    return rows.where(F.col("q") <= limit).agg(F.max(F.col("targets_before") + F.col("targets"))).first()[0] or 0


def choose_weights(psms: DataFrame, parts: list[str], peptide: list[str], is_decoy: Column, grid: tuple[float, ...] = (0.25, 1.0, 4.0), limit: float = 0.01) -> tuple[float, ...]:
    """Weights of tailor, rt difference, precursor, fragment and elution (the columns ``parts``) that accept most peptides.

    The first weight stays 1; the others run over the grid one after another, so the jobs grow with their number, not with its power.
    """
    weights = [1.0] * len(parts)
    for k in range(1, len(parts)):
        tried = {}
        for g in grid:
            now = [*weights[:k], g, *weights[k + 1 :]]
            scored = psms.withColumn("__ensemble", ensemble_score(*(F.col(p) for p in parts), weights=tuple(now)))
            tried[g] = targets_at(scored, "__ensemble", peptide, is_decoy, limit)
        weights[k] = max(grid, key=lambda g: (tried[g], -abs(g - 1.0)))
    return tuple(weights)
