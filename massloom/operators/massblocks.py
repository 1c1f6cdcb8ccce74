"""Spectra against all peptides of their mass, block of masses by block of masses, without a row for each candidate.

The mass axis is cut into blocks. Spectra go to the block of their mass, in chunks of bounded number where a mass is
crowded; an index block goes to every block whose windows reach it, and further up until enough heavier
neighbours are there. Block counts (some thousand numbers) are all that the driver plans with. A task turns its peptides' fragment
bins into one flat array once, scores a spectrum's candidates by a gather and a segmented sum, ranks them, and
gives back the best matches alone, with ranks, deltas and tailor scores that all candidates took part in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.functions.sequence import BIN_OFFSET, BIN_WIDTH, PROTON, RESIDUE_MASS, WATER
from massloom.operators import search as S
from massloom.operators.joins import mass_windows
from massloom.operators.ranking import TAILOR_OFFSET, TAILOR_QUANTILE

#: Width of a block in Da, at least, and the spectra of a chunk.
BLOCK, CHUNK = 2.0, 4000
#: Candidates that a spectrum's tailor score should rest on; heavier neighbours fill up.
MIN_CANDIDATES = 30
MODES = ("xcorr", "exact", "residue-evidence", "combined")


class Peptides:
    """Index rows of one task, by mass, with their fragment bins on end for each charge."""

    def __init__(self, table: pa.Table, static: dict[str, float], width: float, offset: float):
        names = pc.sort_indices(table, [("mass", "ascending"), ("mod_sequence", "ascending"), ("is_decoy", "ascending")])
        self.table = table.take(names).combine_chunks()
        self.mass = self.table["mass"].to_numpy()
        self.decoy = self.table["is_decoy"].to_numpy(zero_copy_only=False)
        # order of ties
        self.tie = np.argsort(np.argsort(self.table["mod_sequence"].to_numpy(zero_copy_only=False), kind="stable"))
        text = self.table["sequence"].to_pylist()
        self.size = np.array([len(t) for t in text], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer("".join(text).encode("ascii", "replace"), dtype=np.uint8)
        by_letter = np.full(256, np.nan)
        for r, m in RESIDUE_MASS.items():
            by_letter[ord(r)] = m + static.get(r, 0.0)
        self.residues = by_letter[self.letters]
        mods = self.table["mods"].combine_chunks()
        if isinstance(mods, pa.ChunkedArray):
            mods = mods.chunk(0) if mods.num_chunks else pa.array([], mods.type)
        flat = mods.flatten()
        if len(flat):
            at = self.first[pc.list_parent_indices(mods).to_numpy()] + flat.field("place").to_numpy()
            np.add.at(self.residues, at, flat.field("delta").to_numpy())
        self.width, self.offset = width, offset
        self.flat: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._cuts: tuple[np.ndarray, np.ndarray] | None = None

    def ions(self) -> tuple[np.ndarray, np.ndarray]:
        """(peptide, mass) of every b and y ion."""
        who, what = [], []
        for n in np.unique(self.size).tolist():
            mine = np.flatnonzero(self.size == n)
            if n < 2:
                continue
            masses = self.residues[self.first[mine][:, None] + np.arange(n)]
            b = np.cumsum(masses, axis=1)[:, :-1]
            who += [np.repeat(mine, n - 1)] * 2
            what += [b.ravel(), (masses.sum(axis=1)[:, None] - b + WATER).ravel()]
        return (np.concatenate(who), np.concatenate(what)) if who else (np.zeros(0, dtype=np.int64), np.zeros(0))

    def bins(self, charge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bins, start of each peptide's, their number): each bin of a peptide once, in order."""
        if charge not in self.flat:
            who, ion = self.ions()
            known = np.isfinite(ion)
            at = np.floor((ion[known] + charge * PROTON) / charge / self.width + 1 - self.offset).astype(np.int64)
            span = int(at.max(initial=0)) + 1
            key = np.unique(who[known] * span + at)
            count = np.bincount(key // span, minlength=len(self.mass))
            self.flat[charge] = key % span, np.cumsum(count) - count, count
        return self.flat[charge]

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """(mass in units of each residue's end, on end; whole mass of each peptide) for the exact distributions."""
        if self._cuts is None:
            step = np.round(np.nan_to_num(self.residues) / S.UNIT_WIDTH).astype(np.int64)
            run = np.cumsum(step)
            before = np.concatenate([[0], run])[self.first]
            self._cuts = run - np.repeat(before, self.size), np.concatenate([[0], run])[self.first + self.size] - before
        return self._cuts


def stretches(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions ``start .. start + count`` of each entry, on end."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def segment_sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of each run of ``count`` values; empty runs give 0."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(count)])])


def xcorr(p: Peptides, at: np.ndarray, evidence: np.ndarray, charge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(summed evidence, bins hit, bins, hits right after one) of peptides ``at``; charges above 2 count doubly charged ions too."""
    total, matched, size, repeat = (np.zeros(len(at)) for _ in range(4))
    for z in (1, 2) if charge > 2 else (1,):
        bins, start, count = p.bins(z)
        count = count[at]
        here = bins[stretches(start[at], count)]
        got = np.where(here < len(evidence), evidence[np.minimum(here, len(evidence) - 1)], 0.0)
        hit = got > 0
        pair = hit.copy()
        pair[1:] &= hit[:-1]
        pair[(np.cumsum(count) - count)[count > 0]] = False
        total += segment_sums(got, count)
        matched += segment_sums(hit, count)
        repeat += segment_sums(pair, count)
        size += count
    return total, matched.astype(np.int64), size.astype(np.int64), repeat.astype(np.int64)


def exact(p: Peptides, at: np.ndarray, null: S.NullScores) -> tuple[np.ndarray, np.ndarray]:
    """(integer evidence, its exact p-value); one table for each whole mass among the candidates."""
    ends, whole = p.units()
    score, chance = np.zeros(len(at)), np.ones(len(at))
    for unit in np.unique(whole[at]).tolist():
        if unit < 1:
            continue
        mine = np.flatnonzero(whole[at] == unit)
        e, tail, low = null.tail(unit)
        count = p.size[at[mine]] - 1
        s = segment_sums(e[np.clip(ends[stretches(p.first[at[mine]], count)], 0, unit)], count)
        place = s + low
        chance[mine] = np.where(place < 0, 1.0, np.where(place < len(tail), tail[np.clip(place, 0, len(tail) - 1)], 0.0))
        score[mine] = s / S.RESCALE
    return score, chance


def residue_evidence(p: Peptides, at: np.ndarray, mz: np.ndarray, intensity: np.ndarray, steps: dict[str, int], weights: dict[str, float], tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(score, p-value) by residue evidence; its matrix and distribution are made once for each whole mass."""
    ends, whole = p.units()
    names = sorted(steps)
    row = np.full(256, -1)
    row[[ord(n) for n in names]] = np.arange(len(names))
    score, chance = np.zeros(len(at)), np.ones(len(at))
    for unit in np.unique(whole[at]).tolist():
        mine = np.flatnonzero(whole[at] == unit)
        grid = np.round(S.residue_evidence(mz, intensity, unit, steps, tolerance) * 10.0).astype(np.int64)
        tail = S.residue_tail(grid, names, steps, weights)
        count = p.size[at[mine]]
        where = stretches(p.first[at[mine]], count)
        letter, end = row[p.letters[where]], ends[where]
        fine = (letter >= 0) & (end <= unit)
        s = segment_sums(np.where(fine, grid[np.maximum(letter, 0), np.minimum(end, unit)], 0), count)
        score[mine] = s / 10.0
        chance[mine] = tail[np.minimum(s, len(tail) - 1)]
    return score, chance


def combined(p: np.ndarray, q: np.ndarray, m: float = 1.2) -> np.ndarray:
    """Chance of a product of two dependent p-values with ``m`` effective ones; ``p`` alone where ``q`` is 0."""
    y = np.power(p * q, m / 2)
    log = -np.log(np.where(y > 0, y, 1.0))
    whole = int(m)
    total = sum(log**i / math.factorial(i) for i in range(whole)) + (m - whole) * log**whole / math.factorial(whole)
    return np.where(q > 0, np.where(y > 0, y * total, 0.0), p)


def ranked(score: np.ndarray, tie: np.ndarray, active: np.ndarray, top: int, ascending: bool) -> dict[str, np.ndarray]:
    """The best ``top`` active candidates of one set: their places, ranks, deltas and tailor scores.

    All candidates, padding included, place the tailor quantile. The last match of ``delta_lcn`` is the ``top``-th or the worst.
    """
    sign = 1.0 if ascending else -1.0
    order = np.lexsort((tie, sign * score))
    n = len(order)
    place = min(max(int(math.floor(TAILOR_QUANTILE * n + 0.5)) - 1, 2), n - 1)
    base = score[order[place]]
    order = order[active[order]]
    x = score[order]
    best, n = order[:top], len(order)
    first = x[: len(best)]
    after = np.append(x[1:], x[-1:])[: len(best)]
    last = x[min(top, n) - 1]
    if ascending:
        low = np.log10(np.maximum([first, after, np.full(len(best), last)], 1e-300))
        cn, lcn = low[1] - low[0], low[2] - low[0]
    else:
        scale = np.maximum(first, 1.0)
        cn, lcn = (first - after) / scale, (first - last) / scale
    return {"at": best, "rank": np.arange(1, len(best) + 1), "cn": cn, "lcn": lcn, "tailor": (first + TAILOR_OFFSET) / (base + TAILOR_OFFSET), "n": np.full(len(best), n)}


def _plan(spectra: DataFrame, index: DataFrame, width: float, min_candidates: int) -> list[tuple[int, int, int]]:
    """(index block, spectrum block, chunks): where each index block has to go."""
    asked = spectra.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).collect()
    counts = {r.block: r.n for r in index.groupBy(F.floor(F.col("mass") / width).cast("int").alias("block")).agg(F.count("*").alias("n")).collect()}
    blocks = sorted(counts)
    out = []
    for a in asked:
        last, spare = math.floor(a.hi / width), 0
        for b in blocks:
            if b < math.floor(a.lo / width):
                continue
            # the block of the upper bound may hold all its peptides below it, so it does not count as spare
            if b > last and spare >= min_candidates:
                break
            out.append((b, a.block, max(1, -(-a.n // CHUNK))))
            spare += counts[b] if b > last else 0
    return out


def search_blocks(
    spectra: DataFrame, index: DataFrame, kind: str = "ppm", window: float = 50.0, isotopes: tuple[int, ...] = (0,), top_match: int = 5, static: dict[str, float] | None = None,
    separate: bool = True, score: str = "xcorr", min_candidates: int = MIN_CANDIDATES, width: float = BIN_WIDTH, offset: float = BIN_OFFSET, remove_precursor: float | None = None,
    flanks: bool = False, losses: bool = False, tolerance: float = 0.02, block: float = BLOCK,
) -> DataFrame:
    """The best ``top_match`` index rows of every spectrum with ranks, deltas and tailor scores; see ``search``.

    ``score`` is ``xcorr``, ``exact`` (p-value of the rounded evidence), ``residue-evidence`` (p-value) or ``combined`` (of both); matches are ranked by it. Spectra without
    candidates give no rows; one with fewer than ``min_candidates`` has heavier neighbours take part in the tailor quantile.
    """
    if score not in MODES:
        raise ValueError(f"unknown score {score!r}")
    static = dict(static or {})
    asked = mass_windows(spectra.withColumn("spec_id", F.xxhash64("file", "scan", "charge")), kind, window, isotopes=isotopes)
    asked = asked.withColumn("lo", F.array_min(F.transform("windows", lambda w: w["lo"]))).withColumn("hi", F.array_max(F.transform("windows", lambda w: w["hi"])))
    asked = asked.withColumn("block", F.floor(F.col("neutral_mass") / block).cast("int"))
    plan = _plan(asked, index, block, min_candidates)
    spark = spectra.sparkSession
    where = spark.createDataFrame(plan, "index_block int, block int, chunks int")  # block counts bound its size
    chunks = where.groupBy("block").agg(F.max("chunks").alias("chunks"))
    left = asked.join(F.broadcast(chunks), "block").withColumn("chunk", F.pmod(F.col("spec_id"), F.col("chunks")).cast("int"))
    left = left.select("block", "chunk", "spec_id", "file", "scan", "charge", "precursor_mz", "neutral_mass", "mz", "intensity", "windows")
    names = index.columns
    right = index.withColumn("__b", F.floor(F.col("mass") / block).cast("int")).join(F.broadcast(where), F.col("__b") == F.col("index_block"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "chunk", *(f"`{c}`" for c in names))
    weights = _frequencies(index) if score != "xcorr" else {}
    steps = {r: max(1, int(round((RESIDUE_MASS[r] + static.get(r, 0.0)) / S.UNIT_WIDTH))) for r in weights}
    ascending = score != "xcorr"
    fields = {"xcorr": [], "exact": ["refactored xcorr", "exact p-value"], "residue-evidence": ["res-ev score", "res-ev p-value"], "combined": ["refactored xcorr", "exact p-value", "res-ev score", "res-ev p-value", "combined p-value"]}[score]
    info = ["spec_id", "file", "scan", "charge", "precursor_mz", "neutral_mass"]
    kept = [f for f in index.schema.fields]
    schema = T.StructType([
        *(T.StructField("peptide mass" if f.name == "mass" else f.name, f.dataType) for f in kept), *(left.schema[c] for c in info[:4]),
        T.StructField("spectrum precursor m/z", T.DoubleType()), T.StructField("spectrum neutral mass", T.DoubleType()),
        *(T.StructField(c, T.DoubleType()) for c in ("xcorr score", "sp score", *fields, "tailor score", "delta_cn", "delta_lcn")),
        *(T.StructField(c, T.IntegerType()) for c in ("xcorr rank", "sp rank", "b/y ions matched", "b/y ions total", "b/y ion repeat match")), T.StructField("distinct matches/spectrum", T.LongType()),
    ])
    numbers = [f.name for f in schema.fields[len(kept) + len(info) :]]

    def run(spectra: pa.Table, peptides: pa.Table) -> pa.Table:
        p = Peptides(peptides, static, width, offset)
        picked, who, values = [], [], {c: [] for c in numbers}
        # spectra without candidates give no rows, so they are left out before any becomes Python objects
        asked, many = pc.list_flatten(spectra["windows"]).combine_chunks(), pc.list_value_length(spectra["windows"]).to_numpy()
        met = np.searchsorted(p.mass, asked.field("hi").to_numpy(), side="right") > np.searchsorted(p.mass, asked.field("lo").to_numpy(), side="left")
        spectra = spectra.filter(pa.array(np.bincount(np.repeat(np.arange(len(many)), many), weights=met, minlength=len(many)) > 0))
        for k, one in enumerate(spectra.to_pylist()):
            spans = [(np.searchsorted(p.mass, w["lo"], side="left"), np.searchsorted(p.mass, w["hi"], side="right")) for w in one["windows"]]
            at = np.unique(np.concatenate([np.arange(a, b) for a, b in spans]))
            if not len(at):
                continue
            n_active = len(at)
            if n_active < min_candidates:
                top = max(b for _, b in spans)
                at = np.concatenate([at, np.arange(top, min(len(p.mass), top + min_candidates - n_active))])
            active = np.arange(len(at)) < n_active
            mz, intensity = np.array(one["mz"]), np.array(one["intensity"])
            evidence = S.preprocess(mz, intensity, one["precursor_mz"], one["charge"], width, offset, remove_precursor, flanks=flanks, losses=losses)
            total, matched, size, repeat = xcorr(p, at, evidence, one["charge"])
            more = {"xcorr score": total / S.SCALE, "b/y ions matched": matched, "b/y ions total": size, "b/y ion repeat match": repeat}
            plain = S.preprocess(mz, intensity, one["precursor_mz"], one["charge"], width, offset, stop_after="ten-bin") / S.TOP * 100
            lit, hits, ions, rep = xcorr(p, at, plain, one["charge"])
            more["sp score"] = np.where(ions > 0, lit * hits * (1 + 0.075 * rep) / np.maximum(ions, 1), 0.0)
            if score in ("exact", "combined"):
                null = S.NullScores(mz, intensity, one["precursor_mz"], one["charge"], static, weights)
                more["refactored xcorr"], more["exact p-value"] = exact(p, at, null)
            if score in ("residue-evidence", "combined"):
                more["res-ev score"], more["res-ev p-value"] = residue_evidence(p, at, mz, intensity, steps, weights, tolerance)
            if score == "combined":
                more["combined p-value"] = combined(more["exact p-value"], more["res-ev p-value"])
            by = more[{"xcorr": "xcorr score", "exact": "exact p-value", "residue-evidence": "res-ev p-value", "combined": "combined p-value"}[score]]
            for kind_ in (False, True) if separate else (None,):
                mine = np.flatnonzero(p.decoy[at] == kind_) if separate else np.arange(len(at))
                if not active[mine].any():
                    continue
                tie = p.tie[at[mine]]
                got = ranked(by[mine], tie, active[mine], top_match, ascending)
                if ascending:  # the tailor score is one of XCorr
                    got["tailor"] = _tailor(more["xcorr score"][mine])[got["at"]]
                sp = np.empty(len(mine), dtype=np.int64)
                on = np.flatnonzero(active[mine])
                sp[on[np.lexsort((tie[on], -more["sp score"][mine][on]))]] = np.arange(1, len(on) + 1)
                best = mine[got["at"]]
                picked.append(at[best])
                who.append(np.full(len(best), k))
                for c in more:
                    values[c].append(more[c][best])
                for c, key in (("tailor score", "tailor"), ("delta_cn", "cn"), ("delta_lcn", "lcn"), ("xcorr rank", "rank"), ("distinct matches/spectrum", "n")):
                    values[c].append(got[key])
                values["sp rank"].append(sp[got["at"]])
        if not picked:
            return pa.Table.from_pylist([], schema=arrow)
        take, from_ = pa.array(np.concatenate(picked)), pa.array(np.concatenate(who))
        columns = [p.table[f.name].take(take) for f in kept] + [spectra[c].take(from_) for c in info]
        columns += [pa.array(np.concatenate(values[c])) for c in numbers]
        return pa.Table.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, schema)


def _tailor(scores: np.ndarray) -> np.ndarray:
    n = len(scores)
    place = min(max(int(math.floor(TAILOR_QUANTILE * n + 0.5)) - 1, 2), n - 1)
    return (scores + TAILOR_OFFSET) / (np.sort(scores)[::-1][place] + TAILOR_OFFSET)


def _frequencies(index: DataFrame) -> dict[str, float]:
    """Counts of the residues of the index's targets."""
    letters = index.where(~F.col("is_decoy")).select(F.explode(F.split("sequence", "")).alias("r"))
    return {r.r: float(r.n) for r in letters.groupBy("r").agg(F.count("*").alias("n")).collect() if r.r in RESIDUE_MASS}
