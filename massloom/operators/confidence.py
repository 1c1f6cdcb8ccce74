"""Target-decoy statistics: competition, q-values, peptide-level filtering, Sidak adjustment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.operators.ordered import RANGES, running_before, running_extreme, with_range
from massloom.session import written

#: Whether a larger score is better, in the order in which a score is looked for.
SCORES = {
    "tailor score": True,
    "xcorr score": True,
    "e-value": False,
    "combined p-value": False,
    "res-ev p-value": False,
    "res-ev score": True,
    "exact p-value": False,
    "smoothed p-value": False,
    "percolator score": True,
    "sp score": True,
    "refactored xcorr": True,
}


def detect_score(psms: DataFrame) -> str:
    """The first known score column of ``psms`` that is not wholly null."""
    have = [s for s in SCORES if s in psms.columns]
    if not have:
        raise ValueError("no known score column")
    seen = psms.agg(*(F.count(f"`{s}`").alias(s) for s in have)).first()
    return next((s for s in have if seen[s]), have[0])


def competition(psms: DataFrame, key: list[str], is_decoy: Column, order: list[Column], better: Column) -> DataFrame:
    """Target-decoy competition: for each key, the best target against the best decoy.

    Of several decoys of a key the first in ``order`` counts. ``better`` compares the columns
    ``t`` and ``d`` (structs of the rows, ``d`` null where a target has no decoy). Returns the winners with
    ``is_decoy``.
    """
    marked = psms.withColumn("__decoy", is_decoy)
    first = Window.partitionBy(*key, "__decoy").orderBy(*order)
    best = marked.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    names = psms.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    # one shuffle on the key gives both sides of the join
    sides = best.groupBy(*key).agg(F.max(F.when(~F.col("__decoy"), row)).alias("t"), F.max(F.when(F.col("__decoy"), row)).alias("d")).where("t is not null")
    won = F.when(F.col("d").isNull() | better, F.struct(F.col("t").alias("row"), F.lit(False).alias("is_decoy"))).otherwise(F.struct(F.col("d").alias("row"), F.lit(True).alias("is_decoy")))
    return sides.select(won.alias("w")).select("w.row.*", "w.is_decoy")


def score_counts(psms: DataFrame, score: str, is_decoy: Column) -> DataFrame:
    """(score, targets, decoys) for every distinct score; map-side combined."""
    return psms.groupBy(F.col(f"`{score}`").alias("score")).agg(F.count_if(~is_decoy).alias("targets"), F.count_if(is_decoy).alias("decoys"))


def tdc_table(psms: DataFrame, score: str, is_decoy: Column, ascending: bool = False) -> DataFrame:
    """(score, q) of every distinct target score by target-decoy competition.

    The estimate at a score is (decoys strictly better + 1) / (targets strictly better + 1), 1 at
    most; a q-value is the least estimate at this or a worse score.
    """
    counts = score_counts(psms, score, is_decoy)
    before = running_before(counts, "score", ["targets", "decoys"], descending=not ascending, keep_range=True)
    fdr = F.least(F.lit(1.0), (F.col("decoys_before") + 1) / (F.col("targets_before") + 1))
    rated = before.where("targets > 0").withColumn("fdr", fdr)
    return running_extreme(rated, "score", "fdr", "q", descending=not ascending).select("score", "q")


def tdc_qvalues(psms: DataFrame, score: str, is_decoy: Column, ascending: bool = False, out: str = "q_value") -> DataFrame:
    """Targets with their q-values. Null scores have none."""
    table = tdc_table(psms.where(F.col(f"`{score}`").isNotNull()), score, is_decoy, ascending)
    targets = psms.where(~is_decoy)
    return targets.join(table.withColumnsRenamed({"score": "__score", "q": out}), F.col(f"`{score}`") == F.col("__score"), "left").drop("__score")


def decoy_counts(psms: DataFrame, q: str, is_decoy: Column, thresholds=(0.01, 0.05, 0.1)) -> DataFrame:
    """How many targets reach each threshold."""
    return psms.agg(*(F.count_if(~is_decoy & (F.col(q) <= t)).alias(f"at_{round(t * 100)}_percent") for t in thresholds))


def mixmax_counts(psms: DataFrame, score: str, is_decoy: Column, ascending: bool = False) -> DataFrame:
    """(score, targets, decoys, n_w_ge, n_z_ge): rows at this or a better score, targets w and decoys z."""
    before = running_before(score_counts(psms, score, is_decoy), "score", ["targets", "decoys"], descending=not ascending)
    return before.select("score", "targets", "decoys", (F.col("targets_before") + F.col("targets")).alias("n_w_ge"), (F.col("decoys_before") + F.col("decoys")).alias("n_z_ge"))


def mixmax_table(psms: DataFrame, score: str, is_decoy: Column, pi0: float, ascending: bool = False) -> DataFrame:
    """(score, q) by the mix-max procedure with a given share of null targets.

    Each decoy z adds the chance that a false target was beaten by its own decoy, estimated from
    the targets and decoys no better than z and clipped to [0, 1].
    """
    if not 0 < pi0 < 1:
        raise ValueError("pi0 must lie between 0 and 1")
    counts = mixmax_counts(psms, score, is_decoy, ascending)
    counts = written(counts, "mixmax")
    total = counts.agg(F.coalesce(F.sum("targets"), F.lit(0)).alias("w"), F.coalesce(F.sum("decoys"), F.lit(0)).alias("z")).first()
    # rows no better than z: all but the strictly better ones, the ties of z included
    w_le = F.lit(total.w) - (F.col("n_w_ge") - F.col("targets"))
    z_le = F.lit(total.z) - (F.col("n_z_ge") - F.col("decoys"))
    share = (w_le - pi0 * z_le) / ((1 - pi0) * z_le)
    # within a tie group of decoys, every decoy but the worst placed uses the same counts
    weight = F.when(F.col("decoys") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * (1 - pi0) * F.col("decoys")).otherwise(F.lit(0.0))
    grown = running_before(counts.withColumn("e", weight), "score", ["e"], descending=not ascending, keep_range=True)
    fdr = F.least(F.lit(1.0), (F.col("n_z_ge") * pi0 + F.col("e_before") + F.col("e")) / F.col("n_w_ge"))
    rated = grown.where("targets > 0").withColumn("fdr", fdr)
    return running_extreme(rated, "score", "fdr", "q", descending=not ascending).select("score", "q")


def fdr_to_q(rows: DataFrame, score: str, fdr: str, descending: bool = True, out: str = "q_value") -> DataFrame:
    """q-values from estimates: the least ``fdr`` at this or a worse ``score`` (distinct)."""
    return running_extreme(rows, score, fdr, out, descending)


def storey_pi0(p_values: DataFrame, p: str, lam: float = 0.5) -> float:
    """Share of null hypotheses by Storey's estimator, 1 at most."""
    seen = p_values.agg(F.count(p).alias("n"), F.count_if(F.col(p) > lam).alias("above")).first()
    return min(1.0, seen.above / (seen.n * (1 - lam))) if seen.n else 1.0


def decoy_pi0(psms: DataFrame, score: str, is_decoy: Column, ascending: bool = False, lam: float = 0.5) -> float:
    """Storey's estimator on the targets' p-values by decoys: the share of decoys at this or a better score."""
    counts = mixmax_counts(psms, score, is_decoy, ascending)
    total = psms.agg(F.count_if(~is_decoy).alias("w"), F.count_if(is_decoy).alias("z")).first()
    above = counts.agg(F.sum(F.when(F.col("n_z_ge") > lam * total.z, F.col("targets")))).first()[0] or 0
    return min(1.0, above / (total.w * (1 - lam))) if total.w and total.z else 1.0


def sidak(p: Column, n: Column) -> Column:
    """Adjust the best of ``n`` p-values: 1 - (1 - p)^n."""
    return 1 - F.pow(1 - p, n)


def best_per_peptide(psms: DataFrame, peptide: list[str], score: str, ascending: bool = False, tie: list[str] = ()) -> DataFrame:
    """One row for each peptide, its best score; ties go by the columns ``tie``."""
    order = F.col(f"`{score}`").asc_nulls_last() if ascending else F.col(f"`{score}`").desc_nulls_last()
    w = Window.partitionBy(*peptide).orderBy(order, *tie)
    return psms.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def atdc_matrix(psms: DataFrame, key: list[str], score: str, decoy_index: str) -> DataFrame:
    """(key, target, decoys): the target's score and those of its n decoys by index; checked to be complete."""
    wide = psms.groupBy(*key).agg(
        F.count_if(F.col(f"`{decoy_index}`").isNull()).alias("__t"),
        F.max(F.when(F.col(f"`{decoy_index}`").isNull(), F.col(f"`{score}`"))).alias("target"),
        F.sort_array(F.collect_list(F.when(F.col(f"`{decoy_index}`").isNotNull(), F.struct(F.col(f"`{decoy_index}`").alias("i"), F.col(f"`{score}`").alias("s"))))).alias("__d"),
    )
    sizes = wide.agg(F.min("__t").alias("a"), F.max("__t").alias("b"), F.min(F.size("__d")).alias("c"), F.max(F.size("__d")).alias("d")).first()
    if sizes.a is not None and (sizes.a != 1 or sizes.b != 1 or sizes.c != sizes.d):
        raise ValueError("every key needs one target and the same number of decoys")
    return wide.select(*key, "target", F.transform("__d", lambda x: x["s"]).alias("decoys"))


#: Ranges whose blocks one task pools at each level of ``pep_table``.
FAN_IN = 16


def pooled(targets: np.ndarray, decoys: np.ndarray) -> np.ndarray:
    """First entries of the blocks in which adjacent counts, best first, are pooled until decoys over targets never fall.

    Pooling blocks again with those of neighbours gives what pooling all counts at once gives.
    """
    first: list[int] = []
    t: list[int] = []
    d: list[int] = []
    for k, (x, y) in enumerate(zip(targets.tolist(), decoys.tolist(), strict=True)):
        begin = k
        while first and d[-1] * x >= y * t[-1]:
            begin, x, y = first.pop(), x + t.pop(), y + d.pop()
        first.append(begin)
        t.append(x)
        d.append(y)
    return np.array(first, dtype=np.int64)


def pep_blocks(psms: DataFrame, score: str, is_decoy: Column, ascending: bool = False) -> list[tuple[float, int, int]]:
    """(worst score, targets, decoys) of each block, best first.

    Counts per distinct score are pooled in ranges of scores, ranges by sixteens until one is left; the blocks of
    T targets and D decoys differ in their ratio, so there are at most some (T D)^(1/3) of them. Null scores take no part.
    """
    counts = written(score_counts(psms.where(F.col(f"`{score}`").isNotNull()), score, is_decoy), "scores")
    blocks = with_range(counts.withColumn("best", F.col("score")), "score").withColumnRenamed("__range", "r")

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("best", ascending=ascending).reset_index(drop=True)
        first = pooled(pdf["targets"].to_numpy(), pdf["decoys"].to_numpy())
        last = np.append(first[1:], len(pdf)) - 1
        sums = {c: np.add.reduceat(pdf[c].to_numpy(), first) for c in ("targets", "decoys")}
        return pd.DataFrame({"r": pdf["r"].iloc[0] // FAN_IN, "best": pdf["best"].to_numpy()[first], "score": pdf["score"].to_numpy()[last], **sums})

    kind = counts.schema["score"].dataType.simpleString()
    left = RANGES
    while left:
        blocks = blocks.groupBy("r").applyInPandas(pool, f"r int, best {kind}, score {kind}, targets long, decoys long")
        left //= FAN_IN
    found = blocks.groupBy().agg(F.collect_list(F.struct("best", "score", "targets", "decoys")).alias("b")).first().b
    return [(b.score, b.targets, b.decoys) for b in sorted(found, key=lambda b: b.best, reverse=not ascending)]


def posterior_errors(psms: DataFrame, score: str, is_decoy: Column, ascending: bool = False, pi0: float | None = None, out: str = "PEP") -> DataFrame:
    """Append each row's posterior error probability, which never falls as scores get worse; null for a null score.

    It is the pooled ratio of decoys to targets, 1 at most. With ``pi0``, the share of null targets among matches that did not
    compete, it is scaled by ``pi0`` and the number of targets over that of decoys; without, the rows are winners of a competition. The mean over the targets of a block and all
    better ones is the share of decoys among them.
    """
    blocks = pep_blocks(psms, score, is_decoy, ascending)
    targets, decoys = sum(b[1] for b in blocks), sum(b[2] for b in blocks)
    factor = 1.0 if pi0 is None else pi0 * targets / max(1, decoys)
    sign = 1.0 if ascending else -1.0
    worst = np.array([sign * float(b[0]) for b in blocks])
    value = np.array([min(1.0, factor * b[2] / b[1]) if b[1] else 1.0 for b in blocks])

    @F.pandas_udf("double")
    def looked_up(s: pd.Series) -> pd.Series:
        found = np.searchsorted(worst, sign * s.to_numpy(dtype=float), side="left")
        return pd.Series(np.where(s.isna(), np.nan, value[np.minimum(found, len(value) - 1)] if len(value) else np.nan)).astype(object).where(s.notna(), None)

    return psms.withColumn(out, looked_up(F.col(f"`{score}`").cast("double")))
