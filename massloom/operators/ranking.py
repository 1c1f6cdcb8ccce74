"""Per-spectrum ranks, top-N, delta scores and tailor calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAILOR_OFFSET = 5.0
TAILOR_QUANTILE = 0.01


def _order(score: str, ascending: bool) -> Column:
    return F.col(f"`{score}`").asc_nulls_last() if ascending else F.col(f"`{score}`").desc_nulls_last()


def dense_ranks(psms: DataFrame, by: list[str], score: str, ascending: bool = False, out: str = "rank") -> DataFrame:
    """Rank matches of a spectrum; equal scores share a rank and leave no gap."""
    return psms.withColumn(out, F.dense_rank().over(Window.partitionBy(*by).orderBy(_order(score, ascending))))


def row_ranks(psms: DataFrame, by: list[str], score: str, tie: list[str] = (), ascending: bool = False, out: str = "sp_rank") -> DataFrame:
    """Number matches of a spectrum one by one."""
    return psms.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(_order(score, ascending), *tie)))


def top_n(psms: DataFrame, by: list[str], score: str, n: int, tie: list[str] = (), ascending: bool = False, out: str = "rank") -> DataFrame:
    """The ``n`` best matches of each spectrum; Spark limits groups before the shuffle."""
    return row_ranks(psms, by, score, tie, ascending, out).where(F.col(out) <= n)


def delta_scores(psms: DataFrame, by: list[str], score: str, top: int = 5, tie: list[str] = (), p_value: bool = False, gathered: bool = False) -> DataFrame:
    """Append ``delta_cn`` (to the next match) and ``delta_lcn`` (to the last one).

    The last is the ``top``-th match or the worst, whichever comes first. With ``gathered`` the set holds one match more
    than is reported, and the last is that before it when the set is larger than ``top``.
    """
    w = Window.partitionBy(*by).orderBy(_order(score, p_value), *tie)
    whole = Window.partitionBy(*by)
    rows = psms.withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count("*").over(whole)).withColumn("__next", F.lead(score).over(w))
    at = F.when(F.col("__all") > top, F.col("__all") - 1).otherwise(F.col("__all")) if gathered else F.least(F.lit(top), F.col("__all"))
    rows = rows.withColumn("__last", F.max(F.when(F.col("__n") == at, F.col(score))).over(whole))
    x, y, z = F.col(score), F.col("__next"), F.col("__last")
    if p_value:
        cn, lcn = F.log10(y) - F.log10(x), F.log10(z) - F.log10(x)
    else:
        scale = F.greatest(x, F.lit(1.0))
        cn, lcn = (x - y) / scale, (x - z) / scale
    return rows.withColumn("delta_cn", F.coalesce(cn, F.lit(0.0))).withColumn("delta_lcn", lcn).drop("__n", "__all", "__next", "__last")


def tailor_scores(psms: DataFrame, by: list[str], score: str, tie: list[str] = (), out: str = "tailor_score") -> DataFrame:
    """(x + 5) / (q + 5), with q the score at the spectrum's 1 % position, the third at least.

    All rows of a spectrum count, inactive padding included.
    """
    w = Window.partitionBy(*by).orderBy(_order(score, False), *tie)
    whole = Window.partitionBy(*by)
    rows = psms.withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count("*").over(whole))
    place = F.least(F.greatest(F.floor(F.lit(TAILOR_QUANTILE) * F.col("__all") + 0.5) - 1, F.lit(2)), F.col("__all") - 1)
    q = F.max(F.when(F.col("__n") == place + 1, F.col(score))).over(whole)
    return rows.withColumn(out, (F.col(score) + TAILOR_OFFSET) / (q + TAILOR_OFFSET)).drop("__n", "__all")


def gaps_and_islands(rows: DataFrame, by: list[str], position: str, allowed: int = 1, out: str = "island") -> DataFrame:
    """Number the runs of ``position`` (integers) whose members miss at most ``allowed`` places in between."""
    w = Window.partitionBy(*by).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(w) > allowed + 1, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def scaled_position(values: DataFrame, value: str, quantiles: tuple[float, ...]) -> list[float]:
    """Values at the positions int(q * n + 0.5) of the ascending order, the last at most.

    A count per distinct value and its running total find them exactly without one sorted task.
    """
    from massloom.operators.ordered import running_before

    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = values.agg(F.count(value)).first()[0]
    if not total:
        return [float("nan")] * len(quantiles)
    before = running_before(counts, "v", ["n"], descending=False)
    want = [min(int(q * total + 0.5), total - 1) for q in quantiles]
    rows = before.agg(*(F.max(F.when((F.col("n_before") <= k) & (F.lit(k) < F.col("n_before") + F.col("n")), F.col("v"))).alias(f"q{i}") for i, k in enumerate(want))).first()
    return list(rows)


def robust_scale(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Scale each column by its values at two quantiles; NaN and null become 0, a flat column stays."""
    for c in columns:
        fine = F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c))
        rows = rows.withColumn(c, fine)
        a, b = scaled_position(rows, c, (low, high))
        if b - a > 1e-12:
            rows = rows.withColumn(c, (F.col(c) - a) / (b - a))
    return rows
