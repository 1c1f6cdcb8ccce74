"""Running totals over one global order without a single-task window.

A window without ``partitionBy`` runs in one task. Here the order key (made distinct by
grouping first) is cut at approximate quantiles into ranges; each range is windowed on its
own and shifted by the totals of the ranges before it, a table of a few hundred rows. The
input is written first, since its quantiles, its totals and its rows are each read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.session import written

RANGES = 256
#: Below this many keys one range is enough.
SMALL = 200_000


def with_range(df: DataFrame, key: str, rows: int | None = None, ranges: int = RANGES) -> DataFrame:
    """Append ``__range``, a number that grows with ``key`` (null for a null key)."""
    if rows is None or rows > SMALL:
        at = [k / ranges for k in range(1, ranges)]
        seen = df.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), 10_000).alias("q"), F.count(key).alias("n")).first()
        cuts = sorted({c for c in seen.q or []}) if seen.n > SMALL else []
    else:
        cuts = []
    if not cuts:
        return df.withColumn("__range", F.when(F.col(key).isNotNull(), F.lit(0)))
    # two short searches: whole blocks of cuts below the key, then cuts within the next block
    size = math.isqrt(len(cuts)) + 1
    blocks = [cuts[k : k + size] for k in range(0, len(cuts) + 1, size)]
    below = lambda known: F.size(F.filter(known, lambda c: c < F.col(key)))
    listed = lambda some: F.array(*map(F.lit, some)).cast(T.ArrayType(df.schema[key].dataType))
    full = below(listed([b[-1] for b in blocks if len(b) == size]))
    within = below(F.element_at(F.array(*map(listed, blocks)), F.col("__range") + 1))
    return df.withColumn("__range", F.when(F.col(key).isNotNull(), full)).withColumn("__range", F.col("__range") * size + within)


def running_before(df: DataFrame, key: str, sums: Iterable[str], descending: bool, keep_range: bool = False) -> DataFrame:
    """Append ``<c>_before`` for each column c of ``sums``: its total over strictly better keys.

    ``key`` must be distinct in ``df``. Better is larger where ``descending``. Rows with a null key come last. With ``keep_range`` the column ``__range`` stays, which
    ``running_extreme`` goes by instead of writing and cutting the rows again.
    """
    ranged = with_range(written(df, "ordered"), key)
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    rank = F.col("__range").desc_nulls_last() if descending else F.col("__range").asc_nulls_last()
    totals = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    ahead = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__t_{c}").over(ahead), F.lit(0)).alias(f"__o_{c}") for c in sums))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(offsets), ranged["__range"].eqNullSafe(offsets["__range"])).drop(offsets["__range"])
    out = joined.select("*", *((F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__o_{c}")).alias(f"{c}_before") for c in sums))
    return out.drop(*([] if keep_range else ["__range"]), *(f"__o_{c}" for c in sums))


def running_extreme(df: DataFrame, key: str, value: str, out: str, descending: bool, from_worst: bool = True) -> DataFrame:
    """Append the least ``value`` from each key on to the worst key (or from the best key up to it)."""
    ranged = df if "__range" in df.columns else with_range(written(df, "ordered"), key)
    best_first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    rank = F.col("__range").desc_nulls_last() if descending else F.col("__range").asc_nulls_last()
    frame = (1, Window.unboundedFollowing) if from_worst else (Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(F.min(value).alias("__m"))
    others = totals.select("__range", F.min("__m").over(Window.orderBy(rank).rowsBetween(*frame)).alias("__rest"))  # one row for each range
    joined = ranged.join(F.broadcast(others), ranged["__range"].eqNullSafe(others["__range"])).drop(others["__range"])
    # frames that end at the current row cost one step a row; those that begin there cost the rest of the range
    worst_first = F.col(key).asc_nulls_first() if descending else F.col(key).desc_nulls_first()
    within = Window.partitionBy("__range").orderBy(worst_first if from_worst else best_first).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.min(value).over(within)
    return joined.withColumn(out, F.least(mine, "__rest")).drop("__range", "__rest")


def numbered(df: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """Append ``out``, the place of each row of a group by ``key``, from 0 on; rows with a null group or key go. No group is sorted in one task."""
    ranged = with_range(written(df, "ordered"), key)
    counts = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a group
    offsets = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__o"))
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(key)) - 1 + F.col("__o")
    return ranged.join(offsets, [*by, "__range"]).withColumn(out, place).drop("__range", "__o")
