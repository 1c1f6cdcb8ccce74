"""Averaged target-decoy competition over ordered ranges of scores, with no task that sees all rows.

Every target competes with each of its decoys; how many it wins are its wins. Going down the target scores, the mean
number of winning targets says how many rows may be held, and where one is too many the row with the fewest wins is given up,
the latest of these first. That pass is a function of a small state, and ranges of scores compose:

* the number held after row i is ``i + min(1, least of (allowed_j + 1 - j) over j <= i)``, a running minimum;
* rows of at most c wins that are held form a queue that never falls below zero, so a range maps its
  length ``L`` to ``max(L + sum, floor)``, for every c;
* a row is given up exactly when the stack of its win count later falls below its place, a running
  minimum from the end.

Each pass is a grouped job over ranges that returns a few numbers a range; these are composed on the driver.
A score that many rows share is a range of its own and is cut by a hash of the key, which stands before the key in the order of ties.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import written

#: Rows meant for a range, the most ranges, and the shares of a score that makes a range of its own.
RANGE_ROWS = 200_000
MOST_RANGES = 2048
SHARES = 64


def atdc_rows(matrix: DataFrame, key: list[str], ascending: bool = False) -> DataFrame:
    """(key, target, s, wins) of every row and (s, n) of every decoy that won; ``s`` falls as scores get better.

    ``matrix`` has ``target`` and ``decoys``, the scores of one target and its decoys. Ties go to the target.
    """
    sign = 1.0 if ascending else -1.0
    rows = matrix.withColumn("s", F.col("target").cast("double") * sign).withColumn("wins", F.size(F.filter("decoys", lambda d: F.col("s") <= d.cast("double") * sign)))
    lost = rows.select(F.explode(F.filter("decoys", lambda d: F.col("s") > d.cast("double") * sign)).alias("d")).groupBy((F.col("d").cast("double") * sign).alias("s")).agg(F.count("d").alias("n"))
    targets = rows.select(*key, "target", "s", "wins", F.lit(0).cast("long").alias("n"), F.xxhash64(*key).alias("h"))
    return targets.unionByName(lost.withColumn("h", F.lit(0).cast("long")), allowMissingColumns=True)


def _placed(rows: DataFrame, ranges: int) -> DataFrame:
    """Append ``zone`` (ranges of ``s``; odd ones hold one score) and ``share`` (parts of an odd zone by hash)."""
    targets = rows.where("wins is not null")
    if ranges > 1:
        at = [k / ranges for k in range(1, ranges)]
        cuts = sorted(set(targets.agg(F.percentile_approx("s", F.array(*map(F.lit, at)), 10_000)).first()[0] or []))
    else:
        cuts = []
    literal = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    below = F.size(F.filter(literal, lambda c: c < F.col("s")))
    zone = 2 * below + F.array_contains(literal, F.col("s")).cast("int")
    hot = F.when((F.col("zone") % 2 == 1) & F.col("wins").isNotNull(), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * SHARES).cast("int")).otherwise(F.lit(0))
    return rows.withColumn("zone", zone).withColumn("share", hot)


class _Range:
    """One share of a zone in order: its targets, and how many targets and decoys have won up to each of them."""

    def __init__(self, pdf: pd.DataFrame, key: list[str], sets: int, start: dict):
        lost = pdf[pdf["wins"].isna()].sort_values("s")
        # the first three columns tell all that the passes count; the key comes with the last pass only
        self.rows = pdf[pdf["wins"].notna()].sort_values(["s", "h", "wins", *key], kind="stable").reset_index(drop=True)
        s, self.wins = self.rows["s"].to_numpy(), self.rows["wins"].to_numpy(dtype=np.int64)
        self.sets, self.index = sets, start["rows"] + np.arange(len(s))
        if start["zone"] % 2:  # one score: all of the zone counts at each row
            self.won, self.lost = (np.full(len(s), start[f"{x}_before"] + start[f"{x}_zone"], dtype=np.int64) for x in ("won", "lost"))
        else:
            self.won = start["won_before"] + np.concatenate([[0], np.cumsum(self.wins)])[np.searchsorted(s, s, side="right")]
            fallen = np.concatenate([[0], np.cumsum(lost["n"].to_numpy(dtype=np.int64))])
            self.lost = start["lost_before"] + fallen[np.searchsorted(lost["s"].to_numpy(), s, side="right")]
        # rows that may be held once a row is in: one more than the largest h with h <= won / sets - 1/2
        self.slack = (2 * self.won - sets) // (2 * sets) + 1 - self.index

    def moves(self, slack: int) -> np.ndarray:
        """[row, level] running sum of what a row adds to the queue of rows with at most ``level`` wins, less what is given up; ``slack`` is the least one before."""
        least = np.minimum.accumulate(np.minimum(self.slack, slack))
        before = np.minimum(1, np.concatenate([[slack], least[:-1]])) - 1
        given_up = np.minimum(1, least) == before
        return np.cumsum((self.wins[:, None] <= np.arange(self.sets + 1)) - given_up[:, None].astype(np.int64), axis=0)

    def heights(self, slack: int, queues: np.ndarray) -> np.ndarray:
        """[row, level] held rows with exactly ``level`` wins, from the queues' lengths before the range; row 0 stands before it."""
        moves = self.moves(slack)
        length = moves - np.minimum(np.minimum.accumulate(moves, axis=0), -queues)
        return np.diff(np.concatenate([queues[None], length]), prepend=0, axis=1)


def _passes(placed: DataFrame, sets: int, start: dict, columns: list[str], schema: str, f: Callable[[_Range, dict], pd.DataFrame], key: list[str]) -> DataFrame:
    """``f`` over every share that holds targets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = (int(pdf["zone"].iloc[0]), int(pdf["share"].iloc[0]))
        mine = start.get(here)
        if mine is None:  # decoys alone
            return pd.DataFrame({c.split()[0].strip("`"): pd.Series(dtype=object) for c in schema.split(", ")})
        out = f(_Range(pdf, key, sets, mine), mine)
        return out.assign(zone=here[0], share=here[1])

    return placed.select("zone", "share", "s", "h", "wins", "n", *columns).groupBy("zone", "share").applyInPandas(run, schema)


def atdc_qvalues(matrix: DataFrame, key: list[str], ascending: bool = False, ranges: int | None = None) -> DataFrame:
    """(key, target, estimate, q_value) by averaged target-decoy competition; no rows for an empty table.

    ``matrix`` has one row for each ``key``, with ``target`` and the array ``decoys``, of one length and without nulls. The estimate at a row is
    (decoys that won down to it + the last rise, 1 to the number of sets) over the number of sets and the rows held so far;
    a q-value is the least estimate here or further down, 1 at most.
    """
    size = matrix.agg(F.count("target").alias("n"), F.max(F.size("decoys")).alias("sets")).first()
    if ranges is None:
        ranges = int(min(MOST_RANGES, 1 + size.n // RANGE_ROWS))
    sets = size.sets or 1
    placed = written(_placed(atdc_rows(matrix, key, ascending), ranges), "averaged")
    totals = placed.groupBy("zone", "share").agg(F.count("wins").alias("rows"), F.coalesce(F.sum("wins"), F.lit(0)).alias("won"), F.sum("n").alias("lost")).orderBy("zone", "share").collect()
    start: dict[tuple[int, int], dict] = {}
    rows, won, lost = 0, 0, 0
    for zone in sorted({t.zone for t in totals}):
        shares = [t for t in totals if t.zone == zone]
        whole = {"won_zone": sum(t.won for t in shares), "lost_zone": sum(t.lost for t in shares)}
        for t in shares:
            if t.rows:
                start[zone, t.share] = {"zone": zone, "rows": rows, "won_before": won, "lost_before": lost, **whole}
                rows += t.rows
        won, lost = won + whole["won_zone"], lost + whole["lost_zone"]

    def collected(schema, f):
        found = _passes(placed, sets, start, [], f"zone int, share int, {schema}", f, []).collect()
        return {(r.zone, r.share): r for r in found}

    first = collected("slack long, lost long", lambda r, _: pd.DataFrame({"slack": [r.slack.min()], "lost": [r.lost[-1]]}))
    slack, last = 1, 0
    for at, mine in start.items():
        mine["slack"], mine["last"] = slack, last
        slack, last = min(slack, first[at].slack), first[at].lost

    def ends(r: _Range, mine: dict) -> pd.DataFrame:
        moves = r.moves(mine["slack"])
        return pd.DataFrame({"sum": [moves[-1].tolist()], "floor": [(moves[-1] - np.minimum(0, moves.min(axis=0))).tolist()]})

    second = collected("sum array<long>, floor array<long>", ends)
    queues = np.zeros(sets + 1, dtype=np.int64)
    for at, mine in start.items():
        mine["queues"] = queues
        queues = np.maximum(queues + np.array(second[at].sum), np.array(second[at].floor))

    def stacks(r: _Range, mine: dict) -> pd.DataFrame:
        heights = r.heights(mine["slack"], mine["queues"])[1:]
        return pd.DataFrame({"least": [heights.min(axis=0).tolist()], "last": [heights[-1].tolist()]})

    third = collected("least array<long>, last array<long>", stacks)
    rest = np.full(sets + 1, np.iinfo(np.int64).max)
    for at, mine in reversed(start.items()):
        mine["rest"] = rest
        mine["held_after"] = int(np.minimum(rest, third[at].last).sum())
        rest = np.minimum(rest, third[at].least)
    held = 0
    for mine in start.values():
        mine["held"] = held
        held = mine["held_after"]

    def estimates(r: _Range, mine: dict) -> pd.DataFrame:
        heights = r.heights(mine["slack"], mine["queues"])
        later = np.minimum(np.minimum.accumulate(heights[:0:-1], axis=0)[::-1], mine["rest"])
        at = np.arange(len(r.wins))
        kept = later[at, r.wins] > heights[at, r.wins]
        rise = np.clip(np.diff(r.lost, prepend=mine["last"]), 1, sets)
        out = r.rows[[*key, "target"]].copy()
        out["estimate"] = (rise + r.lost) / sets / np.maximum(1, mine["held"] + np.cumsum(kept))
        out["place"] = r.index
        return out

    kinds = "".join(f", `{c}` {matrix.schema[c].dataType.simpleString()}" for c in [*key, "target"])
    rated = written(_passes(placed, sets, start, [*key, "target"], f"zone int, share int{kinds}, estimate double, place long", estimates, key), "averaged")
    least = {(r.zone, r.share): r.least for r in rated.groupBy("zone", "share").agg(F.min("estimate").alias("least")).collect()}
    beyond, after = [], 1.0
    for at in reversed(start):
        beyond.append((*at, after))
        after = min(after, least[at])
    spark = matrix.sparkSession
    table = F.broadcast(spark.createDataFrame(beyond, "zone int, share int, beyond double"))  # a row for each range
    from_worst = Window.partitionBy("zone", "share").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    out = rated.join(table, ["zone", "share"]).withColumn("q_value", F.least(F.min("estimate").over(from_worst), "beyond"))
    return out.select(*key, "target", "estimate", "q_value")
