"""Averaged target-decoy competition and posterior error probabilities against plain loops."""

import numpy as np
import pytest

from massloom.operators import averaged, confidence


def loop(target, decoys, order):
    """Estimates of the greedy pass, row by row; larger scores are better."""
    n, sets = decoys.shape
    wins = (target[:, None] >= decoys).sum(axis=1)
    stacks = [[] for _ in range(sets + 1)]
    gone, held = set(), 0
    best = {}
    for i in order:
        best.setdefault(target[i], None)
    total_won = {t: int(wins[target >= t].sum()) for t in best}
    beaten = decoys[decoys > target[:, None]]
    total_lost = {t: int((beaten >= t).sum()) for t in best}
    for i in order:
        stacks[wins[i]].append(i)
        if held <= total_won[target[i]] / sets - 0.5:
            held += 1
        else:
            gone.add(next(s for s in stacks if s).pop())
    out, held, last = {}, 0, 0
    for i in order:
        held += i not in gone
        lost = total_lost[target[i]]
        out[i] = (min(sets, max(1, lost - last)) + lost) / sets / max(1, held)
        last = lost
    least, q = 1.0, {}
    for i in reversed(order):
        least = min(least, out[i])
        q[i] = least
    return out, q


def matrix(spark, n, sets, seed, levels=None):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.6
    target = np.where(good, rng.normal(2, 1, n), rng.normal(0, 1, n))
    decoys = rng.normal(0, 1, (n, sets))
    if levels:  # many ties, one score in a third of the rows
        target, decoys = np.round(target * levels) / levels, np.round(decoys * levels) / levels
        target[rng.random(n) < 0.35] = 0.5
    return target, decoys, spark.createDataFrame([(i, float(t), d.tolist()) for i, (t, d) in enumerate(zip(target, decoys))], "id long, target double, decoys array<double>")


@pytest.mark.parametrize(("n", "sets", "levels"), [(3000, 3, None), (3000, 5, 4), (40, 1, 2)])
def test_averaged_competition_equals_the_loop_however_it_is_cut(spark, n, sets, levels):
    from pyspark.sql import functions as F

    target, decoys, df = matrix(spark, n, sets, n + sets, levels)
    h = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    order = sorted(range(n), key=lambda i: (-target[i], h[i]))
    estimate, q = loop(target, decoys, order)
    for ranges in (1, 20):
        got = {r.id: r for r in averaged.atdc_qvalues(df, ["id"], ranges=ranges).collect()}
        assert len(got) == n
        for i in range(n):
            assert abs(got[i].estimate - estimate[i]) < 1e-12, (ranges, i)
            assert abs(got[i].q_value - q[i]) < 1e-12


def test_posterior_errors_never_fall_and_average_to_the_share_of_decoys(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    n = 20000
    decoy = rng.random(n) < 0.4
    score = np.where(~decoy & (rng.random(n) < 0.7), rng.normal(3, 1, n), rng.normal(0, 1, n)).round(3)
    df = spark.createDataFrame([(float(s), bool(d)) for s, d in zip(score, decoy)] + [(None, False)], "s double, d boolean")
    got = confidence.posterior_errors(df, "s", F.col("d"), out="pep").toPandas()
    assert got["pep"].isna().sum() == 1
    rows = got.dropna().sort_values("s", ascending=False)
    assert (np.diff(rows["pep"]) >= -1e-12).all()
    uncut = confidence.pep_blocks(df, "s", F.col("d"))
    assert [t for _, t, _ in uncut] and sum(t for _, t, _ in uncut) == int((~decoy).sum())
    ratios = [d / t for _, t, d in uncut if t]
    assert ratios == sorted(ratios)
    # at a block's end the mean over the targets is decoys over targets, which is the q-value there
    for worst, *_ in uncut[:-1]:
        above = rows[rows["s"] >= worst]
        targets = above[~above["d"]]
        if len(targets) and targets["pep"].max() < 1:
            assert abs(targets["pep"].mean() - above["d"].sum() / len(targets)) < 1e-9


def test_assign_confidence_averages_over_decoy_sets(spark):
    from massloom.plans.pipelines import assign_confidence

    rng = np.random.default_rng(9)
    rows = []
    for scan in range(300):
        rows.append((scan, 2, float(rng.normal(3 if scan % 2 else 0)), "T", None, False))
        rows.append((scan, 2, -9.0, "U", None, False))  # a worse target of the same spectrum
        rows += [(scan, 2, float(rng.normal()), "D", k, True) for k in range(4)]
    df = spark.createDataFrame(rows, "scan int, charge int, `xcorr score` double, sequence string, `decoy index` int, is_decoy boolean")
    got = assign_confidence(df, method="atdc").toPandas()
    assert len(got) == 300 and set(got["sequence"]) == {"T"}
    ordered = got.sort_values("xcorr score", ascending=False)["atdc q-value"].to_numpy()
    assert (np.diff(ordered) >= -1e-12).all() and ordered[0] < 0.05
    with pytest.raises(ValueError):
        assign_confidence(df.where("not (scan = 3 and `decoy index` = 1)"), method="atdc")
    tdc = assign_confidence(df.drop("decoy index"), method="tdc", pep=True).toPandas()
    assert tdc["PEP"].between(0, 1).all() and {"tdc q-value", "PEP"} <= set(tdc.columns)
