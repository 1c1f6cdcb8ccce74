"""Guards, lists of inputs, peaks by region and SQL functions."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from massloom.functions import register
from massloom.functions import sequence as S
from massloom.operators import counting, digestion
from massloom.sources import psms, spectra


def test_functions_for_sql_text(spark):
    names = register.register(spark)
    assert set(names) >= {"peptide_mass", "mass2bin", "tryptic_peptides"}
    df = spark.createDataFrame([("AGK", 500.25, 2), ("AXB", 700.5, 3), ("", 10.0, 1)], "s string, m double, z int")
    df.createOrReplaceTempView("small_rows")
    got = spark.sql("SELECT peptide_mass(s) AS a, mass2bin(m, z) AS b, bin2mass(mass2bin(m, z), z) AS c, to_mz(m, z) AS d, neutral_mass(m, z) AS e FROM small_rows").collect()
    want = df.select(S.peptide_mass(F.col("s")).alias("a"), S.mass2bin(F.col("m"), F.col("z")).alias("b"), S.bin2mass(S.mass2bin(F.col("m"), F.col("z")), F.col("z")).alias("c"), S.to_mz(F.col("m"), F.col("z")).alias("d"), S.to_mass(F.col("m"), F.col("z")).alias("e")).collect()
    for g, w in zip(got, want):
        assert [x if x is None else round(x, 9) for x in g] == [x if x is None else round(x, 9) for x in w]
    assert spark.sql("SELECT tryptic_peptides('MKAKPRGG') AS p, plain_sequence('AC[57.02]K') AS q").first() == (["MK", "AKPR", "GG"], "ACK")
    plan = spark.sql("SELECT peptide_mass(s) FROM small_rows")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_guards(spark):
    proteins = spark.createDataFrame([("p", "MK")], "protein_id string, residues string")
    assert digestion.guard_decoys(proteins).count() == 1
    with pytest.raises(ValueError):
        digestion.guard_decoys(proteins.unionByName(spark.createDataFrame([("decoy_p", "KM")], proteins.schema)))
    scores = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "protein string, score double")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        counting.check_normalised(scores)
    with pytest.warns(UserWarning):
        counting.check_normalised(scores.where("protein = 'a'"))


def test_lists_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("scan\tcharge\tsequence\tprotein id\txcorr score\n1\t2\tAK\tp\t0.5\n")
    (tmp_path / "b.txt").write_text("scan\tcharge\tsequence\tprotein id\n2\t2\tGK\tp\n")
    (tmp_path / "list").write_text(f"a.txt # first\n\n{tmp_path}/b.txt\n")
    assert psms.expand_inputs(spark, "x.txt") == ["x.txt"] and psms.expand_inputs(spark, str(tmp_path / "list"), True) == [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"]
    got = {r.scan: r["xcorr score"] for r in psms.read_psm_lists(spark, str(tmp_path / "list")).collect()}
    assert got == {1: 0.5, 2: None}
    (tmp_path / "none").write_text("# nothing\n")
    with pytest.raises(ValueError):
        psms.expand_inputs(spark, str(tmp_path / "none"), True)


def test_top_peaks_of_each_region(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 5.0, 9.0, 10.0], [5.0, 7.0, 6.0, 1.0, 2.0, 2.0]), (2, [], []), (3, [4.0], [1.0])], "scan int, mz array<double>, intensity array<double>")
    got = {r.scan: (r.mz, r.intensity) for r in spectra.top_per_region(df, 2, 2).collect()}
    assert got == {1: ([1.0, 2.0, 9.0, 10.0], [7.0, 6.0, 2.0, 2.0]), 2: ([], []), 3: ([4.0], [1.0])}


def test_ranks_of_a_set_that_many_proteins_share(spark):
    # with a copy of the members for each of them this was 3.2 billion values
    pairs = spark.range(40_000).select(F.col("id").alias("protein"), F.explode(F.when(F.col("id") < 2, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))).alias("peptide"))
    scores = spark.range(1, 40_001).select(F.col("id").alias("protein"), F.col("id").alias("score"))
    sets = counting.peptide_sets(pairs)
    assert sorted(tuple(r) for r in counting.peptide_set_ranks(sets, scores).collect()) == [(["x"], 0, 1, 2), (["x", "y"], 2, 39_999, 1)]
    ranks = counting.meta_ranks(counting.meta_proteins(pairs), scores)
    assert ranks.columns == ["score", "proteins", "rank"] and sorted((r.proteins[0], len(r.proteins), r.score, r["rank"]) for r in ranks.collect()) == [(0, 2, 1, 2), (2, 39_998, 39_999, 1)]
