"""More registered queries: spectra, files, confidence tables, statistics of DIA runs and label-free quantification.

An order with its lines is a spectrum: prices are m/z, quantities are intensities. See ``contract`` for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import arrays
from massloom.functions import sequence as S
from massloom.operators import confidence, counting, dia, digestion, inference, joins, lfq, ranking
from massloom.plans.contract import _TIE, TIE, _lines, _proteins, query
from massloom.session import new_path, table
from massloom.sources import psms, sinks, spectra


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, scan, precursor_mz, mz, intensity): one spectrum for each order, its peaks by m/z."""
    peaks = F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("m"), F.col("l_quantity").alias("i"))))
    rows = _lines(spark, sf_dir).groupBy("l_orderkey").agg(peaks.alias("p"))
    return rows.select(F.lit("run").alias("file"), F.col("l_orderkey").alias("scan"), F.col("p")[0]["m"].alias("precursor_mz"), F.transform("p", lambda x: x["m"]).alias("mz"), F.transform("p", lambda x: x["i"]).alias("intensity"))


def _peaks(rows: DataFrame) -> DataFrame:
    return rows.select("scan", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("scan", "p.mz", "p.intensity")


_PEAKS = "pk AS (SELECT l_orderkey AS scan, l_extendedprice AS mz, l_quantity AS intensity FROM lineitem)"


@query(f"""WITH {_PEAKS} SELECT scan, CAST(count(*) AS INTEGER) AS n_peaks, sum(intensity) AS tic, arg_max(mz, (intensity, mz)) AS base_mz, max(intensity) AS base_intensity,
min(mz) AS min_mz, max(mz) AS max_mz FROM pk GROUP BY scan""")
def spectrum_stats(spark, sf_dir):
    return spectra.spectrum_stats(_spectra(spark, sf_dir)).drop("file")


@query(f"""WITH {_PEAKS} SELECT scan, mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY intensity DESC, mz DESC) AS n FROM pk) WHERE n <= 2""")
def truncate_peaks(spark, sf_dir):
    return _peaks(spectra.truncate_peaks(_spectra(spark, sf_dir), 2))


@query(f"""WITH {_PEAKS} SELECT scan, mz, intensity FROM pk p WHERE NOT EXISTS (SELECT 1 FROM pk q WHERE q.scan = p.scan AND q.intensity > p.intensity
AND (abs(p.mz - 1.00335483 - q.mz) <= p.mz * 20000 / 1e6 OR abs(p.mz - 1.00335483 / 2 - q.mz) <= p.mz * 20000 / 1e6))""")
def deisotope(spark, sf_dir):
    return _peaks(spectra.deisotope(_spectra(spark, sf_dir), 20_000.0))


@query(f"""WITH {_PEAKS} SELECT scan, CAST(count(*) AS INTEGER) AS n FROM pk GROUP BY scan HAVING min(mz) BETWEEN 2000 AND 30000 AND scan BETWEEN 10 AND 40000 AND count(*) >= 3""")
def spectrum_filter(spark, sf_dir):
    kept = spectra.filter_spectra(_spectra(spark, sf_dir), 2000.0, 30_000.0, "10-40000", 3)
    return kept.select("scan", F.size("mz").alias("n"))


@query(f"""WITH {_PEAKS}, s AS (SELECT scan, min(mz) AS pmz FROM pk GROUP BY scan),
z AS (SELECT scan, 2 AS charge, pmz * 2 AS mh FROM s WHERE scan % 2 = 0 UNION ALL SELECT scan, c, pmz * c - (c - 1) * {S.PROTON!r} FROM s, (VALUES (1), (2), (3)) t(c) WHERE scan % 2 = 1)
SELECT scan, charge, round(mh - {S.PROTON!r}, 6) AS neutral_mass FROM z""")
def spectrum_charges(spark, sf_dir):
    given = F.when(F.col("scan") % 2 == 0, F.array(F.struct(F.lit(2).alias("charge"), (F.col("precursor_mz") * 2).alias("mh")), F.struct(F.lit(9).alias("charge"), F.lit(0.0).alias("mh"))))
    rows = spectra.spectrum_charges(_spectra(spark, sf_dir).withColumn("zstates", given), (1, 3))
    return rows.select("scan", "charge", F.round("neutral_mass", 6).alias("neutral_mass"))


@query(f"""WITH {_PEAKS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY intensity DESC, mz DESC) AS n, max(intensity) OVER (PARTITION BY scan) AS top FROM pk)
SELECT scan, CAST(floor(mz / {inference.AVERAGINE_STEP!r}) AS INTEGER) AS bin, round(intensity / top, 9) AS share FROM r WHERE n <= 3""")
def top_fragments(spark, sf_dir):
    rows = inference.top_fragments(_spectra(spark, sf_dir), 3).select("scan", F.explode("bins").alias("b"))
    return rows.select("scan", "b.bin", F.round("b.share", 9).alias("share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_tax FROM lineitem WHERE l_tax <= 0.03")
def threshold_q(spark, sf_dir):
    return counting.threshold_q(_lines(spark, sf_dir), "l_tax", 0.03).select("l_orderkey", "l_linenumber", "l_partkey", "l_tax")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def threshold_custom(spark, sf_dir):
    return counting.threshold_custom(_lines(spark, sf_dir), "l_quantity", 45.0, smaller_passes=False).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {_TIE}) AS INTEGER) AS sp_rank FROM lineitem""")
def sp_rank(spark, sf_dir):
    return ranking.row_ranks(_lines(spark, sf_dir).select(*TIE), ["l_orderkey"], "l_extendedprice", TIE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "sp_rank")


@query("SELECT round(least(1.0, count(*) FILTER (WHERE l_discount > 0.05) / (count(*) * 0.95)), 9) AS pi0 FROM lineitem")
def storey_pi0(spark, sf_dir):
    share = confidence.storey_pi0(_lines(spark, sf_dir), "l_discount", 0.05)
    return spark.range(1).select(F.round(F.lit(share), 9).alias("pi0"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS t, o_custkey % 1000 AS a, o_custkey % 77 AS b FROM orders)
SELECT o_orderkey, t AS target, CAST(a AS DOUBLE) AS first_decoy, CAST(b AS DOUBLE) AS second_decoy FROM o""")
def atdc_matrix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    made = [(None, F.col("o_totalprice")), (1, F.col("o_custkey") % 77), (0, F.col("o_custkey") % 1000)]
    rows = orders.select("o_orderkey", F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("i"), s.cast("double").alias("s")) for i, s in made))).alias("x")).select("o_orderkey", "x.*")
    found = confidence.atdc_matrix(rows, ["o_orderkey"], "s", "i")
    return found.select("o_orderkey", "target", F.col("decoys")[0].alias("first_decoy"), F.col("decoys")[1].alias("second_decoy"))


_DIGEST = """WITH p AS (SELECT p_partkey AS protein_id, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS r FROM part),
c AS (SELECT protein_id, string_split(regexp_replace(regexp_replace(r, '([KR])', '\\1|', 'g'), '\\|(P|$)', '\\1', 'g'), '|') AS ps FROM p WHERE r <> ''),
i AS (SELECT protein_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM c),
g AS (SELECT protein_id, CAST(coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start, ps[k] AS sequence FROM i WHERE length(ps[k]) BETWEEN 2 AND 50)"""


@query(f"""{_DIGEST}, l AS (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS k FROM g)
SELECT CASE WHEN k = 1 THEN 'N' WHEN k = length(sequence) THEN 'C' ELSE 'I' END AS place, substr(sequence, k, 1) AS residue, count(*) AS n FROM l GROUP BY ALL""")
def residue_frequencies(spark, sf_dir):
    return digestion.residue_frequencies(digestion.digest(_proteins(spark, sf_dir), min_length=2, max_length=50))


@query(f"""{_DIGEST}, m(residue, mass) AS (VALUES {', '.join(f"('{r}', {m!r})" for r, m in S.RESIDUE_MASS.items())}),
d AS (SELECT sequence, count(*) AS places, min(protein_id) AS first_protein FROM (SELECT DISTINCT * FROM g) GROUP BY 1),
w AS (SELECT sequence, sum(CAST(mass AS DOUBLE)) + {S.WATER!r} AS mass, count(mass) AS known FROM (SELECT sequence, unnest(string_split(sequence, '')) AS residue FROM d) LEFT JOIN m USING (residue) GROUP BY 1)
SELECT sequence, round(mass + 3e-9, 6) AS mass, CAST(places AS INTEGER) AS places, first_protein FROM d JOIN w USING (sequence) WHERE known = length(sequence) AND mass BETWEEN 200 AND 7200""")
def peptide_locations(spark, sf_dir):
    found = digestion.peptide_locations(digestion.digest(_proteins(spark, sf_dir), min_length=2, max_length=50))
    # masses have 8 digits: with 3e-9 more no order of summation meets a tie
    return found.select("sequence", F.round(F.col("mass") + 3e-9, 6).alias("mass"), F.size("locations").alias("places"), F.col("locations")[0]["protein_id"].alias("first_protein"))


@query(f"{_DIGEST} SELECT protein_id AS protein, count(*) AS possible FROM g GROUP BY 1")
def possible_peptides(spark, sf_dir):
    return digestion.possible_peptides(_proteins(spark, sf_dir), min_length=2, max_length=50)


_RANKED = f"{_PEAKS}, r AS (SELECT *, ln(1 + rank() OVER (PARTITION BY scan ORDER BY intensity DESC) - 1) AS log_rank FROM pk)"


@query(f"WITH {_RANKED} SELECT scan, mz, intensity, round(log_rank, 9) AS log_rank FROM r")
def log_ranks(spark, sf_dir):
    return dia.log_ranks(_peaks(_spectra(spark, sf_dir))).withColumn("log_rank", F.round("log_rank", 9))


@query("""WITH r AS (SELECT user_id % 50 AS scan, value, ln(rank() OVER (PARTITION BY user_id % 50 ORDER BY value DESC)) AS y FROM events)
SELECT scan, round(regr_slope(y, ln(1 + value)), 5) AS slope, round(regr_intercept(y, ln(1 + value)), 5) AS intercept FROM r GROUP BY scan""")
def rank_regression(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("scan"), F.col("value").alias("intensity"))
    return dia.rank_regression(events).select("scan", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("""WITH d AS (SELECT l_suppkey, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS d FROM (SELECT DISTINCT l_suppkey, l_extendedprice FROM lineitem))
SELECT l_suppkey, round(avg(d), 6) AS gap FROM d GROUP BY 1""")
def isolation_gap(spark, sf_dir):
    return dia.isolation_gap(_lines(spark, sf_dir), ["l_suppkey"], "l_extendedprice").select("l_suppkey", F.round("gap", 6).alias("gap"))


def _peptides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("mod_sequence"), F.col("l_returnflag").alias("file")).agg(F.round(F.sum("l_extendedprice"), 2).alias("intensity"))
    design = spark.createDataFrame([("A", "c", 1, 1, 1), ("N", "c", 1, 1, 2), ("R", "d", 1, 1, 1)], "file string, condition string, biorep int, fraction int, techrep int")
    return rows, design


_PEPTIDES = "pt AS (SELECT l_partkey AS mod_sequence, l_returnflag AS file, round(sum(l_extendedprice), 2) AS intensity FROM lineitem GROUP BY 1, 2)"


def _normalised(lead: str, file: str) -> str:
    return f"""WITH {_PEPTIDES}, f AS (SELECT median(a.intensity / b.intensity) AS factor FROM pt a JOIN pt b USING (mod_sequence) WHERE a.file = '{lead}' AND b.file = '{file}')
SELECT mod_sequence, file, round(CASE WHEN file = '{file}' THEN intensity * factor ELSE intensity END, 4) AS intensity FROM pt, f"""


@query(_normalised("A", "N"))
def normalise_techreps(spark, sf_dir):
    rows, design = _peptides(spark, sf_dir)
    return lfq.normalise_techreps(rows, design).withColumn("intensity", F.round("intensity", 4))


@query(_normalised("A", "R"))
def normalise_bioreps(spark, sf_dir):
    rows, design = _peptides(spark, sf_dir)
    return lfq.normalise_bioreps(rows, design.where("file <> 'N'")).withColumn("intensity", F.round("intensity", 4))


@query(f"""WITH {_PEPTIDES} SELECT mod_sequence, coalesce(max(intensity) FILTER (WHERE file = 'A'), 0.0) AS Intensity_A, coalesce(max(intensity) FILTER (WHERE file = 'R'), 0.0) AS Intensity_R,
coalesce(max('MSMS') FILTER (WHERE file = 'A'), 'NotDetected') AS "Detection Type_A", coalesce(max('MSMS') FILTER (WHERE file = 'R'), 'NotDetected') AS "Detection Type_R" FROM pt GROUP BY 1""")
def wide_intensities(spark, sf_dir):
    rows, _ = _peptides(spark, sf_dir)
    return sinks.wide_intensities(rows.withColumn("detection", F.lit("MSMS")), ["A", "R"], ["mod_sequence"])


@query(f"""WITH {_PEAKS} SELECT scan, round(corr(mz, intensity), 6) AS r, median(intensity) AS middle, round(max(mz) + ln(sum(exp(mz - top))), 6) AS log_sum
FROM (SELECT *, max(mz) OVER (PARTITION BY scan) AS top FROM pk) GROUP BY scan HAVING count(DISTINCT mz) > 1 AND count(DISTINCT intensity) > 1""")
def array_statistics(spark, sf_dir):
    rows = _spectra(spark, sf_dir).where((F.size(F.array_distinct("mz")) > 1) & (F.size(F.array_distinct("intensity")) > 1))
    return rows.select("scan", F.round(arrays.pearson(F.col("mz"), F.col("intensity")), 6).alias("r"), arrays.median(F.col("intensity")).alias("middle"), F.round(arrays.log_sum_exp(F.col("mz")), 6).alias("log_sum"))


@query(f"""SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_linenumber + {S.PROTON!r}, 6) AS mz, round(l_linenumber * l_extendedprice - l_linenumber * {S.PROTON!r}, 6) AS mass,
abs((l_extendedprice - l_quantity * 1000) / (l_quantity * 1000) * 1e6) <= 100000 AS near FROM lineitem""")
def mass_conversion(spark, sf_dir):
    rows, x, z = _lines(spark, sf_dir), F.col("l_extendedprice"), F.col("l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", F.round(S.to_mz(x, z), 6).alias("mz"), F.round(S.to_mass(x, z), 6).alias("mass"), S.within_ppm(x, F.col("l_quantity") * 1000, 100_000.0).alias("near"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def table_round_trip(spark, sf_dir):
    path = new_path(spark, "table")
    sinks.write_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), path)
    return psms.read_delimited(spark, path)


@query(f"""WITH {_PEAKS} SELECT scan, round(mz, 2) AS mz, intensity FROM pk""")
def mgf_round_trip(spark, sf_dir):
    path = new_path(spark, "mgf")
    rows = _spectra(spark, sf_dir).withColumn("zstates", F.array(F.struct(F.lit(2).alias("charge"), F.lit(1.0).alias("mh")))).withColumn("rt", F.lit(None).cast("double"))
    sinks.write_mgf(rows, path)
    return _peaks(spectra.read_mgf(spark, path)).withColumn("scan", F.col("scan").cast("long")).withColumn("mz", F.round("mz", 2))


@query("""WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) SELECT a.o_orderkey FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.o_orderkey % 3 = 0 AND b.o_custkey = a.o_custkey AND round(b.o_totalprice, 4) = round(a.o_totalprice, 4))""")
def index_minus_index(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("mod_sequence"), F.col("o_totalprice").alias("mass"))
    return joins.subtract_index(rows, rows.where("o_orderkey % 3 = 0")).select("o_orderkey")
