"""Registered queries of file round trips, modifications, preprocessing and the features of DIA runs.

A line is a match (order = scan, part = peptide) or a peak of its order's spectrum. See ``contract`` for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.sequence import NEUTRON, PROTON
from massloom.operators import dia, dia_run, digestion, features, inference, joins, lfq, search, sweeps
from massloom.plans.contract import _lines, _proteins, query
from massloom.plans.contract_search import _order_spectra
from massloom.plans.contract_spectra import _DIGEST
from massloom.session import new_path, table
from massloom.sources import psms, sinks, spectra

# files


def _psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("sequence"))
    rows = _lines(spark, sf_dir).join(names, "l_partkey")
    return rows.select(
        F.col("l_orderkey").cast("int").alias("scan"), F.lit(2).alias("charge"), (F.col("l_orderkey") % 900 + 300).cast("double").alias("spectrum neutral mass"), F.col("l_extendedprice").alias("peptide mass"),
        F.col("l_tax").alias("delta_cn"), (F.col("l_discount") * 10 + 1).alias("xcorr score"), F.col("l_linenumber").cast("int").alias("xcorr rank"), "sequence",
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(",decoy_P"), F.col("l_partkey").cast("string"))).otherwise("")).alias("protein id"), F.lit("KR").alias("flanking aa"),
    )


_PSMS = """m AS (SELECT CAST(l_orderkey AS INTEGER) AS scan, l_orderkey, CAST(l_linenumber AS INTEGER) AS rank, l_extendedprice AS mass, l_tax, l_discount * 10 + 1 AS xcorr,
  regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS sequence, 'S' || l_suppkey AS first, CASE WHEN l_suppkey % 2 = 0 THEN 'decoy_P' || l_partkey END AS second
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_BACK = f"WITH {_PSMS} SELECT scan, rank, sequence, round(mass, 2) AS mass, round(xcorr, 4) AS xcorr, first || coalesce(',' || second, '') AS proteins FROM m"


def _shown(rows: DataFrame, rank: str) -> DataFrame:
    proteins = F.array_join(F.reverse(F.array_sort(F.split("protein id", ","))), ",")  # S before decoy
    proteins = F.when(F.col("protein id").contains(","), F.array_join(F.array_sort(F.split("protein id", ",")), ",")).otherwise(proteins)
    return rows.select("scan", F.col(f"`{rank}`").alias("rank"), "sequence", F.round("peptide mass", 2).alias("mass"), F.round("xcorr score", 4).alias("xcorr"), proteins.alias("proteins"))


@query(_BACK)
def sqt_round_trip(spark, sf_dir):
    path = new_path(spark, "sqt")
    sinks.write_sqt(_psms(spark, sf_dir), path)
    return _shown(psms.read_sqt(spark, path), "xcorr rank")


@query(_BACK)
def pepxml_round_trip(spark, sf_dir):
    path = new_path(spark, "pepxml")
    sinks.write_pepxml(_psms(spark, sf_dir), path, compression="gzip")
    return _shown(psms.read_pepxml(spark, path), "rank")


@query(_BACK)
def mzid_round_trip(spark, sf_dir):
    path = new_path(spark, "mzid")
    sinks.write_mzid(_psms(spark, sf_dir), path, compression="gzip")
    return _shown(psms.read_mzid(spark, path), "rank")


@query(f"""WITH {_PSMS} SELECT 'target_0_' || scan || '_2_' || rank AS id, CAST(scan AS DOUBLE) AS scan, round(mass + {PROTON!r}, 4) AS calc_mass, CAST(length(sequence) AS DOUBLE) AS length,
CAST(sequence[-1:] IN ('K', 'R') AS DOUBLE) AS ends_cleaved, first || coalesce(',' || second, '') AS proteins FROM m""")
def pin_round_trip(spark, sf_dir):
    path = new_path(spark, "pin")
    sinks.write_pin(sinks.make_pin([_psms(spark, sf_dir).withColumn("flanking aa", F.lit("KG"))]), path)
    rows = psms.read_pin(spark, path)
    return rows.select(F.col("SpecId").alias("id"), F.col("ScanNr").alias("scan"), F.round("CalcMass", 4).alias("calc_mass"), F.col("PepLen").alias("length"), F.col("enzC").alias("ends_cleaved"), F.col("Proteins").alias("proteins"))


@query(f"""WITH {_PSMS} SELECT scan || '_2_' || rank AS id, sequence, first || coalesce(',' || second, '') AS accession, CASE WHEN second IS NULL THEN '1' ELSE '0' END AS uniq, round(mass / 2 + {PROTON!r}, 4) AS calc_mz FROM m""")
def mztab_rows(spark, sf_dir):
    path = new_path(spark, "mztab")
    sinks.write_mztab(_psms(spark, sf_dir), path)
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(F.startswith("value", F.lit("PSM\t"))).select(cells.alias("c"))
    mz = F.element_at("c", -3).cast("double")
    return rows.select(F.col("c")[2].alias("id"), F.col("c")[1].alias("sequence"), F.col("c")[3].alias("accession"), F.col("c")[4].alias("uniq"), F.round(mz, 4).alias("calc_mz"))


@query("""WITH k AS (SELECT l_orderkey AS scan, l_extendedprice AS mz, l_quantity AS i FROM lineitem)
SELECT CAST(scan AS INTEGER) AS scan, round(min(mz), 2) AS precursor, count(*) AS peaks, round(sum(mz), 2) AS total_mz, CAST(sum(i) AS DOUBLE) AS total FROM k GROUP BY 1""")
def ms2_round_trip(spark, sf_dir):
    path = new_path(spark, "ms2")
    rows = _order_spectra(spark, sf_dir).withColumn("mz", F.transform("mz", lambda x: F.round(x * 50, 2))).withColumn("precursor_mz", F.col("mz")[0])
    sinks.write_ms2(rows.withColumn("zstates", F.array(F.struct(F.lit(2).alias("charge"), F.lit(1.0).alias("mh")))).withColumn("rt", F.lit(30.0)), path)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return spectra.read_spectra(spark, path, "ms2").select("scan", F.round("precursor_mz", 2).alias("precursor"), F.size("mz").cast("long").alias("peaks"), F.round(add("mz"), 2).alias("total_mz"), add("intensity").alias("total"))


@query("SELECT 'P' || p_partkey AS protein_id, p_type AS description, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS residues FROM part")
def fasta_round_trip(spark, sf_dir):
    path = new_path(spark, "fasta")
    proteins = _proteins(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_type").alias("description")), "protein_id")
    sinks.write_fasta(proteins.withColumn("protein_id", F.concat(F.lit("P"), F.col("protein_id").cast("string"))), path)
    return psms.read_fasta(spark, path)


# peptides


@query(f"""{_DIGEST}, s AS (SELECT DISTINCT sequence FROM g), places AS (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS k FROM s),
f AS (SELECT sequence, 0 AS k, sequence AS mod_sequence, 0e0 AS delta FROM s UNION ALL
  SELECT sequence, k, substr(sequence, 1, CAST(k AS INTEGER)) || '[+15.99]' || substr(sequence, CAST(k + 1 AS INTEGER)), 15.994915e0 FROM places WHERE substr(sequence, CAST(k AS INTEGER), 1) = 'L' UNION ALL
  SELECT sequence, k, substr(sequence, 1, CAST(k AS INTEGER)) || '[+79.97]' || substr(sequence, CAST(k + 1 AS INTEGER)), 79.966331e0 FROM places WHERE substr(sequence, CAST(k AS INTEGER), 1) IN ('S', 'T'))
SELECT sequence, mod_sequence, round(100 + delta, 4) AS mass FROM f""")
def modified_forms(spark, sf_dir):
    rows = digestion.digest(_proteins(spark, sf_dir), min_length=2, max_length=50).select("sequence").distinct().withColumn("mass", F.lit(100.0))
    found = digestion.expand_mods(rows, digestion.parse_mods("1L+15.994915,1ST+79.966331"), max_mods=1)
    return found.select("sequence", "mod_sequence", F.round("mass", 4).alias("mass"))


# spectra


@query(f"""WITH pk AS (SELECT l_orderkey AS scan, o_totalprice / 250 AS mass, l_extendedprice / 50 AS mz, CAST(l_quantity AS DOUBLE) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
kept AS (SELECT scan, CAST(floor(mz / 0.02 + 1 - 0.4) AS BIGINT) AS bin, max(sqrt(i)) AS v FROM pk WHERE mz < mass + {PROTON!r} + 50 GROUP BY 1, 2),
clean AS (SELECT scan, bin, v, max(bin) OVER (PARTITION BY scan) // 10 + 1 AS size, v > 0.05 * max(v) OVER (PARTITION BY scan) AS stays FROM kept)
SELECT CAST(scan AS BIGINT) AS scan, CAST(bin AS INTEGER) AS bin, round(v / max(v) OVER (PARTITION BY scan, bin // size), 9) AS share FROM clean WHERE stays""")
def processed_spectra(spark, sf_dir):
    schema = "scan long, bin int, share double"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for rows in batches:
            precursor, charge = rows["precursor_mz"].to_numpy(zero_copy_only=False), rows["charge"].to_numpy(zero_copy_only=False)
            owner = rows["mz"].value_parent_indices().to_numpy()
            peaks = (rows[c].flatten().to_numpy(zero_copy_only=False) for c in ("mz", "intensity"))
            owner, at, value = search.ten_bin_peaks(owner, *peaks, precursor, charge)
            yield pa.RecordBatch.from_arrays([rows["scan"].take(pa.array(owner)), pa.array(at, pa.int32()), pa.array(np.round(value / search.TOP, 9))], names=["scan", "bin", "share"])

    return _order_spectra(spark, sf_dir).mapInArrow(run, schema)


# isolation windows and features of DIA matches


@query("""WITH w AS (SELECT o_orderkey, o_totalprice / 1000 - (o_custkey % 50) / 500.0 AS lo, o_totalprice / 1000 + (o_custkey % 7) / 100.0 AS hi FROM orders),
e AS (SELECT event_id, value AS a, value + (user_id % 13) * (user_id % 5) / 50.0 AS b FROM events)
SELECT o_orderkey, event_id FROM w JOIN e ON a <= hi AND lo <= b""")
def overlap_join(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000 - F.col("o_custkey") % 50 / 500.0).alias("lo"), (F.col("o_totalprice") / 1000 + F.col("o_custkey") % 7 / 100.0).alias("hi"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("a"), (F.col("value") + (F.col("user_id") % 13) * (F.col("user_id") % 5) / 50.0).alias("b"))
    return joins.overlap_join(w, e, "lo", "hi", "a", "b", base=0.01).select("o_orderkey", "event_id")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber AS ion, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS level, [l_quantity, 1000 * l_discount, 1000 * l_tax, CAST(l_linenumber AS DOUBLE)] AS t FROM lineitem),
n AS (SELECT l_orderkey, level, row_number() OVER (PARTITION BY l_orderkey, level ORDER BY ion, t) AS k, list_transform(t, lambda x: x / sqrt(list_sum(list_transform(t, lambda y: y * y)))) AS t FROM t),
p AS (SELECT a.l_orderkey, CASE WHEN a.level <> b.level THEN 3 ELSE a.level END AS kind, list_sum(list_transform(list_zip(a.t, b.t), lambda z: z[1] * z[2])) AS c
  FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND ((a.level = b.level AND a.k < b.k) OR (a.level = 1 AND b.level = 2 AND a.k = 1))),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY c DESC) AS rank FROM p)
SELECT l_orderkey, round(coalesce(sum(c) FILTER (WHERE kind = 1 AND rank <= 3), 0) / 3, 9) AS ms1, round(coalesce(sum(c) FILTER (WHERE kind = 2 AND rank <= 3), 0) / 3, 9) AS ms2, round(coalesce(sum(c) FILTER (WHERE kind = 3 AND rank <= 3), 0) / 3, 9) AS ms1_ms2
FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN r USING (l_orderkey) GROUP BY 1""")
def coelution(spark, sf_dir):
    trace = F.array(F.col("l_quantity").cast("double"), 1000 * F.col("l_discount"), 1000 * F.col("l_tax"), F.col("l_linenumber").cast("double"))
    rows = _lines(spark, sf_dir).select("l_orderkey", F.when(F.col("l_linenumber") <= 3, "ms1").otherwise("ms2").alias("kind"), F.col("l_linenumber").alias("ion"), trace.alias("trace"))
    found = dia.coelution(rows, ["l_orderkey"])
    return found.select("l_orderkey", *(F.round(c, 9).alias(c) for c in ("ms1", "ms2", "ms1_ms2")))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS win, l_shipdate AS day, 500 + (l_partkey % 40) + (l_linenumber - 4) * 3e-3 AS mz FROM lineitem), n AS (SELECT *, dense_rank() OVER (PARTITION BY win ORDER BY day) AS k FROM p),
l AS (SELECT win, max(k) AS last FROM n GROUP BY 1),
c AS (SELECT n.*, last, EXISTS (SELECT 1 FROM n o WHERE o.win = n.win AND o.k = n.k - 1 AND abs(o.mz - n.mz) <= n.mz * 20 / 1e6) AS before, EXISTS (SELECT 1 FROM n o WHERE o.win = n.win AND o.k = n.k + 1 AND abs(o.mz - n.mz) <= n.mz * 20 / 1e6) AS after FROM n JOIN l USING (win))
SELECT win, day, round(mz, 4) AS mz FROM c WHERE (before OR k = 1) AND (after OR k = last)""")
def denoise(spark, sf_dir):
    mz = 500 + F.col("l_partkey") % 40 + (F.col("l_linenumber") - 4) * F.lit(0.003)
    rows = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("win"), F.col("l_shipdate").alias("day"), mz.alias("mz")).distinct()
    return dia.denoise(rows, ["win"], "day", "mz").select("win", "day", F.round("mz", 4).alias("mz"))


@query(f"""WITH r AS (SELECT l_orderkey AS scan, l_extendedprice / 50 AS mz, l_quantity AS i, ln(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)) AS y FROM lineitem),
f AS (SELECT scan, regr_slope(y, ln(1 + i)) AS slope, regr_intercept(y, ln(1 + i)) AS intercept FROM r GROUP BY 1),
q AS (SELECT l_orderkey AS scan, l_orderkey % 3 + 1 AS z, max(l_extendedprice) / 50 * (1 + (l_orderkey % 7 - 3) * 8e-6) AS mz FROM lineitem GROUP BY 1, 2),
a AS (SELECT scan, k, mz + k * {NEUTRON!r} / z AS x FROM q, (VALUES (0), (1), (2)) t(k)),
n AS (SELECT a.*, (SELECT r.i FROM r WHERE r.scan = a.scan AND abs(r.mz - x) <= x * 20 / 1e6 ORDER BY abs(r.mz - x), r.mz LIMIT 1) AS i FROM a)
SELECT scan, {', '.join(f'round(max(CASE WHEN slope IS NULL OR isnan(slope) THEN 0 ELSE slope * ln(1 + coalesce(i, 0)) + intercept END) FILTER (WHERE k = {k}), 6) + 0.0 AS precursor_m{k}' for k in range(3))} FROM n JOIN f USING (scan) GROUP BY 1""")
def precursor_ranks(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "scan")
    mz = F.max("l_extendedprice") / 50 * (1 + (F.col("scan") % 7 - 3) * F.lit(8e-6))
    asked = lines.groupBy("scan").agg(mz.alias("mz")).select(F.col("scan").alias("psm_id"), "scan", (F.col("scan") % 3 + 1).alias("charge"), "mz")
    peaks = lines.select("scan", (F.col("l_extendedprice") / 50).alias("mz"), F.col("l_quantity").alias("intensity"))
    found = dia.precursor_ranks(asked, peaks)
    return found.select("scan", *((F.round(f"precursor_m{k}", 6) + 0.0).alias(f"precursor_m{k}") for k in range(3)))


@query("""WITH s AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS nb, count(*) FILTER (WHERE l_linestatus <> 'O') AS ny, coalesce(sum(l_quantity * l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS ib, coalesce(sum(l_quantity * l_quantity) FILTER (WHERE l_linestatus <> 'O'), 0) AS iy FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(lgamma(nb + 1) + lgamma(ny + 1) + ln(1 + ib) + ln(1 + iy), 6) AS static_fragment FROM s""")
def static_fragments(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", F.when(F.col("l_linestatus") == "O", "b").otherwise("y").alias("ion"), F.col("l_quantity").alias("intensity"))
    return dia.static_fragment_score(rows, ["l_orderkey"]).select("l_orderkey", F.round("static_fragment", 6).alias("static_fragment"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + 6 AS n, l_linenumber AS k, l_discount + 0.05 AS p FROM lineitem), j AS (SELECT *, unnest(range(k, n + 1)) AS j FROM t)
SELECT l_orderkey, l_linenumber, n, round(p, 2) AS p, round(-ln(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)))), 5) + 0.0 AS dynamic_fragment FROM j GROUP BY l_orderkey, l_linenumber, n, j.p""")
def dynamic_fragments(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") + 6).alias("n"), (F.col("l_discount") + 0.05).alias("p")).distinct()
    found = dia.dynamic_fragment_score(rows, "n", "l_linenumber", "p")
    return found.select("l_orderkey", "l_linenumber", "n", F.round("p", 2).alias("p"), (F.round("dynamic_fragment", 5) + 0.0).alias("dynamic_fragment"))


@query("""WITH b AS (SELECT l_partkey, l_returnflag = 'R' AS d, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2), c AS (SELECT s, count(*) FILTER (WHERE NOT d) AS t, count(*) FILTER (WHERE d) AS d FROM b GROUP BY 1),
f AS (SELECT s, sum(t) OVER w AS t, sum(d) OVER w AS d FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), q AS (SELECT t, min(d / greatest(t, 1)) OVER (ORDER BY s DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM f)
SELECT CAST(coalesce(max(t), 0) AS BIGINT) AS accepted FROM q WHERE q <= 0.4""")
def accepted_peptides(spark, sf_dir):
    n = dia.targets_at(_lines(spark, sf_dir), "l_extendedprice", ["l_partkey"], F.col("l_returnflag") == "R", 0.4)
    return spark.range(1).select(F.lit(n).cast("long").alias("accepted"))


@query("""WITH s AS (SELECT p_name AS sequence, max(p_retailprice) AS rt FROM part GROUP BY 1), e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT sequence, round(least(floor((rt - lo) / ((hi - lo) / 100) + 1e-9) + 1, 101) / 101, 9) AS share FROM s, e""")
def predicted_share(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("sequence"), F.col("p_retailprice").alias("predicted_rt"))
    return dia_run.predicted_share(rows).select("sequence", F.round("share", 9).alias("share"))


# sweeps


_WINDOWS = "w AS (SELECT o_totalprice / 1000 - (o_custkey % 50) / 500.0 AS lo, o_totalprice / 1000 + (o_custkey % 7) / 100.0 AS hi FROM orders)"


def _swept(least: int) -> str:
    return f"""WITH {_WINDOWS}, p AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT lo AS x, 1 AS a, 0 AS b FROM w UNION ALL SELECT hi, 0, 1 FROM w) GROUP BY 1),
d AS (SELECT x, coalesce(sum(a - b) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, a, b FROM p),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM d WHERE before < {least} AND before + a >= {least}), c AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM d WHERE before + a >= {least} AND before + a - b < {least})
SELECT round(o.x, 6) AS lo, round(c.x, 6) AS hi FROM o JOIN c USING (k)"""


def _windows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000 - F.col("o_custkey") % 50 / 500.0).alias("lo"), (F.col("o_totalprice") / 1000 + F.col("o_custkey") % 7 / 100.0).alias("hi"))


@query(_swept(1))
def window_union(spark, sf_dir):
    return sweeps.covered(_windows(spark, sf_dir)).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(_swept(3))
def window_intersection(spark, sf_dir):
    return sweeps.covered(_windows(spark, sf_dir), least=3).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""WITH s AS (SELECT l_suppkey % 5 AS file, l_orderkey AS scan, 500 + (l_partkey % 60) + l_linenumber * 1e-3 AS mz, CAST(l_quantity AS DOUBLE) AS i FROM lineitem),
k AS (SELECT file, scan, row_number() OVER (PARTITION BY file ORDER BY scan) AS k FROM (SELECT DISTINCT file, scan FROM s)),
p AS (SELECT s.*, k FROM s JOIN k USING (file, scan)), m AS (SELECT row_number() OVER () AS id, * FROM p),
o AS (SELECT m.id, q.k, max(q.i) AS best FROM m JOIN p q ON q.file = m.file AND q.k <> m.k AND q.k BETWEEN m.k - 3 AND m.k + 3 AND q.mz BETWEEN m.mz * (1 - 8 / 1e6) AND m.mz * (1 + 8 / 1e6) GROUP BY 1, 2),
t AS (SELECT id, sum(best) AS total, count(*) AS n FROM o GROUP BY 1), l AS (SELECT file, max(k) AS last FROM k GROUP BY 1)
SELECT m.file, m.scan, round(mz, 4) AS mz, round((i + total) / (least(m.k + 3, last) - greatest(m.k - 3, 1) + 1), 6) AS intensity, CAST(n + 1 AS INTEGER) AS n FROM m JOIN t USING (id) JOIN l ON l.file = m.file""")
def boxcar(spark, sf_dir):
    mz = 500 + F.col("l_partkey") % 60 + F.col("l_linenumber") * F.lit(0.001)
    peaks = _lines(spark, sf_dir).select((F.col("l_suppkey") % 5).alias("file"), F.col("l_orderkey").alias("scan"), F.struct(mz.alias("m"), F.col("l_quantity").cast("double").alias("i")).alias("p"))
    rows = peaks.groupBy("file", "scan").agg(F.collect_list("p").alias("p")).select("file", "scan", F.transform("p", lambda x: x["m"]).alias("mz"), F.transform("p", lambda x: x["i"]).alias("intensity"))
    found = sweeps.boxcar(rows, 3, 8.0, 2)
    return found.select("file", "scan", F.round("mz", 4).alias("mz"), F.round("intensity", 6).alias("intensity"), "n")


@query("""WITH p AS (SELECT l_suppkey AS t, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) % 400 AS day, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
s AS (SELECT t, min(day) AS lo, max(day) AS hi FROM p GROUP BY 1)
SELECT x.t AS a, y.t AS b, count(*) AS n, round(corr(x.v, y.v), 6) AS r FROM p x JOIN p y ON x.day = y.day AND x.t < y.t GROUP BY 1, 2 HAVING count(*) >= 4 AND min(x.v) < max(x.v) AND min(y.v) < max(y.v)""")
def trace_correlations(spark, sf_dir):
    at = F.floor(F.unix_timestamp("l_shipdate") / 86400) % 400
    points = _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("trace_id"), at.alias("scan")).agg(F.sum("l_quantity").cast("double").alias("intensity"))
    found = sweeps.trace_correlations(points, least=4)
    return found.where("r is not null").select("a", "b", "n", F.round("r", 6).alias("r"))


# parameters from the spectra


_PLACES = ", ".join(f"('{d}', '{i}', '{k}', {v!r})" for d, i, k, v in inference.detector_places())


@query(f"""WITH pl(detector, ion, kind, v) AS (VALUES {_PLACES}), sp AS (SELECT o_orderkey AS scan, (o_totalprice / 250) / 2 + {PROTON!r} AS pmz FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey),
pk AS (SELECT l_orderkey AS scan, l_extendedprice / 50 AS mz, CAST(l_quantity AS DOUBLE) AS i, max(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey) AS top FROM lineitem),
a AS (SELECT scan, detector, ion, CASE kind WHEN 'fixed' THEN v WHEN 'loss' THEN pmz - v / 2 ELSE (pmz - {PROTON!r}) * 2 + {PROTON!r} - v END AS x FROM sp, pl),
h AS (SELECT a.scan, detector, ion, sum(i / top) AS share FROM a JOIN pk ON pk.scan = a.scan AND abs(mz - x) <= 2.5 GROUP BY 1, 2, 3),
t AS (SELECT detector, ion, sum(share) AS total, sum(share * share) AS squares FROM h GROUP BY 1, 2)
SELECT detector, ion, (SELECT count(*) FROM sp) AS n, round(coalesce(total, 0), 4) AS total, round(coalesce(squares, 0), 4) AS squares FROM pl LEFT JOIN t USING (detector, ion)""")
def detector_counts(spark, sf_dir):
    found = inference.detector_counts(_order_spectra(spark, sf_dir), 2.5)
    return found.select("detector", "ion", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))


# features and quantification


@query("""WITH p AS (SELECT l_returnflag AS file, CASE WHEN l_linenumber < 6 THEN CAST(l_partkey % 50 AS INTEGER) END AS apex_scan, CASE WHEN l_linenumber < 6 THEN CAST(l_suppkey % 7 AS DOUBLE) END AS apex_mz,
  CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber % 2 + 1 AS INTEGER) END AS apex_charge, l_quantity AS i, 'p' || (l_partkey % 20) AS s FROM lineitem)
SELECT file, coalesce(apex_scan, -1) AS apex_scan, coalesce(apex_mz, -1) AS apex_mz, coalesce(apex_charge, -1) AS apex_charge, max(i) AS intensity, list_aggregate(list_sort(list(DISTINCT s)), 'string_agg', ',') AS sequences, count(*) AS n_psms
FROM p GROUP BY file, p.apex_scan, p.apex_mz, p.apex_charge, CASE WHEN p.apex_scan IS NULL THEN s END""")
def merge_by_apex(spark, sf_dir):
    some = F.col("l_linenumber") < 6
    rows = _lines(spark, sf_dir).select(
        F.col("l_returnflag").alias("file"), F.when(some, (F.col("l_partkey") % 50).cast("int")).alias("apex_scan"), F.when(some, (F.col("l_suppkey") % 7).cast("double")).alias("apex_mz"), F.when(some, (F.col("l_linenumber") % 2 + 1).cast("int")).alias("apex_charge"),
        F.col("l_quantity").alias("intensity"), F.lit(1.0).alias("apex_rt"), F.lit(1).alias("n_charges"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("mod_sequence"),
    )
    return lfq.merge_by_apex(rows).select("file", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("apex_scan", "apex_mz", "apex_charge")), "intensity", F.array_join("sequences", ",").alias("sequences"), "n_psms")


@query("""WITH s AS (SELECT o_orderkey AS spec_id, 400 + (o_totalprice / 1000) AS mz, (o_custkey % 60) AS rt FROM orders),
f AS (SELECT event_id, user_id % 4 + 1 AS z, 400 + value AS base, 400 + value + 0.3 AS mono, event_id % 55 AS a, event_id % 55 + user_id % 3 AS b FROM events),
n AS (SELECT *, base * (1 - 1e-5) AS lo, base * (1 + 1e-5) AS hi FROM f UNION ALL SELECT *, mono - 0.05, mono + CASE z WHEN 1 THEN 3.10 WHEN 2 THEN 2.10 ELSE 4.0 / z END FROM f)
SELECT DISTINCT spec_id, event_id FROM s JOIN n ON s.mz BETWEEN lo AND hi AND s.rt BETWEEN a - 0.5 AND b + 0.5""")
def match_features(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_id"), (400 + F.col("o_totalprice") / 1000).alias("precursor_mz"), (F.col("o_custkey") % 60).cast("double").alias("rt_time"))
    base = 400 + F.col("value")
    first = (F.col("event_id") % 55).cast("double")
    found = table(spark, sf_dir, "events").select(F.col("event_id").alias("feature_id"), (F.col("user_id") % 4 + 1).alias("charge"), base.alias("base_mz"), (base + 0.3).alias("mono_mz"), first.alias("first_rt"), (first + F.col("user_id") % 3).alias("last_rt"))
    return joins.match_features(rows, found).select("spec_id", F.col("feature_id").alias("event_id"))


@query("""WITH p AS (SELECT l_orderkey AS scan, l_extendedprice AS mz, CAST(l_quantity AS DOUBLE) AS i, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
r AS (SELECT *, row_number() OVER (PARTITION BY scan, least(floor((mz - lo) / greatest((hi - lo) / 3, 1e-12)), 2) ORDER BY i DESC, mz DESC) AS n FROM p)
SELECT scan, mz, i AS intensity FROM r WHERE n = 1""")
def top_per_region(spark, sf_dir):
    rows = _order_spectra(spark, sf_dir).withColumn("mz", F.transform("mz", lambda x: F.round(x * 50, 2)))
    kept = spectra.top_per_region(rows, 3, 1)
    return kept.select("scan", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("scan", "p.mz", "p.intensity")


@query("""WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v, list(event_id ORDER BY event_id) AS e FROM events GROUP BY 1), k AS (SELECT user_id, v, e, unnest(range(1, len(v) + 1)) AS k FROM l)
SELECT e[k] AS event_id, round(list_sum(list_transform(range(-4, 5), lambda j: [-21, 14, 39, 54, 59, 54, 39, 14, -21][j + 5] * v[least(greatest(k + j, 1), len(v))])) / 231, 6) AS smooth FROM k""")
def savitzky_golay(spark, sf_dir):
    import numpy as np
    import pandas as pd

    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("p"))
    rows = rows.select(F.transform("p", lambda x: x["event_id"]).alias("e"), F.transform("p", lambda x: x["value"]).alias("v"))

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame({"event_id": r.e, "smooth": np.round(features.savitzky_golay(np.asarray(r.v, dtype=float)), 6)})

    return rows.mapInPandas(run, "event_id long, smooth double")
