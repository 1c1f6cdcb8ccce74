"""Registered queries of confidence estimation, isolation windows, search and features.

An order is a spectrum or an isolation window, its lines are matches or peaks. See ``contract`` for the rest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON, RESIDUE_MASS, WATER
from massloom.operators import averaged, confidence, digestion, search
from massloom.plans.contract import _lines, _proteins, query
from massloom.plans.contract_spectra import _DIGEST
from massloom.session import table

_SETS = 3
_DECOYS = "[(o_custkey * 7919 + o_orderkey * 104729) % 400009 + 0.25, (o_custkey * 611953 + o_orderkey * 31) % 350003 + 0.5, (o_custkey * 15485863 + o_orderkey * 7) % 300007 + 0.75]"
_LEVELS = range(_SETS + 1)


@query(f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_totalprice + o_orderkey * 1e-7 AS DOUBLE) AS t, list_transform({_DECOYS}, lambda x: CAST(x AS DOUBLE)) AS d FROM orders),
w AS (SELECT *, CAST(len(list_filter(d, lambda x: x <= t)) AS BIGINT) AS wins, list_filter(d, lambda x: x > t) AS beaten FROM o),
points AS (SELECT t AS s, 1 AS kind, id, wins, 0 AS lost FROM w UNION ALL SELECT unnest(beaten), 0, NULL, 0, 1 FROM w),
n AS (SELECT s AS t, id, kind, wins, sum(wins) OVER z AS won, sum(lost) OVER z AS lost FROM points WINDOW z AS (ORDER BY s DESC, kind ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, row_number() OVER (ORDER BY t DESC) - 1 AS i FROM n WHERE kind = 1),
h AS (SELECT *, i + least(1, min(CAST(floor((2 * won - {_SETS}) / {2 * _SETS}) AS BIGINT) + 1 - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS h FROM i),
g AS (SELECT *, CAST(h = lag(h, 1, 0) OVER (ORDER BY i) AS INT) AS gone FROM h),
m AS (SELECT *, {', '.join(f'sum(CAST(wins <= {c} AS INT) - gone) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS m{c}' for c in _LEVELS)} FROM g),
l AS (SELECT *, {', '.join(f'm{c} - least(0, min(m{c}) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS l{c}' for c in _LEVELS)} FROM m),
e AS (SELECT *, l0 AS e0, {', '.join(f'l{c} - l{c - 1} AS e{c}' for c in _LEVELS if c)} FROM l),
b AS (SELECT *, {', '.join(f'lag(e{c}, 1, 0) OVER (ORDER BY i) AS b{c}, min(e{c}) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r{c}' for c in _LEVELS)} FROM e),
k AS (SELECT *, sum(CASE {' '.join(f'WHEN wins = {c} THEN CAST(r{c} > b{c} AS INT)' for c in _LEVELS)} END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS held,
  least({_SETS}, greatest(1, lost - lag(lost, 1, 0) OVER (ORDER BY i))) AS rise FROM b),
f AS (SELECT *, (rise + lost) / {_SETS}.0 / greatest(1, held) AS estimate FROM k)
SELECT id, CAST(wins AS INTEGER) AS n_won, round(estimate, 9) AS estimate, round(least(1.0, min(estimate) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_value FROM f""")
def atdc_qvalue(spark, sf_dir):
    a, b = F.col("o_custkey"), F.col("o_orderkey")
    made = [(a * 7919 + b * 104729) % 400009 + 0.25, (a * 611953 + b * 31) % 350003 + 0.5, (a * 15485863 + b * 7) % 300007 + 0.75]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + F.col("o_orderkey") * F.lit(1e-7)).alias("target"), F.array(*(x.cast("double") for x in made)).alias("decoys"))
    rows = rows.withColumn("n_won", F.size(F.filter("decoys", lambda d: d <= F.col("target"))))
    rated = averaged.atdc_qvalues(rows, ["id", "n_won"], ranges=12)
    return rated.select("id", "n_won", F.round("estimate", 9).alias("estimate"), F.round("q_value", 9).alias("q_value"))


@query("""WITH c AS (SELECT l_quantity AS s, count(*) FILTER (WHERE l_returnflag <> 'R') AS t, count(*) FILTER (WHERE l_returnflag = 'R') AS d FROM lineitem GROUP BY 1),
b AS (SELECT s, sum(t) OVER z AS tt, sum(d) OVER z AS dd, coalesce(sum(t) OVER y, 0) AS tb, coalesce(sum(d) OVER y, 0) AS db FROM c
  WINDOW z AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING), y AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT x.s AS lo, y.s AS hi, (y.dd - x.db) / (y.tt - x.tb) AS ratio FROM b x JOIN b y ON y.s <= x.s WHERE y.tt > x.tb),
m AS (SELECT c.s, r.lo, min(ratio) AS least FROM c JOIN r ON r.lo >= c.s AND r.hi <= c.s GROUP BY 1, 2),
p AS (SELECT s, least(1.0, max(least)) AS pep FROM m GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pep, 9) AS pep FROM lineitem JOIN p ON s = l_quantity WHERE l_returnflag <> 'R'""")
def posterior_error(spark, sf_dir):
    rows = confidence.posterior_errors(_lines(spark, sf_dir), "l_quantity", F.col("l_returnflag") == "R", out="pep")
    return rows.where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("pep", 9).alias("pep"))


def _order_spectra(spark, sf_dir):
    """Doubly charged spectra: an order's lines are peaks, its price sets the mass."""
    peaks = F.sort_array(F.collect_list(F.struct((F.col("l_extendedprice") / 50).alias("m"), F.col("l_quantity").cast("double").alias("i"))))
    lines = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("scan")).agg(peaks.alias("p"))
    mass = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan"), (F.col("o_totalprice") / 250).alias("neutral_mass"))
    rows = lines.join(mass, "scan").withColumn("precursor_mz", F.col("neutral_mass") / 2 + PROTON)
    return rows.select(F.lit("run").alias("file"), "scan", F.lit(2).alias("charge"), "precursor_mz", "neutral_mass", F.transform("p", lambda x: x["m"]).alias("mz"), F.transform("p", lambda x: x["i"]).alias("intensity"))


_PEPTIDES = f"""{_DIGEST}, rm(residue, m) AS (VALUES {', '.join(f"('{r}', {m!r})" for r, m in RESIDUE_MASS.items())}),
lt AS (SELECT sequence, k, CAST(m AS DOUBLE) AS m FROM (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS k FROM (SELECT DISTINCT sequence FROM g)) JOIN rm ON residue = substr(sequence, k, 1)),
pep AS (SELECT sequence, sum(m) + {WATER!r} AS mass FROM lt GROUP BY 1 HAVING count(*) = length(sequence) AND sum(m) + {WATER!r} BETWEEN 200 AND 7200),
pre AS (SELECT sequence, k, sum(m) OVER (PARTITION BY sequence ORDER BY k ROWS UNBOUNDED PRECEDING) AS b FROM lt),
ion AS (SELECT DISTINCT sequence, CAST(floor((x + {PROTON!r}) / 0.02 + 1 - 0.4) AS BIGINT) AS bin
  FROM (SELECT sequence, unnest([b, mass - {WATER!r} - b + {WATER!r}]) AS x FROM pre JOIN pep USING (sequence) WHERE k < length(sequence)))"""


@query(f"""{_PEPTIDES},
sp AS (SELECT o_orderkey AS scan, o_totalprice / 250 AS mass FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey),
pk AS (SELECT scan, mass, l_extendedprice / 50 AS mz, CAST(l_quantity AS DOUBLE) AS i FROM lineitem JOIN sp ON scan = l_orderkey),
ends AS (SELECT scan, CAST(floor((max(mz) + 76) / 0.02 + 1 - 0.4) AS BIGINT) AS ending FROM pk GROUP BY 1),
kept AS (SELECT scan, CAST(floor(mz / 0.02 + 1 - 0.4) AS BIGINT) AS bin, max(sqrt(i)) AS v FROM pk WHERE mz < mass + {PROTON!r} + 50 GROUP BY 1, 2),
clean AS (SELECT scan, bin, v, max(bin) OVER (PARTITION BY scan) // 10 + 1 AS size, v > 0.05 * max(v) OVER (PARTITION BY scan) AS stays FROM kept),
ten AS (SELECT scan, bin, v * 25000000.0 / max(v) OVER (PARTITION BY scan, bin // size) AS v FROM clean WHERE stays),
hit AS (SELECT scan, sequence, pep.mass FROM sp JOIN pep ON pep.mass BETWEEN sp.mass - 3 AND sp.mass + 3),
few AS (SELECT scan, count(*) AS n FROM hit GROUP BY 1),
seat AS (SELECT sequence, mass, row_number() OVER (ORDER BY mass, sequence) AS seat FROM pep),
upto AS (SELECT few.scan, n, (SELECT count(*) FROM pep WHERE pep.mass <= sp.mass + 3) AS upto FROM few JOIN sp USING (scan)),
pairs AS (SELECT scan, sequence, true AS active FROM hit UNION ALL SELECT scan, sequence, false FROM upto JOIN seat ON seat > upto AND seat <= upto + 30 - n),
near AS (SELECT p.scan, p.sequence, ion.bin, coalesce(sum(v) FILTER (WHERE ten.bin = ion.bin), 0) AS own, coalesce(sum(v) FILTER (WHERE ten.bin <> ion.bin), 0) AS around
  FROM pairs p JOIN ion USING (sequence) JOIN ends ON ends.scan = p.scan AND ion.bin < ending LEFT JOIN ten ON ten.scan = p.scan AND ten.bin BETWEEN ion.bin - 75 AND ion.bin + 74 GROUP BY 1, 2, 3),
score AS (SELECT scan, sequence, sum(trunc(own - around / 150)) / 1e8 AS x, count(*) FILTER (WHERE trunc(own - around / 150) > 0) AS hits FROM near GROUP BY 1, 2),
every AS (SELECT scan, sequence, active, coalesce(x, 0) AS x, coalesce(hits, 0) AS hits FROM pairs LEFT JOIN score USING (scan, sequence)),
seated AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY x DESC, sequence) AS k, count(*) OVER (PARTITION BY scan) AS n FROM every),
based AS (SELECT *, max(x) FILTER (WHERE k = least(greatest(CAST(floor(0.01 * n + 0.5) AS BIGINT) - 1, 2), n - 1) + 1) OVER (PARTITION BY scan) AS q FROM seated),
best AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY x DESC, sequence) AS rank FROM based WHERE active)
SELECT scan, sequence, CAST(rank AS INTEGER) AS rank, round(x + 3e-9, 4) AS xcorr, CAST(hits AS INTEGER) AS hits, round((x + 5) / (q + 5), 6) AS tailor FROM best WHERE rank <= 5""")
def search_xcorr(spark, sf_dir):
    # a peptide's places in its proteins are no part of the result, and every block of the search would hold them
    index = digestion.build_index(_proteins(spark, sf_dir), mods_spec="", decoy="none", locations=False, min_length=2, max_length=50)
    found = search.search(_order_spectra(spark, sf_dir), index, kind="mass", window=3.0)
    return found.select("scan", "sequence", F.col("`xcorr rank`").alias("rank"), F.round(F.col("`xcorr score`") + 3e-9, 4).alias("xcorr"), F.col("`b/y ions matched`").alias("hits"), F.round("`tailor score`", 6).alias("tailor"))
