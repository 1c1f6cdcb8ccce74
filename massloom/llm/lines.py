"""Site-relative line dedup: lines that stand on too large a share of their site's pages are dropped.

DataFrame expressions only. A page's distinct lines become 128-bit fingerprints, so
the count per (host, line) shuffles a few bytes a line and is combined before the
shuffle; a common line or a large host is no hot key. Lines are told apart by these 128 bits, their bytes are not compared
again. The list of a host's boilerplate
lines is bounded by (lines of a mean page) / ratio. It is written first, so that
Spark broadcasts it only where its measured size allows and otherwise joins by host with splitting of skewed
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.arrow import without
from massloom.session import written

RATIO = 0.1
#: A line of a single page is no boilerplate, whatever share of its host that page is.
MIN_PAGES = 2


def _mark(line: Column) -> Column:
    """Two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate_lines(pages: DataFrame, text: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row (``host``, ``marks``) for each host with lines on more than ``ratio`` of its pages and on ``min_pages`` at least."""
    site = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("site")
    totals = pages.groupBy(site).agg(F.count("*").alias("pages"))
    lines = pages.select(site, F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).where("line <> ''")
    counts = lines.select("site", _mark(F.col("line")).alias("mark")).groupBy("site", "mark").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= min_pages).join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("site").agg(F.collect_list("mark").alias("marks"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Replace ``text`` by its kept lines and append ``n_lines`` and ``n_dropped``.

    Lines are equal if their fingerprints are; empty lines always stay. A null text stays null (with
    0 lines), a null host counts as the empty host, repeated rows are pages of their
    own. Input columns named like the new ones are replaced.
    """
    pages = without(pages, ["n_lines", "n_dropped", "__site", "__marks", "__lines", "__near", "__kept"])
    names = pages.columns
    lists = written(boilerplate_lines(pages, text, host, ratio, min_pages), "boilerplate").select(F.col("site").alias("__site"), F.col("marks").alias("__marks"))
    joined = pages.withColumn("__site", F.coalesce(F.col(host).cast("string"), F.lit(""))).join(lists, "__site", "left")
    split = joined.withColumn("__lines", F.split(text, "\n"))
    # the host's marks that this page may hold, by one half of the mark (a hash set); most pages have few or none
    near = F.array_intersect(F.transform("__lines", lambda x: F.xxhash64(x)), F.transform("__marks", lambda m: m["a"]))
    split = split.withColumn("__near", F.when(F.col("__marks").isNull(), F.array().cast("array<bigint>")).otherwise(near))
    drop = lambda x: (x != "") & F.array_contains("__near", F.xxhash64(x)) & F.array_contains("__marks", _mark(x))
    out = split.withColumn("__kept", F.when(F.size("__near") == 0, F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~drop(x))))
    return out.select(
        *(F.array_join("__kept", "\n").alias(text) if c == text else F.col(f"`{c}`") for c in names),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def oracle(table: str = "documents", key: str = "doc_id", text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same in SQL: kept text and line counts of every row."""
    return f"""
WITH docs AS (SELECT {key}, {text} AS t, coalesce({host}, '') AS site FROM {table}),
totals AS (SELECT site, count(*) AS pages FROM docs GROUP BY site),
lines AS (SELECT site, unnest(list_distinct(string_split(t, chr(10)))) AS line FROM docs),
counts AS (SELECT site, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY site, line),
bad AS (SELECT c.site, list(c.line) AS marks FROM counts c JOIN totals t ON c.site = t.site
        WHERE c.n >= {min_pages} AND c.n > {ratio} * t.pages GROUP BY c.site),
split AS (SELECT d.{key}, d.t, string_split(d.t, chr(10)) AS ls, b.marks FROM docs d LEFT JOIN bad b ON d.site = b.site),
kept AS (SELECT {key}, t, ls, list_filter(ls, lambda x: x = '' OR marks IS NULL OR NOT list_contains(marks, x)) AS ks FROM split)
SELECT {key}, CASE WHEN t IS NULL THEN NULL ELSE array_to_string(ks, chr(10)) END AS {text},
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped
FROM kept"""
