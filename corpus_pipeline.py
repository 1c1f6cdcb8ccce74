"""The corpus pipeline: five operators applied one after another to ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of ``docs``. ``run`` writes each stage's rows in the
shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import contamination, lines, neardup, pieces, toxicity
from massloom.session import table, written

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted again."""
    kept = out.select(*(f"`{c}`" for c in docs.columns))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above their language's toxicity threshold go."""
    labels = table(spark, sf_dir, "labels").where(toxicity.crc_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="__score", flag="__flag")
    return scored.where(~F.col("__flag")).select(*(f"`{c}`" for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; the documents stay."""
    return _like(lines.drop_boilerplate(docs), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    return neardup.keep_first(docs).select(*(f"`{c}`" for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go; the documents stay."""
    return _like(contamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and whether they decode to the text."""
    out = pieces.round_trip(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), PIECE_MODEL)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.translate("text", "▁", " ")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Training a classifier, tokenising and checking similarities have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
