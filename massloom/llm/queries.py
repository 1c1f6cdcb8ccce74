"""The registered queries of this subpackage and their SQL, collected from its modules."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm import audit, chat, contamination, fingerprints, lines, neardup, oracles, pieces, quality, resample, substrings, topk, toxicity, warc
from massloom.session import new_path, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.drop_boilerplate(docs).drop("source")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.round_trip(docs, PIECE_MODEL)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.digests(chat.format_examples(turns.unionByName(own)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(toxicity.crc_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (toxicity.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "flagged")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = quality.classify(docs, labels, toxicity.crc_mod("doc_id", 5) != 0)
    return scored.select("doc_id", (toxicity.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    crawled, kept = new_path(spark, "warc-crawled"), new_path(spark, "warc-kept")
    warc.archive(pages, crawled)
    warc.deduplicate(spark, crawled, kept)
    records = warc.read_archive(spark, kept, payloads=False)
    return records.select(F.col("key").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.remove_repeats(docs)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    out = out.select("doc_id", F.length("kept").cast("long").alias("left"), removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return out.select("doc_id", (F.col("left") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = contamination.find_contamination(docs, benchmark).drop("text")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    items = F.array_sort(F.array_distinct("hit_items"))
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.text_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.audit(rows, list("ABCDE"), ["good", "toxic"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_neardup": op9_neardup,
    "op10_decontamination": op10_decontamination,
    "op11_fingerprints": op11_fingerprints,
    "op12_resample": op12_resample,
    "op13_filter_audit": op13_filter_audit,
}

_OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLE: dict[str, str] = {
    "op1_topk_search": _OP1,
    "op2_line_dedup": lines.oracle(),
    "op4_chat_format": oracles.CHAT,
    "op7_warc": oracles.WARC,
    "op8_substring_dedup": oracles.SUBSTRINGS,
    "op9_neardup": oracles.NEAR,
    "op10_decontamination": oracles.LEAKS,
    "op12_resample": oracles.DRAW,
    "op13_filter_audit": oracles.AUDIT,
}
