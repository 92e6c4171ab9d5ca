"""The queries opN_<name>: thin digests of the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import mixing
from tracelake.llm.ann import ann
from tracelake.llm.bpe import encode_decode
from tracelake.llm.common import materialize, table
from tracelake.llm.embedding_dedup import embedding_dedup
from tracelake.llm.html_extract import html_extract
from tracelake.llm.pii import KINDS, pii
from tracelake.llm.simhash_dedup import simhash_dedup
from tracelake.llm.substring_dedup import substring_dedup
from tracelake.llm.token_count import token_counts
from tracelake.llm.toxicity import CUT, held_out, toxicity

TOKEN_LIMIT = 1024


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    # Texts are read once; a row is a few numbers and names from there on.
    return mixing.sampled(materialize(docs.drop("text"))).select(
        "doc_id", "mix_topic", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), F.round("mix_probability", 6).alias("mix_probability"), "mix_selected"
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.withColumn("base", F.filter("spans", lambda s: s["base"])).select(
        "doc_id", *map(of, KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans")
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_ann": op10_ann,
}
ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.oracle_sql()}
