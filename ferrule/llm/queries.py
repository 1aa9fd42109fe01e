"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.chat import formatted_turns, read_back
from ferrule.llm.common import read_table
from ferrule.llm.decontam import overlaps
from ferrule.llm.hard_negatives import hard_negatives
from ferrule.llm.licenses import license_scan
from ferrule.llm.line_dedup import line_dedup
from ferrule.llm.ngram_join import ngram_join
from ferrule.llm.packing import best_fit_packing
from ferrule.llm.pii import pseudonymised
from ferrule.llm.quality import quality_rules
from ferrule.llm.tokens import prefix_counts
from ferrule.llm.vector_codes import vector_codes
from ferrule.llm.vector_graph import nearest_neighbours
from ferrule.llm.warc import archived


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(formatted_turns(rows))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read_table(spark, sf_dir, "documents"), "ferrule").select("doc_id", "text", "n_pseudonyms")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", moved), lambda vec_id: vec_id % 50 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_warc_revisits": op2_warc_revisits,
        "op3_ngram_join": op3_ngram_join,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_pii_pseudonyms": op8_pii_pseudonyms,
        "op9_token_counts": op9_token_counts,
        "op10_decontamination": op10_decontamination,
        "op11_nearest_neighbours": op11_nearest_neighbours,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_vector_codes": op13_vector_codes,
    }
