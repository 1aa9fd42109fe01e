"""From raw documents to packed sequences: quality rules, line deduplication, near duplicates, decontamination, packing.

Each stage reads what the one before it kept, as written Parquet, so a lost executor costs a part of one stage.

Defined results, for all stages: null texts count as empty ones and null languages as one of their own; repeated rows are
judged alike; other columns, whatever their names, pass through all stages but the last; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import read_table, written
from ferrule.llm.decontam import decontaminated
from ferrule.llm.line_dedup import line_dedup
from ferrule.llm.ngram_join import one_of_each
from ferrule.llm.packing import best_fit_packing
from ferrule.llm.quality import quality_filter
from ferrule.plans.store import discard, scoped


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; empty and short ones go."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; one of which nothing but white space is left goes. Of equal places that
    with the least id stays, a null id before all; repeated rows are one place."""
    out = line_dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates, with all of its rows; rows with a null id, and
    texts without words, are classes of their own."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null text has the end token alone."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither a tokenizer nor best fit; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scoped(spark) as keep:  # what a stage makes on its way goes once its result is written
            docs = keep(written(stage(spark, before, sf_dir), name))
        if before is not docs and hasattr(before, "_stored_at"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
