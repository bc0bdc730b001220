"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import settle, table
from barloom.llm.decontaminate import decontaminate
from barloom.llm.language_id import fit_dictionaries, identify_language, training_rows
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.near_dedup import near_duplicates, without_ids
from barloom.llm.packing import pack_power_of_two

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin."""
    model = fit_dictionaries(training_rows(docs))
    return identify_language(docs, model).where(~F.col("rejected")).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that stand in ten documents or more, only the first occurrence stays; n_chars follows the text.
    Documents that have no text left go."""
    kept = dedup_lines(docs, min_docs=10, keep_first=True).where("n_dropped = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8)."""
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id")
    return without_ids(docs, gone).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids."""
    return pack_power_of_two(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("packing", pack)]

#: Compression, hashing and tokenizing can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
