"""A training-corpus pipeline over ``documents``: quality rules, line dedup, SimHash
near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result below ``spark.checkpoint.dir`` and reads it again as the next one's input.
All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanaforge.llm import line_dedup, mixing, packing, quality, simhash
from kanaforge.llm.common import materialize, table

CAPACITY = 4096


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites; n_chars follows the new text."""
    cut = line_dedup.drop_boilerplate(docs, min_sites=line_dedup.site_threshold(docs), lines_beside=True)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the smallest doc_id."""
    return simhash.near_dedup(docs, shingle=4, max_bits=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens follow the tempered target shares."""
    return mixing.sample_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its ids, sequence and offset."""
    pieces = packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=CAPACITY)
    return pieces.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot express the fitted stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
