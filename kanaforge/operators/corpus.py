"""Parallel-corpus preparation in one lazy chain: written lines -> readings by
dictionary longest match (LEX-1) -> (reading, line) pairs -> cleaning and alphabet
filter (FLT-2) -> exact split (SPL-1). Each row keeps its key, so no positional
re-zip is needed between the steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .filters import clean_pairs
from .index import split_exact
from .lexicon import assign_readings


def build_parallel_corpus(lines: DataFrame, lexicon: DataFrame, line: str = "line_id", text: str = "text",
                          reading_text: str | None = None, chars: str = K.JA_PUNCT, lo: str = K.KANA_LO,
                          hi: str = K.KANA_HI, train: float = K.TRAIN_RATIO, test: float = K.TEST_RATIO,
                          validation: float = K.VALIDATION_RATIO, seed: int = K.SEED) -> DataFrame:
    """(line, source, target, split) for every kept pair: source = the reading of the
    line, target = the line. ``reading_text`` names a column to read instead of
    ``text`` (for example a case-folded copy); ``line`` must be unique."""
    src_col = reading_text or text
    readings = assign_readings(lines.select(line, F.col(src_col).alias("_src")), lexicon, line, "_src", "source")
    pairs = readings.join(lines.select(line, F.col(text).alias("target")), on=line, how="inner")
    kept = clean_pairs(pairs, "source", "target", chars, lo, hi)
    return split_exact(kept.withColumn("_k", F.col(line).cast("string")), "_k", train, test, validation,
                       seed).drop("_k")
