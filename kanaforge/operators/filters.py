"""Filters and predicates (FLT-*) and the filter counters (AGG-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import is_valid_alphabet, strip_chars, strip_ws


def clean_pairs(df: DataFrame, source: str = "source", target: str = "target",
                chars: str = K.JA_PUNCT, lo: str = K.KANA_LO, hi: str = K.KANA_HI,
                keep_flag: str | None = None) -> DataFrame:
    """FLT-2: delete ``chars`` and trim on both sides; keep the pair iff the cleaned
    source is non-empty and inside the alphabet [lo, hi]. The target is cleaned but
    never tested. With ``keep_flag`` every row is returned with a boolean column of
    that name instead of filtering (used by the counters)."""
    out = df.withColumn(source, strip_chars(source, chars))
    ok = is_valid_alphabet(F.col(source), lo, hi)
    if keep_flag is not None:
        return out.withColumn(keep_flag, ok).withColumn(target, strip_chars(target, chars))
    # The source test is placed before the target projection, so the target is only
    # cleaned for rows that survive.
    return out.filter(ok).withColumn(target, strip_chars(target, chars))


def filter_counts(df: DataFrame, ok: Column | str, by: list[str] | tuple = ()) -> DataFrame:
    """AGG-1: valid, filtered and total rows (per group when ``by`` is given)."""
    okc = F.col(ok) if isinstance(ok, str) else ok
    aggs = [
        F.count_if(okc).cast("long").alias("valid"),
        F.count_if(~okc).cast("long").alias("filtered"),
        F.count(F.lit(1)).cast("long").alias("total"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """FLT-3: drop rows that are empty after a whitespace strip (NULL counts as blank)."""
    return df.filter(F.length(strip_ws(F.col(col))) > 0)


def min_length(df: DataFrame, col: str, n: int = K.MIN_SENTENCE_LEN) -> DataFrame:
    """FLT-4: keep rows longer than ``n`` code points."""
    return df.filter(F.length(F.col(col)) > n)


def drop_empty_refs(df: DataFrame, reference: str = "reference") -> DataFrame:
    """FLT-5: before the pooled CER, drop pairs whose reference is blank."""
    return drop_blank(df, reference)


def namespace(df: DataFrame, ns: int, col: str = "ns") -> DataFrame:
    """FLT-6: pages (0) or categories (14)."""
    return df.filter(F.col(col) == ns)
