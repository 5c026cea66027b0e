"""Evaluation end to end: a predictor answers the source lines, answers and references are
paired strictly, and the row metrics are averaged."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import macro_metrics, row_metrics
from .model_io import batch_score
from .pairing import join_predictions


def evaluate(references: DataFrame, sources: DataFrame, make_predict_fn: Callable, key: str | Sequence[str] = "line_no",
             text: str = "text", by: Sequence[str] = (), batch_size: int = 64) -> DataFrame:
    """Macro metrics, per value of ``by`` (columns of ``references``) or over all lines.

    Both tables hold one line per ``key`` in ``text``; a line that one of them lacks fails
    the job (JOI-4). ``make_predict_fn`` is MDL-1's predictor."""
    keys = [key] if isinstance(key, str) else list(key)
    answers = batch_score(sources.select(*keys, F.col(text).alias("_source")), "_source", make_predict_fn, batch_size)
    # The reference carries its group through the pairing.
    packed = references.select(*keys, F.struct(F.col(text).alias("t"), *by).alias("_ref"))
    pairs = join_predictions(packed, answers, keys, "_ref", "prediction")
    rows = pairs.select(*[F.col(f"reference.{c}").alias(c) for c in by], F.col("reference.t").alias("reference"), "prediction")
    return macro_metrics(row_metrics(rows), by=list(by))
