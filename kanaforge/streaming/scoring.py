"""The evaluation operators on a streaming DataFrame.

Row metrics (MET-1..4) are stateless projections, so they run on a stream unchanged;
the macro averages (MET-5) become a streaming aggregation whose state is one running
sum per group and metric. Scored pairs can be appended to a sink as they arrive, and
the running averages read in ``complete`` mode. Start the queries with
``option("checkpointLocation", <shared folder>)`` so their offsets and aggregation
state survive a restart or the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.metrics import macro_metrics, row_metrics


def score_stream(stream: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Per-pair metrics for every arriving pair (append mode)."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame (spark.readStream)")
    return row_metrics(stream, reference, prediction)


def running_macro_metrics(stream: DataFrame, by: Sequence[str] = (), reference: str = "reference",
                          prediction: str = "prediction") -> DataFrame:
    """Running macro averages per group (complete or update mode)."""
    return macro_metrics(score_stream(stream, reference, prediction), by=by)
