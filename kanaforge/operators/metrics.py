"""Evaluation (MET-*): character-set precision/recall/F, CER, sentence accuracy, macro
and pooled averages, leaderboards and run comparisons.

Pairs are compared in one pass over Arrow batches (NFKC, character sets, edit distance: numpy
over the code points of the batch); everything else is a native expression or a grouped
aggregate. Averages are partial aggregates: one row per group and task crosses the shuffle,
so a hot model or dataset does not gather its rows in one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.distance import code_distances
from ..functions.matching import code_points
from ..functions.text import normalize_text
from ..session import write_once

METRIC_COLS = ("precision", "recall", "f_score", "cer", "sentence_accuracy")


def _ratio(num: Column, den: Column) -> Column:
    """num / den, or 0.0 when den is 0 (the reference's guard)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


# Characters of both sides that are worked on at a time, and cells of a character-set bitmap.
_SLICE, _SET_CELLS = 1 << 21, 1 << 22


def _row_slices(lengths: np.ndarray) -> Iterable[slice]:
    """Runs of rows of about ``_SLICE`` characters."""
    part = np.cumsum(lengths) // _SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    return (slice(x, y) for x, y in zip(cuts, cuts[1:]) if y > x)


def _sides(refs: list[str], preds: list[str], rule: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all references, then of all predictions, and where each begins; with
    the rule "normalize" after TXT-1 (NFKC, then all whitespace deleted), with "collapse" after
    MET-6's (runs of 2+ whitespace -> one space, then strip)."""
    texts = refs + preds
    if rule == "normalize":
        texts = [unicodedata.normalize("NFKC", t) for t in texts]
    elif rule == "collapse":
        texts = [re.sub(r"\s{2,}", " ", t).strip() for t in texts]
    codes, at = code_points(texts)
    if rule == "normalize":
        spaces = np.zeros(max(K.WHITESPACE_CODEPOINTS) + 2, bool)
        spaces[K.WHITESPACE_CODEPOINTS] = True
        kept = ~spaces[np.minimum(codes, len(spaces) - 1)]
        codes, at = codes[kept], np.append(0, np.cumsum(kept))[at]
    return codes, at


def _set_sizes(codes: np.ndarray, at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct characters of each reference, of each prediction, and of both."""
    number = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    number[codes] = 1
    letters = max(1, int(number.sum()))
    number = np.cumsum(number) - 1
    sizes, step = np.zeros((3, rows), np.int64), max(1, _SET_CELLS // letters)
    for x in range(0, rows, step):
        y, maps = min(x + step, rows), []
        for first in (x, rows + x):
            bounds = at[first:first + y - x + 1]
            there = np.zeros((y - x, letters), bool)
            there[np.repeat(np.arange(y - x), np.diff(bounds)), number[codes[bounds[0]:bounds[-1]]]] = True
            maps.append(there)
        for k, there in enumerate((*maps, maps[0] & maps[1])):
            sizes[k, x:y] = np.count_nonzero(there, axis=1)
    return sizes[0], sizes[1], sizes[2]


def _equal_rows(codes: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    length = np.diff(at)
    same = length[:rows] == length[rows:]
    a, b = np.repeat(same, length[:rows]), np.repeat(same, length[rows:])
    differ = codes[:at[rows]][a] != codes[at[rows]:][b]
    same[np.repeat(np.arange(rows), np.where(same, length[:rows], 0))[differ]] = False
    return same


def _compare(rule: str | None, sets: bool):
    """Column function (reference, prediction) -> the numbers behind the metrics of a pair:
    characters of the reference, edit distance, equality, and with ``sets`` the distinct
    characters of either side and of both. The code points of a batch are worked on together,
    so a pair crosses to Python once."""
    fields = ["length", "edits", "equal", *(("refs", "preds", "both") if sets else ())]

    @F.arrow_udf(", ".join(f"{f} {'boolean' if f == 'equal' else 'long'}" for f in fields))
    def compare(refs: pa.Array, preds: pa.Array) -> pa.Array:
        refs, preds = refs.fill_null("").to_pylist(), preds.fill_null("").to_pylist()
        done = [[np.zeros(0, bool if f == "equal" else np.int64)] for f in fields]
        sizes = np.fromiter(map(len, refs), np.int64, len(refs)) + np.fromiter(map(len, preds), np.int64, len(preds))
        for part in _row_slices(sizes):
            codes, at = _sides(refs[part], preds[part], rule)
            rows = part.stop - part.start
            length, equal, edits = np.diff(at), _equal_rows(codes, at, rows), np.zeros(rows, np.int64)
            other = np.flatnonzero(~equal)
            edits[other] = code_distances(codes, at[other], length[other], at[rows + other], length[rows + other])
            found = [length[:rows], edits, equal, *(_set_sizes(codes, at, rows) if sets else ())]
            for column, values in zip(done, found):
                column.append(values)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in done], fields)

    return compare


def row_metrics(df: DataFrame, reference: str = "reference", prediction: str = "prediction",
                normalize: bool = True, keep_normalized: bool = False) -> DataFrame:
    """MET-4 (with MET-1..3): one row per pair, five metrics x100.

    Both sides are normalised once (NFKC, whitespace removed; NULL -> '') and compared in the
    same pass over Arrow batches; the metrics are native expressions on the counts.
    """
    ref = F.coalesce(F.col(reference), F.lit(""))
    pred = F.coalesce(F.col(prediction), F.lit(""))
    if keep_normalized:
        df = df.withColumns({"_ref_n": normalize_text(ref) if normalize else ref, "_pred_n": normalize_text(pred) if normalize else pred})
    counted = df.withColumn("_m", _compare("normalize" if normalize else None, sets=True)(ref, pred))
    # Both character sets are distinct, so |P \ R| = |P| - |P & R|.
    out = (
        counted.withColumn("_prec", _ratio(F.col("_m.both"), F.col("_m.preds")))
        .withColumn("_rec", _ratio(F.col("_m.both"), F.col("_m.refs")))
        .withColumn("precision", F.col("_prec") * 100.0)
        .withColumn("recall", F.col("_rec") * 100.0)
        .withColumn(
            "f_score",
            _ratio(2.0 * F.col("_prec") * F.col("_rec"), F.col("_prec") + F.col("_rec")) * 100.0,
        )
        .withColumn(
            "cer",
            F.when(F.col("_m.length") > 0, F.col("_m.edits").cast("double") / F.col("_m.length")).otherwise(F.lit(1.0)) * 100.0,
        )
        .withColumn("sentence_accuracy", F.when(F.col("_m.equal"), F.lit(100.0)).otherwise(F.lit(0.0)))
    )
    return out.drop("_m", "_prec", "_rec")


def macro_metrics(scored: DataFrame, by: Sequence[str] = (), n_col: str | None = "n") -> DataFrame:
    """MET-5: unweighted means of the five row metrics (F is the mean of row F values)."""
    aggs = [F.avg(c).alias(c) for c in METRIC_COLS]
    if n_col:
        aggs.append(F.count(F.lit(1)).cast("long").alias(n_col))
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def corpus_cer(df: DataFrame, reference: str = "reference", prediction: str = "prediction",
               by: Sequence[str] = ()) -> DataFrame:
    """MET-6: training-time CER, a fraction: sum of edits / sum of reference lengths
    over pairs whose reference is not blank (FLT-5); 1.0 when no pair is left.
    No NFKC; whitespace runs are collapsed and ends stripped."""
    ref = F.coalesce(F.col(reference), F.lit(""))
    pred = F.coalesce(F.col(prediction), F.lit(""))
    t = df.select(*by, _compare("collapse", sets=False)(ref, pred).alias("_m"))
    keep = F.col("_m.length") > 0
    aggs = [
        F.sum(F.when(keep, F.col("_m.edits"))).alias("_edits"),
        F.sum(F.when(keep, F.col("_m.length"))).alias("_chars"),
        F.count_if(keep).alias("_pairs"),
    ]
    g = t.groupBy(*by).agg(*aggs) if by else t.agg(*aggs)
    return g.select(
        *by,
        F.when(F.col("_pairs") == 0, F.lit(1.0))
        .otherwise(F.col("_edits").cast("double") / F.col("_chars")).alias("corpus_cer"),
        F.coalesce(F.col("_edits"), F.lit(0)).cast("long").alias("edits"),
        F.coalesce(F.col("_chars"), F.lit(0)).cast("long").alias("ref_chars"),
        F.col("_pairs").cast("long").alias("pairs"),
    )


def leaderboard(runs: DataFrame, model: str = "model", dataset: str = "dataset",
                metric: str = "f_score", datasets: Sequence[str] | None = None) -> DataFrame:
    """MET-7: one row per model, one column per dataset holding ``metric``.
    ``runs`` holds one row per (model, dataset) (the output of MET-5). Pass
    ``datasets`` to avoid the extra job that finds the pivot values."""
    g = runs.groupBy(model)
    g = g.pivot(dataset, list(datasets)) if datasets is not None else g.pivot(dataset)
    return g.agg(F.first(metric))


def best_checkpoint(runs: DataFrame, by: Sequence[str] = ("dataset",), model: str = "model",
                    metric: str = "cer", greater_is_better: bool = False) -> DataFrame:
    """MET-8: the best model (checkpoint) per group; ties go to the smaller name."""
    key = F.struct((-F.col(metric)) if greater_is_better else F.col(metric), F.col(model))
    return runs.groupBy(*by).agg(
        F.min_by(F.col(model), key).alias("best_model"),
        F.min_by(F.col(metric), key).alias(f"best_{metric}"),
    )


def keep_last_checkpoints(runs: DataFrame, step: str = "step", by: Sequence[str] = (),
                          keep: int = 3) -> DataFrame:
    """MET-8 (retention): the ``keep`` most recent checkpoints per group."""
    if not by:
        return runs.orderBy(F.col(step).desc()).limit(keep)  # a top-k, no global window
    w = Window.partitionBy(*by).orderBy(F.col(step).desc())
    return runs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def compare_outputs(preds: DataFrame, key: Sequence[str], model: str = "model",
                    prediction: str = "prediction", models: Sequence[str] | None = None) -> DataFrame:
    """MET-9: the same input scored by several models, side by side (one column per
    model). Each (key, model) holds one prediction, so ``first`` is exact.

    With ``models`` the rows are shuffled as they are and sorted behind the shuffle, a partition
    at a time; an aggregate before it would sort, and spill, all texts of a task to save little
    (the repeated reference of a key compresses well)."""
    if models is None:
        return preds.groupBy(*key).pivot(model).agg(F.first(prediction))
    # A struct, so that a null prediction counts as one.
    answer = lambda m: F.first(F.when(F.col(model) == m, F.struct(F.col(prediction).alias("p"))), ignorenulls=True)
    g = preds.select(*key, model, prediction).repartition(*key).groupBy(*key)
    return g.agg(*[answer(m).alias(str(m)) for m in models]).select(*key, *[F.col(f"`{m}`.p").alias(str(m)) for m in models])


def metric_deltas(runs: DataFrame, base_model: str, model: str = "model", dataset: str = "dataset",
                  metrics: Sequence[str] = METRIC_COLS) -> DataFrame:
    """MET-10: each run minus the base model's run on the same dataset. The base side
    holds one row per dataset."""
    runs = write_once(runs)  # a row for each run, read twice here; scoring below it runs once
    base = runs.filter(F.col(model) == base_model).select(
        F.col(dataset), *[F.col(m).alias(f"_base_{m}") for m in metrics]
    )
    out = runs.join(base, on=dataset, how="inner")
    return out.select(
        model, dataset, *[(F.col(m) - F.col(f"_base_{m}")).alias(f"delta_{m}") for m in metrics]
    )
