"""Global order, splits and samples (IDX-*, SPL-*, SMP-1, AGG-5).

A dense 0-based position in a total order is computed without a single-partition
window: rows are grouped into buckets that are monotone with the order (a hash prefix,
a file block, or range-partition bounds), bucket sizes are counted (a small table),
turned into offsets and joined back (a broadcast when small), and each row adds its
rank inside its bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import ensure_checkpoint_dir, write_once

_B, _N, _OFF, _MID = "_bkt", "_bkt_n", "_bkt_off", "_mid"


def _cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _offsets(counts: DataFrame, total_col: str | None) -> DataFrame:
    """Exclusive running sum of bucket sizes. ``counts`` has one row per bucket, so
    its size is bounded by the number of buckets, not by the data."""
    before = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col(_B), F.coalesce(F.sum(_N).over(before), F.lit(0)).cast("long").alias(_OFF)]
    if total_col:
        cols.append(F.sum(_N).over(Window.partitionBy()).cast("long").alias(total_col))
    return counts.select(*cols)


def with_global_index(df: DataFrame, order_cols: Sequence[Column | str], index_col: str = "idx",
                      bucket: Column | None = None, n_buckets: int | None = None,
                      total_col: str | None = None) -> DataFrame:
    """IDX-1: add ``index_col`` = dense 0-based position of the row in ``order_cols``
    order (which should be a total order, e.g. end with a unique key).

    ``bucket``: an expression monotone with the order (rows of a smaller bucket come
    first). Then the operator stays lazy: one aggregate for the bucket sizes and one
    shuffle by bucket for the in-bucket rank. The offsets table holds one row per
    distinct bucket value (a fixed-width hash prefix gives at most 65,536).

    Without ``bucket`` the frame is range-partitioned on the order, sorted within
    partitions and checkpointed to the cluster's checkpoint folder, so partition ids
    and positions are fixed before they are counted; range bounds come from a sample
    of the full sort key, so a hot value is still spread over several partitions.

    ``total_col``: also add the total row count (used by exact splits).
    """
    order = _cols(order_cols)
    if bucket is not None:
        b = df.withColumn(_B, bucket)
        counts = b.groupBy(_B).agg(F.count(F.lit(1)).alias(_N))
        offs = _offsets(counts, total_col)
        # Rank first: the rows are then hash-partitioned by bucket, and the join with
        # the offsets reuses that partitioning (or becomes a broadcast join when
        # adaptive execution measures the offsets table as small).
        w = Window.partitionBy(_B).orderBy(*order)
        ranked = b.withColumn("_rk", F.row_number().over(w))
        out = ranked.join(offs, on=_B, how="inner")
        out = out.withColumn(index_col, (F.col(_OFF) + F.col("_rk") - 1).cast("long"))
        return out.drop(_B, _OFF, "_rk")

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Without an explicit count adaptive execution may merge neighbouring ranges (order
    # is kept), so a small input does not become hundreds of tiny checkpoint files.
    ranged = df.repartitionByRange(n_buckets, *order) if n_buckets else df.repartitionByRange(*order)
    ranged = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn(_B, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    counts = ranged.groupBy(_B).agg(F.count(F.lit(1)).alias(_N))
    offs = _offsets(counts, total_col)
    local = F.col(_MID) - F.shiftleft(F.col(_B).cast("long"), 33)
    out = ranged.join(F.broadcast(offs), on=_B, how="inner")
    out = out.withColumn(index_col, (F.col(_OFF) + local).cast("long"))
    return out.drop(_B, _OFF, _MID)


def limit_ordered(df: DataFrame, n: int | None, order_cols: Sequence[Column | str]) -> DataFrame:
    """IDX-2: the first ``n`` rows in order (``None``/0 = all rows, sorted)."""
    ordered = df.orderBy(*_cols(order_cols))
    return ordered.limit(n) if n else ordered


def hash_key(key: Column | str, seed: int = K.SEED) -> Column:
    """md5 of 'seed:key' as lowercase hex: a reproducible shuffle order."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def check_ratios(train: float, test: float, validation: float) -> None:
    total = train + test + validation
    if not (1 - K.RATIO_TOLERANCE <= total <= 1 + K.RATIO_TOLERANCE):
        raise ValueError(f"the three split ratios add up to {total}; they must add up to 1")


def split_exact(df: DataFrame, key: str, train: float = K.TRAIN_RATIO, test: float = K.TEST_RATIO,
                validation: float = K.VALIDATION_RATIO, seed: int = K.SEED,
                split_col: str = "split") -> DataFrame:
    """SPL-1: exact split sizes. n_train = floor(n*train); of the rest r,
    n_test = floor(r*test/(test+validation)) and validation takes what remains; with
    test = 0 only train and validation. Membership: the first n_train rows in
    (md5(seed:key), key) order are train, and so on, so the split is reproducible and
    independent of partitioning. ``key`` must be unique.

    The rows themselves are neither shuffled nor ranked: two short jobs over the keys
    find the first row behind either boundary, and every row is compared with it."""
    check_ratios(train, test, validation)
    # Only the keys are needed to find the two boundaries: they are written once.
    keys = write_once(df.select(F.col(key).alias("_k"))).withColumn("_h", hash_key("_k", seed))
    # The first 4 hex digits are monotone with the md5 order: at most 65,536 counts.
    prefix = F.substring("_h", 1, 4)
    counts = sorted((r["p"], r["n"]) for r in keys.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    n_train = math.floor(total * train)
    n_test = math.floor((total - n_train) * (test / (test + validation))) if test > 0 else 0
    own = F.struct(hash_key(key, seed).alias("h"), F.col(key).alias("k"))
    split = F.lit("validation")
    for name, size in (("test", n_train + n_test), ("train", n_train)):
        split = F.when(_before(keys, counts, size, own), name).otherwise(split)
    return df.withColumn(split_col, split)


def _before(keys: DataFrame, counts: list[tuple[str, int]], size: int, own: Column) -> Column:
    """Whether a row is among the first ``size`` rows in (hash, key) order. Only the
    bucket that holds the boundary is ranked, a 65,536th of the keys."""
    for prefix, n in counts:
        if size < n:
            break
        size -= n
    else:
        return F.lit(True)  # the boundary lies behind the last row
    bucket = keys.filter(F.substring("_h", 1, 4) == prefix).select(F.struct(F.col("_h").alias("h"), F.col("_k").alias("k")).alias("s"))
    ranked = bucket.withColumn("_rn", F.row_number().over(Window.orderBy("s")))
    first_after = ranked.filter(F.col("_rn") == size + 1).first()["s"]
    k_type = keys.schema["_k"].dataType
    return own < F.struct(F.lit(first_after["h"]).alias("h"), F.lit(first_after["k"]).cast(k_type).alias("k"))


def hash_unit(key: Column | str, seed: int = K.SEED) -> Column:
    """A reproducible uniform number in [0, 1) from md5(seed:key)."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / float(2**32)


def split_hash(df: DataFrame, key: str, train: float = K.TRAIN_RATIO, test: float = K.TEST_RATIO,
               validation: float = K.VALIDATION_RATIO, seed: int = K.SEED,
               split_col: str = "split") -> DataFrame:
    """SPL-2: the same ratios in expectation, with no sort and no shuffle."""
    check_ratios(train, test, validation)
    u = hash_unit(key, seed)
    if test > 0:
        split = F.when(u < train, "train").when(u < train + test, "test").otherwise("validation")
    else:
        split = F.when(u < train, "train").otherwise("validation")
    return df.withColumn(split_col, split)


def sample_rows(df: DataFrame, n: int, key: str, by: Sequence[str] = ("split",),
                seed: int = K.SEED) -> DataFrame:
    """SMP-1: ``n`` reproducible example rows per group (smallest md5(seed:key)).
    Planned as a per-partition top-n before the shuffle (window group limit)."""
    w = Window.partitionBy(*by).orderBy(hash_key(key, seed), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def split_stats(df: DataFrame, split_col: str = "split") -> DataFrame:
    """AGG-5: rows per split, the total, and the percentage of the total."""
    counts = df.groupBy(split_col).agg(F.count(F.lit(1)).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the per-split table only
    return counts.select(split_col, "n", total.cast("long").alias("total"),
                         F.round(F.col("n") * 100.0 / total, 6).alias("pct"))
