"""Bit sets over the strings of a table, to leave rows out before they are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import Bloom, in_slices, prefix_hashes, text_hashes
from ..session import write_once

# Bytes of a bit set, at most.
BLOOM_BYTES = 32 << 20
# Words of a block: the 4 KiB that Spark's bitmap functions work on.
BLOCK_WORDS = 512
# Bytes of titles that are broadcast as they are, at most.
BROADCAST_MAX_BYTES = 64 << 20


def bloom_of(df: DataFrame, col: str, entries: int, prefixes: bool = False) -> Bloom:
    """Bit set over a string column (nulls left out) of about ``entries`` rows, or over all that
    its strings begin with (``prefixes``; ``entries`` counts these). Every task sets the bits of
    its rows in a set of its own, and the blocks of the sets are combined and collected as Arrow:
    a task sends, and the driver receives, at most ``BLOOM_BYTES``, however many rows there are.
    With more entries than bits it lets more through, and loses none."""
    n_words = min(BLOOM_BYTES // 8, max(1 << 10, entries * 10 // 64))
    n_blocks = -(-n_words // BLOCK_WORDS)

    def bits(batches):
        own = np.zeros((n_blocks, BLOCK_WORDS), np.uint64)
        for batch in batches:
            for part in in_slices(batch.column(0).to_pylist()):
                for bit in Bloom.bits(np.unique(prefix_hashes(part) if prefixes else text_hashes(part)), n_words):
                    np.bitwise_or.at(own.reshape(-1), (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        used = np.flatnonzero(own.any(axis=1))
        for some in np.array_split(used, -(-len(used) // 1024) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([own[i].tobytes() for i in some], pa.binary())], ["block", "bits"])

    known = df.select(F.col(col).alias("s")).filter(F.col("s").isNotNull())
    got = known.mapInArrow(bits, "block int, bits binary").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    words = np.zeros((n_blocks, BLOCK_WORDS), np.uint64)
    for block, of in zip(got.column("block").to_pylist(), got.column("bits")):
        words[block] = np.frombuffer(of.as_buffer(), np.uint64)
    return Bloom(words.reshape(-1)[:n_words])


def asked_rows(df: DataFrame, asked: DataFrame, col: str, broadcast_max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """The rows of ``df`` whose ``col`` is among the values of ``asked`` (its column of that
    name; nulls match nothing). ``asked`` is written and measured. A small one goes to every
    task, and no row of ``df`` moves; a larger one becomes a bit set that rows are held
    against where they are scanned, and only those that pass it (a few in a hundred of the
    others) are shuffled to the exact join."""
    asked = write_once(asked.select(col).filter(F.col(col).isNotNull()).distinct())
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(col) + 32).alias("bytes")).first()
    if (size["bytes"] or 0) <= broadcast_max_bytes:
        return df.join(F.broadcast(asked), on=col, how="left_semi")
    bound = df.sparkSession.sparkContext.broadcast(bloom_of(asked, col, size["n"]))

    @F.arrow_udf("boolean")
    def may_be_asked(values: pa.Array) -> pa.Array:
        return pa.array(bound.value.has(text_hashes(values.fill_null("").to_pylist())))

    return df.filter(F.col(col).isNotNull() & may_be_asked(F.col(col))).join(asked, on=col, how="left_semi")
