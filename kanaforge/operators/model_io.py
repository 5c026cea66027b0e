"""Model-facing data work (MDL-1..5): character encoding and decoding against a
vocabulary, example preparation, length buckets and batch scoring with a caller's
predictor.

Encoding and decoding are row-local maps over Arrow batches. The vocabulary is a
character set, so its arrays go along with the function; examples are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from ..functions import constants as K
from ..functions.text import format_prompt

UNK_ID = -1


def _vocab_arrays(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their ids, by code point. A vocabulary has at most one entry per
    Unicode character, so it is bounded whatever the corpus."""
    rows = sorted((ord(r["ch"]), int(r["idx"])) for r in vocab.select("ch", "idx").collect() if r["ch"] is not None and len(r["ch"]) == 1)
    return np.array([c for c, _ in rows], np.uint32), np.array([i for _, i in rows], np.int32)


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of Arrow strings in a row (null: none), and where each string begins
    and ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=ends[1:])
    if not ends[-1]:
        return np.zeros(0, np.uint32), ends
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    joined = texts.buffers()[2].slice(int(cuts[0]), int(cuts[-1] - cuts[0])).to_pybytes().decode("utf-8")
    return np.frombuffer(joined.encode("utf-32-le"), "<u4"), ends


def _strings(chars: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow strings from code points in a row and where each string begins and ends."""
    size = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    cuts = np.append(0, np.cumsum(size))[ends].astype(np.int64)
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).cast(pa.string())


# Characters or ids that are worked on at a time, beside the strings and lists of the batch.
PIECE = 1 << 20


def _in_pieces(rows: pa.Array, work: Callable[[pa.Array], pa.Array], sizes: pa.Array, kind: pa.DataType) -> pa.Array:
    """``work`` over runs of rows of about ``PIECE`` bytes or ids: its arrays of several times
    the batch are held for one run only, however many rows a batch has."""
    part = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rows)]
    done = [work(rows.slice(x, y - x)) for x, y in zip(cuts, cuts[1:]) if y > x]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _encoder(vocab: DataFrame, max_length: int | None, unk_id: int):
    """Column function: text -> ids of its characters. Arrow strings in, Arrow lists out: the
    ids of a batch are looked up at once, and offsets cut them into rows."""
    points, ids = _vocab_arrays(vocab)
    table = np.full(int(points[-1]) + 2 if len(points) else 1, unk_id, np.int32)
    table[points] = ids

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        def piece(part: pa.Array) -> pa.Array:
            chars, ends = _code_points(part if max_length is None else pc.utf8_slice_codeunits(part, 0, max_length))
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(table[np.minimum(chars, len(table) - 1)]))

        return _in_pieces(texts, piece, pc.binary_length(texts), pa.list_(pa.int32()))

    return encode


def encode_chars(df: DataFrame, text: Column | str, vocab: DataFrame, max_length: int | None = None,
                 unk_id: int = UNK_ID, out: str = "input_ids") -> DataFrame:
    """MDL-2: text -> ARRAY<INT> of vocabulary indices of its characters (of the first
    ``max_length``, if given); characters outside the vocabulary get ``unk_id``. NULL and
    empty texts get an empty array. A row-local map over Arrow batches: the vocabulary
    goes to the tasks, no character crosses a shuffle."""
    return df.withColumn(out, _encoder(vocab, max_length, unk_id)(F.col(text) if isinstance(text, str) else text))


def decode_ids(df: DataFrame, ids: str, vocab: DataFrame, out: str = "text", pad_id: int | None = None,
               skip_ids: Sequence[int] = ()) -> DataFrame:
    """MDL-3: ids -> text. ``pad_id`` and ``skip_ids`` (special tokens) decode to nothing
    even where the vocabulary has an entry for them, as do ids without an entry (negative
    ones, the label filler -100, out-of-range predictions). NULL: empty text."""
    points, entries = _vocab_arrays(vocab)
    gone = {int(i) for i in skip_ids} | ({pad_id} if pad_id is not None else set())
    keep = np.array([int(i) not in gone and int(i) >= 0 for i in entries], bool)
    table = np.zeros(int(entries[keep].max(initial=-1)) + 1, np.uint32)
    known = np.zeros(len(table), bool)
    table[entries[keep]], known[entries[keep]] = points[keep], True

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        def piece(part: pa.Array) -> pa.Array:
            values = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)))
            kept = (values >= 0) & (values < len(table))
            kept[kept] = known[values[kept]]
            return _strings(table[values[kept]], np.append(0, np.cumsum(kept))[ends])

        return _in_pieces(rows, piece, pc.list_value_length(rows), pa.string())

    return df.withColumn(out, decode(F.col(ids)))


def prepare_examples(df: DataFrame, vocab: DataFrame, source: str = "source", target: str = "target",
                     prefix: str = K.PROMPT_PREFIX, max_length: int | None = None) -> DataFrame:
    """MDL-5: prompt + source -> ``input_ids`` and ``attention_mask``; target ->
    ``labels``; both cut to ``max_length``, if given. Both sides go through Python together."""
    encode = _encoder(vocab, max_length, UNK_ID)
    both = df.withColumns({"input_ids": encode(format_prompt(F.col(source), prefix)), "labels": encode(F.col(target))})
    return both.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def map_batches(df: DataFrame, fn: Callable, schema, batch_rows: int | None = None) -> DataFrame:
    """MDL-5, caller-supplied form: apply ``fn(pandas.DataFrame) -> pandas.DataFrame``
    to Arrow batches of each partition (a batched map over the examples), with the
    output ``schema``. ``batch_rows`` caps the rows per batch for memory-bound
    functions (Spark's ``arrowMaxRecordsPerBatch`` otherwise)."""

    def run(batches):
        for pdf in batches:
            if batch_rows:
                for start in range(0, len(pdf), batch_rows):
                    yield fn(pdf.iloc[start:start + batch_rows])
            else:
                yield fn(pdf)

    return df.mapInPandas(run, schema)


def length_buckets(df: DataFrame, text: str = "text", width: int = 64) -> DataFrame:
    """MDL-4: examples grouped by length band ``floor(length / width)``, so batches can
    be formed from rows of similar length: (bucket, n, min_len, max_len)."""
    ln = F.length(F.col(text))
    return df.select(F.floor(ln / width).cast("long").alias("bucket"), ln.alias("_len")).groupBy("bucket").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.min("_len").cast("long").alias("min_len"),
        F.max("_len").cast("long").alias("max_len"))


def with_length_bucket(df: DataFrame, text: str = "text", width: int = 64, partitions: int | None = None) -> DataFrame:
    """MDL-4: tag each example with its length band and lay the rows out so that each
    partition holds rows of one or a few neighbouring bands (range partitioning on the
    band, then a hash of the text): batches cut from a partition are even in length,
    and a band holding most rows is spread over many partitions instead of one."""
    b = df.withColumn("bucket", F.floor(F.length(F.col(text)) / width).cast("long"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return b.repartitionByRange(n, F.col("bucket"), F.xxhash64(F.col(text)))


def length_batches(df: DataFrame, key: Sequence[str], text: str = "text", batch_rows: int = 8, mega_batches: int = 50,
                   max_tokens: int | None = None, seed: int = K.SEED) -> DataFrame:
    """MDL-4: ``df`` cut into batches of similar length, with ``mega_batch``, ``batch`` (from 0
    inside its mega-batch, longest first), ``batch_len`` (length of its longest text, to which
    the others are padded).

    Rows are dealt to mega-batches of about ``batch_rows * mega_batches`` rows by a hash of
    seed and key, which is the random order of an epoch; inside one they are sorted by length,
    longest first, ties by that hash, and cut into batches of ``batch_rows``; or, with
    ``max_tokens``, into as few as keep rows x batch_len within it (a longer row is alone). One
    shuffle by mega-batch, each of bounded size, lays the rows out; sort a partition by
    (mega_batch, batch) to feed them. A null text has length 0; null key parts count as text
    "null". Columns of ``df`` that have one of the three names are replaced."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("mega_batch", "batch", "batch_len")])
    megas = max(1, -(-df.count() // (batch_rows * mega_batches)))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key]).cast("binary"))
    dealt = df.withColumn("_hash", digest).withColumn("_len", F.coalesce(F.length(F.col(text)), F.lit(0))).withColumn(
        "mega_batch", F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") % megas)
    order = [F.col("_len").desc(), F.col("_hash")]
    if max_tokens is None:
        w = Window.partitionBy("mega_batch")
        cut = dealt.withColumn("batch", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / batch_rows).cast("long"))
        return cut.withColumn("batch_len", F.max("_len").over(Window.partitionBy("mega_batch", "batch")).cast("long")).drop("_len", "_hash")
    schema = StructType([*(f for f in dealt.schema if f.name not in ("_len", "_hash")), StructField("batch", LongType()), StructField("batch_len", LongType())])

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_len", "descending"), ("_hash", "ascending")])
        batch, first, held, numbers, longest = -1, 0, 0, [], []
        for n in rows.column("_len").to_pylist():
            held += 1
            if batch < 0 or held * first > max_tokens:
                batch, first, held = batch + 1, n, 1
            numbers.append(batch)
            longest.append(first)
        return rows.drop_columns(["_len", "_hash"]).append_column("batch", pa.array(numbers, pa.int64())).append_column("batch_len", pa.array(longest, pa.int64()))

    return dealt.groupBy("mega_batch").applyInArrow(fill, schema)


def padding_report(batches: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """MDL-4: what padding costs: (by, batches, n_rows, tokens, padded, padding_share) for the
    result of ``length_batches``. padding_share: padding of all positions, 0 without any."""
    each = batches.groupBy(*by, "mega_batch", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long")).alias("t"), F.max("batch_len").alias("l"))
    total = each.groupBy(*by).agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                                  F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.col("n") * F.col("l")), F.lit(0)).alias("padded"))
    share = F.when(F.col("padded") > 0, 1 - F.col("tokens") / F.col("padded")).otherwise(0.0)
    return total.withColumn("padding_share", F.round(share, 6))


def batch_score(df: DataFrame, text: Column | str, make_predict_fn: Callable, batch_size: int = 64,
                return_type: DataType = StringType(), prefix: str | None = K.PROMPT_PREFIX,
                out: str = "prediction") -> DataFrame:
    """MDL-1: prompt each text, run the caller's predictor in Arrow batches of
    ``batch_size`` rows, and add the prediction column. ``make_predict_fn`` is called
    once per Python worker and returns ``predict(np.ndarray[str]) -> np.ndarray``."""
    from pyspark.ml.functions import predict_batch_udf

    t = F.col(text) if isinstance(text, str) else text
    inp = format_prompt(t, prefix) if prefix else t
    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size)
    return df.withColumn(out, udf(inp))
