"""Character vocabulary (AGG-2, AGG-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_set, strip_ws


# Code points of one bitmap (Spark's fixed value).
BITMAP_BITS = 32_768


def char_of(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def build_vocab(df: DataFrame, col: str = "text", strip: bool = True) -> DataFrame:
    """AGG-2: distinct characters of the (stripped) lines, sorted by code point,
    indexed from 0: (ch, idx).

    Every task sets bits in one bitmap for each 32,768 code points, so the only exchange of
    the corpus moves at most 35 bitmaps of 4 KiB a task; the merged ones are numbered and
    spread out in place."""
    text = strip_ws(F.col(col)) if strip else F.col(col)
    code = df.select(F.explode(char_set(text)).alias("ch")).select(F.ascii("ch").cast("long").alias("code"))
    maps = code.groupBy(F.bitmap_bucket_number("code").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 35 rows
    maps = maps.withColumn("offset", F.coalesce(F.sum(F.bitmap_count("bits")).over(before), F.lit(0)))
    byte = lambda p: F.conv(F.hex(F.substring("bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.filter(F.sequence(F.lit(0), F.lit(BITMAP_BITS - 1)), lambda p: F.getbit(byte(p), p % 8) == 1)
    # Bucket 0 holds code point 0 alone, bucket b > 0 the 32,768 from (b - 1) * 32,768 + 1 on.
    first = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITMAP_BITS + 1).otherwise(0)
    spread = maps.select(first.alias("first"), "offset", F.posexplode(there).alias("nth", "place"))
    return spread.select(char_of(F.col("first") + F.col("place")).alias("ch"), (F.col("offset") + F.col("nth")).cast("long").alias("idx"))


def vocab_summary(vocab: DataFrame, k: int = 10) -> DataFrame:
    """AGG-3: the vocabulary size (no special tokens are counted) next to the first k
    entries. The window runs over the vocabulary, which is bounded by the character
    set."""
    size = F.count(F.lit(1)).over(Window.partitionBy()).cast("long")
    return vocab.withColumn("vocab_size", size).filter(F.col("idx") < k).select("vocab_size", "idx", "ch")
