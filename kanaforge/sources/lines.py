"""Line files (SRC-1, SNK-1): one record per line, the line number made explicit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import strip_ws

MODES = ("raw", "nonblank", "strip", "splitlines")

# Separators Python's str.splitlines honours beyond those Spark's text reader cuts at
# (\n, \r, \r\n): VT, FF, FS, GS, RS, NEL, LINE SEPARATOR, PARAGRAPH SEPARATOR.
EXTRA_LINE_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _scan(spark: SparkSession, path: str | Iterable[str], **options) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_file_size"),
        # Position inside the scan task; a task reads one block of one file in order.
        F.monotonically_increasing_id().alias("_pos"),
        F.col("value").alias("text"),
    )


def number_lines(df: DataFrame, order: list[Column | str], line_col: str = "line_no") -> DataFrame:
    """Dense 0-based line numbers per ``file`` from (file, _block) buckets: the rank in
    the bucket plus the rows of the earlier blocks of the same file. The per-block
    counts are one row per input split."""
    counts = df.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("file", "_block").orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(w))
    out = ranked.join(offs, on=["file", "_block"], how="inner")
    return out.withColumn(line_col, (F.col("_off") + F.col("_r") - 1).cast("long")).drop("_off", "_r")


def read_lines(spark: SparkSession, path: str | Iterable[str], mode: str = "raw") -> DataFrame:
    """SRC-1: a line file as (file, line_no, text), line_no 0-based per file.

    Modes: ``raw`` keeps every line; ``nonblank`` strips and drops blank lines (line
    numbers count kept lines only); ``strip`` strips and keeps blanks; ``splitlines``
    keeps every line and also cuts at the wider set of separators Python's
    ``splitlines`` uses.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    try:
        raw = _scan(spark, path)
    except AnalysisException as e:  # the reader resolves globs and every file system
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Input not found: {path}") from e
        raise
    order: list[Column | str] = ["_pos"]
    if mode == "nonblank":
        raw = raw.withColumn("text", strip_ws("text")).filter(F.length("text") > 0)
    elif mode == "strip":
        raw = raw.withColumn("text", strip_ws("text"))
    elif mode == "splitlines":
        parts = F.split(F.col("text"), K.char_class(EXTRA_LINE_BREAKS), -1)
        raw = raw.select("file", "_block", "_file_size", "_pos",
                         F.posexplode(parts).alias("_sub", "text"))
        order = ["_pos", "_sub"]
    out = number_lines(raw, order)
    return out.select("file", "line_no", "text")


def write_lines(df: DataFrame, path: str, order_col: str, text_col: str = "text",
                partitions: int | None = None, mode: str = "overwrite") -> None:
    """SNK-1: one line per row, in ``order_col`` order across the part files (range
    partitioned, sorted inside each part), so the parts read in name order give the
    full order. Each part ends with a newline."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, F.col(order_col)).sortWithinPartitions(order_col)
     .select(F.col(text_col).cast("string")).write.mode(mode).text(path))


def export_lines_single_file(df: DataFrame, local_path: str, order_col: str,
                             text_col: str = "text") -> int:
    """SNK-1, single-file form with no final newline, for small results only: rows are
    streamed to the driver one partition at a time. Returns the number of lines."""
    n = 0
    rows = df.select(order_col, text_col).orderBy(order_col).toLocalIterator()
    with open(local_path, "w", encoding="utf-8") as f:
        for i, r in enumerate(rows):
            if i:
                f.write("\n")
            f.write(r[text_col] or "")
            n += 1
    return n
