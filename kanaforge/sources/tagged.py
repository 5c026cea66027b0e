"""Tagged dumps (SRC-3): one row per ``<doc ...>body</doc>`` block."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import block_body, tagged_bodies
from .lines import _scan, number_lines


def read_tagged_docs(spark: SparkSession, path: str | Iterable[str], tag: str = "doc") -> DataFrame:
    """SRC-3: blocks of dump files (plain or compressed) as (file, block_no, body).

    The reader cuts records at the closing tag, so a block spanning many lines is one
    record and no file is held whole in one row; each record gives its ``block_body``,
    the same rule as for a column. The last record of a file may be unclosed text. It is
    a block only if a closing tag follows the file's last opening tag, which a second
    scan, cut at the opening tags, tells from the content alone.
    """
    recs = _scan(spark, path, lineSep=f"</{tag}>")
    at_open = _scan(spark, path, lineSep=f"<{tag}")
    closed = at_open.groupBy("file").agg(
        F.max_by(F.col("text").contains(f"</{tag}>"), F.struct("_block", "_pos")).alias("_last_closed"))
    last = recs.groupBy("file").agg(F.max(F.struct("_block", "_pos")).alias("_last")).join(closed, "file", "left")
    j = recs.withColumn("body", block_body("text", tag)).filter(F.length("body") > 0).join(last, on="file", how="inner")
    is_last = F.struct("_block", "_pos") == F.col("_last")
    # Numbered per file like lines: rank inside each (file, split block) plus the
    # blocks of earlier splits, so one very large file is not ranked by one task.
    blocks = j.filter(~is_last | F.coalesce("_last_closed", F.lit(False)))
    numbered = number_lines(blocks.select("file", "_block", "_pos", "body"), ["_pos"], line_col="block_no")
    return numbered.select("file", "block_no", "body")


def tagged_docs_in_column(df: DataFrame, col: str, tag: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC-3 for text already in a column: one row per block (block_no, body)."""
    return df.select(*keep, F.posexplode(tagged_bodies(F.col(col), tag)).alias("block_no", "body")).withColumn(
        "block_no", F.col("block_no").cast("long"))
