"""Stored link and page tables (SRC-5), laid out so that walks and title joins need no
exchange of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.graph import walk_category

# Files of a table, and slices that the links of one category are spread over.
BUCKETS, SLICES = 64, 8


def _store(df: DataFrame, keys: list[str], table: str, path: str, buckets: int) -> None:
    # Dealt out as the buckets are, so that every bucket is one file.
    df.repartition(buckets, *keys).write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def store_links(links: DataFrame, table: str, path: str, buckets: int = BUCKETS, slices: int = SLICES) -> None:
    """SRC-5: write the links (category, member, member_ns, ord) as a table bucketed and
    sorted by (category, slice). The slice is a hash of the member, so a category that holds
    a third of all links lies in ``slices`` buckets, not in one. ``path``: a folder that all
    executors share."""
    sliced = links.withColumn("slice", F.pmod(F.xxhash64("member", "ord"), F.lit(slices)).cast("int"))
    _store(sliced, ["category", "slice"], table, path, buckets)


def store_pages(pages: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """SRC-5: write the pages as a table bucketed and sorted by title, for JOI-2 and GRP-3."""
    _store(pages, ["title"], table, path, buckets)


def walk_stored(spark: SparkSession, roots: DataFrame, table: str, max_depth: int = K.MAX_DEPTH, slices: int = SLICES,
                root_col: str = "root") -> DataFrame:
    """GRP-1 over a table of ``store_links`` (with the ``slices`` it was written with): the
    frontier goes to every slice of its categories, and the links stay in their buckets."""
    return walk_category(roots, spark.table(table), max_depth, root_col, slices=slices)
