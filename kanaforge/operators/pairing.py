"""Joins and pairing (JOI-*), group ranks, and the domain summary (AGG-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .bloom import BROADCAST_MAX_BYTES, asked_rows
from .index import with_global_index


def pair_by_position(a: DataFrame, b: DataFrame, key: str | Sequence[str] = "line_no",
                     a_col: str = "text", b_col: str = "text", a_as: str = "source",
                     b_as: str = "target", strict: bool = False) -> DataFrame:
    """JOI-1: zip two line tables by position (an equi-join on the position key).
    ``strict=False`` keeps only positions present on both sides (zip stops at the
    shorter); ``strict=True`` is a full outer join that fails the job at a position
    which one side lacks, naming the position and the side. Nothing runs while the
    plan is built, and either side is computed once."""
    keys = [key] if isinstance(key, str) else list(key)
    left = a.select(*keys, F.col(a_col).alias(a_as))
    right = b.select(*keys, F.col(b_col).alias(b_as))
    if not strict:
        return left.join(right, on=keys, how="inner")
    both = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), on=keys, how="full_outer")
    where = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    lost = F.when(F.col("_left").isNull(), "first").otherwise("second")
    error = F.raise_error(F.concat(F.lit("Lines differ: the "), lost, F.lit(" side has no line "), where))
    # Every output column carries the check, so no selection of columns prunes it away.
    whole = F.col("_left") & F.col("_right")
    return both.select(*[F.when(whole, F.col(c)).otherwise(error.cast(both.schema[c].dataType)).alias(c) for c in [*keys, a_as, b_as]])


def join_predictions(refs: DataFrame, preds: DataFrame, key: str | Sequence[str] = "line_no",
                     ref_col: str = "text", pred_col: str = "text") -> DataFrame:
    """JOI-4: attach each prediction to its reference by line (strict: both
    sides must have the same lines) as (key, reference, prediction), ready for the metrics."""
    return pair_by_position(refs, preds, key, ref_col, pred_col, "reference", "prediction", strict=True)


def rank_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  rank_col: str = "rank") -> DataFrame:
    """0-based rank of each row inside its group in ``order_cols`` order.

    Not a window partitioned by the group: a single hot group would then be sorted by
    one task. Instead a global index over (group, order) is taken (range partitions
    split a hot group), the first index of each group is a partial aggregate, and the
    rank is the difference. The join back is on the group key against one row per
    group, which adaptive skew-join handling splits when a group is hot."""
    idx = with_global_index(df, [*group_cols, *order_cols], index_col="_gidx")
    first = idx.groupBy(*group_cols).agg(F.min("_gidx").alias("_first"))
    out = idx.join(first, on=list(group_cols), how="inner")
    return out.withColumn(rank_col, F.col("_gidx") - F.col("_first")).drop("_gidx", "_first")


def title_status(titles: DataFrame, pages: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """JOI-2: status of every requested title: 'found' (page with text), 'empty' (page
    whose text is blank) or 'missing' (no page). Blankness is told where the pages are
    scanned, so the join moves titles and flags alone."""
    blank = F.length(strip_ws(F.coalesce(F.col(text), F.lit("")))) == 0
    p = pages.select(F.col(title).alias("_t"), blank.alias("_blank"))
    status = F.when(F.col("_t").isNull(), "missing").when(F.col("_blank"), "empty").otherwise("found")
    return titles.join(p, titles[title] == p["_t"], "left").withColumn("status", status).drop("_t", "_blank")


def lookup_titles(titles: DataFrame, pages: DataFrame, title: str = "title", text: str = "text",
                  broadcast_max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """JOI-2: ``title_status`` with the page text. Texts of pages that nobody asked for do
    not move."""
    p = asked_rows(pages.select(F.col(title), F.col(text)), titles.select(title), title, broadcast_max_bytes)
    p = p.select(F.col(title).alias("_t"), F.col(text).alias("_text"))
    out = titles.join(p, titles[title] == p["_t"], "left")
    status = (F.when(F.col("_t").isNull(), "missing")
              .when(F.length(strip_ws(F.coalesce(F.col("_text"), F.lit("")))) == 0, "empty")
              .otherwise("found"))
    return out.withColumn("status", status).withColumnRenamed("_text", text).drop("_t")


def found_titles(titles: DataFrame, pages: DataFrame, title: str = "title") -> DataFrame:
    """JOI-2: requested titles that exist (left semi join)."""
    return titles.join(pages.select(F.col(title)), on=title, how="left_semi")


def missing_titles(titles: DataFrame, pages: DataFrame, title: str = "title") -> DataFrame:
    """JOI-2: requested titles with no page (left anti join)."""
    return titles.join(pages.select(F.col(title)), on=title, how="left_anti")


def resolve_domain(names: DataFrame, domains: DataFrame, name: str = "name",
                   domain: str = "domain", category: str = "category", ord_col: str = "ord") -> DataFrame:
    """JOI-3: a requested name matches a domain case-insensitively and expands to its
    categories in order; an unknown name stands for itself as one category (ord 0,
    ``matched`` false). The columns of ``names`` are carried to the output."""
    d = domains.select(
        F.lower(F.col(domain)).alias("_dl"), F.col(domain).alias("_domain"),
        F.col(category).alias("_category"), F.col(ord_col).alias("_ord"),
    )
    j = names.join(d, F.lower(names[name]) == d["_dl"], "left")
    return j.select(
        *[names[c] for c in names.columns],  # the request's own columns are kept
        F.col("_domain").alias(domain),
        F.coalesce(F.col("_category"), names[name]).alias(category),
        F.coalesce(F.col("_ord"), F.lit(0)).cast("int").alias(ord_col),
        F.col("_dl").isNotNull().alias("matched"),
    )


def domain_summary(domains: DataFrame, domain: str = "domain", category: str = "category") -> DataFrame:
    """AGG-6: number of categories and of domains."""
    return domains.agg(
        F.count(F.col(category)).cast("long").alias("n_categories"),
        F.count_distinct(F.col(domain)).cast("long").alias("n_domains"),
    )
