"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate and goes from all of them. The spread of a
line is how many distinct sites (values of the site column) hold it. HyperLogLog sketches
of the sites, one per line hash, are built map-side and merged by aggregation. A line whose
estimate is clearly below the threshold stays, one clearly above it goes; lines near the
threshold get an exact distinct count. Lines are compared without white space around them,
by two independent 64-bit hashes; blank lines never go.

A document that would lose nearly all of its text is a copy that stands on many sites, not a
page with boilerplate around it: it keeps its lines, for near-duplicate removal to decide.
With ``lines_beside`` that is not taken for granted: it loses the lines whose spread does not
come from such documents, so a short page of menu lines loses them like a long one.

All work is DataFrame functions: line hashes cross the shuffles, and texts cross one, where
documents meet the hashes to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

MIN_SITES = 15
#: Sites that ``site_threshold`` asks for at least, however few there are.
LEAST_SITES = 3
#: Percent of a document's characters that may go as boilerplate.
MAX_PERCENT = 80
LOG_K = 10
#: Standard errors of a sketch (0.83 / sqrt(2 ** LOG_K)) on either side of the threshold
#: within which lines are counted exactly.
BAND_ERRORS = 5


def _bare(line: Column) -> Column:
    """A line without ASCII white space around it."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _key(line: Column) -> Column:
    """Struct of two 64-bit hashes of a bare line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def line_keys(text: Column) -> Column:
    """Keys of the lines of a text, null for blank lines; null text: no lines."""
    bare = F.transform(F.split(text, "\n", -1), _bare)
    return F.transform(bare, lambda x: F.when(x != "", _key(x)))


def site_threshold(docs: DataFrame, site_col: str = "source", most: int = MIN_SITES, least: int = LEAST_SITES) -> int:
    """Three quarters of the distinct sites, from ``least`` to ``most``."""
    sites = docs.agg(F.countDistinct(F.col(site_col).cast("string"))).first()[0]
    return min(most, max(least, -(-3 * sites // 4)))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """(h1, h2) of the lines that stand on at least ``min_sites`` sites, from ``lines``
    (h1, h2, site). A null site is no site."""
    lines = lines.where("site IS NOT NULL")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", log_k)).alias("sites"))
    band = BAND_ERRORS * 0.83 / 2 ** (log_k / 2)
    near = F.col("sites").between(min_sites * (1 - band) - 1, min_sites * (1 + band) + 1)
    spread = sketched.where(F.col("sites") >= min_sites * (1 - band) - 1).withColumn("near", near)
    exact = lines.join(spread.where("near").select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(
        F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where("NOT near").select("h1", "h2").unionByName(exact.select("h1", "h2"))


def hits_beside_copies(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, max_percent: int, log_k: int) -> DataFrame:
    """(doc, h1, h2): the lines that go from every document. One that would lose over
    ``max_percent`` of its characters loses those that stand on ``min_sites`` sites without
    such documents."""
    line = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.struct(F.when(_bare(x) != "", _key(_bare(x))).alias("k"), F.char_length(x).alias("n")))
    lines = materialize(docs.select(F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"), F.explode(line).alias("x")).select(
        "doc", "site", F.col("x.k.h1").alias("h1"), F.col("x.k.h2").alias("h2"), F.col("x.n").alias("n")))
    common = boilerplate(lines.where("h1 IS NOT NULL").select("h1", "h2", "site"), min_sites, log_k)
    gone = materialize(lines.join(common, ["h1", "h2"], "left_semi"))
    chars = lines.groupBy(F.col("doc").alias("all_doc")).agg(F.sum("n").alias("chars"))
    lost = gone.groupBy(F.col("doc").alias("over_doc")).agg(F.sum("n").alias("lost"))
    over = lost.join(chars, F.col("over_doc").eqNullSafe(F.col("all_doc"))).where(100 * (F.col("chars") - F.col("lost")) < (100 - max_percent) * F.col("chars"))
    over = over.select("over_doc", F.lit(True).alias("over"))
    marked = materialize(gone.join(over, gone["doc"].eqNullSafe(over["over_doc"]), "left").select("doc", "site", "h1", "h2", F.coalesce("over", F.lit(False)).alias("over")))
    beside = boilerplate(marked.where("NOT over").select("h1", "h2", "site"), min_sites, log_k)
    return marked.where("NOT over").select("doc", "h1", "h2").unionByName(marked.where("over").join(beside, ["h1", "h2"], "left_semi").select("doc", "h1", "h2"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                     min_sites: int = MIN_SITES, max_percent: int = MAX_PERCENT, log_k: int = LOG_K,
                     removed_as: str | None = None, lines_beside: bool = False) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text (the other lines stay as
    they are, joined by line feeds) and, if named, the number of removed lines.

    Every row comes back, a null text as null. A text that would lose over ``max_percent``
    of its characters (line feeds not counted) stays as it is; at 100, a text of
    boilerplate alone becomes empty; with ``lines_beside`` it loses the lines that stand on
    ``min_sites`` sites without counting such texts (rows of one id count as one). Rows that repeat an id are each rid of the same lines.
    Ids may be null. A column of the input named like ``removed_as`` is replaced."""
    if removed_as:
        docs = docs.drop(*[c for c in docs.columns if c.lower() == removed_as.lower()])
    key, gone, own = fresh(docs, "line_doc", "line_gone", "line_kept")
    if lines_beside:
        hits = hits_beside_copies(docs, id_col, text_col, site_col, min_sites, max_percent, log_k)
    else:
        # Written once: the sketches, the exact counts and the hits all read these narrow rows.
        lines = materialize(docs.select(F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"),
                            F.explode(F.array_distinct(line_keys(F.col(text_col)))).alias("k")).where("k IS NOT NULL").select(
            "doc", "site", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")))
        hits = lines.join(boilerplate(lines.select("h1", "h2", "site"), min_sites, log_k), ["h1", "h2"], "left_semi")
    # A document's hits are bounded by its own lines.
    hits = hits.groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    # Hits grow with the documents, so they are never broadcast: one plan at every size.
    joined = docs.join(hits.hint("merge"), docs[id_col].eqNullSafe(hits[key]), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: (_bare(x) == "") | ~F.array_contains(F.col(gone), _key(_bare(x))))
    joined = joined.withColumn(own, F.when(F.col(gone).isNotNull() & F.col(text_col).isNotNull(), kept))
    chars = F.char_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    enough = F.lit(True) if lines_beside else 100 * F.char_length(F.array_join(own, "")) >= (100 - max_percent) * chars
    cut = F.col(own).isNotNull() & enough
    text = F.when(cut, F.array_join(own, "\n")).otherwise(F.col(text_col))
    cols = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if removed_as:
        n_lines = F.size(F.split(F.col(text_col), "\n", -1))
        cols.append(F.when(cut, n_lines - F.size(own)).otherwise(0).cast("long").alias(removed_as))
    return joined.select(*cols)
