"""Split datasets, transcription tables and corpus exports (SRC-2, SRC-4, SNK-2..5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import slug
from ..session import ensure_checkpoint_dir, write_once

SPLITS = ("train", "test", "validation")
# Folder names that are broadcast at most (some 200 bytes each).
BROADCAST_NAMES = 100_000


class UnknownDataset(ValueError):
    pass


def read_transcriptions(spark: SparkSession, name: str, registry: Mapping[str, Mapping[str, str]],
                        split: str | None = None) -> DataFrame:
    """SRC-2: resolve a dataset name through ``registry`` and read its transcription
    column as ``transcription``, keeping one split.

    A registry entry holds ``path``, ``column`` and optionally ``format`` (default
    parquet), ``split_column`` (default 'split') and ``split`` (the default split).
    Unknown names fail with the list of known names."""
    if name not in registry:
        raise UnknownDataset(f"Unknown dataset {name!r}; known: {sorted(registry)}")
    e = registry[name]
    df = spark.read.format(e.get("format", "parquet")).load(e["path"])
    want = split or e.get("split")
    if want is not None:
        df = df.filter(F.col(e.get("split_column", "split")) == want)
    return df.select(F.col(e["column"]).cast("string").alias("transcription"))


def write_transcriptions(df: DataFrame, path: str, column: str = "transcription", mode: str = "overwrite") -> None:
    """SRC-2's headerless CSV form: one column, no header line; quotes are doubled and
    texts with commas, quotes or line breaks quoted (``read_csv_transcriptions`` reads
    them back)."""
    df.select(F.col(column).cast("string")).write.mode(mode).option("header", False).option("escape", '"').option(
        "emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of one column -> (transcription)."""
    return spark.read.schema("transcription string").option("header", False).option("escape", '"').option("multiLine", True).option(
        "emptyValue", "").option("nullValue", "\u0000").csv(path)


def default_domains(spark: SparkSession) -> DataFrame:
    """The built-in domain table (domain, category, ord) for JOI-3 and GRP-4."""
    rows = [(d, c, i) for d, cats in K.DOMAIN_MAP.items() for i, c in enumerate(cats)]
    return spark.createDataFrame(rows, "domain string, category string, ord int")


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-4: load a saved split dataset; with ``split`` only that partition is read
    (partition pruning on the ``split=`` directories)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split is not None else df


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2: save the split dataset as Parquet partitioned by ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_splits_counted(df: DataFrame, path: str, mode: str = "overwrite", splits: Sequence[str] = SPLITS) -> DataFrame:
    """SNK-2 and AGG-5 in one pass: ``write_splits``, returning (split, n, total, pct) for the
    given splits that have rows (other splits count towards the total only). The counts are
    observed while the rows are written, in the writing stage, so nothing is read twice."""
    seen = Observation()
    counts = [F.count_if(F.col("split") == s).alias(s) for s in splits]
    write_splits(df.observe(seen, F.count(F.lit(1)).alias("_total"), *counts), path, mode)
    got = seen.get
    rows = [(s, got[s], got["_total"], round(got[s] * 100.0 / got["_total"], 6)) for s in splits if got[s]]
    return df.sparkSession.createDataFrame(rows, "split string, n long, total long, pct double")


def write_clean_pairs(flagged: DataFrame, path: str, ok: str = "ok", by: str | None = None, values: Sequence[str] = (),
                      mode: str = "overwrite") -> DataFrame:
    """FLT-2's output and AGG-1 in one pass: the pairs whose flag ``ok`` holds (of
    ``clean_pairs(..., keep_flag=ok)``) are written as Parquet without the flag. Returns
    (valid, filtered, total), or with ``by`` a row for each of its ``values`` that has rows and
    one with a null for rows of any other value. The counts are observed while writing."""
    seen, flag = Observation(), F.coalesce(F.col(ok), F.lit(False))
    groups = [*((v, F.col(by) == v) for v in values), (None, ~F.coalesce(F.col(by).isin(list(values)), F.lit(False)))] if by else [(None, F.lit(True))]
    counts = [F.count_if(flag & there).alias(f"v{i}") for i, (_, there) in enumerate(groups)] + [F.count_if(there).alias(f"t{i}") for i, (_, there) in enumerate(groups)]
    flagged.observe(seen, *counts).filter(flag).drop(ok).write.mode(mode).parquet(path)
    got = seen.get
    rows = [(v, got[f"v{i}"], got[f"t{i}"] - got[f"v{i}"], got[f"t{i}"]) for i, (v, _) in enumerate(groups) if got[f"t{i}"] or not by]
    table = flagged.sparkSession.createDataFrame(rows, f"{by or '_'} string, valid long, filtered long, total long")
    return table if by else table.drop("_")


def export_split(df: DataFrame, split: str, source_path: str, target_path: str,
                 order_col: str = "pair_key", translation: str = "translation", partitions: int | None = None) -> None:
    """SNK-3: one split as two aligned line outputs (source, target): part k of one holds the
    pairs of part k of the other, line by line. The rows are range-partitioned and sorted
    once and checkpointed, which keeps their partitions; both files are projections of that."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = df.filter(F.col("split") == split).select(
        F.col(order_col).alias("_order"), F.col(f"{translation}.source").alias("source"), F.col(f"{translation}.target").alias("target"))
    part = part.repartitionByRange(n, "_order").sortWithinPartitions("_order").select("source", "target").checkpoint()
    for path, side in ((source_path, "source"), (target_path, "target")):
        part.select(F.col(side).cast("string")).write.mode("overwrite").text(path)


def vocab_json(vocab: DataFrame, ch: str = "ch", idx: str = "idx") -> DataFrame:
    """SNK-4 body: one row holding the JSON object {char: index} in index order.
    The vocabulary is bounded by the character set, not by the corpus size."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(ch).alias("c"))))
    as_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["c"], e["i"])))
    return vocab.agg(F.to_json(as_map).alias("value"))


def write_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-4: write the vocabulary as a JSON object, non-ASCII characters kept as is."""
    vocab_json(vocab).coalesce(1).write.mode(mode).text(path)


def distinct_slugs(names: DataFrame, name_col: str) -> DataFrame:
    """TXT-11 for folders: (name, slug) of every distinct name, slugs distinct even without
    regard to case. Of several names with one slug the smallest keeps it, the others get a
    hash of their name behind it; names without any usable character are "unnamed"."""
    own = names.select(F.col(name_col).alias("name")).distinct().withColumn("plain", slug(F.col("name")))
    own = own.withColumn("plain", F.when(F.col("plain") == "", "unnamed").otherwise(F.coalesce("plain", F.lit("unnamed"))))
    label = F.coalesce("name", F.lit("\x00null"))
    first = own.groupBy(F.lower("plain").alias("folded")).agg(F.min(label).alias("first"))
    kept, tail = label == F.col("first"), F.substring(F.md5(label.cast("binary")), 1, 12)
    return own.join(first, F.lower("plain") == F.col("folded")).select(
        "name", F.when(kept, F.col("plain")).otherwise(F.concat("plain", F.lit("-"), tail)).alias("slug"))


def write_corpus_by_domain(df: DataFrame, path: str, name_col: str, text_col: str = "article",
                           mode: str = "overwrite", names: DataFrame | None = None, compression: str = "none") -> None:
    """SNK-5: one output folder per domain or category, its name made file-safe (TXT-11) and
    distinct, holding the rendered articles. ``names``: a table that has all names in
    ``name_col``, where one is at hand (else the articles are read for them first, as they are
    where names of the table share a slug: only names with articles take one).
    ``compression``: the codec of the files, such as "gzip". A page that several categories
    reach stands in the folder once for each, mostly next to each other, which a codec folds.

    Rows are rebalanced by folder: AQE splits the rows of a large folder and joins small ones
    up to the advisory partition size, so a folder gets files by its bytes, not by tasks, and
    one that a codec leaves unsplittable is no more than a task's work. The names are counted,
    and sent to every task unless they are very many."""
    slugs = write_once(distinct_slugs(names if names is not None else df, name_col))
    if names is not None and not slugs.filter(F.col("slug") != slug(F.col("name"))).isEmpty():
        slugs = write_once(distinct_slugs(df, name_col))
    slugs = F.broadcast(slugs) if slugs.count() <= BROADCAST_NAMES else slugs
    named = df.select(F.col(name_col).alias("_name"), F.col(text_col).alias("value"))
    out = named.join(slugs, named["_name"].eqNullSafe(slugs["name"])).select("slug", "value")
    out.hint("rebalance", "slug").write.mode(mode).partitionBy("slug").text(path, compression=compression)
