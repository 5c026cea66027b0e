"""The driver's tables and the corpus shapes derived from them.

The test tables hold English, German, Spanish and French prose, so the Japanese
defaults are replaced by parameters here: terminators ``.!?`` and the alphabet A-Z.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_upper, split_sentences_drop

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Parameters of the derived corpus (fixed for the catalogue).
LATIN_TERMS = ".!?"
LATIN_LO = "A"
LATIN_HI = "Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of ``documents``: (doc_id, lang, sent_no, sentence),
    ``sent_no`` 0-based among the kept sentences of the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    arr = split_sentences_drop(F.col("text"), LATIN_TERMS)
    return docs.select("doc_id", "lang", F.posexplode(arr).alias("sent_no", "sentence")).select(
        "doc_id", "lang", F.col("sent_no").cast("long").alias("sent_no"), "sentence"
    )


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel pairs: source = ASCII upper-case of the sentence, target = the sentence,
    keyed by (doc_id, sent_no) and by the string ``pair_key`` = 'doc_id:sent_no'."""
    s = sentences(spark, sf_dir)
    return s.select(
        "doc_id", "lang", "sent_no",
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sent_no").cast("string")).alias("pair_key"),
        ascii_upper(F.col("sentence")).alias("source"),
        F.col("sentence").alias("target"),
        F.col("sentence").alias("raw"),
    )


# Three rule-made "models" scored against the same reference sentences.
MODELS = ("copy", "vowel", "next")


def sentences_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, sent_no, sentence, next_sentence): the following sentence of the
    same document ('' after the last), taken from the same array, so no shuffle."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", split_sentences_drop(F.col("text"), LATIN_TERMS).alias("_arr"))
    # The array is a column of its own, so the split runs once per document.
    arr = F.col("_arr")
    with_next = F.transform(
        arr, lambda x, i: F.struct(x.alias("sentence"),
                                   F.coalesce(F.try_element_at(arr, i + 2), F.lit("")).alias("next_sentence"))
    )
    return docs.select("doc_id", "lang", F.posexplode(with_next).alias("sent_no", "s")).select(
        "doc_id", "lang", F.col("sent_no").cast("long").alias("sent_no"), "s.sentence", "s.next_sentence"
    )


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form (doc_id, lang, sent_no, model, reference, prediction): 'copy' repeats
    the reference, 'vowel' swaps e -> a, 'next' answers with the next sentence."""
    s = sentences_with_next(spark, sf_dir)
    return s.selectExpr(
        "doc_id", "lang", "sent_no", "sentence AS reference",
        "stack(3, 'copy', sentence, 'vowel', translate(sentence, 'e', 'a'), 'next', next_sentence) "
        "AS (model, prediction)",
    )


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages keyed by title: 'doc-<doc_id>' -> documents.text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), "text")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain table (domain, category, ord): regions are domains, their nations the
    categories, in nation-key order."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("r_name").alias("domain"), F.col("n_name").alias("category"),
        F.col("n_nationkey").cast("int").alias("ord"))


def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category graph (category, member, member_ns, ord) from the star schema:
    a region lists its nations (categories, ord = nation key) and the supplier pages of
    its nations (ord = 100 + supplier key); a nation lists its customer pages
    (ord = 100 + customer key) and the other nations of its region (categories,
    ord = nation key), which makes cycles and pages reachable twice. Page titles are
    'doc-<key>', so some pages are missing and some are shared."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier")
    c = table(spark, sf_dir, "customer")
    nr = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    region_nations = nr.select(F.col("r_name").alias("category"), F.col("n_name").alias("member"),
                               F.lit(14).alias("member_ns"), F.col("n_nationkey").cast("int").alias("ord"))
    region_pages = s.join(nr, s["s_nationkey"] == nr["n_nationkey"]).select(
        F.col("r_name").alias("category"), F.concat(F.lit("doc-"), F.col("s_suppkey").cast("string")).alias("member"),
        F.lit(0).alias("member_ns"), (F.col("s_suppkey") + 100).cast("int").alias("ord"))
    nation_pages = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("n_name").alias("category"), F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("member"),
        F.lit(0).alias("member_ns"), (F.col("c_custkey") + 100).cast("int").alias("ord"))
    a, b = n.alias("a"), n.alias("b")
    siblings = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(
        F.col("a.n_name").alias("category"), F.col("b.n_name").alias("member"),
        F.lit(14).alias("member_ns"), F.col("b.n_nationkey").cast("int").alias("ord"))
    return region_nations.unionByName(region_pages).unionByName(nation_pages).unionByName(siblings)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, pos, word): runs of letters of ``benchmark`` lines."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("pos", "word"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyser-style tokens of ``benchmark`` lines: (line_no, pos, surface, feature).
    Tokens are whitespace-separated words; the last feature field is the reading
    (ASCII upper case), or '*' for a word with a non-ASCII character."""
    from ..functions import constants as K
    from ..functions.text import ascii_upper

    b = table(spark, sf_dir, "benchmark")
    t = b.select(F.col("item_id").alias("line_no"),
                 F.posexplode(F.regexp_extract_all("text", F.lit(K.NOT_WS_CLASS + "+"), 0)).alias("pos", "surface"))
    is_ascii = F.col("surface").rlike(r"\A[\x{0001}-\x{007F}]+\z")
    reading = F.when(is_ascii, ascii_upper(F.col("surface"))).otherwise(F.lit("*"))
    return t.select("line_no", F.col("pos").cast("int").alias("pos"), "surface",
                    F.concat_ws(",", F.lit("x"), F.lit("y"), reading).alias("feature"))
