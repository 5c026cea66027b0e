"""Query catalogue over the driver's tables.

Each entry pairs a Spark query ``(spark, sf_dir) -> DataFrame`` with, where SQL can
express it, the equivalent DuckDB SQL over the same tables. Output columns carry the
same names and types on both sides; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..operators import corpus as CP
from ..operators import evaluation as EV
from ..operators import filters
from ..operators import graph as G
from ..operators import index as IX
from ..operators import lexicon as LX
from ..operators import metrics as M
from ..operators import model_io as MI
from ..operators import pairing as PR
from ..operators import validate as VL
from ..operators import vocab as VC
from ..session import scratch_folder, write_once
from ..sources import datasets as DSRC
from ..sources import lines as LN
from ..sources import stored as STO
from ..sources.tagged import tagged_docs_in_column
from . import oracle as O
from . import tables as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ops: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: tuple[str, ...], sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn

    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------------------
# Corpus cleaning: FLT-2, AGG-1
# ---------------------------------------------------------------------------------------

def cleaned_pairs(spark: SparkSession, sf_dir: str, keep_flag: str | None = None) -> DataFrame:
    return filters.clean_pairs(T.sentence_pairs(spark, sf_dir), chars=filters.K.JA_PUNCT,
                               lo=T.LATIN_LO, hi=T.LATIN_HI, keep_flag=keep_flag)


@register(
    "clean_pairs", ("TXT-2", "TXT-4", "TXT-8", "FLT-1", "FLT-2"),
    f"WITH {O.corpus_ctes()} SELECT doc_id, lang, sent_no, pair_key, source, target FROM cleaned WHERE ok",
)
def q_clean_pairs(spark, sf_dir):
    return cleaned_pairs(spark, sf_dir).select("doc_id", "lang", "sent_no", "pair_key", "source", "target")


@register(
    "filter_counts", ("FLT-2", "AGG-1"),
    f"WITH {O.corpus_ctes()} SELECT lang, CAST(count_if(ok) AS BIGINT) AS valid, "
    "CAST(count_if(NOT ok) AS BIGINT) AS filtered, CAST(count(*) AS BIGINT) AS total FROM cleaned GROUP BY lang",
)
def q_filter_counts(spark, sf_dir):
    flagged = cleaned_pairs(spark, sf_dir, keep_flag="ok")
    return filters.filter_counts(flagged, "ok", by=["lang"])


# ---------------------------------------------------------------------------------------
# Evaluation: MET-1..10 over three rule-made models
# ---------------------------------------------------------------------------------------


METRICS = M.METRIC_COLS
LANGS = ("de", "en", "es", "fr")


def _r6_all(df, cols=METRICS):
    for c in cols:
        df = df.withColumn(c, r6(F.col(c)))
    return df


def scored(spark, sf_dir):
    return M.row_metrics(T.model_predictions(spark, sf_dir))


def runs(spark, sf_dir):
    """Macro metrics by (model, dataset = language): the shape of a results board."""
    return M.macro_metrics(scored(spark, sf_dir), by=["model", "lang"]).withColumnRenamed("lang", "dataset")


_MET_SQL_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)


@register(
    "row_metrics", ("TXT-1", "TXT-6", "SET-2", "MET-1", "MET-2", "MET-3", "MET-4"),
    f"WITH {O.metrics_ctes()} SELECT doc_id, sent_no, model, {_MET_SQL_COLS} FROM scored",
)
def q_row_metrics(spark, sf_dir):
    return _r6_all(scored(spark, sf_dir).select("doc_id", "sent_no", "model", *METRICS))


@register(
    "macro_metrics_by_lang", ("MET-4", "MET-5"),
    f"WITH {O.metrics_ctes()}, {O.runs_cte()} SELECT model, dataset, {_MET_SQL_COLS}, n FROM runs",
)
def q_macro_metrics(spark, sf_dir):
    return _r6_all(runs(spark, sf_dir))


def _cer_sql(x):
    return O.strip(f"regexp_replace(coalesce({x}, ''), {O.q(O.WS + '{2,}')}, ' ', 'g')")


@register(
    "corpus_cer", ("FLT-5", "MET-6"),
    f"WITH {O.sentences_cte()}, {O.sentences_next_cte()}, {O.predictions_cte()}, "
    f"c1 AS (SELECT model, {_cer_sql('reference')} AS r_, {_cer_sql('prediction')} AS p_ FROM preds), "
    "c2 AS (SELECT model, length(r_) > 0 AS k_, r_, p_ FROM c1), "
    f"c3 AS (SELECT model, sum(CASE WHEN k_ THEN {O.levenshtein('r_', 'p_')} END) AS e_, "
    "sum(CASE WHEN k_ THEN length(r_) END) AS l_, count_if(k_) AS n_ FROM c2 GROUP BY model) "
    "SELECT model, round(CASE WHEN n_ = 0 THEN 1.0 ELSE CAST(e_ AS DOUBLE) / l_ END, 6) AS corpus_cer, "
    "CAST(coalesce(e_, 0) AS BIGINT) AS edits, CAST(coalesce(l_, 0) AS BIGINT) AS ref_chars, "
    "CAST(n_ AS BIGINT) AS pairs FROM c3",
)
def q_corpus_cer(spark, sf_dir):
    out = M.corpus_cer(T.model_predictions(spark, sf_dir), by=["model"])
    return out.withColumn("corpus_cer", r6(F.col("corpus_cer")))


@register(
    "leaderboard", ("MET-5", "MET-7"),
    f"WITH {O.metrics_ctes()}, {O.runs_cte()} SELECT model, "
    + ", ".join(f"round(max(CASE WHEN dataset = '{d}' THEN f_score END), 6) AS {d}" for d in LANGS)
    + " FROM runs GROUP BY model",
)
def q_leaderboard(spark, sf_dir):
    board = M.leaderboard(runs(spark, sf_dir), metric="f_score", datasets=LANGS)
    return _r6_all(board, LANGS)


@register(
    "best_checkpoint", ("MET-8",),
    f"WITH {O.metrics_ctes()}, {O.runs_cte()}, "
    "b AS (SELECT dataset, model, cer, row_number() OVER (PARTITION BY dataset ORDER BY cer, model) AS rn "
    "FROM runs) "
    "SELECT dataset, model AS best_model, round(cer, 6) AS best_cer FROM b WHERE rn = 1",
)
def q_best_checkpoint(spark, sf_dir):
    out = M.best_checkpoint(runs(spark, sf_dir), by=["dataset"], metric="cer")
    return out.withColumn("best_cer", r6(F.col("best_cer")))


@register(
    "compare_outputs", ("MET-9",),
    f"WITH {O.sentences_cte()}, {O.sentences_next_cte()}, {O.predictions_cte()} "
    "SELECT doc_id, sent_no, reference, "
    + ", ".join(f"max(CASE WHEN model = '{m}' THEN prediction END) AS \"{m}\"" for m in T.MODELS)
    + " FROM preds GROUP BY doc_id, sent_no, reference",
)
def q_compare_outputs(spark, sf_dir):
    return M.compare_outputs(T.model_predictions(spark, sf_dir), key=["doc_id", "sent_no", "reference"],
                             models=T.MODELS)


@register(
    "metric_deltas", ("MET-10",),
    f"WITH {O.metrics_ctes()}, {O.runs_cte()} SELECT r.model, r.dataset, "
    + ", ".join(f"round(r.{c} - b.{c}, 6) AS delta_{c}" for c in METRICS)
    + " FROM runs r JOIN runs b ON b.dataset = r.dataset AND b.model = 'copy'",
)
def q_metric_deltas(spark, sf_dir):
    out = M.metric_deltas(runs(spark, sf_dir), base_model="copy")
    return _r6_all(out, [f"delta_{c}" for c in METRICS])


# ---------------------------------------------------------------------------------------
# Splits, validation, samples: SPL-1/2, AGG-5, VAL-1, SMP-1, IDX-1
# ---------------------------------------------------------------------------------------


def split_dataset(spark, sf_dir, exact: bool = True):
    """Kept pairs as a split dataset: (pair_key, lang, translation, split)."""
    pairs = cleaned_pairs(spark, sf_dir).select(
        "pair_key", "lang", F.struct("source", "target").alias("translation"), "raw")
    fn = IX.split_exact if exact else IX.split_hash
    return fn(pairs, key="pair_key")


_KEPT = f"WITH {O.corpus_ctes()}, kept AS (SELECT pair_key, lang, source, target FROM cleaned WHERE ok)"
_N_TRAIN = f"floor(n_ * {K.TRAIN_RATIO!r})"
_SPLIT_EXACT_SQL = (
    f"{_KEPT}, ix AS (SELECT *, row_number() OVER (ORDER BY md5('{K.SEED}:' || pair_key), pair_key) - 1 AS i_, "
    "count(*) OVER () AS n_ FROM kept), "
    f"ds AS (SELECT *, CASE WHEN i_ < {_N_TRAIN} THEN 'train' "
    f"WHEN i_ < {_N_TRAIN} + floor((n_ - {_N_TRAIN}) * {K.TEST_RATIO / (K.TEST_RATIO + K.VALIDATION_RATIO)!r}) "
    "THEN 'test' ELSE 'validation' END AS split FROM ix)"
)


@register("split_exact", ("SPL-1", "IDX-1"), f"{_SPLIT_EXACT_SQL} SELECT pair_key, split FROM ds")
def q_split_exact(spark, sf_dir):
    return split_dataset(spark, sf_dir).select("pair_key", "split")


_U = f"CAST(('0x' || substr(md5('{K.SEED}:' || pair_key), 1, 8)) AS UBIGINT) / 4294967296.0"


@register(
    "split_hash", ("SPL-2",),
    f"{_KEPT} SELECT pair_key, CASE WHEN {_U} < CAST('{K.TRAIN_RATIO!r}' AS DOUBLE) THEN 'train' "
    f"WHEN {_U} < CAST('{K.TRAIN_RATIO + K.TEST_RATIO!r}' AS DOUBLE) THEN 'test' ELSE 'validation' END AS split FROM kept",
)
def q_split_hash(spark, sf_dir):
    return split_dataset(spark, sf_dir, exact=False).select("pair_key", "split")


@register(
    "split_stats", ("AGG-5",),
    f"{_SPLIT_EXACT_SQL}, c AS (SELECT split, CAST(count(*) AS BIGINT) AS n FROM ds GROUP BY split) "
    "SELECT split, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM c",
)
def q_split_stats(spark, sf_dir):
    return IX.split_stats(split_dataset(spark, sf_dir))


@register(
    "validate", ("VAL-1",),
    f"{_SPLIT_EXACT_SQL}, st AS (SELECT count_if(split = 'train') AS a_, count_if(split = 'validation') AS b_, "
    "count_if(split = 'test') AS c_, count_if(source IS NULL OR target IS NULL) AS d_ FROM ds), "
    "rep AS (SELECT 'field:translation' AS \"check\", true AS ok, 'present' AS detail "
    "UNION ALL SELECT 'field:translation.source', true, 'present' "
    "UNION ALL SELECT 'field:translation.target', true, 'present' "
    "UNION ALL SELECT 'split:train', a_ > 0, 'rows=' || a_ FROM st "
    "UNION ALL SELECT 'split:validation', b_ > 0, 'rows=' || b_ FROM st "
    "UNION ALL SELECT 'split:test', true, CASE WHEN c_ > 0 THEN 'rows=' || c_ "
    "ELSE 'rows=0 (optional split is empty or absent)' END FROM st "
    "UNION ALL SELECT 'values:non_null', d_ = 0, 'null_rows=' || d_ FROM st) "
    "SELECT * FROM rep UNION ALL SELECT 'overall', bool_and(ok), 'failed=' || count_if(NOT ok) FROM rep",
)
def q_validate(spark, sf_dir):
    return VL.validate_dataset(split_dataset(spark, sf_dir))


@register(
    "sample", ("SMP-1",),
    f"{_SPLIT_EXACT_SQL}, s AS (SELECT split, pair_key, source, target, row_number() OVER (PARTITION BY split "
    f"ORDER BY md5('{K.SEED}:' || pair_key), pair_key) AS rn FROM ds) "
    "SELECT split, pair_key, source, target FROM s WHERE rn <= 5",
)
def q_sample(spark, sf_dir):
    s = IX.sample_rows(split_dataset(spark, sf_dir), 5, key="pair_key")
    return s.select("split", "pair_key", "translation.source", "translation.target")


# ---------------------------------------------------------------------------------------
# Pairing and lookups: JOI-1..3, AGG-6
# ---------------------------------------------------------------------------------------

@register(
    "pair_by_position", ("JOI-1",),
    "WITH t AS (SELECT conv_id, role, text, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 "
    "AS BIGINT) AS k FROM conversations WHERE role IN ('user', 'assistant')) "
    "SELECT u.conv_id, u.k, u.text AS source, a.text AS target FROM t u JOIN t a "
    "ON a.conv_id = u.conv_id AND a.k = u.k AND u.role = 'user' AND a.role = 'assistant'",
)
def q_pair_by_position(spark, sf_dir):
    conv = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ranked = PR.rank_in_group(conv.filter(F.col("role").isin("user", "assistant")),
                              ["conv_id", "role"], ["turn"], rank_col="k")
    user = ranked.filter(F.col("role") == "user")
    assistant = ranked.filter(F.col("role") == "assistant")
    return PR.pair_by_position(user, assistant, key=["conv_id", "k"])


_PG_TEXT = O.strip("coalesce(pg.text, '')")


@register(
    "lookup_titles", ("JOI-2",),
    "WITH req AS (SELECT 'doc-' || CAST(c_custkey AS VARCHAR) AS title FROM customer), "
    "pg AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS t, text FROM documents) "
    "SELECT req.title, CASE WHEN pg.t IS NULL THEN 'missing' "
    f"WHEN length({_PG_TEXT}) = 0 THEN 'empty' ELSE 'found' END AS status, "
    "CAST(length(pg.text) AS BIGINT) AS n_chars FROM req LEFT JOIN pg ON pg.t = req.title",
)
def q_lookup_titles(spark, sf_dir):
    req = T.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("title"))
    pages = T.doc_pages(spark, sf_dir)
    out = PR.lookup_titles(req, pages)
    return out.select("title", "status", F.length("text").cast("long").alias("n_chars"))


@register(
    "title_status", ("JOI-2",),
    "WITH req AS (SELECT 'doc-' || CAST(c_custkey AS VARCHAR) AS title FROM customer), "
    "pg AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS t, text FROM documents) "
    "SELECT req.title, CASE WHEN pg.t IS NULL THEN 'missing' "
    f"WHEN length({_PG_TEXT}) = 0 THEN 'empty' ELSE 'found' END AS status FROM req LEFT JOIN pg ON pg.t = req.title",
)
def q_title_status(spark, sf_dir):
    req = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("title"))
    return PR.title_status(req, T.doc_pages(spark, sf_dir))


_DOMAIN_SQL = (
    "dom AS (SELECT r_name AS domain, n_name AS category, n_nationkey AS ord FROM nation "
    "JOIN region ON r_regionkey = n_regionkey)"
)


_REQ_SQL = (
    "req AS (SELECT c_custkey AS req_id, lower(r_name) AS name FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "UNION ALL SELECT -s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)


@register(
    "resolve_domain", ("JOI-3",),
    f"WITH {_DOMAIN_SQL}, {_REQ_SQL} "
    "SELECT req.req_id, req.name, dom.domain, coalesce(dom.category, req.name) AS category, "
    "CAST(coalesce(dom.ord, 0) AS INTEGER) AS ord, dom.domain IS NOT NULL AS matched "
    "FROM req LEFT JOIN dom ON lower(dom.domain) = lower(req.name)",
)
def q_resolve_domain(spark, sf_dir):
    """Each customer asks for its region (a domain: expands to the region's nations)
    and each supplier for its nation (not a domain: stands for itself)."""
    c, s = T.table(spark, sf_dir, "customer"), T.table(spark, sf_dir, "supplier")
    n, r = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "region")
    cust = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    names = cust.select(F.col("c_custkey").alias("req_id"), F.lower("r_name").alias("name")).unionByName(
        s.join(n, s["s_nationkey"] == n["n_nationkey"]).select((-F.col("s_suppkey")).alias("req_id"),
                                                                F.col("n_name").alias("name")))
    out = PR.resolve_domain(names, T.domains(spark, sf_dir))
    return out.select("req_id", "name", "domain", "category", "ord", "matched")


@register(
    "domain_summary", ("AGG-6",),
    "WITH seg AS (SELECT DISTINCT c_mktsegment AS domain, n_name AS category FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT CAST(count(category) AS BIGINT) AS n_categories, CAST(count(DISTINCT domain) AS BIGINT) AS n_domains FROM seg",
)
def q_domain_summary(spark, sf_dir):
    """AGG-6 over a domain table derived from the customers: each market segment is a
    domain whose categories are the nations of its customers."""
    c, n = T.table(spark, sf_dir, "customer"), T.table(spark, sf_dir, "nation")
    seg = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_mktsegment").alias("domain"), F.col("n_name").alias("category")).distinct()
    return PR.domain_summary(seg)


# ---------------------------------------------------------------------------------------
# Category walk and corpus assembly: GRP-1..5, TXT-3, TXT-12, SRC-3
# ---------------------------------------------------------------------------------------


def _region_roots(spark, sf_dir):
    return T.table(spark, sf_dir, "region").select(F.col("r_name").alias("root"))


_ROOTS_SQL = "SELECT r_name AS root FROM region"


@register(
    "category_walk", ("GRP-1", "SRC-5", "FLT-6", "SET-1"),
    f"WITH {O.links_cte()}, {O.walk_ctes(_ROOTS_SQL, 1)} "
    f"SELECT root, member, level, {O.path_key('path')} AS path_key FROM walked",
)
def q_category_walk(spark, sf_dir):
    w = G.walk_category(_region_roots(spark, sf_dir), T.category_links(spark, sf_dir), max_depth=1)
    return w.select("root", "member", "level", G.path_key("path").alias("path_key"))


@register(
    "category_walk_stored", ("SRC-5", "GRP-1"),
    f"WITH {O.links_cte()}, {O.walk_ctes(_ROOTS_SQL, 2)} "
    f"SELECT root, member, level, {O.path_key('path')} AS path_key FROM walked",
)
def q_category_walk_stored(spark, sf_dir):
    """The walk over a stored, bucketed link table, two levels deep."""
    path = scratch_folder(spark, "links")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    STO.store_links(T.category_links(spark, sf_dir), name, path, buckets=16)
    w = STO.walk_stored(spark, _region_roots(spark, sf_dir), name, max_depth=2)
    return w.select("root", "member", "level", G.path_key("path").alias("path_key"))


@register(
    "category_cap", ("GRP-1", "GRP-2"),
    f"WITH {O.links_cte()}, {O.walk_ctes(_ROOTS_SQL, 2)}, "
    f"k AS (SELECT root, member, level, {O.path_key('path')} AS path_key FROM walked), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path_key) - 1 AS rank FROM k) "
    "SELECT root, CAST(rank AS BIGINT) AS rank, member, level, path_key FROM r WHERE rank < 100",
)
def q_category_cap(spark, sf_dir):
    w = G.walk_category(_region_roots(spark, sf_dir), T.category_links(spark, sf_dir), max_depth=2)
    c = G.cap_per_root(w, max_pages=100)
    return c.select("root", "rank", "member", "level", G.path_key("path").alias("path_key"))


@register(
    "category_articles", ("GRP-3", "JOI-2", "TXT-3", "TXT-7", "TXT-12"),
    f"WITH {O.links_cte()}, {O.walk_ctes(_ROOTS_SQL, 1)}, {O.page_sentences_cte()}, "
    f"k AS (SELECT root, member, {O.path_key('path')} AS pk FROM walked), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY pk) - 1 AS rank FROM k) "
    f"SELECT root, CAST(rank AS BIGINT) AS rank, title, {O.render('title', 'sentences')} AS article "
    "FROM r JOIN ps ON ps.title = r.member",
)
def q_category_articles(spark, sf_dir):
    a = G.assemble_category(_region_roots(spark, sf_dir), T.category_links(spark, sf_dir),
                            T.doc_pages(spark, sf_dir), max_depth=1, terms=T.LATIN_TERMS)
    return a.select("root", "rank", "title", "article")


@register(
    "domain_corpus", ("GRP-4", "JOI-3", "TXT-12"),
    f"WITH {O.links_cte()}, {_DOMAIN_SQL}, "
    f"{O.walk_ctes('SELECT DISTINCT category AS root FROM dom', 1)}, {O.page_sentences_cte()}, "
    f"k AS (SELECT root, member, {O.path_key('path')} AS pk FROM walked), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY pk) - 1 AS rank FROM k) "
    "SELECT dom.domain, dom.category, CAST(dom.ord AS INTEGER) AS cat_ord, CAST(rank AS BIGINT) AS rank, title, "
    f"{O.render('title', 'sentences', 'dom.category')} AS article "
    "FROM r JOIN dom ON dom.category = r.root JOIN ps ON ps.title = r.member",
)
def q_domain_corpus(spark, sf_dir):
    a = G.assemble_all_domains(T.domains(spark, sf_dir), T.category_links(spark, sf_dir), T.doc_pages(spark, sf_dir),
                               max_depth=1, terms=T.LATIN_TERMS)
    return a.select("domain", "category", "cat_ord", "rank", "title", "article")


@register(
    "title_articles", ("GRP-3", "JOI-2", "TXT-3", "TXT-12"),
    f"WITH {O.page_sentences_cte()}, req AS (SELECT c_custkey AS req_id, 'doc-' || CAST(c_custkey AS VARCHAR) AS title "
    "FROM customer) "
    f"SELECT req.req_id, req.title, {O.render('ps.title', 'ps.sentences')} AS article "
    "FROM req JOIN ps ON ps.title = req.title",
)
def q_title_articles(spark, sf_dir):
    """Articles for a list of requested titles (every customer asks for its page)."""
    req = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"), F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("title"))
    a = G.assemble_titles(req, T.doc_pages(spark, sf_dir), terms=T.LATIN_TERMS)
    return a.select("req_id", "title", "article")


_ARTICLE_RE = O.q("(?s)<article.*?>(.+?)</article>")


@register(
    "tagged_docs", ("SRC-3",),
    f"WITH b AS (SELECT page_id, regexp_extract_all(html, {_ARTICLE_RE}, 1) AS bodies FROM pages) "
    "SELECT page_id, CAST(unnest(generate_series(0, len(bodies) - 1)) AS BIGINT) AS block_no, unnest(bodies) AS body FROM b",
)
def q_tagged_docs(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages").select("page_id", "html")
    return tagged_docs_in_column(pages, "html", tag="article", keep=("page_id",))


def _dump_sql(limit: int | None) -> str:
    cls = K.char_class(T.LATIN_TERMS)
    mk = "body"
    for p in (r"={2,}.*?={2,}", r"\[\[.*?\]\]", r"\{\{.*?\}\}"):
        mk = f"regexp_replace({mk}, {O.q(p)}, '', 'g')"
    arr = (f"list_filter(list_transform(regexp_split_to_array({mk}, {O.q(cls)}), lambda x: {O.strip('x')}), "
           "lambda x: length(x) > 10)")
    sql = (
        f"WITH b AS (SELECT page_id, unnest(generate_series(0, len(bodies) - 1)) AS block_no, unnest(bodies) AS body "
        f"FROM (SELECT page_id, regexp_extract_all(html, {_ARTICLE_RE}, 1) AS bodies FROM pages)), "
        f"s AS (SELECT page_id, CAST(block_no AS BIGINT) AS block_no, {arr} AS arr FROM b), "
        "x AS (SELECT page_id, block_no, CAST(unnest(generate_series(0, len(arr) - 1)) AS BIGINT) AS sent_no, "
        "unnest(arr) AS sentence FROM s) SELECT page_id, block_no, sent_no, sentence FROM x"
    )
    if limit:
        sql += f" ORDER BY page_id, block_no, sent_no LIMIT {limit}"
    return sql


def _dump(spark, sf_dir, limit):
    blocks = q_tagged_docs(spark, sf_dir)
    return G.extract_dump_sentences(blocks, ["page_id", "block_no"], terms=T.LATIN_TERMS, max_sentences=limit)


@register("dump_sentences", ("GRP-5", "TXT-5", "TXT-4", "FLT-4"), _dump_sql(None))
def q_dump_sentences(spark, sf_dir):
    return _dump(spark, sf_dir, None)


@register("dump_sentences_first", ("GRP-5", "IDX-2"), _dump_sql(1000))
def q_dump_sentences_first(spark, sf_dir):
    return _dump(spark, sf_dir, 1000)


# ---------------------------------------------------------------------------------------
# Text rules on whole texts: TXT-1..4, TXT-7, TXT-8, TXT-11, FLT-3
# ---------------------------------------------------------------------------------------


def _docs(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def _conv(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@register(
    "sentences_drop", ("TXT-4", "TXT-8", "FLT-4"),
    f"WITH {O.sentences_cte()} SELECT doc_id, sent_no, sentence FROM sent",
)
def q_sentences_drop(spark, sf_dir):
    return T.sentences(spark, sf_dir).select("doc_id", "sent_no", "sentence")


_TEXT0 = "coalesce(text, '')"


@register(
    "sentences_keep", ("TXT-3", "TXT-7"),
    f"WITH s AS (SELECT doc_id, {O.keep_sentences(_TEXT0)} AS arr FROM documents) "
    "SELECT doc_id, CAST(unnest(generate_series(0, len(arr) - 1)) AS BIGINT) AS sent_no, unnest(arr) AS sentence FROM s",
)
def q_sentences_keep(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(TX.split_sentences_keep(F.col("text"), T.LATIN_TERMS))
                    .alias("sent_no", "sentence")).withColumn("sent_no", F.col("sent_no").cast("long"))


@register(
    "strip_chars_docs", ("TXT-2", "TXT-8"),
    f"SELECT conv_id, turn, {O.strip_chars('text')} AS cleaned FROM conversations",
)
def q_strip_chars_docs(spark, sf_dir):
    return _conv(spark, sf_dir).select("conv_id", "turn", TX.strip_chars("text").alias("cleaned"))


@register(
    "collapse_ws_docs", ("TXT-7", "TXT-8"),
    f"SELECT doc_id, {O.collapse('text')} AS collapsed FROM documents",
)
def q_collapse_ws_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", TX.collapse_ws("text").alias("collapsed"))


@register(
    "normalize_turns", ("TXT-1", "FLT-3"),
    f"SELECT conv_id, turn, regexp_replace(text, {O.q(O.WS + '+')}, '', 'g') AS normalized FROM conversations "
    f"WHERE length({O.strip('coalesce(text, ' + chr(39) + chr(39) + ')')}) > 0",
)
def q_normalize_turns(spark, sf_dir):
    from ..operators.filters import drop_blank
    c = drop_blank(_conv(spark, sf_dir), "text")
    return c.select("conv_id", "turn", TX.normalize_text("text").alias("normalized"))


# ASCII names: word characters are [A-Za-z0-9_] on both engines.
_SLUG_KEEP = "regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9_ -]', '', 'g')"


@register(
    "slugs", ("TXT-11",),
    f"SELECT c_custkey, replace({O.strip(_SLUG_KEEP)}, ' ', '_') AS slug FROM customer",
)
def q_slugs(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    return c.select("c_custkey", TX.slug(F.concat(F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"))).alias("slug"))


# ---------------------------------------------------------------------------------------
# Vocabulary, readings, lexicon, longest match: AGG-2..4, TXT-13, LEX-1..3, TXT-9
# ---------------------------------------------------------------------------------------


# The vocabulary is read from a line file: documents are taken line by line (each
# line stripped on its own, as a file line would be).
_VOCAB_SQL = (
    "dl AS (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')) AS line FROM documents), "
    f"v AS (SELECT ch, CAST(row_number() OVER (ORDER BY ch) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT "
    f"unnest(string_split({O.strip('line')}, '')) AS ch FROM dl) WHERE ch <> '')"
)


def _doc_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\r\n|\r|\n", -1)).alias("text"))


@register("vocab", ("AGG-2", "TXT-6", "IDX-1"), f"WITH {_VOCAB_SQL} SELECT ch, idx FROM v")
def q_vocab(spark, sf_dir):
    return VC.build_vocab(_doc_lines(spark, sf_dir), "text")


@register(
    "vocab_summary", ("AGG-3",),
    f"WITH {_VOCAB_SQL} SELECT CAST(count(*) OVER () AS BIGINT) AS vocab_size, idx, ch FROM v QUALIFY idx < 10",
)
def q_vocab_summary(spark, sf_dir):
    return VC.vocab_summary(VC.build_vocab(_doc_lines(spark, sf_dir), "text"), k=10)


_TOKENS_SQL = (
    f"tk AS (SELECT item_id AS line_no, CAST(unnest(generate_series(0, len(ws) - 1)) AS INTEGER) AS pos, "
    f"unnest(ws) AS surface FROM (SELECT item_id, regexp_extract_all(text, {O.q(O.NOT_WS + '+')}) AS ws "
    "FROM benchmark)), "
    "ft AS (SELECT *, 'x,y,' || CASE WHEN regexp_full_match(surface, '[\\x{0001}-\\x{007F}]+') "
    f"THEN {O.upper_ascii('surface')} ELSE '*' END AS feature FROM tk)"
)


@register(
    "token_readings", ("TXT-13", "AGG-4"),
    f"WITH {_TOKENS_SQL}, rd AS (SELECT line_no, pos, CASE WHEN string_split(feature, ',')[-1] = '*' THEN surface "
    "ELSE string_split(feature, ',')[-1] END AS r FROM ft) "
    "SELECT line_no, string_agg(r, '' ORDER BY pos) AS reading FROM rd GROUP BY line_no",
)
def q_token_readings(spark, sf_dir):
    return LX.concat_readings(T.tokens(spark, sf_dir))


_WORDS_SQL = "wd AS (SELECT item_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM benchmark)"


def _lex_sql(name: str, key: str, value: str) -> str:
    return (
        f"{name}_c AS (SELECT {key} AS key, {value} AS value, count(*) AS n FROM wd GROUP BY 1, 2), "
        f"{name} AS (SELECT key, value, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY key ORDER BY n DESC, value) AS rn FROM {name}_c) WHERE rn = 1)"
    )


@register("lexicon", ("LEX-2",), f"WITH {_WORDS_SQL}, {_lex_sql('lx', O.lower_ascii('word'), 'word')} SELECT * FROM lx")
def q_lexicon(spark, sf_dir):
    w = T.words(spark, sf_dir)
    return LX.build_lexicon(w.select(TX.ascii_lower("word").alias("key"), F.col("word").alias("value")))


def _longest_match_sql(lex: str, text_expr: str, lines_sql: str | None = None) -> str:
    """Greedy longest match as a recursive walk over positions (one step per token)."""
    ln = lines_sql or f"SELECT item_id AS line_id, {text_expr} AS text FROM benchmark"
    return (
        f"ln AS ({ln}), "
        f"lens AS (SELECT DISTINCT length(key) AS l FROM {lex}), "
        "pos AS (SELECT line_id, text, unnest(generate_series(1, length(text))) AS p FROM ln), "
        "cand AS (SELECT line_id, p, l, substr(text, p, l) AS s FROM pos, lens WHERE p + l - 1 <= length(text)), "
        f"hit AS (SELECT c.line_id, c.p, c.l, x.value, row_number() OVER (PARTITION BY c.line_id, c.p ORDER BY c.l DESC) AS rn "
        f"FROM cand c JOIN {lex} x ON x.key = c.s), "
        "best AS (SELECT line_id, p, l, value FROM hit WHERE rn = 1), "
        "walk(line_id, p, out) AS (SELECT line_id, 1, '' FROM ln UNION ALL "
        "SELECT w.line_id, w.p + coalesce(b.l, 1), w.out || coalesce(b.value, substr(n.text, w.p, 1)) "
        "FROM walk w JOIN ln n ON n.line_id = w.line_id LEFT JOIN best b ON b.line_id = w.line_id AND b.p = w.p "
        "WHERE w.p <= length(n.text))"
    )


@register(
    "assign_readings", ("LEX-1",),
    f"WITH RECURSIVE {_WORDS_SQL}, {_lex_sql('lx0', O.lower_ascii('word'), O.upper_ascii('word'))}, "
    "lx AS (SELECT key, value FROM lx0), "
    f"{_longest_match_sql('lx', O.strip(O.lower_ascii('text')))} "
    "SELECT w.line_id, w.out AS reading FROM walk w JOIN ln n ON n.line_id = w.line_id WHERE w.p = length(n.text) + 1",
)
def q_assign_readings(spark, sf_dir):
    w = T.words(spark, sf_dir)
    lex = LX.build_lexicon(w.select(TX.ascii_lower("word").alias("key"), TX.ascii_upper("word").alias("value")))
    lex = lex.select("key", "value")
    lines = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_id"),
                                                        TX.ascii_lower("text").alias("text"))
    return LX.assign_readings(lines, lex)


@register(
    "dictionary_convert", ("LEX-3", "TXT-9"),
    f"WITH RECURSIVE {_WORDS_SQL}, {_lex_sql('lx0', O.upper_ascii('word'), 'word')}, "
    "lx AS (SELECT key, value FROM lx0), "
    f"{_longest_match_sql('lx', O.strip(O.upper_ascii('text')))} "
    "SELECT w.line_id, w.out AS converted FROM walk w JOIN ln n ON n.line_id = w.line_id WHERE w.p = length(n.text) + 1",
)
def q_dictionary_convert(spark, sf_dir):
    w = T.words(spark, sf_dir)
    lex = LX.build_lexicon(w.select(TX.ascii_upper("word").alias("key"), F.col("word").alias("value")))
    lex = lex.select("key", "value")
    lines = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_id"),
                                                        TX.ascii_upper("text").alias("text"))
    return LX.dictionary_convert(lines, lex)


# ---------------------------------------------------------------------------------------
# Model-facing data: TXT-10, TXT-14, MDL-1..5
# ---------------------------------------------------------------------------------------


_PROMPT = O.q(K.PROMPT_PREFIX)


def _enc_sql(text_expr: str, name: str) -> str:
    """``{name}(doc_id, ids)``: vocabulary ids of all characters."""
    return (
        f"{name}_c AS (SELECT doc_id, unnest(generate_series(1, len(cs))) AS p, unnest(cs) AS ch FROM "
        f"(SELECT doc_id, list_filter(string_split({text_expr}, ''), lambda c: c <> '') AS cs FROM documents)), "
        f"{name} AS (SELECT doc_id, string_agg(CAST(coalesce(v.idx, -1) AS VARCHAR), ' ' ORDER BY p) AS ids "
        f"FROM {name}_c LEFT JOIN v ON v.ch = {name}_c.ch GROUP BY doc_id)"
    )


@register(
    "prompts", ("TXT-10", "TXT-14"),
    f"SELECT conv_id, turn, substr({_PROMPT} || text, 1, {K.MAX_LENGTH}) AS prompt FROM conversations",
)
def q_prompts(spark, sf_dir):
    c = _conv(spark, sf_dir)
    return c.select("conv_id", "turn", TX.truncate(TX.format_prompt("text"), K.MAX_LENGTH).alias("prompt"))


@register(
    "encode", ("MDL-2",),
    f"WITH {_VOCAB_SQL}, {_enc_sql('text', 'e')} SELECT d.doc_id, coalesce(e.ids, '') AS ids "
    "FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id",
)
def q_encode(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text")
    enc = MI.encode_chars(d, "text", q_vocab(spark, sf_dir))
    return enc.select("doc_id", F.array_join("input_ids", " ").alias("ids"))


@register(
    "decode", ("MDL-2", "MDL-3"),
    f"WITH {_VOCAB_SQL}, sp AS (SELECT idx FROM v WHERE ch IN ('e', '.')), "
    "c AS (SELECT doc_id, unnest(generate_series(1, len(cs))) AS p, unnest(cs) AS ch FROM "
    "(SELECT doc_id, list_filter(string_split(text, ''), lambda c: c <> '') AS cs FROM documents)) "
    "SELECT d.doc_id, coalesce(x.text, '') AS text FROM documents d LEFT JOIN (SELECT c.doc_id, "
    "string_agg(c.ch, '' ORDER BY p) AS text FROM c JOIN v ON v.ch = c.ch WHERE v.idx NOT IN (SELECT idx FROM sp) "
    "GROUP BY c.doc_id) x ON x.doc_id = d.doc_id",
)
def q_decode(spark, sf_dir):
    """Characters outside the vocabulary were encoded as -1 and decode to nothing; the
    entries of 'e' and '.' play the pad and a special token, which decoding leaves out."""
    v = write_once(q_vocab(spark, sf_dir))
    enc = MI.encode_chars(_docs(spark, sf_dir).select("doc_id", "text"), "text", v)
    special = {r["ch"]: int(r["idx"]) for r in v.filter(F.col("ch").isin("e", ".")).collect()}
    return MI.decode_ids(enc.select("doc_id", "input_ids"), "input_ids", v, pad_id=special.get("e"),
                         skip_ids=[i for c, i in special.items() if c == "."]).select("doc_id", "text")


@register(
    "prepare_examples", ("MDL-5", "TXT-10"),
    f"WITH {_VOCAB_SQL}, {_enc_sql(_PROMPT + ' || ' + O.upper_ascii('text'), 'src')}, {_enc_sql('text', 'tgt')} "
    "SELECT d.doc_id, coalesce(src.ids, '') AS input_ids, coalesce(tgt.ids, '') AS labels, "
    "CAST(len(string_split(coalesce(src.ids, ''), ' ')) AS INTEGER) AS n_input "
    "FROM documents d LEFT JOIN src ON src.doc_id = d.doc_id LEFT JOIN tgt ON tgt.doc_id = d.doc_id",
)
def q_prepare_examples(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", TX.ascii_upper("text").alias("source"), F.col("text").alias("target"))
    ex = MI.prepare_examples(d, q_vocab(spark, sf_dir))
    return ex.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                     F.array_join("labels", " ").alias("labels"),
                     F.size("attention_mask").cast("int").alias("n_input"))


@register(
    "length_buckets", ("MDL-4",),
    "SELECT CAST(floor(length(text) / 64) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, "
    "CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len "
    "FROM conversations GROUP BY 1",
)
def q_length_buckets(spark, sf_dir):
    return MI.length_buckets(T.table(spark, sf_dir, "conversations"), "text", width=64)


def make_upper_predictor():
    """Stub predictor for MDL-1 tests and the catalogue: ASCII upper-case of the
    input with the prompt removed (deterministic, no model)."""
    import numpy as np

    table = str.maketrans(K.ASCII_LOWER, K.ASCII_UPPER)
    plen = len(K.PROMPT_PREFIX)

    def predict(inputs: np.ndarray) -> np.ndarray:
        return np.array([s[plen:].translate(table) for s in inputs], dtype=object)

    return predict


@register(
    "batch_score_stub", ("MDL-1",),
    f"SELECT conv_id, turn, {O.upper_ascii('text')} AS prediction FROM conversations",
)
def q_batch_score_stub(spark, sf_dir):
    c = _conv(spark, sf_dir).select("conv_id", "turn", "text")
    return MI.batch_score(c, "text", make_upper_predictor, batch_size=64).select("conv_id", "turn", "prediction")


# ---------------------------------------------------------------------------------------
# Flagship: the dictionary baseline end to end
#   cleaned pairs -> exact split -> lexicon from train targets (LEX-2) -> longest-match
#   conversion of test sources (LEX-3) -> row metrics -> macro averages by language
# ---------------------------------------------------------------------------------------

def dictionary_baseline(spark, sf_dir):
    ds = split_dataset(spark, sf_dir).select("pair_key", "lang", "translation.source", "translation.target",
                                             "raw", "split")
    # The split dataset feeds two branches (dictionary from train, conversion of test):
    # it is written once to the cluster's checkpoint folder, as the saved dataset of the
    # original pipeline, instead of being recomputed by each branch.
    ds = write_once(ds)
    train = ds.filter(F.col("split") == "train")
    # Words of the raw train sentences (cleaning deletes the spaces).
    train_words = train.select(F.explode(F.regexp_extract_all("raw", F.lit(r"\p{L}+"), 0)).alias("w"))
    lex = LX.build_lexicon(train_words.select(TX.ascii_upper("w").alias("key"), F.col("w").alias("value")))
    test = ds.filter(F.col("split") == "test").select(
        F.col("pair_key").alias("line_id"), F.col("source").alias("text"), "lang", "target")
    conv = LX.dictionary_convert(test, lex.select("key", "value"), keep=("lang", "target"))
    scored_rows = M.row_metrics(conv.select("lang", F.col("target").alias("reference"),
                                            F.col("converted").alias("prediction")))
    return _r6_all(M.macro_metrics(scored_rows, by=["lang"]))


_BASELINE_SQL = (
    f"WITH RECURSIVE {O.corpus_ctes()}, kept AS (SELECT pair_key, lang, source, target, raw FROM cleaned WHERE ok), "
    f"ix AS (SELECT *, row_number() OVER (ORDER BY md5('{K.SEED}:' || pair_key), pair_key) - 1 AS i_, "
    "count(*) OVER () AS n_ FROM kept), "
    f"ds AS (SELECT *, CASE WHEN i_ < {_N_TRAIN} THEN 'train' "
    f"WHEN i_ < {_N_TRAIN} + floor((n_ - {_N_TRAIN}) * {K.TEST_RATIO / (K.TEST_RATIO + K.VALIDATION_RATIO)!r}) "
    "THEN 'test' ELSE 'validation' END AS split FROM ix), "
    "wd AS (SELECT unnest(regexp_extract_all(raw, '\\p{L}+')) AS word FROM ds WHERE split = 'train'), "
    f"{_lex_sql('lx', O.upper_ascii('word'), 'word')}, "
    "ln AS (SELECT pair_key AS line_id, source AS text FROM ds WHERE split = 'test'), "
    "lens AS (SELECT DISTINCT length(key) AS l FROM lx), "
    "pos AS (SELECT line_id, text, unnest(generate_series(1, length(text))) AS p FROM ln), "
    "cand AS (SELECT line_id, p, l, substr(text, p, l) AS s FROM pos, lens WHERE p + l - 1 <= length(text)), "
    "hit AS (SELECT c.line_id, c.p, c.l, x.value, row_number() OVER (PARTITION BY c.line_id, c.p ORDER BY c.l DESC) AS rn "
    "FROM cand c JOIN lx x ON x.key = c.s), "
    "best AS (SELECT line_id, p, l, value FROM hit WHERE rn = 1), "
    "walk(line_id, p, out) AS (SELECT line_id, 1, '' FROM ln UNION ALL "
    "SELECT w.line_id, w.p + coalesce(b.l, 1), w.out || coalesce(b.value, substr(n.text, w.p, 1)) "
    "FROM walk w JOIN ln n ON n.line_id = w.line_id LEFT JOIN best b ON b.line_id = w.line_id AND b.p = w.p "
    "WHERE w.p <= length(n.text)), "
    "conv AS (SELECT w.line_id, w.out AS converted FROM walk w JOIN ln n ON n.line_id = w.line_id "
    "WHERE w.p = length(n.text) + 1), "
    "bp AS (SELECT ds.lang, ds.target AS reference, conv.converted AS prediction FROM ds "
    "JOIN conv ON conv.line_id = ds.pair_key), "
    f"{O.scored_cte('bp')} "
    "SELECT lang, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRICS)
    + ", CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY lang"
)


@register("dictionary_baseline", ("SPL-1", "LEX-2", "LEX-3", "MET-4", "MET-5"), _BASELINE_SQL)
def q_dictionary_baseline(spark, sf_dir):
    return dictionary_baseline(spark, sf_dir)


# ---------------------------------------------------------------------------------------
# Sources over the driver's tables and strict joins: SRC-2, JOI-4
# ---------------------------------------------------------------------------------------


def transcription_registry(sf_dir: str) -> dict:
    """Dataset name -> table, text column and split column (the role of a turn)."""
    return {"conversations": {"path": f"{sf_dir.rstrip('/')}/conversations.parquet", "column": "text",
                              "split_column": "role", "split": "user"}}


@register("transcriptions", ("SRC-2",), "SELECT CAST(text AS VARCHAR) AS transcription FROM conversations WHERE role = 'user'")
def q_transcriptions(spark, sf_dir):
    return DSRC.read_transcriptions(spark, "conversations", transcription_registry(sf_dir))


@register(
    "join_predictions", ("JOI-4", "JOI-1", "MET-4"),
    f"WITH {O.sentences_cte()}, {O.sentences_next_cte()}, {O.predictions_cte()}, "
    "p AS (SELECT doc_id, sent_no, reference, prediction FROM preds WHERE model = 'vowel'), "
    f"{O.scored_cte('p')} SELECT doc_id, sent_no, round(cer, 6) AS cer, sentence_accuracy FROM scored",
)
def q_join_predictions(spark, sf_dir):
    s = T.sentences(spark, sf_dir).select("doc_id", "sent_no", F.col("sentence").alias("text"))
    preds = s.select("doc_id", "sent_no", F.translate("text", "e", "a").alias("text"))
    j = PR.join_predictions(s, preds, key=["doc_id", "sent_no"])
    return M.row_metrics(j).select("doc_id", "sent_no", r6(F.col("cer")).alias("cer"), "sentence_accuracy")



# ---------------------------------------------------------------------------------------
# Pair preparation end to end: LEX-1 -> FLT-2 -> SPL-1 on the lines of ``benchmark``
# ---------------------------------------------------------------------------------------

def benchmark_lines(spark, sf_dir):
    """Non-blank stripped lines of ``benchmark`` keyed 'item:line' (line = position
    among the non-blank lines of the item)."""
    b = T.table(spark, sf_dir, "benchmark")
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\\r\\n|\\r|\\n", -1),
                                 lambda x: TX.strip_ws(x)), lambda x: F.length(x) > 0)
    lines = b.select("item_id", F.posexplode(parts).alias("ln", "text"))
    return lines.select(F.concat_ws(":", F.col("item_id").cast("string"), F.col("ln").cast("string")).alias("line_id"),
                        "text")


_BLINES_SQL = (
    "SELECT CAST(item_id AS VARCHAR) || ':' || CAST(ln AS VARCHAR) AS line_id, text FROM ("
    "SELECT item_id, unnest(generate_series(0, len(ls) - 1)) AS ln, unnest(ls) AS text FROM ("
    f"SELECT item_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), "
    f"lambda x: {O.strip('x')}), lambda x: length(x) > 0) AS ls FROM benchmark))"
)
_PC_LINES = f"SELECT line_id, {O.lower_ascii('text')} AS text FROM ({_BLINES_SQL})"


@register(
    "parallel_corpus", ("LEX-1", "FLT-2", "SPL-1"),
    f"WITH RECURSIVE {_WORDS_SQL}, {_lex_sql('lx0', O.lower_ascii('word'), O.upper_ascii('word'))}, "
    "lx AS (SELECT key, value FROM lx0), "
    f"{_longest_match_sql('lx', '', _PC_LINES)}, "
    "rd AS (SELECT w.line_id, w.out AS source FROM walk w JOIN ln n ON n.line_id = w.line_id "
    "WHERE w.p = length(n.text) + 1), "
    f"pr AS (SELECT rd.line_id, {O.strip_chars('rd.source')} AS source, {O.strip_chars('bl.text')} AS target "
    f"FROM rd JOIN ({_BLINES_SQL}) bl ON bl.line_id = rd.line_id), "
    "kept AS (SELECT * FROM pr WHERE coalesce(regexp_full_match(source, '[\\x{0041}-\\x{005A}]+'), false)), "
    f"ix AS (SELECT *, row_number() OVER (ORDER BY md5('{K.SEED}:' || line_id), line_id) - 1 AS i_, "
    "count(*) OVER () AS n_ FROM kept) "
    f"SELECT line_id, source, target, CASE WHEN i_ < {_N_TRAIN} THEN 'train' "
    f"WHEN i_ < {_N_TRAIN} + floor((n_ - {_N_TRAIN}) * {K.TEST_RATIO / (K.TEST_RATIO + K.VALIDATION_RATIO)!r}) "
    "THEN 'test' ELSE 'validation' END AS split FROM ix",
)
def q_parallel_corpus(spark, sf_dir):
    w = T.words(spark, sf_dir)
    lex = LX.build_lexicon(w.select(TX.ascii_lower("word").alias("key"), TX.ascii_upper("word").alias("value")))
    lex = lex.select("key", "value")
    lines = benchmark_lines(spark, sf_dir).withColumn("lower", TX.ascii_lower("text"))
    out = CP.build_parallel_corpus(lines, lex, reading_text="lower", lo=T.LATIN_LO, hi=T.LATIN_HI)
    return out.select("line_id", "source", "target", "split")


# ---------------------------------------------------------------------------------------
# Readings of all document sentences by the whole dictionary. No SQL: a recursive walk
# over every character is too slow; the operator is tested against brute force.
# ---------------------------------------------------------------------------------------

@register("document_readings", ("LEX-1", "LEX-2"), None)
def q_document_readings(spark, sf_dir):
    s = T.sentences(spark, sf_dir).select("doc_id", "sent_no", "sentence")
    words = s.select(F.explode(F.regexp_extract_all("sentence", F.lit(r"\p{L}+"), 0)).alias("w"))
    lex = LX.build_lexicon(words.select(TX.ascii_lower("w").alias("key"), TX.ascii_upper("w").alias("value")))
    out = LX.longest_match(s.withColumn("text", TX.ascii_lower("sentence")), lex.select("key", "value"), line="doc_id",
                           out="reading", keep=("sent_no",))
    return out.select("doc_id", "sent_no", "reading")


# ---------------------------------------------------------------------------------------
# Evaluation end to end: strict pairing of two tables -> metrics -> averages
# ---------------------------------------------------------------------------------------

_EVAL_PREDS = (
    "ep AS (SELECT lang, sentence AS reference, "
    f"{O.upper_ascii('sentence')} AS prediction FROM sent)"
)


@register(
    "evaluation", ("JOI-4", "MDL-1", "MET-4", "MET-5"),
    f"WITH {O.sentences_cte()}, {_EVAL_PREDS}, {O.scored_cte('ep')} SELECT lang, "
    + ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRICS) + ", CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY lang",
)
def q_evaluation(spark, sf_dir):
    """References and sources are two tables of lines; the stub predictor answers each
    source line, and lines are paired strictly."""
    refs = T.sentences(spark, sf_dir)
    sources = T.sentence_pairs(spark, sf_dir).select("doc_id", "sent_no", F.col("source").alias("text"))
    board = EV.evaluate(refs.select("doc_id", "sent_no", "lang", F.col("sentence").alias("text")), sources, make_upper_predictor,
                        key=["doc_id", "sent_no"], by=["lang"])
    return _r6_all(board)


# Pairing of two different tables: every customer line of orders with its own key.
@register(
    "pair_strict", ("JOI-1",),
    "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS source, CAST(n AS VARCHAR) AS target FROM orders "
    "JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def q_pair_strict(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("string").alias("text"))
    orders = T.table(spark, sf_dir, "orders")
    orders = orders.join(lines.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", F.col("o_totalprice").cast("string").alias("text"))
    return PR.pair_by_position(orders, lines, key="o_orderkey", strict=True)


@register(
    "domain_fallback", ("GRP-4", "JOI-3"),
    f"WITH {O.links_cte()}, req AS (SELECT DISTINCT n_name AS name FROM nation), "
    f"{O.walk_ctes('SELECT name AS root FROM req', 1)}, {O.page_sentences_cte()}, "
    f"k AS (SELECT root, member, {O.path_key('path')} AS pk FROM walked), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY pk) - 1 AS rank FROM k) "
    "SELECT r.root AS domain, r.root AS category, 0 AS cat_ord, CAST(rank AS BIGINT) AS rank, title, "
    f"{O.render('title', 'sentences')} AS article FROM r JOIN ps ON ps.title = r.member",
)
def q_domain_fallback(spark, sf_dir):
    """Names that are no domain (the nations): each is a plain category of its own."""
    names = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).distinct()
    a = G.assemble_domain(names, T.domains(spark, sf_dir), T.category_links(spark, sf_dir), T.doc_pages(spark, sf_dir),
                          max_depth=1, terms=T.LATIN_TERMS)
    return a.select("domain", "category", "cat_ord", "rank", "title", "article")


# ---------------------------------------------------------------------------------------
# Forms of JOI-2, MET-8 and MDL-4
# ---------------------------------------------------------------------------------------

_TITLES_SQL = (
    "req AS (SELECT 'doc-' || CAST(c_custkey AS VARCHAR) AS title FROM customer), "
    "pg AS (SELECT DISTINCT 'doc-' || CAST(doc_id AS VARCHAR) AS title FROM documents)"
)


@register("title_existence", ("JOI-2",), f"WITH {_TITLES_SQL} SELECT title, title IN (SELECT title FROM pg) AS found FROM req")
def q_title_existence(spark, sf_dir):
    req = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("title"))
    pages = T.doc_pages(spark, sf_dir)
    return PR.found_titles(req, pages).withColumn("found", F.lit(True)).unionByName(
        PR.missing_titles(req, pages).withColumn("found", F.lit(False)))


@register(
    "last_checkpoints", ("MET-8",),
    f"WITH {O.metrics_ctes()}, {O.runs_cte()}, s AS (SELECT *, row_number() OVER (ORDER BY model, dataset) AS step FROM runs) "
    "SELECT model, dataset, CAST(step AS INTEGER) AS step FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY step DESC) <= 2",
)
def q_last_checkpoints(spark, sf_dir):
    steps = runs(spark, sf_dir).select("model", "dataset").withColumn("step", F.row_number().over(Window.orderBy("model", "dataset")))
    return M.keep_last_checkpoints(steps, step="step", by=["dataset"], keep=2)


@register(
    "length_banded", ("MDL-4",),
    "SELECT conv_id, turn, CAST(floor(length(text) / 64) AS BIGINT) AS bucket FROM conversations",
)
def q_length_banded(spark, sf_dir):
    return MI.with_length_bucket(_conv(spark, sf_dir), "text", width=64).select("conv_id", "turn", "bucket")


def _batch_sql(rows: int = 8, megas: int = 50) -> str:
    return (
        "k AS (SELECT conv_id, turn, coalesce(length(text), 0) AS len, md5('" + str(K.SEED) + ":' || conv_id || ':' || turn) AS h FROM conversations), "
        f"m AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / {rows * megas}.0) AS BIGINT)) FROM k) "
        "AS mega_batch FROM k), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY mega_batch ORDER BY len DESC, h) AS rn FROM m), "
        f"b AS (SELECT *, CAST((rn - 1) // {rows} AS BIGINT) AS batch FROM r), "
        "lb AS (SELECT conv_id, turn, len, mega_batch, batch, CAST(max(len) OVER (PARTITION BY mega_batch, batch) AS BIGINT) AS batch_len FROM b)"
    )


def _token_batch_sql(max_tokens: int) -> str:
    return (
        "f AS (SELECT mega_batch, rn, conv_id, turn, len, CAST(0 AS BIGINT) AS batch, CAST(len AS BIGINT) AS batch_len, 1 AS held FROM r WHERE rn = 1 "
        "UNION ALL SELECT r.mega_batch, r.rn, r.conv_id, r.turn, r.len, "
        f"CASE WHEN (f.held + 1) * f.batch_len > {max_tokens} THEN f.batch + 1 ELSE f.batch END, "
        f"CASE WHEN (f.held + 1) * f.batch_len > {max_tokens} THEN r.len ELSE f.batch_len END, "
        f"CASE WHEN (f.held + 1) * f.batch_len > {max_tokens} THEN 1 ELSE f.held + 1 END "
        "FROM f JOIN r ON r.mega_batch = f.mega_batch AND r.rn = f.rn + 1)"
    )


@register("length_batches", ("MDL-4",), f"WITH {_batch_sql()} SELECT conv_id, turn, mega_batch, batch, batch_len FROM lb")
def q_length_batches(spark, sf_dir):
    return MI.length_batches(_conv(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "mega_batch", "batch", "batch_len")


@register(
    "token_batches", ("MDL-4",),
    f"WITH RECURSIVE {_batch_sql()}, {_token_batch_sql(4096)} SELECT conv_id, turn, mega_batch, batch, batch_len FROM f",
)
def q_token_batches(spark, sf_dir):
    return MI.length_batches(_conv(spark, sf_dir), ["conv_id", "turn"], max_tokens=4096).select("conv_id", "turn", "mega_batch", "batch", "batch_len")


@register(
    "padding_report", ("MDL-4",),
    f"WITH {_batch_sql()}, e AS (SELECT count(*) AS n, sum(len) AS t, max(batch_len) AS l FROM lb GROUP BY mega_batch, batch) "
    "SELECT CAST(count(*) AS BIGINT) AS batches, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(n * l) AS BIGINT) AS padded, "
    "round(1 - sum(t) / sum(n * l), 6) AS padding_share FROM e",
)
def q_padding_report(spark, sf_dir):
    return MI.padding_report(MI.length_batches(_conv(spark, sf_dir), ["conv_id", "turn"]))


# ---------------------------------------------------------------------------------------
# Round trips through the sinks and sources: SRC-1, SRC-2, SRC-4, SNK-1..5. Every query
# writes all its rows below the shared scratch folder and reads them back.
# ---------------------------------------------------------------------------------------

_DLINES_SQL = (
    "dl AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS n, unnest(ls) AS text FROM (SELECT doc_id, "
    "regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM documents))"
)


def _numbered_doc_lines(spark, sf_dir):
    """Lines of all documents with an ordering key that sorts as text."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\r\n|\r|\n", -1)
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("n", "text"))
    return d.select(F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lpad(F.col("n").cast("string"), 10, "0")).alias("k"), "text")


def _positions(lines):
    """(idx, text): part files in name order, lines in file order."""
    return IX.with_global_index(lines, ["file", "line_no"]).select("idx", "text")


@register(
    "lines_roundtrip", ("SNK-1", "SRC-1", "IDX-1"),
    f"WITH {_DLINES_SQL} SELECT CAST(row_number() OVER (ORDER BY doc_id, n) - 1 AS BIGINT) AS idx, text FROM dl",
)
def q_lines_roundtrip(spark, sf_dir):
    path = scratch_folder(spark, "lines")
    LN.write_lines(_numbered_doc_lines(spark, sf_dir), path, "k")
    return _positions(LN.read_lines(spark, f"{path}/part-*"))


@register(
    "splits_roundtrip", ("SNK-2", "SRC-4"),
    f"{_SPLIT_EXACT_SQL} SELECT pair_key, split, source, target FROM ds",
)
def q_splits_roundtrip(spark, sf_dir):
    path = scratch_folder(spark, "splits")
    DSRC.write_splits(split_dataset(spark, sf_dir).select("pair_key", "translation", "split"), path)
    parts = [DSRC.read_splits(spark, path, split) for split in ("train", "test", "validation")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("pair_key", "split", "translation.source", "translation.target")


@register(
    "export_roundtrip", ("SNK-3", "SRC-1", "JOI-1"),
    f"{_SPLIT_EXACT_SQL} SELECT CAST(row_number() OVER (ORDER BY pair_key) - 1 AS BIGINT) AS idx, source, target FROM ds WHERE split = 'train'",
)
def q_export_roundtrip(spark, sf_dir):
    a, b = scratch_folder(spark, "export-source"), scratch_folder(spark, "export-target")
    kept = write_once(split_dataset(spark, sf_dir).select("pair_key", "translation", "split"))
    # Cleaning keeps line breaks inside a target; the line files hold one line per pair.
    one_line = lambda c: F.translate(F.col(f"translation.{c}"), "\r\n", "\u2424\u2424").alias(c)
    DSRC.export_split(kept.withColumn("translation", F.struct(one_line("source"), one_line("target"))), "train", a, b)
    pairs = PR.pair_by_position(_positions(LN.read_lines(spark, a)), _positions(LN.read_lines(spark, b)), key="idx", strict=True)
    back = lambda c: F.translate(c, "\u2424", "\n").alias(c)
    return pairs.select("idx", back("source"), back("target"))


@register(
    "clean_written", ("FLT-2", "AGG-1"),
    f"WITH {O.corpus_ctes()} SELECT lang, CAST(count_if(ok) AS BIGINT) AS valid, CAST(count_if(NOT ok) AS BIGINT) AS filtered, "
    "CAST(count(*) AS BIGINT) AS total, CAST(count_if(ok) AS BIGINT) AS written FROM cleaned GROUP BY lang",
)
def q_clean_written(spark, sf_dir):
    """The counts observed while the clean pairs are written, beside the rows in the files."""
    path = scratch_folder(spark, "clean")
    counts = DSRC.write_clean_pairs(cleaned_pairs(spark, sf_dir, keep_flag="ok"), path, by="lang", values=LANGS)
    written = spark.read.parquet(path).groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(written, F.col("lang").eqNullSafe(F.col("l")), "left").select("lang", "valid", "filtered", "total", F.coalesce("n", F.lit(0)).alias("written"))


@register(
    "splits_written", ("SNK-2", "AGG-5"),
    f"{_SPLIT_EXACT_SQL}, c AS (SELECT split, CAST(count(*) AS BIGINT) AS n FROM ds GROUP BY split) "
    "SELECT split, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(n * 100.0 / sum(n) OVER (), 6) AS pct, n AS written FROM c",
)
def q_splits_written(spark, sf_dir):
    """Split statistics observed while the splits are written, beside the rows in the files."""
    path = scratch_folder(spark, "splits")
    stats = DSRC.write_splits_counted(split_dataset(spark, sf_dir).select("pair_key", "translation", "split"), path)
    return stats.join(DSRC.read_splits(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("written")), "split")


@register("vocab_roundtrip", ("SNK-4", "SRC-1", "AGG-2"), f"WITH {_VOCAB_SQL} SELECT ch, idx FROM v")
def q_vocab_roundtrip(spark, sf_dir):
    path = scratch_folder(spark, "vocab")
    DSRC.write_vocab(q_vocab(spark, sf_dir), path)
    entries = LN.read_lines(spark, path).select(F.explode(F.from_json("text", "map<string,bigint>")).alias("ch", "idx"))
    return entries.select("ch", "idx")


@register(
    "corpus_roundtrip", ("SNK-5", "GRP-4", "TXT-11"),
    f"WITH {O.links_cte()}, {_DOMAIN_SQL}, "
    f"{O.walk_ctes('SELECT DISTINCT category AS root FROM dom', 1)}, {O.page_sentences_cte()}, "
    f"a AS (SELECT dom.domain, {O.render('title', 'sentences', 'dom.category')} AS article "
    "FROM walked w JOIN dom ON dom.category = w.root JOIN ps ON ps.title = w.member), "
    "l AS (SELECT replace(domain, ' ', '_') AS slug, unnest(string_split(article, chr(10))) AS line FROM a) "
    "SELECT slug, line, CAST(count(*) AS BIGINT) AS n FROM l WHERE line <> '' GROUP BY slug, line",
)
def q_corpus_roundtrip(spark, sf_dir):
    """Lines of the exported folders, by folder, with how often they stand there. Every nation
    of a region reaches the pages of all of them, so the files are compressed."""
    path = scratch_folder(spark, "corpus")
    names = T.domains(spark, sf_dir).select("domain")
    DSRC.write_corpus_by_domain(q_domain_corpus(spark, sf_dir), path, "domain", names=names, compression="gzip")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.filter(F.col("value") != "").groupBy("slug", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register("transcriptions_csv", ("SRC-2",), "SELECT CAST(text AS VARCHAR) AS transcription FROM conversations")
def q_transcriptions_csv(spark, sf_dir):
    path = scratch_folder(spark, "transcriptions")
    DSRC.write_transcriptions(_conv(spark, sf_dir).select(F.col("text").alias("transcription")), path)
    return DSRC.read_csv_transcriptions(spark, path)
