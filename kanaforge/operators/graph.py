"""Category walks and corpus assembly (GRP-1..5).

A walk is a bounded loop of joins between the current frontier of categories and the
link table (category, member, member_ns, ord). Each row carries ``path``, the list of
``ord`` values from the root, so depth-first pre-order is the lexicographic order of
``path`` (shorter prefix first) and no sequential traversal is needed. Many roots walk
in the same joins; duplicates reached through two categories are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import render_article, split_sentences_drop, split_sentences_keep, strip_markup
from ..session import write_once
from .bloom import BROADCAST_MAX_BYTES, asked_rows
from .filters import namespace
from .index import limit_ordered
from .pairing import rank_in_group, resolve_domain


def path_key(path: Column | str, width: int = 10) -> Column:
    """A string that sorts like the ``path`` array (for output and text sinks)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.array_join(F.transform(p, lambda x: F.lpad(x.cast("string"), width, "0")), "/")


def walk_category(roots: DataFrame, links: DataFrame, max_depth: int = K.MAX_DEPTH,
                  root_col: str = "root", slices: int | None = None) -> DataFrame:
    """GRP-1: pages under each root as (root, member, level, path).

    Members of the root are level 0. A page (ns 0) is emitted; a category (ns 14) is
    entered when its level < ``max_depth``, so pages come from levels 0..max_depth.
    Cycles are bounded by the depth only, as in the original walk. ``slices``: the links are
    a stored table whose categories are spread over the values 0 to slices - 1 of ``slice``;
    the frontier is repeated for each, which leaves the links where they are stored."""
    on = ["_cat", "_slice"] if slices else ["_cat"]
    lk = links.select(F.col("category").alias("_cat"), *([F.col("slice").alias("_slice")] if slices else []),
                      "member", "member_ns", F.col("ord").cast("int").alias("ord"))
    everywhere = lambda f: f.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))) if slices else f
    frontier = roots.select(F.col(root_col).alias("root"), F.col(root_col).alias("_cat"),
                            F.array().cast("array<int>").alias("path"))
    pages = []
    for level in range(max_depth + 1):
        m = everywhere(frontier).join(lk, on=on, how="inner").select(
            "root", "member", "member_ns", F.concat("path", F.array("ord")).alias("path"))
        pages.append(namespace(m, K.NS_MAIN, "member_ns")
                     .select("root", "member", F.lit(level).alias("level"), "path"))
        if level < max_depth:
            # The next level and this level's pages both read the join: beyond the first
            # level its result is written once, so that no level is computed again below
            # the ones after it.
            if level:
                m = write_once(m)
                pages[-1] = namespace(m, K.NS_MAIN, "member_ns").select("root", "member", F.lit(level).alias("level"), "path")
            frontier = namespace(m, K.NS_CATEGORY, "member_ns").select(
                "root", F.col("member").alias("_cat"), "path")
    return reduce(lambda a, b: a.unionByName(b), pages)


def cap_per_root(walked: DataFrame, max_pages: int | None = None, root: str = "root",
                 rank_col: str = "rank") -> DataFrame:
    """GRP-2: the pages of each root with their 0-based rank in walk order; with
    ``max_pages`` only the first so many (planned as a per-partition top-N before the
    shuffle, so a root with many pages sends at most N rows per task through it).
    Without a cap the rank comes from a global index, which splits a hot root."""
    if max_pages is None:
        return rank_in_group(walked, [root], ["path"], rank_col)
    w = Window.partitionBy(root).orderBy("path")
    ranked = walked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_pages)
    return ranked.withColumn(rank_col, (F.col("_rn") - 1).cast("long")).drop("_rn")


def page_sentences(pages: DataFrame, title: str = "title", text: str = "text",
                   terms: str = K.TERMS_KEEP) -> DataFrame:
    """Sentences of each page (keep form, TXT-3), computed once per page; pages with
    no sentence are left out (they fail like an empty download)."""
    s = pages.select(F.col(title).alias("title"), split_sentences_keep(F.col(text), terms).alias("sentences"))
    return s.filter(F.size("sentences") > 0)


def assemble_articles(walked: DataFrame, pages: DataFrame, terms: str = K.TERMS_KEEP, category: str | None = None,
                      broadcast_max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """GRP-3 body: walked pages -> page text -> sentences -> rendered article (TXT-12).
    Missing pages and pages without sentences are skipped. Only pages the walk reached
    are split into sentences (a semi join with the distinct walked titles first), each
    once however often it was reached."""
    walked = write_once(walked)  # narrow rows, read twice here and measured by the planner
    # Texts of pages that no walk reached do not move.
    needed = asked_rows(pages, walked.select(F.col("member").alias("title")), "title", broadcast_max_bytes)
    # Sentences move as the one text they are rendered to, which is smaller than their array.
    ps = page_sentences(needed, terms=terms).select("title", F.array_join("sentences", "\n").alias("_body"))
    j = walked.join(ps, walked["member"] == ps["title"], "inner").drop("member")
    cat = F.col(category) if category else None
    return j.withColumn("article", render_article(F.col("title"), F.array("_body"), cat)).drop("_body")


def assemble_titles(titles: DataFrame, pages: DataFrame, title: str = "title",
                    terms: str = K.TERMS_KEEP) -> DataFrame:
    """GRP-3, title-list form: one article per requested title that exists and has
    sentences (a missing or empty page is skipped), with the request's columns."""
    walked = titles.withColumnRenamed(title, "member")
    return assemble_articles(walked, pages, terms)


def assemble_category(roots: DataFrame, links: DataFrame, pages: DataFrame, max_depth: int = K.MAX_DEPTH,
                      max_pages: int | None = None, terms: str = K.TERMS_KEEP) -> DataFrame:
    """GRP-3: one article per walked page for each root category:
    (root, rank, level, path, title, article). A cap applies per root."""
    walked = cap_per_root(walk_category(roots, links, max_depth), max_pages)
    return assemble_articles(walked, pages, terms)


def assemble_domain(names: DataFrame, domains: DataFrame, links: DataFrame, pages: DataFrame,
                    max_depth: int = K.MAX_DEPTH, max_pages_per_category: int | None = None,
                    terms: str = K.TERMS_KEEP) -> DataFrame:
    """GRP-4: every category of the requested domains (JOI-3) walked in the same joins,
    capped per category if asked, rendered with the ``(Category: c)`` header. An unknown
    name is a plain category of its own, rendered like one: ``# title`` alone.
    (domain, category, cat_ord, rank, title, article)."""
    cats = resolve_domain(names, domains).select(
        F.coalesce(F.col("domain"), F.col("name")).alias("domain"), "category", F.col("ord").alias("cat_ord"), F.col("matched").alias("_matched"))
    walked = cap_per_root(walk_category(cats.select(F.col("category").alias("root")).distinct(), links,
                                        max_depth), max_pages_per_category)
    walked = walked.withColumnRenamed("root", "category")
    tagged = cats.join(walked, on="category", how="inner")
    return assemble_articles(tagged.withColumn("_header", F.when(F.col("_matched"), F.col("category"))), pages, terms,
                             category="_header").drop("_header", "_matched")


def assemble_all_domains(domains: DataFrame, links: DataFrame, pages: DataFrame, max_depth: int = K.MAX_DEPTH,
                         max_pages_per_category: int | None = None, terms: str = K.TERMS_KEEP) -> DataFrame:
    """GRP-4, all-domains form: the ``domain`` column is the output partition key."""
    names = domains.select(F.col("domain").alias("name")).distinct()
    return assemble_domain(names, domains, links, pages, max_depth, max_pages_per_category, terms)


def extract_dump_sentences(blocks: DataFrame, order: list[str], body: str = "body",
                           terms: str = K.TERMS_DROP, min_len: int = K.MIN_SENTENCE_LEN,
                           max_sentences: int | None = None) -> DataFrame:
    """GRP-5: dump blocks -> markup removed (TXT-5) -> sentences (TXT-4, drop form) in
    document order; with ``max_sentences`` only the first N (0/None = all)."""
    arr = split_sentences_drop(strip_markup(F.col(body)), terms, min_len)
    s = blocks.select(*order, F.posexplode(arr).alias("sent_no", "sentence")).withColumn(
        "sent_no", F.col("sent_no").cast("long"))
    if max_sentences:
        s = limit_ordered(s, max_sentences, [*order, "sent_no"])
    return s
