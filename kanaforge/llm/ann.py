"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors are the pivots. Every vector is represented by its nearest
pivots in order (a prefix of its pivot permutation). Equal vectors are indexed once, with
their smallest ids. Distinct vectors are dealt into shards of bounded size; each shard posts
its vectors in one inverted file per pivot (vector and place of the pivot). A query walks
the files of its own nearest pivots, which adds up the footrule distance of the permutation
prefixes: the sum of place differences, a pivot missing from a prefix counting as just
behind its end. The vectors of least footrule of every shard, with
all that tie with the last of them, are reranked by their true Euclidean distance, and the
shards' best are merged.

Queries meet every shard in blocks of bounded size, so a task holds one shard and one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOTS = 256
PREFIX = 64
SHARD_ROWS = 4096
QUERY_ROWS = 2048
#: Distinct vectors of a shard that are reranked for each query, besides ties.
RERANK = 400


def usable(col) -> F.Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(col) > 0) & ~bad & F.exists(col, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """The vectors (distinct ones) with the smallest hashes: a sample of at most ``pivots``
    rows that depends on neither order nor partitioning."""
    rows = vectors.select("v").dropDuplicates(["v"]).orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    return np.array([r["v"] for r in rows], np.float64)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of every row of x, nearest first."""
    d = (pivots ** 2).sum(axis=1) - 2 * (x @ pivots.T)
    prefix = min(prefix, len(pivots))
    near = np.argpartition(d, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)


class InvertedFiles:
    """One posting list per pivot over the permutation prefixes of a shard."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        rows, self.prefix = perms.shape
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.vector = order // self.prefix
        self.place = order % self.prefix
        self.first = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        self.rows = rows

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of one query's prefix to every row."""
        end = self.prefix
        # Nothing shared: every pivot of either prefix is displaced to just behind the end.
        far = np.full(self.rows, end * (end + 1), np.int64)
        for place, pivot in enumerate(perm.tolist()):
            a, b = self.first[pivot], self.first[pivot + 1]
            there = self.place[a:b]
            far[self.vector[a:b]] += np.abs(there - place) - (end - there) - (end - place)
        return far


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): every distinct vector with its k + 1 smallest ids in order, an id of
    several rows up to k times. Without any one id, the k smallest rows are among them."""
    own = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    # The limit holds before the shuffle too, so a common vector brings k + 1 rows a task.
    first = own.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("id", "n")))
    return first.groupBy("v").agg(F.flatten(F.transform(ids, lambda x: F.array_repeat(x["id"], x["n"]))).alias("ids"))


def search_shard(ids, x, query_ids, q, pivots, prefix, rerank, k):
    """Best k of a shard for each query: arrays (query id, vector id, distance). The vectors
    x are distinct; ids: a sorted array of ids for each."""
    files = InvertedFiles(permutations(x, pivots, prefix), len(pivots))
    sizes = np.array([len(i) for i in ids], np.int64)
    flat, vector, first = np.concatenate(ids), np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes) - sizes
    single = flat[first] == flat[first + sizes - 1]
    out = []
    for qid, v, perm in zip(query_ids.tolist(), q, permutations(q, pivots, prefix)):
        far = files.footrule(perm)
        mine = vector[flat == qid]
        mine = mine[single[mine]]
        far[mine] = np.iinfo(np.int64).max  # vectors of its own rows alone
        n = min(rerank, len(far))
        # Vectors as far as the last one that counts are reranked too.
        near = np.flatnonzero(far <= np.partition(far, n - 1)[n - 1])
        score = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
        at = np.repeat(np.arange(len(near)), sizes[near])
        own = np.concatenate([ids[i] for i in near])
        at, own = at[own != qid], own[own != qid]
        best = np.lexsort((own, score[at]))[:k]
        out.append((np.full(len(best), qid), own[best], score[at][best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: int = RERANK,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found of every query among all
    rows but those of its own id, nearest first, ties to the smaller id; score is the
    Euclidean distance in double precision. ``queries`` has the columns of ``vectors``.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part,
    nor do rows with a null id or with another dimension than the pivots (the commonest
    one). Repeated rows are candidates one by one; a repeated query id is answered for its
    smallest vector. ``shard_rows`` and ``query_rows`` bound what a task holds; ``rerank``
    applies to each shard."""
    def clean(df):
        v = F.col(vector_col)
        return df.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    rows = clean(vectors)
    per_dim = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    dim = per_dim["dim"] if per_dim else 0
    rows = materialize(distinct_vectors(rows.where(F.size("v") == dim), k))
    total = rows.count()
    asked = clean(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    n_queries = asked.count()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-n_queries // query_rows))
    table = choose_pivots(rows, pivots) if total else np.zeros((0, 0))
    part = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.withColumn("shard", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = search_shard([np.asarray(i, np.int64) for i in x["ids"]], np.stack(x["v"].to_numpy()).astype(np.float64), q["id"].to_numpy(np.int64),
                             np.stack(q["v"].to_numpy()).astype(np.float64), table, prefix, rerank, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
