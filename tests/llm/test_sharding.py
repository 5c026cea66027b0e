import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kanaforge.llm import sharding as S

from .conftest import ODD_ROWS

SF = "/root/testdata/sf0.001"


def check(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(shards)), default=0) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def cut_groups(rows):
    """Number of shards of every group of two rows and more."""
    where = {}
    for r in rows:
        where.setdefault(r["grp"], []).append(r["shard"])
    return {g: (len(v), len(set(v))) for g, v in where.items() if g is not None and len(v) > 1}


@pytest.mark.parametrize("n,shards", [(0, 4), (1, 4), (5, 4), (1000, 7), (24, 24)])
def test_even_counts_and_gapless_slots(spark, n, shards):
    items = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 12).cast("string")).alias("grp"))
    rows = S.balanced_shards(items, shards).collect()
    assert len(rows) == n and len({r["rid"] for r in rows}) == n
    check(rows, shards)


def test_groups_stay_together(spark):
    items = spark.range(4000).select(F.col("id").alias("rid"), F.when(F.col("id") < 1500, F.floor(F.col("id") / 5).cast("string")).alias("grp"))
    rows = S.balanced_shards(items, 8).collect()
    check(rows, 8)
    cut = cut_groups(rows)
    assert len(cut) == 300 and sum(k > 1 for _, k in cut.values()) <= 8


def test_a_third_of_all_rows_in_one_group(spark):
    items = spark.range(3000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.floor(F.col("id") / 12).cast("string")).alias("grp"))
    rows = S.balanced_shards(items, 24).collect()
    check(rows, 24)
    cut = cut_groups(rows)
    n, k = cut.pop("hot")
    assert n == 1000 and k <= 12  # eight quotas hold it
    assert sum(k > 1 for _, k in cut.values()) <= 0.1 * len(cut) + 5


def test_every_row_linked(spark):
    items = spark.range(960).select(F.col("id").alias("rid"), F.floor(F.col("id") / 2).cast("string").alias("grp"))
    rows = S.balanced_shards(items, 24).collect()
    check(rows, 24)
    assert sum(k > 1 for _, k in cut_groups(rows).values()) <= 100


def test_odd_rows(odd_docs, no_docs):
    rows = S.shard_documents(odd_docs, 5).collect()
    check(rows, 5)
    import zlib
    want = sorted((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ODD_ROWS)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert S.shard_documents(no_docs, 5).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = S.shard_documents(odd_docs, 5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query(spark):
    from kanaforge.llm.queries import op6_balanced_sharding

    rows = op6_balanced_sharding(spark, SF).collect()
    check(rows, 24)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
