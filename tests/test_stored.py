"""Stored link and page tables: same answers, and no exchange of what is stored."""

import re
import uuid

from pyspark.sql import functions as F

from kanaforge.operators import graph as G
from kanaforge.sources import stored as ST

LINKS = [("root", f"c{i}", 14, i) for i in range(5)] + [(f"c{i % 5}", f"p{i}", 0, i) for i in range(60)] + [
    ("c0", "root", 14, 999)] + [("hot", f"h{i}", 0, i) for i in range(300)] + [("c1", "hot", 14, 1000)]


def _links(spark):
    return spark.createDataFrame(LINKS, "category string, member string, member_ns int, ord int")


def _rows(df):
    return sorted((r["root"], r["member"], r["level"], tuple(r["path"])) for r in df.collect())


def test_stored_walk_matches(spark, tmpdir_path):
    roots = spark.createDataFrame([("root",), ("c1",), ("none",)], "root string")
    name = f"links_{uuid.uuid4().hex}"
    ST.store_links(_links(spark), name, f"{tmpdir_path}/links", buckets=8, slices=4)
    for depth in (0, 1, 3):
        assert _rows(ST.walk_stored(spark, roots, name, depth, slices=4)) == _rows(G.walk_category(roots, _links(spark), depth))
    held = {(r["category"], r["slice"]) for r in spark.table(name).collect()}
    assert {s for c, s in held if c == "hot"} == {0, 1, 2, 3}


def test_links_and_pages_do_not_move(spark, tmpdir_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        links, pages = f"links_{uuid.uuid4().hex}", f"pages_{uuid.uuid4().hex}"
        ST.store_links(_links(spark), links, f"{tmpdir_path}/links", buckets=8)
        ST.store_pages(spark.range(100).select(F.concat(F.lit("p"), "id").alias("title"), F.lit("x").alias("text")), pages, f"{tmpdir_path}/pages", buckets=8)
        roots = spark.createDataFrame([("root",)], "root string")
        plan = ST.walk_stored(spark, roots, links, 1)._jdf.queryExecution().executedPlan().toString()
        joins, exchanges, scans = (len(re.findall(p, plan)) for p in (r"SortMergeJoin|ShuffledHashJoin", r"Exchange hashpartitioning", r"Bucketed: true"))
        # Each level's join shuffles its frontier and nothing else (level 0 stands in the plan
        # twice: as pages, and as the frontier of level 1).
        assert joins == scans == exchanges == 3
        asked = spark.createDataFrame([("p3",), ("p5",)], "title string")
        plan = asked.join(spark.table(pages), "title")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
