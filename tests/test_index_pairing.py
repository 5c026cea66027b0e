"""IDX-1, SPL-1/2, SMP-1, AGG-5, VAL-1, JOI-1..3."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kanaforge.functions import constants as K
from kanaforge.operators import index as IX
from kanaforge.operators import pairing as PR
from kanaforge.operators import validate as VL


def keyed(spark, n, parts=4):
    return spark.createDataFrame([(f"k{i}", i) for i in range(n)], "key string, v long").repartition(parts)


@pytest.mark.parametrize("n, ratios, sizes", [
    (10, (0.8, 0.1, 0.1), {"train": 8, "test": 1, "validation": 1}),
    (103, (0.8, 0.1, 0.1), {"train": 82, "test": 10, "validation": 11}),
    (103, (0.8, 0.0, 0.2), {"train": 82, "validation": 21}),
])
def test_split_exact_sizes(spark, n, ratios, sizes):
    s = IX.split_exact(keyed(spark, n), "key", *ratios)
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == sizes


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.2), (0.5, 0.1, 0.1)])
def test_split_ratio_errors(spark, ratios):
    with pytest.raises(ValueError):
        IX.split_exact(keyed(spark, 10), "key", *ratios)


def test_split_ratio_tolerance_edges(spark):
    IX.check_ratios(0.8, 0.1, 0.0995)
    IX.check_ratios(0.8, 0.1, 0.1005)
    with pytest.raises(ValueError):
        IX.check_ratios(0.8, 0.1, 0.098)


def test_split_exact_membership_and_invariance(spark):
    n = 1000
    expected_order = sorted((hashlib.md5(f"42:k{i}".encode()).hexdigest(), f"k{i}") for i in range(n))
    want = {}
    for i, (_h, k) in enumerate(expected_order):
        want[k] = "train" if i < 800 else ("test" if i < 900 else "validation")
    for parts in (1, 4, 16):
        got = {r["key"]: r["split"] for r in IX.split_exact(keyed(spark, n, parts), "key").collect()}
        assert got == want


def test_global_index_both_paths_match_bruteforce(spark):
    rows = [(f"k{i % 37}", i) for i in range(500)]
    want = {v: i for i, (_k, v) in enumerate(sorted(rows))}
    for parts in (1, 4, 16):
        df = spark.createDataFrame(rows, "key string, v long").repartition(parts)
        lazy = IX.with_global_index(df, ["key", "v"], bucket=F.substring("key", 1, 2))
        ranged = IX.with_global_index(df, ["key", "v"], n_buckets=5)
        adaptive = IX.with_global_index(df, ["key", "v"])
        assert {r["v"]: r["idx"] for r in lazy.collect()} == want
        assert {r["v"]: r["idx"] for r in ranged.collect()} == want
        assert {r["v"]: r["idx"] for r in adaptive.collect()} == want


def test_split_hash_and_sample(spark):
    df = keyed(spark, 2000)
    s = IX.split_hash(df, "key")
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 2000 and abs(counts["train"] - 1600) < 100
    for r in s.limit(20).collect():
        u = int(hashlib.md5(f"42:{r['key']}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["split"] == ("train" if u < 0.8 else "test" if u < 0.9 else "validation")
    sample = IX.sample_rows(s, 3, "key").collect()
    assert sorted({r["split"] for r in sample}) == ["test", "train", "validation"] and len(sample) == 9
    stats = {r["split"]: (r["n"], r["total"]) for r in IX.split_stats(s).collect()}
    assert all(t == 2000 for _n, t in stats.values())


def _dataset(spark, splits, with_target=True):
    rows = []
    for name, n in splits.items():
        for i in range(n):
            rows.append((f"{name}{i}", ("ア", "亜") if with_target else ("ア",), name))
    t = "struct<source:string,target:string>" if with_target else "struct<source:string>"
    return spark.createDataFrame(rows, f"pair_key string, translation {t}, split string")


def test_validate_fixture(spark):
    assert VL.dataset_is_valid(_dataset(spark, {"train": 3, "validation": 1}))
    rep = {r["check"]: r for r in VL.validate_dataset(_dataset(spark, {"train": 3, "validation": 1})).collect()}
    assert rep["split:test"]["ok"] and "optional" in rep["split:test"]["detail"]
    assert not VL.dataset_is_valid(_dataset(spark, {"train": 3}))
    assert not VL.dataset_is_valid(_dataset(spark, {"train": 3, "validation": 1}, with_target=False))
    nulls = spark.createDataFrame([("a", ("ア", None), "train"), ("b", ("ア", "亜"), "validation")],
                                  "pair_key string, translation struct<source:string,target:string>, split string")
    assert not VL.dataset_is_valid(nulls)


def test_pair_by_position(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "line_no long, text string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(4)], "line_no long, text string")
    assert PR.pair_by_position(a, b).count() == 4
    with pytest.raises(Exception, match="the second side has no line line_no=4"):
        PR.pair_by_position(a, b, strict=True).collect()
    shifted = spark.createDataFrame([(i, "b") for i in (0, 1, 3)], "line_no long, text string")
    three = spark.createDataFrame([(i, "a") for i in (0, 1, 2)], "line_no long, text string")
    for cols in (["source"], ["target"], ["line_no"]):  # equal counts, other lines
        with pytest.raises(Exception, match="Lines differ"):
            PR.pair_by_position(three, shifted, strict=True).select(*cols).collect()
    with pytest.raises(Exception, match="Lines differ"):
        PR.join_predictions(three, shifted).select("prediction").collect()
    same = PR.pair_by_position(a, a, strict=True)
    assert sorted(r["source"] for r in same.collect()) == [f"a{i}" for i in range(5)]


def test_rank_in_group_handles_a_hot_group(spark):
    rows = [(1 if i % 3 else 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, t long").repartition(8)
    got = {(r["g"], r["t"]): r["rank"] for r in PR.rank_in_group(df, ["g"], ["t"]).collect()}
    want = {}
    for g in (1, 2):
        for k, t in enumerate(sorted(t for gg, t in rows if gg == g)):
            want[(g, t)] = k
    assert got == want


def test_lookup_titles_and_domains(spark):
    pages = spark.createDataFrame([("A", "text"), ("B", "  ")], "title string, text string")
    req = spark.createDataFrame([("A",), ("B",), ("C",)], "title string")
    st = {r["title"]: r["status"] for r in PR.lookup_titles(req, pages).collect()}
    assert st == {"A": "found", "B": "empty", "C": "missing"}
    assert [r["title"] for r in PR.found_titles(req, pages).collect()] and \
        [r["title"] for r in PR.missing_titles(req, pages).collect()] == ["C"]
    dom = spark.createDataFrame([(d, c, i) for d, cs in K.DOMAIN_MAP.items() for i, c in enumerate(cs)],
                                "domain string, category string, ord int")
    assert PR.domain_summary(dom).first().asDict() == {"n_categories": 54, "n_domains": 9}
    names = spark.createDataFrame([("physics",), ("量子化学",)], "name string")
    res = PR.resolve_domain(names, dom).orderBy("name", "ord").collect()
    phys = [r["category"] for r in res if r["name"] == "physics"]
    assert phys == K.DOMAIN_MAP["Physics"]
    other = [r for r in res if r["name"] == "量子化学"]
    assert len(other) == 1 and other[0]["category"] == "量子化学" and not other[0]["matched"]
