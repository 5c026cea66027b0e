"""Invariance under partitioning and properties (SURVEY §5 (c), (d))."""

import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kanaforge.operators import graph as G
from kanaforge.operators import index as IX
from kanaforge.operators import metrics as M
from kanaforge.operators import model_io as MI
from kanaforge.operators import vocab as VC
from kanaforge.sources import lines as LN


def test_read_lines_invariant_to_split_size(spark, tmpdir_path):
    rnd = random.Random(5)
    lines = ["".join(rnd.choice("あいうabc \t") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    p = os.path.join(tmpdir_path, "inv.txt")
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(lines))
    results = []
    for size in ("128m", "64k", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            results.append([(r["line_no"], r["text"]) for r in LN.read_lines(spark, p).orderBy("line_no").collect()])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1] == results[2]
    assert [t for _n, t in results[0]] == lines


def test_walk_invariant_to_partitions(spark):
    rnd = random.Random(11)
    links = []
    for c in range(30):
        for o in range(rnd.randint(1, 6)):
            if rnd.random() < 0.3:
                links.append((f"c{c}", f"c{rnd.randint(0, 29)}", 14, o))
            else:
                links.append((f"c{c}", f"p{rnd.randint(0, 50)}", 0, o))
    base = spark.createDataFrame(links, "category string, member string, member_ns int, ord int")
    roots = spark.createDataFrame([(f"c{i}",) for i in range(30)], "root string")
    outs = []
    for parts in (1, 4, 16):
        w = G.cap_per_root(G.walk_category(roots.repartition(parts), base.repartition(parts), 2), 7)
        outs.append(sorted((r["root"], r["rank"], r["member"]) for r in w.collect()))
    assert outs[0] == outs[1] == outs[2]


def test_splits_disjoint_and_covering(spark):
    df = spark.createDataFrame([(f"key{i}",) for i in range(997)], "key string")
    for fn in (IX.split_exact, IX.split_hash):
        s = fn(df, "key")
        rows = s.collect()
        assert len(rows) == 997 and len({r["key"] for r in rows}) == 997
        assert {r["split"] for r in rows} <= {"train", "test", "validation"}


texts = st.text(alphabet="あいう漢字カナab ", max_size=15)


@settings(max_examples=20, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_exact_match_means_zero_cer(spark, refs):
    df = spark.createDataFrame([(r, r) for r in refs], "reference string, prediction string")
    for ref, row in zip(refs, M.row_metrics(df).collect()):
        assert row["sentence_accuracy"] == 100.0
        if "".join(ref.split()):
            assert row["cer"] == 0.0
        else:
            assert row["cer"] == 100.0


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_encode_decode_identity(spark, items):
    df = spark.createDataFrame(list(enumerate(items)), "id long, text string")
    vocab = VC.build_vocab(df, strip=False)
    enc = MI.encode_chars(df, "text", vocab)
    dec = {r["id"]: r["text"] for r in MI.decode_ids(enc, "input_ids", vocab).collect()}
    assert dec == {i: t for i, t in enumerate(items)}


@settings(max_examples=12, deadline=None)
@given(st.integers(min_value=1, max_value=300), st.sampled_from([(0.8, 0.1, 0.1), (0.7, 0.2, 0.1), (0.6, 0.0, 0.4),
                                                                 (0.9, 0.05, 0.05), (0.5, 0.25, 0.25)]))
def test_split_sizes_follow_the_floor_rules(spark, n, ratios):
    import math

    train, test, validation = ratios
    df = spark.createDataFrame([(f"k{i}",) for i in range(n)], "key string")
    got = {r["split"]: r["count"] for r in IX.split_exact(df, "key", *ratios).groupBy("split").count().collect()}
    n_train = math.floor(n * train)
    want = {"train": n_train}
    if test > 0:
        n_test = math.floor((n - n_train) * (test / (test + validation)))
        want.update(test=n_test, validation=n - n_train - n_test)
    else:
        want.update(validation=n - n_train)
    assert got == {k: v for k, v in want.items() if v > 0}
