import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kanaforge.llm import simhash as S
from kanaforge.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, k=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fps, bits):
    """Smallest member index of each one's component, by comparing all."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint_matches_definition():
    for t in [None, "", " \n", "one", "A b C", "a b c d e f a b c d", "É é ÀB\tx\x0by\x1cz w", "x " * 300]:
        assert S.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_golay_code_covers_with_radius_three():
    errors, first, counts = S.error_patterns(3)
    assert (counts == 1).all() and len(errors) == 2048


@pytest.mark.parametrize("bits", [0, 2, 4, 7])
def test_close_fingerprints_share_a_home_anchor(bits):
    rng = random.Random(bits)
    for _ in range(60):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), bits):
            y ^= 1 << b
        row, key, home = S.anchors(np.array([x, y], np.uint64), bits)
        homes = {(r, k) for r, k, h in zip(row, key, home) if h}
        copies = set(zip(row, key))
        assert any((1, k) in copies for r, k in homes if r == 0)


@pytest.mark.parametrize("part_homes", [2, 8192])
def test_links_equal_all_pairs(spark, part_homes):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for f in fps[:8]:
        g = f
        for _ in range(12):  # chains, and many homes under one anchor
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = S.fingerprint_links(df, 4, part_homes)
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected_components(edges).collect()}
    want = groups_of(fps, 4)
    mine = [root.get(f, f) for f in fps]
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, x) for x in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 131)}, **{x: 5 for x in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = S.simhash_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (1, None)}
    assert by_id[2]["component_id"] == 1 and by_id[3]["fp"] == 0
    assert {by_id[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert S.simhash_groups(no_docs).count() == 0
    kept = S.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, -9), (False, 1), (False, 1), (False, 3), (False, 6), (False, 7), (True, 0)]
    assert S.near_dedup(no_docs).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_brute_force(spark):
    from kanaforge.llm.queries import op1_simhash_near_dedup

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    fps = [slow_fingerprint(docs[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[g]) for i, f, g in zip(ids, fps, groups_of(fps, 4))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash_near_dedup(spark, SF).collect()} == want
