"""Longest match in flat arrays, and the join for dictionaries that are too large to copy."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kanaforge.functions import matching as MT
from kanaforge.operators import bloom as BL
from kanaforge.operators import graph as G
from kanaforge.operators import lexicon as LX
from kanaforge.operators import pairing as PR


def plain(text, entries):
    out, p = [], 0
    longest = max(map(len, entries), default=0)
    while p < len(text):
        k = next((k for k in range(min(longest, len(text) - p), 0, -1) if text[p:p + k] in entries), 0)
        out.append(entries[text[p:p + k]] if k else text[p])
        p += max(k, 1)
    return "".join(out)


WORD = st.text("ab日é😀", min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(WORD, st.text("XY語", max_size=3), max_size=25), st.lists(st.none() | st.text("ab日é😀c", max_size=40), max_size=8))
def test_flat_dictionary(entries, texts):
    got = MT.FlatDictionary(list(entries), list(entries.values())).convert(texts)
    assert got == [None if t is None else plain(t, entries) for t in texts]


def test_equal_hashes_do_no_harm(monkeypatch):
    monkeypatch.setattr(MT.Windows, "hashes", lambda self, at, length: np.zeros(len(at), np.uint64) + np.uint64(7))
    entries = {"ab": "1"}
    assert MT.FlatDictionary(list(entries), list(entries.values())).convert(["abcab", "xxab"]) == ["1c1", "xx1"]


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(MT, "SLICE", 100)
    rng = random.Random(1)
    entries = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))): str(i) for i in range(40)}
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (0, 5, 99, 100, 101, 3000, 0, 7)]
    assert MT.FlatDictionary(list(entries), list(entries.values())).convert(texts) == [plain(t, entries) for t in texts]


def test_bloom_has_all_keys_and_few_others():
    keys = [f"key {i}" for i in range(5000)]
    words = np.zeros(5000 * 10 // 64, np.uint64)
    for bit in MT.Bloom.bits(MT.text_hashes(keys), len(words)).ravel().tolist():
        words[bit >> 6] |= np.uint64(1 << (bit & 63))
    bloom = MT.Bloom(words)
    assert bloom.has(MT.text_hashes(keys)).all()
    assert bloom.has(MT.text_hashes([f"other {i}" for i in range(5000)])).mean() < 0.05


def test_large_dictionary_by_join(spark, monkeypatch):
    """Copy and join give the same answers, whatever the bit set lets through."""
    rng = random.Random(2)
    entries = {"".join(rng.choice("abcd日") for _ in range(rng.randrange(1, 7))): rng.choice("XYZ") * rng.randrange(3) for _ in range(300)}
    texts = ["".join(rng.choice("abcd日e") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, "a" * 3000]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, text string").withColumn("key", F.lit("kept"))
    lexicon = spark.createDataFrame([*entries.items(), ("", "no"), (None, "no"), ("zz", None)], "key string, value string")
    want = {i: None if t is None else plain(t, entries) for i, t in enumerate(texts)}
    got = lambda **k: {r["line_id"]: r["converted"] for r in LX.longest_match(lines, lexicon, keep=("key",), **k).collect()}
    assert got() == want
    assert got(broadcast_max_bytes=0) == want
    monkeypatch.setattr(BL, "BLOOM_BYTES", 64)  # so full that it lets nearly all through
    assert got(broadcast_max_bytes=0) == want


def test_join_sees_few_substrings(spark):
    """The join reads about as many candidates as there are hits, not every substring."""
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.conv(F.col("id").cast("string"), 10, 36)).alias("key"), F.lit("v").alias("value"))
    bloom = BL.bloom_of(keys, "key", 20_000)
    hits = bloom.has(MT.text_hashes([f"q{i}" for i in range(20_000)]))
    assert hits.mean() < 0.05


def test_bit_set_reaches_the_driver_as_bytes(spark):
    """Without Arrow for toPandas, as a cluster may have it, a row object for every word of the set
    took ten times its size and more in the driver's Python."""
    import tracemalloc

    keys = spark.range(300_000).select(F.concat(F.lit("k"), F.conv(F.col("id").cast("string"), 10, 36)).alias("key"))
    conf, was = "spark.sql.execution.arrow.pyspark.enabled", spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set(conf, "false")
    tracemalloc.start()
    try:
        bloom = BL.bloom_of(keys, "key", 300_000)
        assert tracemalloc.get_traced_memory()[1] < 4 * bloom.words.nbytes + (2 << 20)
    finally:
        tracemalloc.stop()
        spark.conf.set(conf, was)
    assert bloom.has(MT.text_hashes([r["key"] for r in keys.limit(1000).collect()])).all()


def test_copied_dictionary_reaches_the_driver_as_arrays(spark):
    """Of a dictionary that every task gets, the driver holds its strings once and no row objects."""
    import tracemalloc

    lexicon = spark.range(100_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.concat(F.lit("v"), F.col("id")).alias("value"))
    lines = spark.createDataFrame([(1, "k7 k99999 k")], "line_id long, text string")
    conf, was = "spark.sql.execution.arrow.pyspark.enabled", spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set(conf, "false")
    tracemalloc.start()
    try:
        out = LX.longest_match(lines, lexicon)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(conf, was)
    assert out.first()["converted"] == "v7 v99999 k"
    assert peak < 500 * 100_000


def test_bit_set_over_all_that_keys_begin_with(spark):
    words = ["", None, "a", "ab日", "ab日é😀", "zz"] * 3 + ["long " * 300]
    bloom = BL.bloom_of(spark.createDataFrame([(w,) for w in words], "key string"), "key", 2000, prefixes=True)
    begins = [w[:k] for w in words if w for k in range(1, len(w) + 1)]
    assert bloom.has(MT.text_hashes(begins)).all()
    assert bloom.has(MT.text_hashes([f"b{w}" for w in begins])).mean() < 0.1


def test_written_tables_leave_no_shuffle_files(spark):
    """The counts behind a dictionary go when it is written, not at the driver's next collection."""
    import time

    from kanaforge.session import write_once

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n.split("_")[1] for n in names if n.startswith("shuffle_")}

    before, conf = shuffles(), dict(spark.conf.getAll)
    words = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id") % 500).alias("key"), F.lit("v").alias("value"))
    written = write_once(LX.build_lexicon(words))
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert written.count() == 500 and dict(spark.conf.getAll) == conf


def test_lines_of_several_pieces_keep_their_columns(spark, monkeypatch):
    """Chunks that end within a batch, and batches that end within a chunk; runs that are keys, runs that are not."""
    entries = {"ab": "1", "abc": "2", "日": "", "cd": "😀"}
    texts = [None, "", "abc ab", "abcd日ab.cd", "xabx日", "c" * 40, "日日", "-", "ab" * 20] * 40
    lines = spark.createDataFrame([(i, t, None if i % 7 == 0 else [i, None], float(i)) for i, t in enumerate(texts)], "line_id long, text string, a array<long>, d double")
    lexicon = spark.createDataFrame(list(entries.items()), "key string, value string")
    monkeypatch.setattr(LX, "CHUNK", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["line_id"]: (r["converted"], r["a"], r["d"]) for r in LX.longest_match(lines, lexicon, broadcast_max_bytes=0, keep=("a", "d")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (None if t is None else plain(t, entries), None if i % 7 == 0 else [i, None], float(i)) for i, t in enumerate(texts)}


# --- rows that were asked for ------------------------------------------------------------

def test_asked_rows_copy_and_bit_set_agree(spark, monkeypatch):
    pages = spark.range(5000).select(F.when(F.col("id") % 100 > 0, F.concat(F.lit("t"), F.col("id") % 4000)).alias("title"), F.lit("x").alias("text"), "id")
    asked = spark.range(0, 9000, 7).select(F.concat(F.lit("t"), "id").alias("title")).union(spark.createDataFrame([(None,), ("t7",)], "title string"))
    names = {f"t{i}" for i in range(0, 9000, 7)}
    want = sorted(i for i in range(5000) if i % 100 and f"t{i % 4000}" in names)
    ids = lambda **k: sorted(r["id"] for r in BL.asked_rows(pages, asked, "title", **k).collect())
    assert ids() == ids(broadcast_max_bytes=0) == want
    monkeypatch.setattr(BL, "BLOOM_BYTES", 64)
    assert ids(broadcast_max_bytes=0) == want
    assert BL.asked_rows(pages, asked.limit(0), "title", broadcast_max_bytes=-1).count() == 0


def test_unasked_texts_do_not_move(spark):
    """Beyond the copy's bound, the exchange of page texts reads what passed the bit set."""
    pages = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("title"), F.repeat(F.lit("text. "), 3).alias("text"))
    asked = spark.range(100).select(F.concat(F.lit("t"), F.col("id") * 3).alias("title"))
    out = BL.asked_rows(pages, asked, "title", broadcast_max_bytes=0)
    assert out.count() == 100
    passed = out._jdf.queryExecution().optimizedPlan().toString()
    assert "may_be_asked" in passed and passed.index("Join LeftSemi") < passed.index("may_be_asked")  # below the join


def test_lookups_and_articles_beyond_the_copy(spark):
    pages = spark.createDataFrame([(f"p{i}", (None, "", " \t", "一。二。")[i % 4]) for i in range(40)], "title string, text string")
    titles = spark.createDataFrame([("p3",), ("p0",), ("p1",), ("p2",), ("none",), ("p3",), (None,)], "title string")
    want = sorted([("p3", "found"), ("p0", "empty"), ("p1", "empty"), ("p2", "empty"), ("none", "missing"), ("p3", "found"), ("", "missing")])
    got = lambda df: sorted((r["title"] or "", r["status"]) for r in df.collect())
    assert got(PR.title_status(titles, pages)) == got(PR.lookup_titles(titles, pages)) == got(PR.lookup_titles(titles, pages, broadcast_max_bytes=0)) == want
    walked = titles.where("title IS NOT NULL").withColumnRenamed("title", "member")
    rows = lambda **k: sorted(r["article"] for r in G.assemble_articles(walked, pages, **k).collect())
    assert rows() == rows(broadcast_max_bytes=0) and len(rows()) == 2


def test_large_dictionary_moves_distinct_words_of_chunks(spark, monkeypatch):
    """Lines in several chunks, keys with spaces and regex characters; no row for every hit."""
    rng = random.Random(7)
    entries = {"".join(rng.choice("ab c]^-\\日") for _ in range(rng.randrange(1, 6))): rng.choice("XYZ") * rng.randrange(3) for _ in range(200)}
    texts = ["".join(rng.choice("ab c]^-\\日.!") for _ in range(rng.randrange(80))) for _ in range(300)] + ["", None, "." * 50]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")
    lexicon = spark.createDataFrame(list(entries.items()), "key string, value string")
    monkeypatch.setattr(LX, "CHUNK", 500)
    out = LX.longest_match(lines, lexicon, broadcast_max_bytes=0)
    assert {r["line_id"]: r["converted"] for r in out.collect()} == {i: None if t is None else plain(t, entries) for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_dictionaries_that_are_copied_stay_small():
    assert LX.BROADCAST_MAX_BYTES <= 32 << 20  # 4 workers of an executor, each with its own copy
