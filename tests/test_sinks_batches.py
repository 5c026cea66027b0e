"""One-pass sinks (counts while writing, aligned exports, distinct folders), length batches
and the bitmap vocabulary."""

import glob
import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kanaforge.operators import filters
from kanaforge.operators import model_io as MI
from kanaforge.operators import vocab as VC
from kanaforge.sources import datasets as DS


def _parts(folder):
    return [open(p, encoding="utf-8").read().splitlines() for p in sorted(glob.glob(f"{folder}/part-*"))]


# --- counts while writing ----------------------------------------------------------------

PAIRS = [(i, "アイ" if i % 3 else "x", "愛", ("ja", "en", None)[i % 5 % 3]) for i in range(100)]


def test_clean_pairs_are_written_and_counted_in_one_pass(spark, tmpdir_path):
    scans = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    df = spark.createDataFrame(PAIRS, "id long, source string, target string, lang string")
    df = df.mapInArrow(watched, df.schema)
    flagged = filters.clean_pairs(df, keep_flag="ok")
    got = DS.write_clean_pairs(flagged, f"{tmpdir_path}/clean", by="lang", values=["ja", "none such"])
    assert scans.value == 100
    valid = [r for r in PAIRS if r[1] == "アイ"]
    count = lambda rows, lang: sum((r[3] == "ja") == lang for r in rows)
    want = {("ja", count(valid, True), count(PAIRS, True) - count(valid, True), count(PAIRS, True)),
            (None, count(valid, False), count(PAIRS, False) - count(valid, False), count(PAIRS, False))}
    assert {tuple(r) for r in got.collect()} == want
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmpdir_path}/clean").collect()) == [r[0] for r in valid]
    total = DS.write_clean_pairs(flagged, f"{tmpdir_path}/all")
    assert total.columns == ["valid", "filtered", "total"] and tuple(total.first()) == (len(valid), 100 - len(valid), 100)
    none = DS.write_clean_pairs(flagged.limit(0), f"{tmpdir_path}/none")
    assert tuple(none.first()) == (0, 0, 0)


def test_splits_are_written_and_counted_in_one_pass(spark, tmpdir_path):
    ds = spark.range(97).select(F.col("id").cast("string").alias("pair_key"), F.when(F.col("id") % 4 > 0, "train").otherwise("test").alias("split"))
    got = {r["split"]: tuple(r)[1:] for r in DS.write_splits_counted(ds, f"{tmpdir_path}/ds").collect()}
    assert got == {"train": (72, 97, round(7200 / 97, 6)), "test": (25, 97, round(2500 / 97, 6))}
    assert DS.read_splits(spark, f"{tmpdir_path}/ds", "test").count() == 25
    assert DS.write_splits_counted(ds.limit(0), f"{tmpdir_path}/no").count() == 0


# --- aligned export ----------------------------------------------------------------------

def test_parts_of_an_export_line_up(spark, tmpdir_path):
    rng = random.Random(1)
    rows = [(f"{rng.randrange(10**6):07d}", "train" if i % 10 else "test") for i in range(3000)]
    ds = spark.createDataFrame(rows, "pair_key string, split string").repartition(11).select(
        "pair_key", "split", F.struct(F.concat(F.lit("s"), "pair_key").alias("source"), F.concat(F.lit("t"), "pair_key").alias("target")).alias("translation"))
    a, b = f"{tmpdir_path}/a", f"{tmpdir_path}/b"
    DS.export_split(ds, "train", a, b, partitions=7)
    left, right = _parts(a), _parts(b)
    assert len(left) == len(right) > 3
    assert [[x[1:] for x in p] for p in left] == [[x[1:] for x in p] for p in right]
    assert [x for p in left for x in p] == sorted("s" + k for k, s in rows if s == "train")


# --- distinct folders --------------------------------------------------------------------

def test_names_with_one_slug_stay_apart(spark, tmpdir_path):
    names = ["Arts", "Arts!", "arts", "物理 学", "物理_学", "!!", "", None, "a/b"]
    df = spark.createDataFrame([(n, f"{n}-{i}") for n in names for i in range(3)], "domain string, article string")
    slugs = {r["name"]: r["slug"] for r in DS.distinct_slugs(df, "domain").collect()}
    assert len(slugs) == len({s.lower() for s in slugs.values()}) == len(names)
    assert slugs["Arts"] == "Arts" and slugs["物理 学"] == "物理_学" and slugs["a/b"] == "ab"
    assert slugs["Arts!"] == "Arts-" + hashlib.md5(b"Arts!").hexdigest()[:12]
    DS.write_corpus_by_domain(df, f"{tmpdir_path}/c", "domain", names=df.select("domain").distinct())
    for n, s in slugs.items():
        assert sorted(x for p in _parts(f"{tmpdir_path}/c/slug={s}") for x in p) == [f"{n}-{i}" for i in range(3)]


def test_files_of_a_folder_follow_its_bytes(spark, tmpdir_path):
    df = spark.range(20_000, numPartitions=64).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("domain"), F.sha2(F.col("id").cast("string"), 512).alias("article"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        DS.write_corpus_by_domain(df, f"{tmpdir_path}/c", "domain", names=df.select("domain").distinct())
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {os.path.basename(d): len(_parts(d)) for d in glob.glob(f"{tmpdir_path}/c/slug=*")}
    # A small folder may share the partitions that the large one was split into.
    assert 2 < files["slug=hot"] < 32 and sorted(files.values())[:6] == [1] * 6


def test_corpus_files_can_be_compressed(spark, tmpdir_path):
    """pages that several categories reach are written once for each of them."""
    rng = random.Random(11)
    bodies = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(300)]
    rows = [("A" if i % 3 else "B", f"# {i} (Category: {c})\n{body}\n\n") for i, body in enumerate(bodies) for c in "vwxyz"]
    df = spark.createDataFrame(rows, "domain string, article string")
    want = Counter((d, line) for d, x in rows for line in x.split("\n") if line)
    for codec, end in (("none", ".txt"), ("gzip", ".txt.gz")):
        path = f"{tmpdir_path}/{codec}"
        DS.write_corpus_by_domain(df, path, "domain", compression=codec)
        assert all(f.endswith(end) for f in glob.glob(f"{path}/slug=*/part-*"))
        assert Counter((r["slug"], r["value"]) for r in spark.read.text(path).filter("value <> ''").collect()) == want
    size = lambda codec: sum(os.path.getsize(f) for f in glob.glob(f"{tmpdir_path}/{codec}/slug=*/part-*"))
    assert 5 * size("gzip") < size("none")


def test_names_without_articles_take_no_folder(spark, tmpdir_path):
    """the table of names may hold more than the articles do."""
    df = spark.createDataFrame([("a_b", "x"), ("c", "y")], "domain string, article string")
    names = spark.createDataFrame([("a b",), ("a_b",), ("c",), ("d",), (None,)], "domain string")
    DS.write_corpus_by_domain(df, f"{tmpdir_path}/c", "domain", names=names)
    assert {os.path.basename(d): [x for p in _parts(d) for x in p] for d in glob.glob(f"{tmpdir_path}/c/slug=*")} == {"slug=a_b": ["x"], "slug=c": ["y"]}


def test_corpus_query_exports_less_than_it_renders(spark, tmpdir_path):
    """the folders held every page five times over, as plain text."""
    from kanaforge.plans import catalog
    from kanaforge.session import ensure_checkpoint_dir

    rng = random.Random(5)
    texts = {k: " ".join("".join(rng.choices("abcdefghij", k=8)) + "." for _ in range(60)) for k in range(120)}
    tables = {
        "region": ([(0, "EAST"), (1, "FAR WEST")], "r_regionkey long, r_name string"),
        "nation": ([(i, f"N{i}", i // 5) for i in range(10)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(1, 0)], "s_suppkey long, s_nationkey long"),
        "customer": ([(k, k % 10) for k in range(150)], "c_custkey long, c_nationkey long"),
        "documents": (list(texts.items()), "doc_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmpdir_path}/{name}.parquet")
    want = Counter()
    for k, text in texts.items():
        east = k % 10 < 5
        for n in range(0, 5) if east else range(5, 10):
            for line in [f"# doc-{k} (Category: N{n})", *text.split(" ")]:
                want["EAST" if east else "FAR_WEST", line] += 1
    folders = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/corpus-*"
    before = set(glob.glob(folders))
    got = catalog.q_corpus_roundtrip(spark, tmpdir_path)
    assert {(r["slug"], r["line"]): r["n"] for r in got.collect()} == want
    (made,) = set(glob.glob(folders)) - before
    written = sum(os.path.getsize(f) for f in glob.glob(f"{made}/slug=*/part-*"))
    assert 5 * written < sum(n * len(line) for (_, line), n in want.items())


# --- length batches ----------------------------------------------------------------------

def batches_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["mega_batch"], r["batch"]].append(r)
    return out


@pytest.mark.parametrize("budget", [None, 100])
def test_length_batches(spark, budget):
    rng = random.Random(3)
    texts = ["w" * rng.choice((0, 1, 5, 30, 31, 90, 250)) for _ in range(500)] + [None] * 5
    df = spark.createDataFrame([(i if i % 50 else None, t, "x") for i, t in enumerate(texts)], "id long, text string, Batch string")
    got = MI.length_batches(df, ["id"], batch_rows=4, mega_batches=10, max_tokens=budget)
    assert got.columns == ["id", "text", "mega_batch", "batch", "batch_len"]
    by = batches_of(got)
    assert Counter(r["text"] for rows in by.values() for r in rows) == Counter(texts)
    length = lambda r: len(r["text"] or "")
    assert {m for m, _ in by} <= set(range(13))
    for (m, b), rows in by.items():
        longest = max(map(length, rows))
        assert {r["batch_len"] for r in rows} == {longest}
        if budget is None:
            assert len(rows) == 4 or (m, b + 1) not in by and len(rows) < 4
        else:
            assert len(rows) * longest <= budget or len(rows) == 1
        if (m, b + 1) in by:
            following = by[m, b + 1]
            assert min(map(length, rows)) >= max(map(length, following))
            assert budget is None or (len(rows) + 1) * longest > budget  # the next row did not fit
    report = MI.padding_report(got).first()
    padded = sum(len(rows) * max(map(length, rows)) for rows in by.values())
    assert (report["batches"], report["n_rows"], report["tokens"], report["padded"]) == (len(by), 505, sum(len(t or "") for t in texts), padded)
    assert report["padding_share"] == round(1 - report["tokens"] / padded, 6)


def test_batches_pad_less_than_random_order(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, "w" * int(rng.expovariate(0.01))) for i in range(2000)], "id long, text string")
    share = lambda megas: MI.padding_report(MI.length_batches(df, ["id"], mega_batches=megas)).first()["padding_share"]
    assert share(50) < 0.1 < 0.4 < share(1)
    empty = MI.length_batches(df.limit(0), ["id"])
    assert empty.count() == 0 and tuple(MI.padding_report(empty).first())[:4] == (0, 0, 0, 0)


# --- vocabulary --------------------------------------------------------------------------

def test_vocabulary_over_all_planes(spark):
    codes = [0, 1, 2, 0x41, 0xE9, 32767, 32768, 32769, 65535, 65536, 65537, 0x1F600, 0x10FFFF]
    rng = random.Random(5)
    rows = [("".join(chr(rng.choice(codes)) for _ in range(9)),) for _ in range(200)] + [(None,), ("",)]
    got = {r["ch"]: r["idx"] for r in VC.build_vocab(spark.createDataFrame(rows, "text string"), strip=False).collect()}
    assert got == {c: i for i, c in enumerate(sorted({c for t, in rows for c in t or ""}))}
    assert VC.build_vocab(spark.createDataFrame([], "text string")).count() == 0


def test_vocabulary_reads_its_input_once(spark, tmpdir_path):
    spark.range(10).select(F.col("id").cast("string").alias("text")).write.parquet(f"{tmpdir_path}/t")
    plan = VC.build_vocab(spark.read.parquet(f"{tmpdir_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2  # bitmaps; at most 35 merged ones


# --- encoding and decoding ---------------------------------------------------------------

def test_encode_and_decode_any_text(spark):
    rng = random.Random(6)
    alphabet = "ab é日😀\x00\n"
    texts = ["".join(rng.choice(alphabet + "?Z") for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "", alphabet]
    vocab = VC.build_vocab(spark.createDataFrame([(alphabet,)], "text string"), strip=False)
    index = {c: i for i, c in enumerate(sorted(alphabet))}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for cut in (None, 0, 4):
        enc = MI.encode_chars(df, "text", vocab, max_length=cut)
        got = {r["id"]: r["input_ids"] for r in enc.collect()}
        assert got == {i: [index.get(c, -1) for c in (t or "")[:cut]] for i, t in enumerate(texts)}
        back = {r["id"]: r["back"] for r in MI.decode_ids(enc, "input_ids", vocab, out="back").collect()}
        assert back == {i: "".join(c for c in (t or "")[:cut] if c in index) for i, t in enumerate(texts)}
    ids = spark.createDataFrame([(1, [0, None, -100, 99, 2]), (2, None), (3, [])], "id long, ids array<int>")
    assert {r["id"]: r["text"] for r in MI.decode_ids(ids, "ids", vocab).collect()} == {1: "".join(sorted(alphabet)[i] for i in (0, 2)), 2: "", 3: ""}
    none = VC.build_vocab(spark.createDataFrame([], "text string"))
    assert {tuple(r["input_ids"]) for r in MI.encode_chars(df.where("id = 202"), "text", none).collect()} == {(-1,) * len(alphabet)}


def test_examples_go_through_python_once(spark):
    vocab = VC.build_vocab(spark.createDataFrame([("ab",)], "text string"))
    plan = MI.prepare_examples(spark.createDataFrame([("a", "b")], "source string, target string"), vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_encode_and_decode_hold_little_beside_the_batch(monkeypatch):
    """The arrays of a batch are made for a run of its rows at a time."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(MI, "_vocab_arrays", lambda vocab: (np.arange(97, 123, dtype=np.uint32), np.arange(26, dtype=np.int32)))
    kept = []
    monkeypatch.setattr(MI.F, "arrow_udf", lambda kind: lambda fn: kept.append(fn) or (lambda c: MI.F.lit(None)))
    MI._encoder(None, None, -1)

    class Frame:
        def withColumn(self, *_):
            return self

    monkeypatch.setattr(MI.F, "col", lambda c: c)
    monkeypatch.setattr(MI.F, "lit", lambda c: c)
    MI.decode_ids(Frame(), "ids", None)
    texts = pa.array(["abcxyz" * 300] * 5000 + [None, ""])
    tracemalloc.start()
    back = kept[1](kept[0](texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back.equals(pa.array(["abcxyz" * 300] * 5000 + ["", ""])) and peak < 100 << 20
