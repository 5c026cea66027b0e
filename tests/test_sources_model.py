"""SRC-1..4, SNK-1..5, MDL-1..5, streaming scoring."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from kanaforge.operators import metrics as M
from kanaforge.operators import model_io as MI
from kanaforge.operators import vocab as VC
from kanaforge.plans.catalog import make_upper_predictor
from kanaforge.sources import datasets as DS
from kanaforge.sources import lines as LN
from kanaforge.sources.tagged import read_tagged_docs
from kanaforge.streaming.scoring import running_macro_metrics, score_stream


def _write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_read_lines_modes(spark, tmpdir_path):
    lines = [f" 行{i} " if i % 7 else "" for i in range(3000)]
    text = "\n".join(lines) + "\n"
    p = os.path.join(tmpdir_path, "a.kanji")
    _write(p, text)
    # Small blocks force several splits of the one file.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = LN.read_lines(spark, p, "raw").orderBy("line_no").collect()
        nonblank = LN.read_lines(spark, p, "nonblank").orderBy("line_no").collect()
        stripped = LN.read_lines(spark, p, "strip").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in raw] == lines and [r["line_no"] for r in raw] == list(range(3000))
    assert [r["text"] for r in nonblank] == [s.strip() for s in lines if s.strip()]
    assert [r["line_no"] for r in nonblank] == list(range(len(nonblank)))
    assert [r["text"] for r in stripped] == [s.strip() for s in lines]


def test_read_lines_splitlines_and_missing(spark, tmpdir_path):
    text = "a\x0bb\r\nc d\re\x85f"
    p = os.path.join(tmpdir_path, "b.txt")
    _write(p, text)
    got = [r["text"] for r in LN.read_lines(spark, p, "splitlines").orderBy("line_no").collect()]
    assert got == text.splitlines()
    with pytest.raises(FileNotFoundError):
        LN.read_lines(spark, os.path.join(tmpdir_path, "missing.kana"))


def test_write_lines_order_and_single_file(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "k long, text string").repartition(7)
    out = os.path.join(tmpdir_path, "out")
    LN.write_lines(df, out, "k", partitions=4)
    got = []
    for part in sorted(glob.glob(os.path.join(out, "part-*"))):
        got += open(part, encoding="utf-8").read().splitlines()
    assert got == [f"t{i}" for i in range(500)]
    single = os.path.join(tmpdir_path, "one.txt")
    assert LN.export_lines_single_file(df, single, "k") == 500
    content = open(single, encoding="utf-8").read()
    assert not content.endswith("\n") and content.split("\n") == [f"t{i}" for i in range(500)]


def test_read_tagged_docs(spark, tmpdir_path):
    closed = os.path.join(tmpdir_path, "closed.xml")
    _write(closed, '<doc id="1">本文\n二行目</doc>\n<doc id="2"></doc>\n<doc id="3">三</doc>')
    unclosed = os.path.join(tmpdir_path, "unclosed.xml")
    _write(unclosed, '<doc id="1">一</doc>\n<doc id="2">未完')
    c = [r["body"] for r in read_tagged_docs(spark, closed).orderBy("block_no").collect()]
    assert c == ["本文\n二行目", "三"]
    u = [r["body"] for r in read_tagged_docs(spark, unclosed).orderBy("block_no").collect()]
    assert u == ["一"]


def test_splits_roundtrip_and_pruning(spark, tmpdir_path):
    ds = spark.createDataFrame([(f"k{i}", ("ア", "亜"), ["train", "test", "validation"][i % 3]) for i in range(30)],
                               "pair_key string, translation struct<source:string,target:string>, split string")
    out = os.path.join(tmpdir_path, "ds")
    DS.write_splits(ds, out)
    test = DS.read_splits(spark, out, "test")
    assert test.count() == 10
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "test" in plan
    src, tgt = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "tgt")
    DS.export_split(DS.read_splits(spark, out), "validation", src, tgt)
    read = lambda d: sum((open(p, encoding="utf-8").read().splitlines() for p in sorted(glob.glob(d + "/part-*"))), [])
    assert read(src) == ["ア"] * 10 and read(tgt) == ["亜"] * 10


def test_transcriptions_registry(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "tr")
    spark.createDataFrame([("train", "あ"), ("test", "い")], "split string, transcription string").write.parquet(p)
    reg = {"corpus": {"path": p, "column": "transcription", "split": "test"}}
    assert [r[0] for r in DS.read_transcriptions(spark, "corpus", reg).collect()] == ["い"]
    with pytest.raises(DS.UnknownDataset, match="corpus"):
        DS.read_transcriptions(spark, "nope", reg)


def test_vocab_json_and_corpus_sink(spark, tmpdir_path):
    v = VC.build_vocab(spark.createDataFrame([("あa",)], "text string"))
    out = os.path.join(tmpdir_path, "vocab")
    DS.write_vocab(v, out)
    (part,) = glob.glob(os.path.join(out, "part-*"))
    assert json.loads(open(part, encoding="utf-8").read()) == {"a": 0, "あ": 1}
    assert "あ" in open(part, encoding="utf-8").read()
    arts = spark.createDataFrame([("物理 学!", "# x\n"), ("Arts", "# y\n")], "domain string, article string")
    DS.write_corpus_by_domain(arts, os.path.join(tmpdir_path, "corpus"), "domain")
    assert sorted(os.path.basename(d) for d in glob.glob(os.path.join(tmpdir_path, "corpus", "slug=*"))) == \
        ["slug=Arts", "slug=物理_学"]


def test_encode_decode_prepare(spark):
    df = spark.createDataFrame([(1, "アイ", "愛"), (2, "", "")], "id long, source string, target string")
    vocab = VC.build_vocab(df.select(F.concat("source", "target").alias("text")))
    enc = MI.encode_chars(df, "source", vocab)
    dec = {r["id"]: r["text"] for r in MI.decode_ids(enc, "input_ids", vocab).collect()}
    assert dec == {1: "アイ", 2: ""}
    padded = spark.createDataFrame([(1, [0, -100, 5, 99, 1])], "id long, ids array<int>")
    assert MI.decode_ids(padded, "ids", vocab).first()["text"] == "アイ"
    assert MI.decode_ids(padded, "ids", vocab, pad_id=0).first()["text"] == "イ"
    assert MI.decode_ids(padded, "ids", vocab, skip_ids=[0, 1]).first()["text"] == ""
    empty = vocab.limit(0)
    assert MI.encode_chars(df, "source", empty).filter("id = 1").first()["input_ids"] == [-1, -1]
    assert MI.decode_ids(padded, "ids", empty).first()["text"] == ""
    plan = MI.prepare_examples(df, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no example crosses a shuffle
    ex = {r["id"]: r for r in MI.prepare_examples(df, vocab, max_length=8).collect()}
    assert len(ex[1]["input_ids"]) == 8 and ex[1]["attention_mask"] == [1] * 8
    assert ex[2]["labels"] == [] and ex[1]["labels"] == [2]
    b = {r["bucket"]: r["n"] for r in MI.length_buckets(
        spark.createDataFrame([("a" * n,) for n in (1, 63, 64, 200)], "text string"), width=64).collect()}
    assert b == {0: 2, 1: 1, 3: 1}


def test_batch_score_stub(spark):
    df = spark.createDataFrame([(i, f"abc{i}é") for i in range(200)], "id long, text string")
    out = MI.batch_score(df, "text", make_upper_predictor, batch_size=16).collect()
    assert all(r["prediction"] == r["text"].replace("abc", "ABC") for r in out)


def test_streaming_scoring(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "stream_in")
    pairs = [("m", "交通", "交通"), ("m", "あい", "あう"), ("n", "漢字", "感じ")]
    spark.createDataFrame(pairs, "model string, reference string, prediction string").write.parquet(src)
    stream = spark.readStream.schema("model string, reference string, prediction string").parquet(src)
    q1 = score_stream(stream).writeStream.format("memory").queryName("scored_rows").outputMode("append").start()
    q2 = running_macro_metrics(stream, by=["model"]).writeStream.format("memory").queryName("scored_avg") \
        .outputMode("complete").start()
    try:
        q1.processAllAvailable()
        q2.processAllAvailable()
        rows = spark.sql("SELECT * FROM scored_rows").count()
        avg = {r["model"]: r["cer"] for r in spark.sql("SELECT * FROM scored_avg").collect()}
    finally:
        q1.stop()
        q2.stop()
    batch = spark.createDataFrame(pairs, "model string, reference string, prediction string")
    want = {r["model"]: r["cer"] for r in M.macro_metrics(M.row_metrics(batch), by=["model"]).collect()}
    assert rows == 3 and avg == want


def test_length_band_layout_spreads_a_hot_band(spark):
    rows = [("x" * 10 + str(i),) for i in range(3000)] + [("y" * 200,)] * 10
    df = spark.createDataFrame(rows, "text string")
    laid = MI.with_length_bucket(df, width=64, partitions=8)
    per_part = laid.groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per_part) == 3010
    assert len([r for r in per_part if r["lo"] == 0]) > 1  # the hot band 0 spans several partitions


def test_map_batches_caller_function(spark):
    df = spark.createDataFrame([(i, f"ア{i}") for i in range(100)], "id long, source string")

    def add_prompt(pdf):
        return pdf.assign(prompt="translate kana to kanji: " + pdf["source"], n=len(pdf))

    out = MI.map_batches(df, add_prompt, "id long, source string, prompt string, n long", batch_rows=7).collect()
    assert len(out) == 100 and max(r["n"] for r in out) <= 7
    assert all(r["prompt"] == "translate kana to kanji: " + r["source"] for r in out)


DUMP = ('<doc id="1">first\nblock</doc>\njunk <doc></doc><doc id="2">x</doc><doc>open <doc>inner</doc>')


def test_read_tagged_docs_whatever_the_file(spark, tmpdir_path):
    """Compressed files, a byte order mark and what stands behind the last block make no
    difference; file and column form follow one rule."""
    import bz2
    import gzip

    from kanaforge.sources.tagged import tagged_docs_in_column

    want = ["first\nblock", "x", "open <doc>inner"]
    tails = {"": [], "\n": [], "\n<doc>never closed": [], "<doc id='9'>last</doc>": ["last"]}
    for n, (tail, more) in enumerate(tails.items()):
        data = (DUMP + tail).encode()
        files = {"a.xml": data, "bom.xml": b"\xef\xbb\xbf" + data, "c.xml.gz": gzip.compress(data), "d.xml.bz2": bz2.compress(data)}
        for name, body in files.items():
            p = os.path.join(tmpdir_path, f"{n}-{name}")
            with open(p, "wb") as f:
                f.write(body)
            got = [(r["block_no"], r["body"]) for r in read_tagged_docs(spark, p).orderBy("block_no").collect()]
            assert got == list(enumerate(want + more)), (name, tail)
        col = spark.createDataFrame([(DUMP + tail,)], "t string")
        assert [r["body"] for r in tagged_docs_in_column(col, "t").orderBy("block_no").collect()] == want + more


def test_unclosed_markup_takes_linear_time(spark):
    import time

    from kanaforge.sources.tagged import tagged_docs_in_column

    page = "<p x" * 5000 + "<p>short</q>" * 10000 + "</p>" + "<p>" * 5000
    df = spark.createDataFrame([(page,)], "html string")
    tagged_docs_in_column(df.limit(1), "html", "p").count()
    t = time.time()
    assert tagged_docs_in_column(df, "html", "p").count() == 1
    assert time.time() - t < 5


def test_read_lines_takes_globs(spark, tmpdir_path):
    for n in range(3):
        _write(os.path.join(tmpdir_path, f"g{n}.kana"), f"line {n}\n")
    got = LN.read_lines(spark, os.path.join(tmpdir_path, "g*.kana")).collect()
    assert sorted(r["text"] for r in got) == ["line 0", "line 1", "line 2"]


def test_transcriptions_csv_round_trip(spark, tmpdir_path):
    texts = ["plain", 'a "quoted", one', "two\nlines", "", " spaced ", "\\ back"]
    path = os.path.join(tmpdir_path, "t")
    DS.write_transcriptions(spark.createDataFrame([(t,) for t in texts], "transcription string"), path)
    assert sorted(r["transcription"] for r in DS.read_csv_transcriptions(spark, path).collect()) == sorted(texts)
    assert DS.default_domains(spark).count() == 54


def test_evaluate_end_to_end(spark):
    from kanaforge.operators import evaluation as EV

    refs = spark.createDataFrame([(0, "x", "AB"), (1, "x", "CD"), (2, "y", "EE")], "line_no long, g string, text string")
    src = spark.createDataFrame([(0, "ab"), (1, "cx"), (2, "ee")], "line_no long, text string")
    got = {r["g"]: (r["sentence_accuracy"], r["n"]) for r in EV.evaluate(refs, src, make_upper_predictor, by=["g"]).collect()}
    assert got == {"x": (50.0, 2), "y": (100.0, 1)}
    with pytest.raises(Exception, match="Lines differ"):
        EV.evaluate(refs, src.filter("line_no < 2"), make_upper_predictor).collect()
