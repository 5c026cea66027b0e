import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kanaforge.llm import packing as P
from kanaforge.llm.tokens import WordTokenizer

from .conftest import ODD_ROWS

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_word_cache_equals_the_tokenizer(whole):
    t = WordTokenizer(PATH)
    assert t.by_word
    texts = [r[1] for r in ODD_ROWS if r[1]] + ["It's I'LL we've 'd 12³½ a_b-c", "ΣΑΣ Σ ǅ ß ẞ ŉ", "x\x85y a\x1cb", "Ünïcödé naïve", "a<|startoftext|>b <| x"]
    for text in texts:
        assert np.frombuffer(t.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    other = WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    assert np.frombuffer(other.ids(b"Hello  world\n"), "<u4").tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("Hello  world\n", add_special_tokens=False).ids


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fill = P.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fill == [10, 10] and bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


@pytest.mark.parametrize("lengths", [[], [0, 0], [10] * 7, [6] * 40, list(range(11)) * 20, [3, 3, 3, 7, 7, 1] * 30])
def test_pack_through_a_tree(spark, lengths):
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item_id long, length long").repartition(13, "item_id")
    rows = P.pack(items, capacity=10, slack=0, fan_in=2, carry=1000).join(items, "item_id").collect()
    assert len(rows) == len(lengths)
    n = check_bins(rows, 10)
    best = P.best_fit(np.array(lengths, np.int64), 10)[2] if lengths else []
    assert n <= 1.1 * len(best) + 1


def test_every_underfull_bin_climbs(spark):
    # One item a partition: nothing fits before the first merge.
    items = spark.range(256).select(F.col("id").alias("item_id"), (30 + F.col("id") % 41).alias("length")).repartitionByRange(256, "item_id")
    bins = {}
    for carry in (50_000, 64, 16):
        rows = P.pack(items, capacity=100, slack=0, fan_in=16, carry=carry).join(items, "item_id").collect()
        assert len(rows) == 256
        bins[carry] = check_bins(rows, 100)
    assert bins[16] <= 1.1 * bins[50_000] and bins[64] <= 1.05 * bins[50_000]


def test_pack_bounded_carry_keeps_all(spark):
    items = spark.range(300).select(F.col("id").alias("item_id"), (F.col("id") % 9 + 1).alias("length")).repartition(16, "item_id")
    rows = P.pack(items, capacity=10, fan_in=2, carry=1).join(items, "item_id").collect()
    assert len(rows) == 300
    check_bins(rows, 10)
    with pytest.raises(Exception, match="between 0 and 10"):
        P.pack(spark.createDataFrame([(1, 11)], "item_id long, length long"), capacity=10)


def test_documents_round_trip(odd_docs, no_docs, whole):
    rows = P.pack_documents(odd_docs.select("doc_id", "text"), PATH, capacity=4096).collect()
    check_bins(rows, 4096)
    texts = sorted(np.frombuffer(b"".join(p for _, p in sorted(v)), "<u4").tolist() for v in _by_document(rows))
    want = sorted([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ODD_ROWS)
    assert texts == want
    assert P.pack_documents(no_docs.select("doc_id", "text"), PATH).count() == 0


def _by_document(rows):
    """Pieces of each row: a document's row starts at piece 0; repeated ids are told apart
    by their contents being equal or by length."""
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["piece"], bytes(r["ids"])))
    for pieces in by_id.values():
        if max(p for p, _ in pieces) == 0:
            yield from ([p] for p in pieces)
        else:
            yield pieces


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query(spark, whole):
    from kanaforge.llm.queries import op2_best_fit_packing

    rows = op2_best_fit_packing(spark, SF).collect()
    n = check_bins(rows, 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) * 1.03 + 1
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for i, t in docs.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want


def test_clashing_columns_are_replaced(odd_docs):
    clash = odd_docs.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("ids", "Piece", "offset", "sequence_id", "item_id", "packed_item", "length", "fill")])
    got = P.pack_documents(clash, PATH, capacity=4096)
    assert sorted(got.columns) == sorted(["doc_id", "item_id", "packed_item", "fill", "piece", "start", "length", "ids", "sequence_id", "offset"])
    check_bins(got.collect(), 4096)
