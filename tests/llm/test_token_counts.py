"""Token counts against the tokenizer's own library."""

import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kanaforge.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


BITS = ["a", "b", "A", " ", "  ", "\n", "\t", "\r", "'s", "'LL", "1", "23", "é", "日本", "İ", "<|endoftext|>", "<|endof", "　", "\x1c", "\x85", "\xa0",
        "!", "..", "​", "😀", "é", "Ა", "ſ", "²", "﻿", "the", " of", "aaaa"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join) | st.text(max_size=30).filter(lambda s: s.isprintable()))
def test_any_text(text):
    assert T.counter(PATH).count([text]) == [plain(text)]


def test_long_pretokens():
    rng = random.Random(5)
    texts = ["a" * n for n in (T.LONG - 1, T.LONG, T.LONG + 1, 5001)]
    texts += ["ab" * 3000, "é" * 700 + "x" * 2001, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "." * 999]
    assert T.counter(PATH).count(texts) == [plain(t) for t in texts]


def test_rounds_and_ranks_agree():
    merger, rng = T.counter(PATH).merger, random.Random(6)
    pieces = [bytes(rng.choice(b"aeinrst ") for _ in range(rng.randrange(1, 90))) for _ in range(300)] + [b""]
    flat = merger.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), list(map(len, pieces)))
    rounds, ranks = merger._in_rounds(flat.copy(), owner, len(pieces)), merger._by_rank(flat.copy(), owner, len(pieces))
    assert rounds.tolist() == ranks.tolist() == merger.counts(pieces).tolist()


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHE_CHUNKS", 20)
    monkeypatch.setattr(T, "SLICE", 50)
    c = T.TokenCounter(PATH)
    texts = [f"word{i} and{i % 7}\nline {i}, it's" for i in range(200)]
    assert c.count(texts) == [plain(t) for t in texts]
    assert len(c.spaced) < 100


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.loads(LIBRARY.to_str()) | {"normalizer": {"type": "Lowercase"}}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        T.TokenCounter(str(tmp_path / "t.json"))


def test_odd_documents(spark, odd_docs, no_docs):
    got = T.count_tokens(odd_docs.select("doc_id", "text"), PATH, limit=50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], len(r["t"].encode()), plain(r["t"]), plain(r["t"]) > 50) for r in want)
    assert T.count_tokens(no_docs, PATH).count() == 0
    clash = odd_docs.select("doc_id", "text", F.lit("x").alias("N_TOKENS"), F.lit(1).alias("tokens"))
    assert T.count_tokens(clash, PATH).columns == ["doc_id", "text", "tokens", "n_bytes", "n_tokens", "over_limit"]
