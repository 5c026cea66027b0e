import os
import random
import re
from collections import Counter

import pytest

from kanaforge.llm import quality as Q

from .conftest import ODD_ROWS

SF = "/root/testdata/sf0.001"


def slow(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    count = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if count[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_by_definition():
    rng = random.Random(4)
    texts = [r[1] for r in ODD_ROWS] + ["a b\na b\n a b\n\n \n\n", "x " * 9, "x " * 8, "# * | é$", "a b c d e f g h i a b c d e f g h"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    for t in texts:
        assert Q.features(None if t is None else t.encode())[:5] == slow(t)


def test_em_finds_accuracies():
    rng = random.Random(1)
    truth = [rng.random() < 0.7 for _ in range(20000)]
    right = [(0.97, 0.6), (0.95, 0.7), (0.98, 0.5), (0.9, 0.8), (0.99, 0.3)]
    votes = Counter(tuple(-1 if rng.random() < 0.2 else int(t if rng.random() < a[0 if t else 1] else not t) for a in right) for t in truth)
    good, acc = Q.fit_votes(sorted(votes.items()))
    assert good == pytest.approx(0.7, abs=0.05)
    assert [x for x, _ in acc] == pytest.approx([x for x, _ in right], abs=0.04)
    assert [x for _, x in acc] == pytest.approx([x for _, x in right], abs=0.1)
    assert Q.fit_votes([])[1] == []


def test_posterior_counts_votes_not_abstentions():
    acc = [(0.9, 0.9), (0.8, 0.6)]
    assert Q.posterior(0.5, acc, (-1, -1)) == pytest.approx(0.5)
    assert Q.posterior(0.5, acc, (1, -1)) == pytest.approx(0.9)
    assert Q.posterior(0.5, acc, (1, 0)) == pytest.approx(9 * 0.2 / 0.6 / (1 + 9 * 0.2 / 0.6))


def test_one_bad_vote_does_not_reject(make_docs):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ho", "ri", "mea", "stu", "qui") for b in ("use", "ver", "dow", "dent", "et", "ll", "ning")]
    text = lambda: " ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(15))
    good = [(i, text()) for i in range(60)]
    good[7] = (7, good[7][1] + " a#" * 35)  # many symbols, all else fine
    junk = [(1000 + i, " ".join(f"{a}{i}{k}&&&" for k, a in enumerate("QWERTYUIOPASDFGHJKLZXCVBNM"))) for i in range(15)]
    kept = {r["doc_id"] for r in Q.keep_good(make_docs(good + junk)).collect()}
    assert kept == set(range(60))


def test_odd_rows(odd_docs, no_docs):
    got = Q.score_documents(odd_docs.select("doc_id", "text")).collect()
    assert len(got) == len(ODD_ROWS)
    assert all(r["base_failed"] and not r["kept"] and r["quality"] is None for r in got if r["features"]["n_words"] < 20)
    kept = Q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert Q.keep_good(no_docs).count() == 0 and Q.score_documents(no_docs.select("doc_id", "text")).count() == 0


def test_clashing_columns_are_replaced(odd_docs):
    got = Q.score_documents(odd_docs)
    assert len(set(got.columns)) == len(got.columns) and {"features", "quality", "kept", "base_failed", "votes"} <= set(got.columns)
    assert sorted(r["kept"] for r in got.collect()) == sorted(r["kept"] for r in Q.score_documents(odd_docs.select("doc_id", "text")).collect())


def test_variety_is_judged_at_every_length(spark):
    rows = [(n, share) for n in (30, 400, 2000, 50_000) for share in (0.05, 1.0)]
    c = {f: 0 for f in Q.FEATURES}
    df = spark.createDataFrame([(n, share, c | {"n_words": n, "n_distinct": max(2, int(share * 0.95 * n ** 0.85))}) for n, share in rows],
                               f"n long, share double, f struct<{','.join(f'{x}:long' for x in Q.FEATURES)}>")
    votes = {(r["n"], r["share"]): r["v"] for r in df.select("n", "share", Q.rules("f")["variety"].alias("v")).collect()}
    assert votes == {(n, share): int(share == 1.0) for n, share in rows}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query(spark):
    from kanaforge.llm.queries import op8_quality_rules

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = op8_quality_rules(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == {i: slow(t) for i, t in docs.items()}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
