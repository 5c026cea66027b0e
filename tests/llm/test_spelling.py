"""Spelling variants against plain counting and an all-pairs comparison."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from kanaforge.llm import spelling as S

LOWER = str.maketrans(S.UPPER, S.LOWER)


def plain_words(rows, damage_every=None):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage_every and h % damage_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def random_words(rng, size):
    """Words of syllables, with one or two random edits of some of them."""
    words = set()
    while len(words) < size:
        w = list("".join(rng.choice(("th", "an", "er", "é", "ss", "a", "ing", "zu")) for _ in range(rng.randrange(2, 6))))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k:k + rng.randrange(2)] = rng.choice(("", "a", "s", "ß", "q"))
            w = w or ["a"]
        if len(w) >= 5:
            words.add("".join(w))
    return sorted(words)


def test_near_words_by_brute_force(spark):
    rng = random.Random(11)
    words = random_words(rng, 700) + ["a" * k for k in range(5, 12)] + ["ab" * 4, "ba" * 4, "aabbaabb" + "x" * 300, "aabbaabb" + "x" * 301]
    got = S.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    assert all(r["a"] != r["b"] for r in got) and len(got) == len({frozenset((r["a"], r["b"])) for r in got})
    assert {frozenset((r["a"], r["b"])) for r in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_variants_by_brute_force(spark):
    rng = random.Random(12)
    n = {w: rng.choice((3, 4, 6, 7, 12, 24, 25, 50, 200, 800)) for w in random_words(rng, 500)}
    n |= {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 48}  # a chain, a tie
    got = S.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long").withColumn("form", F.lit("clash")))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(n)


def test_counts_with_damage(spark, make_docs):
    rng = random.Random(13)
    pool = random_words(rng, 60) + ["Éé", "NaïVE", "ÀÉÎÕÜ", "tiny"]
    rows = [(i, " ".join(rng.choice(pool).title() + rng.choice(("", ",", "1", "-x", "日")) for _ in range(60))) for i in range(40)]
    docs = make_docs(rows).withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash"))
    for every in (None, 7, 97):
        assert {(r["word"], r["n"]) for r in S.count_words(docs, damage_every=every).collect()} == set(plain_words(rows, every).items())


def test_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    words = plain_words(rows, 97)
    got = S.spelling_variants(S.count_words(odd_docs, damage_every=97))
    assert {tuple(r) for r in got.collect()} == plain_variants(words)
    assert S.spelling_variants(S.count_words(no_docs)).count() == 0
