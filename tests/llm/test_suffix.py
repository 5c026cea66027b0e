import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from kanaforge.llm import suffix as S

from .conftest import ODD_ROWS

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(removed, runs, remaining) of every text by looking up all its substrings."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def random_texts(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 120))) for _ in range(8)]
    out = []
    for _ in range(30):
        t = bytearray(b"".join(rng.choice(base)[rng.randint(0, 30):rng.randint(30, 120)] for _ in range(rng.randint(0, 4))))
        for _ in range(rng.randint(0, 3)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(b"xyz")
        out.append(bytes(t))
    return [*out, b"a" * 90, b"ab" * 50, out[3], b"", b"abc"]


@pytest.mark.parametrize("seed", range(3))
def test_blocks_name_equal_windows_alike(seed):
    texts = random_texts(seed)
    text, start, n, place, token, d1, d2 = S.blocks(texts, 24, 8, segment=64)
    windows = {}
    for t, s, m, p, k in zip(text, start, n, place, token):
        for i in range(m):
            windows[t, s + i] = (k, p - i)
    assert set(windows) == {(t, i) for t, x in enumerate(texts) for i in range(len(x) - 23)}
    by_content = {}
    for (t, i), name in windows.items():
        assert by_content.setdefault(texts[t][i:i + 24], name) == name


@pytest.mark.parametrize("length", [8, 20, 400])
def test_multikey_quicksort_finds_repeats(length):
    rng = random.Random(length)
    data = bytes(rng.choice(b"ab") for _ in range(300)) + b"ab" * 400
    starts = np.array(sorted(rng.sample(range(len(data) - length), 300)))
    classes = np.array([rng.randrange(3) for _ in starts])
    count = Counter((c, data[s:s + length]) for s, c in zip(starts, classes))
    want = [count[c, data[s:s + length]] > 1 for s, c in zip(starts, classes)]
    assert S.repeated_windows(data, starts, classes, length).tolist() == want


@pytest.mark.parametrize("seed,hot", [(0, 4096), (1, 1), (2, 4096), (3, 1)])
def test_equals_brute_force(spark, seed, hot):
    texts = random_texts(seed)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.drop_repeats(docs, length=24, gram=8, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 24)


def test_odd_rows(odd_docs, no_docs):
    got = S.drop_repeats(odd_docs, length=100, gram=16).collect()
    assert len(got) == len(ODD_ROWS)
    texts = [(r[1] or "").encode() for r in ODD_ROWS]
    want = sorted((len(t), a, b, k) for t, (a, b, k) in zip(texts, brute([t[:0] if len(t) > 10 ** 5 else t for t in texts], 100)) if len(t) < 10 ** 5)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got if r["n_bytes"] < 10 ** 5) == want
    assert S.drop_repeats(no_docs).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_brute_force(spark):
    from kanaforge.llm.queries import op10_suffix_dedup

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    want = {i: (len(docs[i]), a, b, hashlib.sha256(k).hexdigest()) for i, (a, b, k) in zip(ids, brute([docs[i] for i in ids], 400))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op10_suffix_dedup(spark, SF).collect()}
    assert got == want
