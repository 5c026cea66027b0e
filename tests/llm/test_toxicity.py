import random

import numpy as np
import pytest

from kanaforge.llm import toxicity as T

from .conftest import ODD_ROWS


def corpus(n, seed):
    """(id, text, toxic): toxic texts hold insults, some of them with changing endings."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("tion", "sher", "ander", "oulin") for b in ("a", "le", "ing", "er", "ous")]
    bad = ["trash", "moron"] + [f"vermin{e}" for e in ("ly", "ish", "oid", "esque")]
    out = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(30, 80))]
        for _ in range(rng.randint(1, 8) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def trained(make_docs, spark):
    rows = corpus(400, 1)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    return T.fit_severity(make_docs([(i, t) for i, t, _ in rows]), labels)


def test_held_out_accuracy(trained, make_docs):
    rows = corpus(300, 2)
    got = {r["doc_id"]: r for r in T.score_severity(make_docs([(i, t) for i, t, _ in rows]).select("doc_id", "text"), trained).collect()}
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in rows) >= 297
    severe = [got[i]["expected_severity"] for i, t, toxic in rows if toxic and sum(w.startswith(("trash", "moron", "vermin")) for w in t.split()) >= 6]
    mild = [got[i]["expected_severity"] for i, t, toxic in rows if toxic and sum(w.startswith(("trash", "moron", "vermin")) for w in t.split()) <= 2]
    assert min(severe) > np.mean(mild) > 0.5


def test_probabilities_are_ordered(trained):
    assert (np.diff(trained.thresholds) > 0).all()
    for text in (None, "", "trash", "trash moron verminish " * 50):
        p = trained.exceed(text)
        assert (np.diff(p) <= 0).all() and ((0 <= p) & (p <= 1)).all()
    assert trained.exceed("trash moron").sum() > trained.exceed("trash").sum() > trained.exceed("").sum()


def test_fit_recovers_a_known_model():
    rng = np.random.default_rng(0)
    w, theta = np.array([2.0, -1.5, 0.7]), np.array([-0.5, 1.0, 2.5])
    x = rng.normal(size=(6000, 3))
    u = rng.random(6000)
    grades = (u[:, None] < 1 / (1 + np.exp(theta - (x @ w)[:, None]))).sum(axis=1)
    got, cut = T.fit_cumulative_link([dict(enumerate(r)) for r in x], grades, 3, 4, l2=0.0, steps=600)
    # Grades weigh the same in the fit, which moves the thresholds, not the direction.
    assert np.allclose(got / np.linalg.norm(got), w / np.linalg.norm(w), atol=0.06)
    assert (np.diff(cut) > 0).all()


def test_odd_rows(trained, odd_docs, no_docs, spark, make_docs):
    got = T.score_severity(odd_docs.select("doc_id", "text"), trained).collect()
    assert len(got) == len(ODD_ROWS) and not any(r["toxic"] for r in got)
    assert T.score_severity(no_docs.select("doc_id", "text"), trained).count() == 0
    empty = T.fit_severity(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.exceed("trash").sum() < 1e-6
    assert [r["toxic"] for r in T.score_severity(make_docs([(1, "trash")]).select("doc_id", "text"), empty).collect()] == [False]


def test_clashing_columns_are_replaced(trained, odd_docs):
    clash = odd_docs.withColumn("grade", odd_docs["lang"]).withColumn("Toxic", odd_docs["lang"]).withColumn("s", odd_docs["lang"])
    got = T.score_severity(clash, trained)
    assert {"s", "grade", "toxic", "expected_severity"} <= set(got.columns) and "Toxic" not in got.columns
    assert not any(r["toxic"] for r in got.collect())


def test_sample_is_bounded(spark, make_docs):
    docs = make_docs([(i, "a b") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert T._labelled(docs, labels, 7).groupBy("toxic").count().collect() and T._labelled(docs, labels, 7).count() == 14
