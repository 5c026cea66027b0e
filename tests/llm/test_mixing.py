import numpy as np
import pytest
from pyspark.sql import functions as F

from kanaforge.llm import mixing as M

from .conftest import ODD_ROWS


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f"s{a}", f"l{b}", f"t{c}", 100 * (a + 1) * (b + 2) + 37 * c * a) for a in range(5) for b in range(3) for c in range(2)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def test_marginals_meet_their_targets(spark, cells):
    share = lambda n, d: spark.createDataFrame([(f"{d}{k}", w / sum(n)) for k, w in enumerate(n)], "value string, share double")
    targets = {"source": share([5, 1, 1, 2, 1], "s"), "lang": share([1, 1, 3], "l"), "topic": share([4, 1], "t")}
    fitted = M.rake(cells, targets, rounds=8).toPandas()
    total = cells.agg(F.sum("tokens")).first()[0]
    for dim, t in targets.items():
        got = fitted.groupby(dim)["mass"].sum() / total
        for r in t.collect():
            assert got[r["value"]] == pytest.approx(r["share"], abs=1e-3)


def test_missing_targets_and_empty_cells(spark, cells):
    more = cells.unionByName(spark.createDataFrame([(None, None, "t0", 50), ("s9", "l9", "t9", 0)], cells.schema))
    one = spark.createDataFrame([("s0", 0.5), ("s1", 0.5), ("nowhere", 0.0)], "value string, share double")
    fitted = M.rake(more, {"source": one}).toPandas()
    assert fitted[fitted.source.isin(["s0", "s1"])].mass.sum() == pytest.approx(more.agg(F.sum("tokens")).first()[0])
    assert (fitted[~fitted.source.isin(["s0", "s1"])].mass == 0).all()


def test_calibrated_expectation(cells):
    fitted = M.rake(cells, {d: M.tempered_targets(cells, d, 0.3) for d in M.DIMENSIONS}, rounds=2)
    for keep in (0.1, 0.6, 0.9):
        p = M.calibrate(fitted, keep).toPandas()
        assert p.probability.between(0, 1).all()
        assert (p.probability * p.tokens).sum() == pytest.approx(keep * p.tokens.sum(), rel=0.02)


def test_sample_follows_probabilities(make_docs):
    rows = [(i, "some words of a text " * (1 + i % 4), "en" if i % 10 else "de", "big" if i % 3 else "small") for i in range(3000)]
    got = M.mix(make_docs(rows, clash=False), keep=0.5).toPandas()
    for _, g in got.groupby(["source", "lang"]):
        assert g.sampled.mean() == pytest.approx(g.probability.mean(), abs=4 * (0.25 / len(g)) ** 0.5 + 0.01)


def test_driver_and_frames_fit_alike(cells):
    more = cells.unionByName(cells.sparkSession.createDataFrame([(None, None, "t0", 50), ("s9", "l9", "t9", 0)], cells.schema))
    for targets in ({"source": cells.sparkSession.createDataFrame([("s0", 0.7), (None, 0.3)], "value string, share double"), "lang": M.tempered_targets(more, "lang")},):
        a, b = (M.fit_cells(more, targets, 0.4, n).orderBy("source", "lang", "topic").toPandas() for n in (1000, 0))
        assert a[["source", "lang", "topic", "tokens"]].equals(b[["source", "lang", "topic", "tokens"]])
        assert np.allclose(a[["weight", "probability"]], b[["weight", "probability"]], rtol=1e-9, atol=1e-12)


def test_topics_by_patterns(make_docs):
    topics = {"License": "legal", "copyright": "legal", "GPL": "legal", "silicense": "legal", "mail a@b.c": "contact", "see http://x": "contact", "a || b |||": "markup",
              "<<<": "markup", ">>>": "markup", "#*$": "markup", "###": "markup", "one | bar": "general", "an @ alone": "general", "icy opyrigh": "general", "## **": "general"}
    docs = make_docs([(i, t) for i, t in enumerate(topics)], clash=False)
    assert [r["topic"] for r in M.mix(docs).orderBy("doc_id").collect()] == list(topics.values())


def test_odd_rows(odd_docs, no_docs):
    got = M.mix(odd_docs).collect()
    assert len(got) == len(ODD_ROWS) and all(r["probability"] is not None for r in got)
    sampled = M.sample_mix(odd_docs)
    assert sampled.columns == odd_docs.columns and sampled.count() <= len(ODD_ROWS)
    assert M.sample_mix(no_docs).count() == 0
