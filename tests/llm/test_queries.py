"""Queries with an oracle against DuckDB, and the pipeline stage by stage."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kanaforge.llm import mixing, quality, simhash
from kanaforge.llm.queries import ORACLES, QUERIES
from kanaforge.plans.compare import digest, oracle_connection
from kanaforge.plans.tables import TABLES

from .test_line_dedup import brute as line_brute
from .test_simhash import groups_of, slow_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = oracle_connection(SF, TABLES).execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    good = by["quality rules"](spark, docs, SF)
    assert good.columns == columns
    verdict = {r["doc_id"]: r["kept"] for r in quality.score_documents(docs.select("doc_id", "text")).collect()}
    assert set(rows(good)) == {i for i, k in verdict.items() if k}

    cut = by["line dedup"](spark, good, SF)
    assert cut.columns == columns
    before = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in good.collect())
    got = rows(cut)
    for i, text, _ in line_brute(before, 15):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)

    one = by["simhash near-dedup"](spark, cut, SF)
    assert one.columns == columns
    ids = sorted(got)
    label = groups_of([slow_fingerprint(got[i]["text"]) for i in ids], 4)
    assert set(rows(one)) == {ids[k] for k in set(label)}

    mixed = by["mixing to target weights"](spark, one, SF)
    assert mixed.columns == columns
    chosen = {r["doc_id"] for r in mixing.mix(one).where("sampled").collect()}
    assert set(rows(mixed)) == chosen

    packed = by["best-fit packing"](spark, mixed, SF).collect()
    assert {r["doc_id"] for r in packed} == chosen
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        assert len(bytes(r["ids"])) == 4 * r["length"]
    assert max(fill.values()) <= 4096 and np.mean(list(fill.values())) > 0.8 * 4096


def test_pipeline_on_odd_and_empty_documents(spark, make_docs, no_docs):
    for docs in (make_docs([(1, "a b"), (1, "a b"), (None, None), (2, "")]), no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
    assert simhash.near_dedup(no_docs).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SF).agg(F.count("*")).first()[0] == 0
