"""Every catalogue query against its DuckDB oracle on the smallest driver tables,
and the driver contract of __spark_entry__."""

import os

import pytest

import __spark_entry__ as E
from kanaforge.functions import constants as K
from kanaforge.plans import catalog
from kanaforge.plans import tables as T
from kanaforge.plans.compare import digest, oracle_connection
from kanaforge.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

SPARK_TO_DUCKDB = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF, TABLES)


def test_every_query_has_oracle_or_is_listed():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 40


SQL = {name: q.sql for name, q in catalog.REGISTRY.items() if q.sql is not None}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
    rel = con.sql(SQL[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {c: SPARK_TO_DUCKDB.get(t, t) for c, t in df.dtypes} == types


def test_entry_smoke(spark):
    df = E.entry(spark)
    first = df.schema
    assert df.count() >= 0
    assert E.entry(spark).schema == first


def test_document_readings_equals_a_plain_scan(spark):
    import re
    from collections import Counter, defaultdict

    lower, upper = K.ASCII_LOWER, K.ASCII_UPPER
    down, up = str.maketrans(upper, lower), str.maketrans(lower, upper)
    sentences = {(r["doc_id"], r["sent_no"]): r["sentence"] for r in T.sentences(spark, SF).collect()}
    counts = defaultdict(Counter)
    for s in sentences.values():
        for w in re.findall(r"[^\W\d_]+", s):
            counts[w.translate(down)][w.translate(up)] += 1
    lexicon = {k: min(c, key=lambda v: (-c[v], v)) for k, c in counts.items()}
    longest = max(map(len, lexicon))

    def read(text):
        out, p = "", 0
        while p < len(text):
            k = next((k for k in range(min(longest, len(text) - p), 0, -1) if text[p:p + k] in lexicon), 0)
            out, p = out + (lexicon[text[p:p + k]] if k else text[p]), p + (k or 1)
        return out

    got = {(r["doc_id"], r["sent_no"]): r["reading"] for r in catalog.REGISTRY["document_readings"].fn(spark, SF).collect()}
    assert got.keys() == sentences.keys()
    some = sorted(sentences)[::7]
    assert {k: got[k] for k in some} == {k: read(sentences[k].translate(down)) for k in some}
