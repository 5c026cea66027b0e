import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; as extra columns they must not get in the way.
CLASH = ("fp", "root", "component_id", "text_hash", "dedup_key", "features", "quality_features", "votes", "quality", "line_doc", "line_gone",
         "doc", "site", "h1", "h2", "mix_source", "mix_topic", "topic", "tokens", "weight", "shard", "slot", "rid", "grp", "data", "spans", "kept")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing
    extra columns unless told otherwise."""
    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASH]) if clash else df

    return make


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))

#: Nulls in every column, empty and blank texts, a very long one, ties and repeated rows.
ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog. " * 3, None, None),
    (None, "no id here but some words all the same, more than four", "en", None),
    (None, None, None, None),
    (3, None, "de", "b"),
    (4, "", "de", "b"),
    (5, " \t\r\n \x0b\x0c ", "fr", "c"),
    (6, LONG, "en", "c"),
    (7, "é́ ö <|endoftext|> \x1c x\xa0y 日本語 İ", "es", "d"),
    (1, "another text under a repeated id with enough words to be a text", "en", "e"),
    (-9, "x", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD_ROWS)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
