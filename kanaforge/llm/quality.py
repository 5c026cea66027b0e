"""Quality rules as weak supervision.

Each rule looks at a few counts of a document and votes good, bad, or abstains.
Expectation-maximisation over all documents estimates how common good documents are and two
accuracies of each rule: how often its vote is right on good documents, and how often on
bad ones (a rule for symbols is seldom wrong when it accuses, but it also calls documents
good whose defect is another one). A document is kept when its posterior probability of
being good reaches one half. Documents meet the estimator only as counts of equal vote patterns (at
most 3 ** rules of them), so it sees every document whatever the size of the corpus.

A base filter stands before the votes: documents with too few words, or with too many
words inside repeated windows, fail outright.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, materialize

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_NOT_ASCII = bytes(range(128, 256))
_ENDS = b".!?"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ends", "n_distinct")
_TYPE = StructType([StructField(c, LongType()) for c in FEATURES])


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, first ones included.
    Windows are compared by a 64-bit combination of their words' hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + h[k:k + n]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def features(text: bytes | None) -> tuple[int, ...]:
    """The counts of ``FEATURES`` over a whole text (null: as empty)."""
    b = text or b""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    gone = lambda chars: len(b) - len(b.translate(None, chars))
    bare = b.translate(None, _SPACE)
    chars = len(bare.decode("utf-8", "replace"))
    other = chars - len(bare.translate(None, _NOT_ASCII))  # counted as letters
    return (len(words), chars, gone(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), gone(_UPPER),
            gone(_LETTERS) + other, gone(_ENDS), len(set(words)))


@pandas_udf(_TYPE)
def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(t) for t in texts], columns=list(FEATURES), dtype="int64")


def text_features(col: Column) -> Column:
    """Struct of the counts of a text column; Python runs once per document."""
    return _features(col.cast("binary"))


# --- rules ------------------------------------------------------------------------------

def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1).cast("int")


def rules(f: str) -> dict[str, Column]:
    """Name -> vote (1 good, 0 bad, -1 abstains) over the struct column ``f``."""
    c = {k: F.col(f)[k].cast("double") for k in FEATURES}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    letters = F.greatest(c["n_letters"], F.lit(1.0))
    length = c["word_chars"] / words
    return {
        "word_length": _vote(length.between(3.0, 7.5), (length < 2.2) | (length > 12.0)),
        "symbols": _vote(c["n_symbols"] <= 0.02 * words, c["n_symbols"] > 0.15 * words),
        "letters": _vote(letters >= 0.92 * c["word_chars"], letters < 0.75 * c["word_chars"]),
        "repeated_lines": _vote(c["n_dup_lines"] <= 0.15 * lines, c["n_dup_lines"] > 0.4 * lines),
        "repeated_words": _vote(c["n_repeat_words"] <= 0.1 * words, c["n_repeat_words"] > 0.25 * words),
        "capitals": _vote(c["n_upper"] <= 0.15 * letters, c["n_upper"] > 0.4 * letters),
        "sentences": _vote(c["n_ends"].between(0.02 * words, 0.3 * words), (c["n_ends"] > 0.6 * words) | ((c["n_ends"] == 0) & (c["n_words"] >= 100))),
        # Distinct words grow slower than words (Heaps), so their number is held against a power.
        "variety": _vote(c["n_distinct"] >= 0.9 * F.pow(words, F.lit(0.85)), c["n_distinct"] < 0.5 * F.pow(words, F.lit(0.85))),
    }


def base_failed(f: str) -> Column:
    return (F.col(f)["n_words"] < MIN_WORDS) | (100 * F.col(f)["n_repeat_words"] > MAX_REPEAT_PERCENT * F.col(f)["n_words"])


# --- estimation -------------------------------------------------------------------------

def posterior(good: float, accuracy: list[tuple[float, float]], votes) -> float:
    """P(good | votes). accuracy: of each rule's votes on good and on bad documents;
    abstaining says nothing."""
    score = math.log(good / (1 - good))
    for (on_good, on_bad), v in zip(accuracy, votes):
        if v == 1:
            score += math.log(on_good / (1 - on_bad))
        elif v == 0:
            score += math.log((1 - on_good) / on_bad)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, score))))


#: Where the estimation starts: documents are mostly good, rules accuse few good documents
#: and see a part of the bad ones.
START_GOOD, START_ACCURACY = 0.8, (0.99, 0.35)


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, accuracies of each rule) by expectation-maximisation from
    vote patterns and how many documents have them. A rule's accuracy on good documents
    stays within [0.8, 0.999], on bad ones within [0.02, 0.99], the share within
    [0.05, 0.99]; two imagined documents per accuracy at its start keep unused rules defined."""
    n_rules = len(patterns[0][0]) if patterns else 0
    good, acc = START_GOOD, [START_ACCURACY] * n_rules
    if not patterns:
        return good, acc
    votes = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    for _ in range(rounds):
        post = np.array([posterior(good, acc, v) for v in votes])
        good = float(np.clip((weight * post).sum() / weight.sum(), 0.05, 0.99))
        acc = []
        for j in range(n_rules):
            yes, no = votes[:, j] == 1, votes[:, j] == 0
            fair, foul = weight * post, weight * (1 - post)
            on_good = (fair[yes].sum() + 2 * START_ACCURACY[0]) / (fair[yes | no].sum() + 2)
            on_bad = (foul[no].sum() + 2 * START_ACCURACY[1]) / (foul[yes | no].sum() + 2)
            acc.append((float(np.clip(on_good, 0.8, 0.999)), float(np.clip(on_bad, 0.02, 0.99))))
    return good, acc


def judge(featured: DataFrame, f: str = "features", keep_at: float = 0.5) -> tuple[DataFrame, Column]:
    """(one row per vote pattern with its posterior ``quality``, the vote column). Fits on
    all rows of ``featured`` that pass the base filter."""
    named = rules(f)
    votes = F.array(*named.values())
    counted = featured.where(~base_failed(f)).groupBy(votes.alias("votes")).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(r["votes"]), r["n"]) for r in counted)  # at most 3 ** rules
    good, acc = fit_votes(patterns)
    rows = [(list(p), posterior(good, acc, p)) for p, _ in patterns]
    return featured.sparkSession.createDataFrame(rows, "votes array<int>, quality double"), votes


def score_documents(docs: DataFrame, text_col: str = "text", keep_at: float = 0.5, features_as: str = "features",
                    quality_as: str = "quality", failed_as: str = "base_failed", kept_as: str = "kept") -> DataFrame:
    """``docs`` without the text, with the features struct, base_failed, the posterior
    ``quality`` (null where the base filter failed) and ``kept``.

    Null and empty texts have no words and fail the base filter. Repeated rows are scored
    as often as they occur. A column of the input that has one of the four names is replaced.
    The features are written once; texts are never shuffled."""
    added = {c.lower() for c in (text_col, features_as, quality_as, failed_as, kept_as)}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    featured = materialize(docs.select(*rest, text_features(F.col(text_col)).alias(features_as)))
    return _with_verdict(featured, features_as, keep_at, quality_as, failed_as, kept_as)


def _with_verdict(featured, f, keep_at, quality_as, failed_as, kept_as) -> DataFrame:
    table, votes = judge(featured, f)
    key, q = fresh(featured, "vote_key", "vote_quality")
    table = table.select(F.col("votes").alias(key), F.col("quality").alias(q))
    failed = base_failed(f)
    return featured.join(F.broadcast(table), votes == F.col(key), "left").select(
        *[F.col(f"`{c}`") for c in featured.columns], failed.alias(failed_as),
        F.when(~failed, F.col(q)).alias(quality_as), F.coalesce(~failed & (F.col(q) >= keep_at), F.lit(False)).alias(kept_as))


def keep_good(docs: DataFrame, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep. One pass over the texts writes the counts
    beside the documents; they are judged and filtered from there, and no text is shuffled."""
    f, = fresh(docs, "quality_features")
    featured = materialize(docs.withColumn(f, text_features(F.col(f"`{text_col}`"))))
    table, votes = judge(featured, f)
    good = [tuple(r["votes"]) for r in table.where(F.col("quality") >= keep_at).collect()]
    code = lambda v: F.concat_ws(",", v.cast("array<string>"))
    names = [",".join(map(str, p)) for p in good]
    return featured.where(~base_failed(f) & code(votes).isin(names or [""])).select(*[F.col(f"`{c}`") for c in docs.columns])
