"""Toxicity severity by cumulative-link ordinal regression.

Severity has ordered grades 0 (clean), 1, 2, ... The model is the proportional-odds one:
P(grade > j | x) = sigmoid(w . x - theta_j) with one weight vector for all thresholds and
theta_0 < theta_1 < ...; the expected severity is the sum of these probabilities. Features
are sparse: log(1 + count) of words, and of word beginnings of four to seven letters (stems
that take many endings), that the labelled documents tie to toxicity.

Fitting uses a sample of labelled documents, at most ``SAMPLE`` of each label (those with
the smallest id hashes), so its tables are bounded and may be broadcast; scoring is one
pass over all documents without a shuffle.

The labels say toxic or not. Toxic documents are graded by how many telling words they
hold: below the median 1, from it on 2; with more cut points, more grades.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, materialize

SAMPLE = 10_000
#: Features of toxic sample documents that are considered, and that are kept, at most.
CANDIDATES, FEATURES = 50_000, 2_000
MIN_DOCS = 3
MIN_Z = 5.0
#: Quantiles of the count among toxic documents that part the grades above 0.
GRADE_CUTS = (0.5,)
#: A document is toxic when its expected severity exceeds that of this share of the clean
#: sample documents, and TOXIC_AT at least.
CLEAN_SHARE, TOXIC_AT = 0.99, 0.5

_LETTERS = re.compile(r"[^\W\d_]+").findall


#: Letters of the word beginnings that are features.
STEMS = (4, 5, 6, 7)


def terms(text: str | None) -> Counter:
    """How often each word and each word beginning (marked ^) stands in a text."""
    out = Counter(_LETTERS((text or "").lower()))
    for word, n in list(out.items()):
        for k in STEMS:
            if len(word) > k:
                out["^" + word[:k]] += n
    return out


@dataclass
class SeverityModel:
    """Feature numbers by term, their weights, the ordered thresholds of the grades, and the
    expected severity above which a document counts as toxic."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    toxic_above: float = TOXIC_AT

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        return exceed(self.vocabulary, self.weights, self.thresholds, text)


def exceed(vocabulary: dict[str, int], weights: np.ndarray, thresholds: np.ndarray, text: str | None) -> np.ndarray:
    score = sum(weights[vocabulary[w]] * np.log1p(n) for w, n in terms(text).items() if w in vocabulary)
    return 1 / (1 + np.exp(np.clip(thresholds - score, -700, 700)))


def fit_cumulative_link(rows: list[dict[int, float]], grades: np.ndarray, n_features: int, n_grades: int,
                        l2: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the mean penalised log-likelihood. Thresholds are
    ordered by construction (the first, then positive steps). Each grade weighs the same in
    sum, so that rare grades count."""
    grades = np.asarray(grades)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([k for r in rows for k in r], np.int64)
    value = np.array([v for r in rows for v in r.values()], float)
    share = np.bincount(grades, minlength=n_grades).astype(float)
    weight = (1 / np.maximum(share, 1))[grades] / max(1, (share > 0).sum())
    w, free = np.zeros(n_features), np.concatenate([[0.0], np.zeros(n_grades - 2)])
    params = [w, free]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    index = np.arange(len(rows))
    for step in range(1, steps + 1):
        theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        score = np.bincount(at, w[feature] * value, minlength=len(rows))
        below = np.column_stack([np.zeros(len(rows)), *(sigmoid(t - score) for t in theta), np.ones(len(rows))])
        slope = below * (1 - below)
        lo, hi = below[index, grades], below[index, grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weight * slope[index, grades + 1] / p, weight * slope[index, grades] / p
        d_score = d_hi - d_lo  # of the negative log-likelihood: -(d/dscore) log p
        grad_w = np.bincount(feature, d_score[at] * value, minlength=n_features) + l2 * w
        grad_theta = np.array([d_lo[grades == j + 1].sum() - d_hi[grades == j].sum() for j in range(n_grades - 1)])
        grad_free = np.concatenate([[grad_theta.sum()], [grad_theta[j:].sum() * np.exp(free[j]) for j in range(1, n_grades - 1)]])
        for k, g in enumerate((grad_w, grad_free)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text) of at most ``sample`` labelled documents of each label."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.select("doc_id", (F.col("toxic") > 0).alias("toxic")))
    few = [known.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for flag in (True, False)]
    chosen = materialize(few[0].unionByName(few[1]))  # at most 2 x sample narrow rows
    return materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"))


def _word_counts(texts: DataFrame, keep: frozenset | None = None) -> DataFrame:
    """(word, n): in how many of the texts a word stands, added up per task first."""
    def count(frames):
        held: Counter = Counter()
        for f in frames:
            for t in f["text"]:
                found = terms(t).keys()
                held.update(found & keep if keep is not None else found)
            if len(held) > 200_000:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return texts.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def choose_words(sample: DataFrame, candidates: int = CANDIDATES, features: int = FEATURES, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> list[str]:
    """Words and beginnings that stand in toxic documents more often than in clean ones, by
    the root of their likelihood ratio, the most telling first."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    common = _word_counts(sample.where("toxic")).where(F.col("n") >= min_docs).orderBy(F.col("n").desc(), "word").limit(candidates).collect()
    toxic = {r["word"]: r["n"] for r in common}
    if not toxic:
        return []
    clean = {r["word"]: r["n"] for r in _word_counts(sample.where("NOT toxic"), frozenset(toxic)).collect()}
    scored = []
    for w, t in toxic.items():
        c = clean.get(w, 0)
        share = (t + c) / (n_toxic + n_clean)
        ratio = sum(a * np.log(a / (n * q)) for a, n, q in (
            (t, n_toxic, share), (c, n_clean, share), (n_toxic - t, n_toxic, 1 - share), (n_clean - c, n_clean, 1 - share)) if a)
        if t * n_clean > c * n_toxic:
            scored.append((float(np.sqrt(max(0.0, 2 * ratio))), w))
    return [w for z, w in sorted(scored, key=lambda x: (-x[0], x[1])) if z >= min_z][:features]


def fit_severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cuts: tuple[float, ...] = GRADE_CUTS) -> SeverityModel:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Rows of labels
    without an id or label do not count; of contrary labels of an id, toxic wins. Without
    any toxic labelled document the model finds every document clean."""
    rows = _labelled(docs, labels, sample)
    vocabulary = {w: k for k, w in enumerate(choose_words(rows))}
    n_grades = len(cuts) + 2
    if not vocabulary:
        return SeverityModel({}, np.zeros(0), 50.0 + np.arange(n_grades - 1))

    def vectorise(frames):
        for f in frames:
            out = []
            for toxic, text in zip(f["toxic"], f["text"]):
                found = sorted((vocabulary[w], n) for w, n in terms(text).items() if w in vocabulary)
                out.append((bool(toxic), float(sum(n for _, n in found)), [k for k, _ in found], [float(np.log1p(n)) for _, n in found]))
            yield pd.DataFrame(out, columns=["toxic", "telling", "features", "values"])

    got = rows.mapInPandas(vectorise, "toxic boolean, telling double, features array<int>, values array<double>").collect()
    got.sort(key=lambda r: (r["toxic"], r["telling"], r["features"]))  # the order of tasks does not matter
    telling = np.array([r["telling"] for r in got])
    toxic = np.array([r["toxic"] for r in got])
    edges = np.quantile(telling[toxic], cuts) if toxic.any() else np.zeros(len(cuts))
    grades = np.where(toxic, 1 + np.searchsorted(edges, telling, "right"), 0)
    w, theta = fit_cumulative_link([dict(zip(r["features"], r["values"])) for r in got], grades, len(vocabulary), n_grades)
    score = np.array([float(w[r["features"]] @ np.array(r["values"])) if r["features"] else 0.0 for r in got])
    clean = (1 / (1 + np.exp(theta[None, :] - score[~toxic, None]))).sum(axis=1)
    above = max(TOXIC_AT, float(np.quantile(clean, CLEAN_SHARE))) if len(clean) else TOXIC_AT
    return SeverityModel(vocabulary, w, theta, above)


def score_severity(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with expected_severity, grade (how many thresholds are
    more likely passed than not) and toxic. Null and empty texts score like a text without
    any telling word. A column of the input that has one of the three names is replaced. One
    pass, no shuffle; the model has at most FEATURES words."""
    bound = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights, model.thresholds))

    @pandas_udf("expected_severity double, grade int")
    def score(texts: pd.Series) -> pd.DataFrame:
        p = [exceed(*bound.value, t) for t in texts]
        return pd.DataFrame({"expected_severity": [float(x.sum()) for x in p], "grade": [int((x >= 0.5).sum()) for x in p]}).astype({"grade": "int32"})

    added = {text_col.lower(), "expected_severity", "grade", "toxic"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    s, = fresh(docs, "severity_score")
    return docs.select(*rest, score(F.col(text_col)).alias(s)).select(
        *rest, f"{s}.expected_severity", f"{s}.grade", (F.col(f"{s}.expected_severity") > model.toxic_above).alias("toxic"))
