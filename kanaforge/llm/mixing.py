"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). The cell weights are raked: each
round scales them so that the source totals meet their targets, then the language totals,
then the topic totals. Documents are then sampled, each with its cell's weight times a
factor that calibrates the expected number of tokens; cells that would exceed probability
one are taken whole and the factor is set anew for the rest.

Documents are aggregated map-side into cells once; every further step runs on the cell
table (on the driver up to LOCAL_CELLS cells, as frames beyond, with the same result), and
each document is decided by its own hash, so no text is shuffled or ranked.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
#: Targets are the corpus's own shares raised to this power (below 1: flatter) where none are given.
TEMPER = 0.7
#: Share of all tokens that the sample aims at.
KEEP = 0.6
CALIBRATIONS = 5
#: Topic names and the pattern that marks them; the first topic that is found counts.
TOPICS = (("legal", "[Ll]icen[sc]e|[Cc]opyright|GPL"), ("contact", "[A-Za-z0-9]@[A-Za-z]|https?://"), ("markup", "[#*$%&|<>]{3}"))
#: Cells that are fitted on the driver at most; a larger cell table is fitted as a frame.
LOCAL_CELLS = 200_000


def topic_of(text: Column, topics=TOPICS, other: str = "general") -> Column:
    out, text = F.lit(other), F.coalesce(text, F.lit(""))
    for name, marks in reversed(topics):
        out = F.when(text.rlike(marks), name).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Words of a text; null: none."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)).cast("long")


def uniform(key: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of a key's md5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def tempered_targets(cells: DataFrame, dim: str, temper: float = TEMPER) -> DataFrame:
    """(value, share): the dimension's token shares, flattened; shares sum up to one."""
    t = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    t = t.withColumn("share", F.pow("tokens", F.lit(temper)))
    return t.crossJoin(F.broadcast(t.agg(F.sum("share").alias("all")))).select("value", (F.col("share") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``mass``: the fitted tokens, whose totals per
    value of each dimension approach share x all tokens. Values without a target, and
    cells without tokens, get mass 0; a target without tokens has no effect."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = cells.withColumn("mass", F.col("tokens").cast("double"))
    goals = {d: materialize(t.select(F.col("value").alias("goal_value"), (F.col("share") * total).alias("goal"))) for d, t in targets.items()}
    for _ in range(rounds):
        for dim, goal in goals.items():
            now = fitted.groupBy(F.col(dim).alias("goal_value")).agg(F.sum("mass").alias("now"))
            scale = now.join(goal, now["goal_value"].eqNullSafe(goal["goal_value"]), "left").select(
                now["goal_value"], F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("scale"))
            fitted = fitted.join(scale, fitted[dim].eqNullSafe(scale["goal_value"])).select(*[fitted[c] for c in cells.columns], (F.col("mass") * F.col("scale")).alias("mass"))
        fitted = materialize(fitted)
    return fitted


def calibrate(fitted: DataFrame, keep: float = KEEP) -> DataFrame:
    """``fitted`` with weight (mass per token) and probability: min(1, factor x weight),
    the factor set so that the expected tokens are ``keep`` of all."""
    fitted = materialize(fitted.withColumn("weight", F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(0.0)))
    sums = fitted.agg(F.sum("tokens").cast("double"), F.sum("mass")).first()
    budget = keep * (sums[0] or 0.0)
    factor = budget / sums[1] if sums[1] else 0.0
    for _ in range(CALIBRATIONS):
        whole = F.col("weight") * factor >= 1
        s = fitted.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(whole, 0.0).otherwise(F.col("mass")))).first()
        if s[1]:
            factor = max(factor, (budget - s[0]) / s[1])
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * factor))


def fit_local(cells: DataFrame, targets: dict[str, dict], keep: float, rounds: int = ROUNDS) -> DataFrame:
    """``calibrate(rake(...))`` for a cell table of checked size, on the driver: the same
    steps in the same order."""
    rows = cells.collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    total, mass = tokens.sum(), tokens.copy()
    plan = []
    for dim, goal in targets.items():
        values = {v: k for k, v in enumerate(dict.fromkeys(r[dim] for r in rows))}
        plan.append((np.array([values[r[dim]] for r in rows], np.int64), np.array([goal.get(v, 0.0) * total for v in values])))
    for _ in range(rounds if rows else 0):
        for code, goal in plan:
            now = np.bincount(code, mass, len(goal))
            mass = mass * np.where(now > 0, goal / np.where(now > 0, now, 1), 0.0)[code]
    weight = np.where(tokens > 0, mass / np.where(tokens > 0, tokens, 1), 0.0)
    budget = keep * total
    factor = budget / mass.sum() if mass.sum() else 0.0
    for _ in range(CALIBRATIONS):
        whole = weight * factor >= 1
        if mass[~whole].sum():
            factor = max(factor, (budget - tokens[whole].sum()) / mass[~whole].sum())
    out = [(*r, float(w), float(min(1.0, w * factor))) for r, w in zip(rows, weight)]
    return cells.sparkSession.createDataFrame(out, ", ".join(f"{n} {t}" for n, t in cells.dtypes) + ", weight double, probability double")


def fit_cells(cells: DataFrame, targets: dict[str, DataFrame] | None, keep: float, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability). Targets default to the tempered
    shares of the cells."""
    targets = targets or {d: tempered_targets(cells, d) for d in DIMENSIONS}
    sizes = [cells.limit(local_cells + 1).count(), *(t.limit(local_cells + 1).count() for t in targets.values())]
    if max(sizes) <= local_cells:
        return fit_local(cells, {d: {r["value"]: r["share"] for r in t.collect()} for d, t in targets.items()}, keep)
    return calibrate(rake(cells, targets), keep).select(*DIMENSIONS, "tokens", "weight", "probability")


def _probabilities(cells: DataFrame, targets, keep: float, names: list[str], local_cells: int) -> DataFrame:
    return materialize(fit_cells(cells, targets, keep, local_cells).select(*DIMENSIONS, "weight", "probability").toDF(*names))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text",
        local_cells: int = LOCAL_CELLS, topics=TOPICS) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, sampled) for every row.

    A null source or language is a value of its own. Documents without words weigh nothing
    but share their cell's probability; a cell without any word has probability 0. Repeated
    ids are sampled together. ``targets`` maps dimensions to (value, share); the default
    tempers the corpus's own shares."""
    own = materialize(docs.select(F.col(id_col).alias("doc_id"), "source", "lang", topic_of(F.col(text_col), topics).alias("topic"),
                                  n_tokens(F.col(text_col)).alias("tokens")))
    cells = materialize(own.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    ready = _probabilities(cells, targets, keep, ["m_source", "m_lang", "m_topic", "weight", "probability"], local_cells)
    joined = own.join(ready, own["source"].eqNullSafe(ready["m_source"]) & own["lang"].eqNullSafe(ready["m_lang"]) & (own["topic"] == ready["m_topic"]), "left")
    return joined.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def sample_mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text",
               local_cells: int = LOCAL_CELLS, topics=TOPICS) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples. One pass over the texts writes topic and
    tokens beside the documents; no text is shuffled."""
    topic, tokens, *names = fresh(docs, "mix_own_topic", "mix_own_tokens", "mix_source", "mix_lang", "mix_topic", "mix_weight", "mix_probability")
    own = materialize(docs.withColumn(topic, topic_of(F.col(text_col), topics)).withColumn(tokens, n_tokens(F.col(text_col))))
    cells = materialize(own.groupBy("source", "lang", F.col(topic).alias("topic")).agg(F.sum(tokens).alias("tokens")))
    ready = _probabilities(cells, targets, keep, names, local_cells)
    joined = own.join(ready, own["source"].eqNullSafe(ready[names[0]]) & own["lang"].eqNullSafe(ready[names[1]]) & (own[topic] == ready[names[2]]), "left")
    return joined.where(uniform(F.col(id_col)) < F.col(names[4])).select(*[F.col(f"`{c}`") for c in docs.columns])


# --- the same in SQL --------------------------------------------------------------------

def mix_sql(keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, topics=TOPICS) -> str:
    """DuckDB SQL of ``mix`` over ``documents`` with tempered targets."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{marks}') THEN '{n}'" for n, marks in topics) + " ELSE 'general' END"
    ctes = [f"d AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM documents)",
            "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)"]
    for dim in DIMENSIONS:
        ctes.append(f"t_{dim} AS MATERIALIZED (SELECT value, share / sum(share) OVER () * (SELECT sum(tokens) FROM c) AS goal FROM "
                    f"(SELECT {dim} AS value, pow(CAST(sum(tokens) AS DOUBLE), {temper}) AS share FROM c GROUP BY 1 HAVING sum(tokens) > 0))")
    last = "m0"
    ctes.append("m0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) AS mass FROM c)")
    for k in range(rounds * len(DIMENSIONS)):
        dim, name = DIMENSIONS[k % len(DIMENSIONS)], f"m{k + 1}"
        ctes.append(f"{name} AS MATERIALIZED (SELECT m.source, m.lang, m.topic, m.tokens, CASE WHEN n.mass > 0 THEN m.mass * (coalesce(goal, 0) / n.mass) ELSE 0 END AS mass "
                    f"FROM {last} m JOIN (SELECT {dim} AS value, sum(mass) AS mass FROM {last} GROUP BY 1) n ON m.{dim} IS NOT DISTINCT FROM n.value "
                    f"LEFT JOIN t_{dim} t ON m.{dim} IS NOT DISTINCT FROM t.value)")
        last = name
    ctes.append(f"w AS MATERIALIZED (SELECT source, lang, topic, tokens, mass, CASE WHEN tokens > 0 THEN mass / tokens ELSE 0 END AS weight FROM {last})")
    ctes.append(f"f0 AS MATERIALIZED (SELECT {keep} * sum(tokens) / sum(mass) AS f FROM w)")
    for k in range(CALIBRATIONS):
        ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN weight * f >= 1 THEN 0 ELSE mass END) > 0 THEN greatest(any_value(f), "
                    f"({keep} * sum(tokens) - sum(CASE WHEN weight * f >= 1 THEN tokens ELSE 0 END)) / sum(CASE WHEN weight * f >= 1 THEN 0 ELSE mass END)) "
                    f"ELSE any_value(f) END AS f FROM w, f{k})")
    ctes.append(f"p AS MATERIALIZED (SELECT source, lang, topic, weight, least(1.0, weight * f) AS probability FROM w, f{CALIBRATIONS})")
    return (f"WITH {', '.join(ctes)} SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, "
            "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS sampled "
            "FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic")
