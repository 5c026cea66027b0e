"""Spelling variants by PartEnum signatures.

A word is the multiset of its letters, seen as a binary vector with one place for each
(letter, occurrence). One replaced letter changes two places, one inserted or deleted letter
changes one. The places are dealt out to a few parts: words two places apart agree in two of
four parts, words one place apart in one of two. A signature names the parts and their
letters, and words that can be near share one. As the edit itself lies in one half of the
word, a signature also carries one half of the word in order, which stays as it is; that keeps
words of equal letters in another order (half of the lexicon, where words are made of
syllables) from meeting. Signatures are joined by equality and each pair is verified on the
words, so hash collisions only cost time.

Counting is one aggregate over all runs of letters, combined in the tasks before the shuffle;
everything behind it works on the lexicon alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC32_CTE, crc32_sql, materialize

#: What does not stand in a run of letters.
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS, MIN_COUNT = 5, 3
#: Parts of the letter vectors, by the places in which two words may differ: as many parts as
#: agree at least are named by each signature.
PARTS = {2: 4, 1: 2}


# --- the lexicon ------------------------------------------------------------------------

def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage_every: int | None = None,
                min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the lower-cased (A-Z only) runs of letters of all whole texts that have at
    least ``min_letters`` code points, with their number of occurrences if it is at least
    ``min_count``.

    With ``damage_every``, a run whose crc32 h of "<id>:<run>" it divides loses its code point
    h % length first (a null id is written as nothing). Null and empty texts have no runs,
    repeated rows count as often as they occur."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.split(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), NOT_LETTERS)).alias("word"))
    runs = runs.where(F.char_length("word") >= min_letters)
    if damage_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("h") % damage_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= min_letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# --- signatures -------------------------------------------------------------------------

def letters_by_frequency(words: DataFrame) -> list[str]:
    """The code points of the words, commonest first; at most one for each code point."""
    got = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()
    return [r["c"] for r in sorted(got, key=lambda r: (-r["n"], r["c"]))]


def _part_hashes(alphabet: str, parts: int) -> Column:
    """Array with the hash of the letters in each part of a word. The place of the k-th
    occurrence of the r-th commonest letter lies in part (r + 3 k) mod ``parts``, so that
    common letters, and repeats of one letter, spread over all parts."""
    letters = F.filter(F.array_sort(F.split("word", "")), lambda c: c != "")
    # Sorted letters: the first place of a letter gives the number of its occurrence.
    placed = F.transform(letters, lambda c, i: F.struct(
        c.alias("c"), ((F.position(c, F.lit(alphabet)) + 3 * (i - F.array_position(letters, c))) % parts).alias("p")))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.xxhash64(
        F.array_join(F.transform(F.filter(placed, lambda x: x["p"] == p), lambda x: x["c"]), "")))


def _signatures(words: DataFrame, alphabet: str, differ: int, longer: bool = False) -> DataFrame:
    """(key, word, n): every word once for each signature that a word ``differ`` places away
    may share. ``longer``: as the longer one of a pair whose lengths differ by one."""
    parts = PARTS[differ]
    length = F.char_length("word") - (1 if longer else 0)  # of the shorter one
    half = F.floor(length / 2).cast("int")
    halves = {"front": F.substring("word", F.lit(1), half), "back": F.expr("right(word, rest)")}
    hashed = words.select("word", "n", length.alias("length"), _part_hashes(alphabet, parts).alias("p"), (length - half).cast("int").alias("rest"))
    keys = [F.xxhash64(F.lit(f"{side} {named}"), "length", text, *[F.col("p")[k] for k in named])
            for side, text in halves.items() for named in combinations(range(parts), parts - differ)]
    return hashed.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of ``words`` (word, n; distinct words) that differ by
    exactly one inserted, deleted or replaced code point, each pair once. Null words have no
    partners. A signature with very many words is split by AQE's skew join."""
    alphabet = "".join(letters_by_frequency(words))
    words = words.select("word", "n")
    named = lambda df, s: df.select("key", F.col("word").alias(s), F.col("n").alias(f"{s}_n"))
    replaced = _signatures(words, alphabet, 2)
    shorter, longer = _signatures(words, alphabet, 1), _signatures(words, alphabet, 1, longer=True)
    near = F.levenshtein("a", "b", 1) == 1
    same = named(replaced, "a").join(named(replaced, "b"), "key").where((F.col("a") < F.col("b")) & near)
    other = named(shorter, "a").join(named(longer, "b"), "key").where(near)
    return same.unionByName(other).drop("key").distinct()


# --- the operator -----------------------------------------------------------------------

def follow_forms(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root): the last word reached from each word of ``forms`` (word, form; every
    word once, no cycles) by following forms. Paths are halved in every round."""
    at = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; each word
    once, other columns are dropped).

    n_near: number of words that differ by exactly one inserted, deleted or replaced code
    point. form: the near word of largest n (ties: smallest in code-point order) if that is at
    least twice the word's, else null; form_n its n. root: the last word reached over forms,
    the word itself if it has none. An empty table gives an empty result. A chain of forms
    doubles n with every step, so it is short and has no cycle."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")))
    links = materialize(near_words(words))
    sides = links.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("near")).unionByName(
        links.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form")).alias("near")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    big = -F.col("near.less") >= 2 * F.col("n")
    judged = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, F.col("near.form")).alias("form"),
        F.when(big, -F.col("near.less")).alias("form_n")))
    roots = follow_forms(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(damage_every: int) -> str:
    """DuckDB SQL for ``spelling_variants(count_words(documents, damage_every=...))``: near
    words by strings with one code point masked or left out."""
    return f"""
        WITH RECURSIVE {CRC32_CTE},
        runs AS (SELECT doc_id, word, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
                     unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS word FROM documents)
                 WHERE length(word) >= {MIN_LETTERS} GROUP BY ALL),
        hashed AS (SELECT word, n, {crc32_sql("(doc_id || ':' || word)")} AS h FROM runs, crc),
        words AS (SELECT word, sum(n) AS n FROM (SELECT n, CASE WHEN h % {damage_every} = 0
                      THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word FROM hashed)
                  WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
        holes AS (SELECT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS masked, substr(word, 1, i - 1) || substr(word, i + 1) AS less
                  FROM (SELECT word, n, unnest(range(1, 1 + length(word))) AS i FROM words)),
        near AS (SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.masked = b.masked AND a.word <> b.word
                 UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.less = w.word
                 UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.less = w.word),
        best AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'form': other}}) AS b FROM near GROUP BY word),
        judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * w.n THEN b.form END AS form,
                          CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best USING (word)),
        chain(word, top) AS (SELECT word, form FROM judged WHERE form IS NOT NULL
                            UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON c.top = j.word WHERE j.form IS NOT NULL),
        roots AS (SELECT c.word, c.top AS root FROM chain c JOIN judged j ON c.top = j.word WHERE j.form IS NULL)
        SELECT j.word, j.form, coalesce(root, j.word) AS root, CAST(j.n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
        FROM judged j LEFT JOIN roots USING (word)"""
