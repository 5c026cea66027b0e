"""SQL building blocks for the DuckDB oracle of the catalogue.

DuckDB differs from Spark in a few places that matter here: its regex ``\\s`` is
ASCII, its ``trim`` strips other characters, and its ``levenshtein`` counts bytes. The
fragments below spell out the same rules the Spark side uses.
"""

from __future__ import annotations

from ..functions import constants as K

WS = K.WS_CLASS
NOT_WS = K.NOT_WS_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def upper_ascii(x: str) -> str:
    return f"translate({x}, {q(K.ASCII_LOWER)}, {q(K.ASCII_UPPER)})"


def lower_ascii(x: str) -> str:
    return f"translate({x}, {q(K.ASCII_UPPER)}, {q(K.ASCII_LOWER)})"


def strip_chars(x: str, chars: str = K.JA_PUNCT) -> str:
    return strip(f"translate({x}, {q(chars)}, '')")


def cast_text(x: str) -> str:
    return f"coalesce({x}, '')"


def sentences_cte(terms: str = ".!?", min_len: int = K.MIN_SENTENCE_LEN) -> str:
    """``sent(doc_id, lang, sent_no, sentence)`` from ``documents``."""
    cls = K.char_class(terms)
    arr = (
        f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {q(cls)}), "
        f"lambda x: {strip('x')}), lambda x: length(x) > {min_len})"
    )
    return (
        "sent AS (SELECT doc_id, lang, CAST(unnest(generate_series(0, len(arr) - 1)) AS BIGINT) AS sent_no, "
        f"unnest(arr) AS sentence FROM (SELECT doc_id, lang, {arr} AS arr FROM documents))"
    )


def pairs_cte() -> str:
    """``pairs(doc_id, lang, sent_no, pair_key, source, target)``; needs ``sent``."""
    return (
        "pairs AS (SELECT doc_id, lang, sent_no, CAST(doc_id AS VARCHAR) || ':' || CAST(sent_no AS VARCHAR) AS pair_key, "
        f"{upper_ascii('sentence')} AS source, sentence AS target, sentence AS raw FROM sent)"
    )


def clean_cte(lo: str = "A", hi: str = "Z") -> str:
    """``cleaned(..., ok)``: FLT-2 flags on ``pairs``."""
    rng = K.range_class(lo, hi)
    return (
        "cleaned AS (SELECT doc_id, lang, sent_no, pair_key, source, target, raw, "
        f"coalesce(regexp_full_match(source, {q(rng + '+')}), false) AS ok FROM ("
        f"SELECT doc_id, lang, sent_no, pair_key, {strip_chars('source')} AS source, "
        f"{strip_chars('target')} AS target, raw FROM pairs))"
    )


def corpus_ctes() -> str:
    return ", ".join([sentences_cte(), pairs_cte(), clean_cte()])


# --- edit distance in code points -------------------------------------------------------

# The non-ASCII characters of the driver's text tables (the same 21 at
# sf0.001, sf0.01 and sf0.1). DuckDB's levenshtein counts bytes, so each is mapped to a
# control byte that does not occur in the text (1-8, 14-26) before measuring.
NON_ASCII_TEXT_CHARS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CONTROL_BYTES = [*range(1, 9), *range(14, 27)]


def one_byte(x: str) -> str:
    to = " || ".join(f"chr({b})" for b in _CONTROL_BYTES[: len(NON_ASCII_TEXT_CHARS)])
    return f"translate({x}, {q(NON_ASCII_TEXT_CHARS)}, {to})"


def levenshtein(a: str, b: str) -> str:
    return f"levenshtein({one_byte(a)}, {one_byte(b)})"


def sentences_next_cte() -> str:
    """``sentn(doc_id, lang, sent_no, sentence, next_sentence)``; needs ``sent``."""
    return (
        "sentn AS (SELECT doc_id, lang, sent_no, sentence, coalesce(lead(sentence) OVER "
        "(PARTITION BY doc_id ORDER BY sent_no), '') AS next_sentence FROM sent)"
    )


def predictions_cte() -> str:
    """``preds(doc_id, lang, sent_no, model, reference, prediction)``; needs ``sentn``."""
    return (
        "preds AS (SELECT doc_id, lang, sent_no, m.model, sentence AS reference, "
        "CASE m.model WHEN 'copy' THEN sentence WHEN 'vowel' THEN translate(sentence, 'e', 'a') "
        "ELSE next_sentence END AS prediction FROM sentn, (VALUES ('copy'), ('vowel'), ('next')) m(model))"
    )


def chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ''), lambda c: c <> ''))"


def scored_cte(src: str = "preds") -> str:
    """``scored(..., precision, recall, f_score, cer, sentence_accuracy)`` from a table
    with ``reference`` and ``prediction`` (NFKC is a no-op on the driver's text)."""
    rm = f"regexp_replace(coalesce(reference, ''), {q(WS + '+')}, '', 'g')"
    pm = f"regexp_replace(coalesce(prediction, ''), {q(WS + '+')}, '', 'g')"
    return (
        f"n1 AS (SELECT *, {rm} AS r_, {pm} AS p_ FROM {src}), "
        f"n2 AS (SELECT *, {chars('r_')} AS rs_, {chars('p_')} AS ps_ FROM n1), "
        "n3 AS (SELECT *, len(list_intersect(ps_, rs_)) AS tp_, len(ps_) - len(list_intersect(ps_, rs_)) AS fp_, "
        "len(rs_) - len(list_intersect(ps_, rs_)) AS fn_ FROM n2), "
        "n4 AS (SELECT *, CASE WHEN tp_ + fp_ > 0 THEN CAST(tp_ AS DOUBLE) / (tp_ + fp_) ELSE 0.0 END AS pr_, "
        "CASE WHEN tp_ + fn_ > 0 THEN CAST(tp_ AS DOUBLE) / (tp_ + fn_) ELSE 0.0 END AS rc_ FROM n3), "
        "scored AS (SELECT *, pr_ * 100.0 AS precision, rc_ * 100.0 AS recall, "
        "CASE WHEN pr_ + rc_ > 0 THEN 2.0 * pr_ * rc_ / (pr_ + rc_) ELSE 0.0 END * 100.0 AS f_score, "
        f"CASE WHEN length(r_) > 0 THEN CAST({levenshtein('r_', 'p_')} AS DOUBLE) / length(r_) ELSE 1.0 END * 100.0 AS cer, "
        "CASE WHEN r_ = p_ THEN CAST(100.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS sentence_accuracy FROM n4)"
    )


def metrics_ctes() -> str:
    return ", ".join([sentences_cte(), sentences_next_cte(), predictions_cte(), scored_cte()])


def runs_cte() -> str:
    """``runs(model, dataset, precision, ..., n)``: macro metrics by model and language."""
    return (
        "runs AS (SELECT model, lang AS dataset, avg(precision) AS precision, avg(recall) AS recall, "
        "avg(f_score) AS f_score, avg(cer) AS cer, avg(sentence_accuracy) AS sentence_accuracy, "
        "CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY model, lang)"
    )


def links_cte() -> str:
    """``links(category, member, member_ns, ord)`` as built by tables.category_links."""
    return (
        "links AS (SELECT r_name AS category, n_name AS member, 14 AS member_ns, CAST(n_nationkey AS INTEGER) AS ord "
        "FROM nation JOIN region ON n_regionkey = r_regionkey "
        "UNION ALL SELECT r_name, 'doc-' || CAST(s_suppkey AS VARCHAR), 0, CAST(s_suppkey + 100 AS INTEGER) "
        "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
        "UNION ALL SELECT n_name, 'doc-' || CAST(c_custkey AS VARCHAR), 0, CAST(c_custkey + 100 AS INTEGER) "
        "FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "UNION ALL SELECT a.n_name, b.n_name, 14, CAST(b.n_nationkey AS INTEGER) FROM nation a JOIN nation b "
        "ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"
    )


def path_key(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: lpad(CAST(v AS VARCHAR), 10, '0')), '/')"


def walk_ctes(roots_sql: str, depth: int) -> str:
    """``walked(root, member, level, path)``: fixed-depth unions of link joins from the
    roots in ``roots_sql`` (a query with one column ``root``)."""
    parts = [
        f"w0 AS (SELECT r.root, l.member, l.member_ns, [l.ord] AS path, 0 AS level "
        f"FROM ({roots_sql}) r JOIN links l ON l.category = r.root)"
    ]
    for d in range(1, depth + 1):
        parts.append(
            f"w{d} AS (SELECT w.root, l.member, l.member_ns, list_append(w.path, l.ord) AS path, {d} AS level "
            f"FROM w{d - 1} w JOIN links l ON l.category = w.member WHERE w.member_ns = 14)"
        )
    union = " UNION ALL ".join(f"SELECT root, member, level, path FROM w{d} WHERE member_ns = 0" for d in range(depth + 1))
    parts.append(f"walked AS ({union})")
    return ", ".join(parts)


def keep_sentences(x: str, terms: str = ".!?") -> str:
    cls, neg = K.char_class(terms), K.char_class(terms, negate=True)
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, {q('(' + neg + '*' + cls + ')')}, 1), "
        f"lambda s: {collapse('s')}), lambda s: length(s) > 0)"
    )


def render(title: str, sentences: str, category: str | None = None) -> str:
    header = f"'# ' || {title}"
    if category:
        header += f" || ' (Category: ' || {category} || ')'"
    return f"{header} || chr(10) || array_to_string({sentences}, chr(10)) || chr(10) || chr(10)"


def page_sentences_cte() -> str:
    """``ps(title, sentences)`` from documents as pages 'doc-<id>'."""
    return (
        f"ps AS (SELECT title, sentences FROM (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS title, "
        f"{keep_sentences('text')} AS sentences FROM documents) WHERE len(sentences) > 0)"
    )
