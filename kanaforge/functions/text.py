"""Column -> Column text rules (TXT-*). All native Spark expressions except NFKC.

Semantics follow Python's string model: whitespace is Unicode whitespace, a regex dot
does not cross ``\\n`` only, and lengths count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as K

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- whitespace -------------------------------------------------------------------------

def strip_ws(c: ColumnOrName) -> Column:
    """TXT-8: trim Unicode whitespace at both ends (Python ``str.strip``). ``btrim``
    with the full whitespace set (Spark's plain ``trim`` removes only U+0020)."""
    return F.btrim(_c(c), F.lit(K.WHITESPACE))


def collapse_ws(c: ColumnOrName) -> Column:
    """TXT-7: every whitespace run becomes one space, then trim."""
    return strip_ws(F.regexp_replace(_c(c), K.WS_CLASS + "+", " "))


def remove_ws(c: ColumnOrName) -> Column:
    """Delete every whitespace character (a character map, no regex)."""
    return F.translate(_c(c), K.WHITESPACE, "")


# --- NFKC (no built-in in Spark: one Arrow-batched pandas UDF) ----------------------------

@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(c: ColumnOrName) -> Column:
    """TXT-1: NFKC, then delete all whitespace. Only strings that NFKC may change go to
    Python: a native test finds those with any character outside the inert ones (plain
    Latin letters, kana, ideographs; they neither change nor join with a neighbour). The test
    with the full class only runs where a short class of plain ranges finds something."""
    col = _c(c)
    may_change = (F.length(col) != F.octet_length(col)) & col.rlike(K.NOT_PLAIN) & col.rlike(K.NOT_NFKC_INERT)
    return remove_ws(F.coalesce(nfkc(F.when(may_change, col)), col))


# --- character deletion, alphabets ------------------------------------------------------

def strip_chars(c: ColumnOrName, chars: str = K.JA_PUNCT) -> Column:
    """TXT-2: delete every character of ``chars``, then trim whitespace."""
    return strip_ws(F.translate(_c(c), chars, ""))


def katakana_to_hiragana(c: ColumnOrName) -> Column:
    """TXT-9: katakana -> hiragana by a fixed character map; hiragana is kept."""
    return F.translate(_c(c), K.KATAKANA, K.HIRAGANA)


def ascii_upper(c: ColumnOrName) -> Column:
    """Upper-case ASCII letters only (engine-independent, unlike locale rules)."""
    return F.translate(_c(c), K.ASCII_LOWER, K.ASCII_UPPER)


def ascii_lower(c: ColumnOrName) -> Column:
    return F.translate(_c(c), K.ASCII_UPPER, K.ASCII_LOWER)


# --- sentence segmentation ----------------------------------------------------------------

def split_sentences_keep(c: ColumnOrName, terms: str = K.TERMS_KEEP) -> Column:
    """TXT-3: cut after each terminator and keep it; the tail after the last terminator
    is dropped. Each piece has whitespace collapsed; empty pieces are dropped.
    Returns ARRAY<STRING> in text order."""
    cls = K.char_class(terms)
    # Cut after every terminator (a zero-width split, linear time); every piece but the
    # last ends with a terminator, and the last one is the tail, which is dropped.
    # (Extracting "[^T]*[T]" instead is quadratic on a long text with no terminator.)
    pieces = F.split(F.coalesce(_c(c), F.lit("")), f"(?<={cls})", -1)
    closed = F.filter(pieces, lambda x: x.rlike(f"{cls}\\z"))
    cleaned = F.transform(closed, lambda x: collapse_ws(x))
    return F.filter(cleaned, lambda x: F.length(x) > 0)


def split_sentences_drop(c: ColumnOrName, terms: str = K.TERMS_DROP,
                         min_len: int = K.MIN_SENTENCE_LEN) -> Column:
    """TXT-4 + FLT-4: cut at terminators and drop them, trim, drop empty pieces and
    keep only pieces longer than ``min_len`` code points. The tail is kept.
    Returns ARRAY<STRING> in text order."""
    pieces = F.split(F.coalesce(_c(c), F.lit("")), K.char_class(terms), -1)
    trimmed = F.transform(pieces, lambda x: strip_ws(x))
    return F.filter(trimmed, lambda x: F.length(x) > min_len)


# --- markup ---------------------------------------------------------------------------------

# (?d): only "\n" ends a line for ".", as in Python.
MARKUP_PATTERNS = (r"(?d)={2,}.*?={2,}", r"(?d)\[\[.*?\]\]", r"(?d)\{\{.*?\}\}")


def strip_markup(c: ColumnOrName) -> Column:
    """TXT-5: delete headings, links (with their label) and templates, in that order."""
    out = _c(c)
    for p in MARKUP_PATTERNS:
        out = F.regexp_replace(out, p, "")
    return out


def tagged_bodies(c: ColumnOrName, tag: str = "doc") -> Column:
    """Bodies of ``<tag ...>body</tag>`` blocks (spanning newlines, body non-empty), in
    order. Returns ARRAY<STRING>. The text is cut at the closing tags, what follows the
    last one is dropped, and each piece gives its ``block_body``; linear in the text."""
    pieces = F.split(_c(c), _literal(f"</{tag}>"), -1)
    bodies = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: block_body(x, tag))
    return F.filter(bodies, lambda x: F.length(x) > 0)


def _literal(s: str) -> str:
    """A regex matching exactly ``s``."""
    return "\\Q" + s + "\\E"


def block_body(piece: ColumnOrName, tag: str = "doc") -> Column:
    """SRC-3: the body of a record that ended at a closing tag: what follows the first
    ``>`` behind the first opening tag; NULL without an opening tag."""
    opened = F.try_element_at(F.split(_c(piece), _literal(f"<{tag}"), 2), F.lit(2))
    return F.try_element_at(F.split(opened, ">", 2), F.lit(2))


# --- characters -------------------------------------------------------------------------------

def char_array(c: ColumnOrName) -> Column:
    """TXT-6: the code points of a string as ARRAY<STRING> ([] for '')."""
    return F.array_remove(F.split(_c(c), ""), "")


def char_set(c: ColumnOrName) -> Column:
    """TXT-6: the distinct code points of a string."""
    return F.array_distinct(char_array(c))


# --- small formatting rules ---------------------------------------------------------------------

def format_prompt(c: ColumnOrName, prefix: str = K.PROMPT_PREFIX) -> Column:
    """TXT-10."""
    return F.concat(F.lit(prefix), _c(c))


def slug(c: ColumnOrName) -> Column:
    """TXT-11: keep word characters, whitespace and '-' (Python's definitions); trim;
    spaces -> '_'. Applied to names (domains, categories), so the long class is cheap."""
    col = _c(c)
    # ASCII names take the short class (Python's \\w on ASCII is [A-Za-z0-9_]); others
    # the full rule-built class, whitespace and '-' listed first.
    ascii_drop = "[^" + K.WS_CLASS[1:-1] + "\\-A-Za-z0-9_]"
    full_drop = "[^" + K.WS_CLASS[1:-1] + "\\-" + K.word_class_body() + "]"
    kept = F.when(F.length(col) == F.octet_length(col), F.regexp_replace(col, ascii_drop, "")).otherwise(
        F.regexp_replace(col, full_drop, ""))
    return F.regexp_replace(strip_ws(kept), " ", "_")


def render_article(title: ColumnOrName, sentences: ColumnOrName,
                   category: ColumnOrName | None = None) -> Column:
    """TXT-12: ``# title\\n<sentences, one per line>\\n\\n``; with a category the header
    is ``# title (Category: c)`` (a NULL category adds nothing)."""
    header = F.concat(F.lit("# "), _c(title))
    if category is not None:
        header = F.concat(header, F.coalesce(F.concat(F.lit(" (Category: "), _c(category), F.lit(")")), F.lit("")))
    return F.concat(header, F.lit("\n"), F.array_join(_c(sentences), "\n"), F.lit("\n\n"))


def reading_of(surface: ColumnOrName, feature: ColumnOrName) -> Column:
    """TXT-13: the last comma field of the analyser feature; '*' means the surface."""
    last = F.element_at(F.split(_c(feature), ","), -1)
    return F.when(last == "*", _c(surface)).otherwise(last)


def truncate(c: ColumnOrName, n: int = K.MAX_LENGTH, is_array: bool = False) -> Column:
    """TXT-14: cap a string (code points) or an array to ``n`` elements."""
    return F.slice(_c(c), 1, n) if is_array else F.substring(_c(c), 1, n)


def is_valid_alphabet(c: ColumnOrName, lo: str = K.KANA_LO, hi: str = K.KANA_HI) -> Column:
    """FLT-1: non-empty and every character within [lo, hi]."""
    return F.coalesce(_c(c).rlike(rf"\A{K.range_class(lo, hi)}+\z"), F.lit(False))
