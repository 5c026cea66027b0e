"""Constants of the corpus rules.

Everything language-specific is a default only; the operators take each value as a
parameter, so the same code runs on other alphabets and terminators.
"""

from __future__ import annotations

import re
import unicodedata

# --- fixed values (must equal the original rules for equal results) -----------------

# Characters deleted from both sides of a pair before the alphabet test, in the order
# the rule lists them (the straight double quote appears twice there).
JA_PUNCT = " 　.,‥【】\"\"‼⁉−〔〕、。〈〉《》「」『』・！（），．？［］"

# Inclusive alphabet of a valid source line: katakana small A .. prolonged sound mark.
KANA_LO = "ァ"
KANA_HI = "ー"

# Sentence terminators: the "keep" splitter keeps them, the "drop" splitter removes them.
TERMS_KEEP = "。！？"
TERMS_DROP = "。．!！?？"

# A dump sentence is kept only if it is longer than this many code points.
MIN_SENTENCE_LEN = 10

# Model-facing defaults.
PROMPT_PREFIX = "translate kana to kanji: "
MAX_LENGTH = 128
LABEL_IGNORE_ID = -100

# Split defaults.
SEED = 42
TRAIN_RATIO = 0.8
TEST_RATIO = 0.1
VALIDATION_RATIO = 0.1
RATIO_TOLERANCE = 0.001

# Category walk defaults and namespaces.
MAX_DEPTH = 1
MAX_PAGES = 100
NS_MAIN = 0
NS_CATEGORY = 14

# Domain -> categories, in listing order.
DOMAIN_MAP = {
    "Physics": ["物理学", "物理現象", "力学", "電磁気学", "量子力学", "相対性理論"],
    "Medical": ["医学", "医療", "疾患", "解剖学", "薬学", "公衆衛生学"],
    "Technology": ["技術", "工学", "コンピュータ", "ソフトウェア", "人工知能", "ロボット工学"],
    "Literature": ["文学", "小説", "詩", "文学作品", "文学理論", "作家"],
    "History": ["歴史", "古代史", "中世史", "近代史", "考古学", "文明"],
    "Companies": ["企業", "会社", "ビジネス", "多国籍企業", "スタートアップ企業"],
    "Finance": ["金融", "経済学", "投資", "銀行", "株式市場", "保険"],
    "Industry": ["産業", "製造業", "農業", "鉱業", "エネルギー産業", "自動車産業"],
    "Arts": ["芸術", "絵画", "彫刻", "建築", "音楽", "演劇", "映画"],
}

# --- tables built from a rule ----------------------------------------------------------

# Katakana U+30A1..U+30F6 map to hiragana 0x60 lower; the prolonged sound mark stays.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))

ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_UPPER = ASCII_LOWER.upper()


def _ranges(codepoints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in codepoints:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _class_body(codepoints: list[int]) -> str:
    parts = []
    for lo, hi in _ranges(codepoints):
        parts.append(f"\\x{{{lo:04X}}}" if lo == hi else f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}")
    return "".join(parts)


# Unicode whitespace exactly as Python's str.isspace / str.strip / re "\s" see it. Java's
# "\s" is ASCII only and Spark's trim removes only U+0020, so the class is spelled out.
# The \x{...} escapes are read the same way by Java regex and by RE2 (DuckDB).
WHITESPACE_CODEPOINTS = [c for c in range(0x110000) if chr(c).isspace()]
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)
WS_CLASS = "[" + _class_body(WHITESPACE_CODEPOINTS) + "]"
NOT_WS_CLASS = "[^" + _class_body(WHITESPACE_CODEPOINTS) + "]"


# Blocks whose characters are mostly untouched by NFKC: Latin, Japanese punctuation and
# kana, unified ideographs. A character is inert when NFKC keeps it and it does not combine
# with the one before it; a string of inert characters is its own NFKC form.
_INERT_BLOCKS = [*range(0x250), *range(0x3000, 0x3100), *range(0x4E00, 0xA000)]
NOT_NFKC_INERT = "[^" + _class_body([
    c for c in _INERT_BLOCKS if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c))]) + "]"

# A few plain ranges inside the inert blocks (ASCII, Latin-1 letters, kana, ideographs): the
# regex engine walks a long class range by range, so most strings are told by this short one.
PLAIN_RANGES = ((0x00, 0x7F), (0xC0, 0xFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF))
NOT_PLAIN = "[^" + "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in PLAIN_RANGES) + "]"


def char_class(chars: str, negate: bool = False) -> str:
    """Regex class matching any of ``chars`` (escaped for Java and RE2)."""
    cps = sorted({ord(c) for c in chars})
    return ("[^" if negate else "[") + _class_body(cps) + "]"


def range_class(lo: str, hi: str) -> str:
    return f"[\\x{{{ord(lo):04X}}}-\\x{{{ord(hi):04X}}}]"


_WORD_CLASS_BODY: list[str] = []  # memo; a plain global, so functions still pickle by value


def word_class_body() -> str:
    """Body of a regex class of Python's Unicode word characters (``\\w`` on str), built
    by testing every code point. Java's ``(?U)\\w`` differs: it adds combining marks and
    connector punctuation and leaves out numeric symbols such as circled digits."""
    if not _WORD_CLASS_BODY:
        _WORD_CLASS_BODY.append(_class_body(
            [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and re.match(r"\w", chr(c))]))
    return _WORD_CLASS_BODY[0]
