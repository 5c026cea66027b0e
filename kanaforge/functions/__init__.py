"""Column -> Column helpers."""

from . import constants
from .text import (
    ascii_lower,
    ascii_upper,
    char_array,
    char_set,
    collapse_ws,
    format_prompt,
    is_valid_alphabet,
    katakana_to_hiragana,
    nfkc,
    normalize_text,
    reading_of,
    remove_ws,
    render_article,
    slug,
    split_sentences_drop,
    split_sentences_keep,
    strip_chars,
    strip_markup,
    strip_ws,
    tagged_bodies,
    truncate,
)

__all__ = [
    "constants", "ascii_lower", "ascii_upper", "char_array", "char_set", "collapse_ws",
    "format_prompt", "is_valid_alphabet", "katakana_to_hiragana", "nfkc", "normalize_text",
    "reading_of", "remove_ws", "render_article", "slug", "split_sentences_drop",
    "split_sentences_keep", "strip_chars", "strip_markup", "strip_ws", "tagged_bodies",
    "truncate",
]
