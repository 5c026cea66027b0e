"""Token ids of texts by a public tokenizer file, words cached.

Where white space always separates tokens, a text's ids are the ids of its words one after
the other, so each distinct word is tokenized once per worker. For the common setting of
lower-cased byte-pair words, plain Latin words are cut by the tokenizer's own split pattern
and handed to its model directly; all others go through the whole tokenizer.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

#: Words and pieces that a worker remembers at most; beyond it starts anew.
CACHE_WORDS = 600_000

#: The setting for which the short way holds (fixed values of the tokenizer file).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Latin letters up to U+024F without U+0130 (its lower case has a combining mark), digits
#: and printable ASCII: normalization C leaves them, lower-casing goes letter by letter.
_PLAIN = re.compile("[!-~À-įı-ɏ]+").fullmatch


class WordTokenizer:
    """ids(text as UTF-8 bytes) -> little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.by_word = ((spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and len(steps) == 2
                        and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
                        and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and steps[1] == _BYTES)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        if self.by_word:
            import regex
            from tokenizers.pre_tokenizers import ByteLevel

            self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
            self.model = self.whole.model
            self.special = [t["content"] for t in spec.get("added_tokens") or []]

    def _cut(self, text: str) -> list[str]:
        """Pieces by the split pattern; letters alone, or with one mark behind, need no regex."""
        if text.isalpha():
            return [text]
        if text[-1] in ".,!?:;" and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.split(text)

    def _plain(self, text: str) -> bytes:
        out = []
        for piece in self._cut(text.lower()):
            got = self.pieces.get(piece)
            if got is None:
                mapped = piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]
                ids = [t.id for t in self.model.tokenize(mapped)]
                got = struct.pack(f"<{len(ids)}I", *ids)
                self.pieces[piece] = got
            out.append(got)
        return b"".join(out)

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        for w in words:
            if w not in self.words:
                text = w.decode("utf-8", "replace")
                plain = _PLAIN(text) and not ("<" in text and any(s in text for s in self.special))
                self.words[w] = self._plain(text) if plain else self._encode(text)

    def ids(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._encode(text.decode("utf-8", "replace"))
        # ASCII letters may be lowered ahead of the tokenizer, unless that could make a
        # special token of them.
        words = (text if b"<|" in text else text.lower()).split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.words.__getitem__, words))


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
