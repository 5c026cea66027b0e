"""Token counts by rank-synchronous array merging.

A byte-level byte-pair tokenizer cuts a text into pre-tokens and merges the symbols of each,
lowest rank first. Here the pre-tokens of a whole batch of texts lie behind one another in
one flat array of symbols, ragged by an array of owners. In every round each sequence finds
its lowest-ranked neighbouring pair and merges all its occurrences at once (of overlapping
ones every other, from the left), until no sequence has a pair with a rank; what is left is
counted. That equals merging one pair after the other, since a pair that holds a new symbol
always ranks behind the merge that made the symbol (checked when the file is loaded).

Sequences above ``LONG`` symbols would need a round for each rank that occurs in them, over all
of their symbols. They are linked lists in arrays instead, and a heap of ranks names the places
of each rank; the places of one rank are merged together, in all sequences.

Texts are cut before every space that a non-space follows, where a pre-token always begins.
Each distinct chunk is merged once per worker and batch, and remembered.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import filterfalse

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Chunks that a worker remembers at most; beyond it starts anew.
CACHE_CHUNKS = 600_000
#: Characters of text that are cut into chunks at a time (a longer text is cut alone).
SLICE = 2_000_000
#: Symbols from which a sequence is merged rank by rank instead of in rounds.
LONG = 256
#: Split pattern of byte-level tokenizers (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII, Latin letters, Greek, Cyrillic, dashes and quotes: every version of Unicode has the
#: same letters, digits and spaces here. Other texts are cut by the tokenizer's own library.
_SETTLED = regex.compile("[\x00-\x7f\xa0-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԓ‐-‧]*").fullmatch
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 characters
    stand for themselves, all other bytes for letters from U+0100 on, in order."""
    own = set(range(ord("!"), ord("~") + 1)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairMerger:
    """Merges of a byte-level vocabulary: symbols in, numbers of surviving symbols out."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[c] for c in byte_letters()], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(merges))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes, or a symbol has several merges")
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); _NONE where no merge has them."""
        if not len(self.keys):
            return np.full(len(a), _NONE, np.int32)
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that each piece ends with."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        for some, merge in ((np.flatnonzero((n > 0) & (n <= LONG)), self._in_rounds), (np.flatnonzero(n > LONG), self._by_rank)):
            if len(some):
                symbols = self.first[np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)]
                out[some] = merge(symbols, np.repeat(np.arange(len(some)), n[some]), len(some))
        return out

    def _in_rounds(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        ranks = self._pair_ranks(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))  # of each sequence
            low = np.minimum.reduceat(ranks, first)
            length = np.diff(np.append(first, len(owner)))
            done = low == _NONE
            out[owner[first[done]]] = length[done]
            hit = (ranks == np.repeat(low, length)) & (ranks != _NONE)
            at = np.flatnonzero(hit)
            at = at[_alternate(at)]
            keep = ~np.repeat(done, length)
            symbols[at] = self.made[ranks[at]]
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
            ranks = self._pair_ranks(symbols, owner)
        return out

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; _NONE at the end of a sequence."""
        ranks = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return ranks

    def _by_rank(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        end = len(symbols)  # a place behind all others, of no sequence
        after, before = np.arange(1, end + 1), np.arange(-1, end - 1)
        same = owner[1:] == owner[:-1]
        after[:-1][~same], before[1:][~same] = end, -1
        ranks = np.append(self._pair_ranks(symbols, owner), _NONE)
        alive = np.ones(end, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[ranks[at] != _NONE]
            order = np.argsort(ranks[at], kind="stable")
            at = at[order]
            for group in np.split(at, np.flatnonzero(np.diff(ranks[at])) + 1) if len(at) else ():
                r = int(ranks[group[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(group)

        note(np.arange(end))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (ranks[at] == r)]
            if not len(at):
                continue
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            at = at[_every_other(chained)]
            gone = after[at]
            symbols[at], alive[gone], ranks[gone] = self.made[r], False, _NONE
            follow = after[gone]
            after[at] = follow
            before[follow[follow < end]] = at[follow < end]
            touched = np.concatenate([at, before[at][before[at] >= 0]])
            touched = np.unique(touched)
            nxt = after[touched]
            ranks[touched] = np.where(nxt < end, self.rank(symbols[touched], symbols[np.minimum(nxt, end - 1)]), _NONE)
            note(touched)
        return np.bincount(owner[alive], minlength=n)


def _every_other(chained: np.ndarray) -> np.ndarray:
    """Of runs of overlapping places (each chained to the one before it), every other one,
    beginning with the first of each run."""
    i = np.arange(len(chained))
    return (i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0


def _alternate(at: np.ndarray) -> np.ndarray:
    return _every_other(np.diff(at, prepend=-2) == 1) if len(at) else np.zeros(0, bool)


class TokenCounter:
    """count(texts) -> numbers of tokens, as the tokenizer's library gives them without begin
    or end tokens; special strings inside texts are tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {"add_prefix_space": False, "use_regex": True, "type": "ByteLevel"}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model.get("type") != "BPE" or spec.get("normalizer") or odd or model.get("ignore_merges") or any(pre.get(k) != v for k, v in plain.items()):
            raise ValueError(f"{path} is no plain byte-level byte-pair tokenizer")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = PairMerger(model["vocab"], pairs)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        # Added tokens with other flags than plain ones are left to the library.
        self.plain_added = not any(t[k] for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pre = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile(r" (?=\S)").split
        self.bare: dict[str, int] = {}  # tokens of a chunk
        self.spaced: dict[str, int] = {}  # tokens of a chunk with a space in front

    def _cut(self, text: str) -> tuple[int, list[str], list[str]]:
        """(tokens so far, chunks, chunks that stand behind a space): the chunks' tokens and
        those so far are the text's."""
        # A line break between two non-spaces is a token alone.
        lines = text.split("\n") if "\n" in text and not _EDGE(text) else [text]
        bare, spaced = [], []
        for line in lines:
            first, *rest = self.cut(line) if _wide(line) else line.split(" ")
            bare.append(first)
            spaced += rest
        return len(lines) - 1, bare, spaced

    def _pretokens(self, chunk: str) -> list[bytes]:
        if _SETTLED(chunk):
            return [x.encode() for x in self.split(chunk)]
        return [bytes(map(self.bytes_of.__getitem__, x)) for x, _ in self.pre(chunk)]

    def _learn(self, bare: list[str], spaced: list[str]) -> None:
        cut = [self._pretokens(c) for c in bare] + [self._pretokens(" " + c) for c in spaced]
        pieces = list({p for ps in cut for p in ps})
        n = dict(zip(pieces, self.merger.counts(pieces).tolist()))
        totals = [n[ps[0]] if len(ps) == 1 else sum(map(n.__getitem__, ps)) for ps in cut]
        self.bare.update(zip(bare, totals))
        self.spaced.update(zip(spaced, totals[len(bare):]))

    def _parts(self, text: str) -> tuple[int, list[str], list[str]]:
        special = [a for a in self.added if a in text]
        if not special:
            return self._cut(text)
        if not self.plain_added:
            return len(self.library.encode(text, add_special_tokens=False).ids), [], []
        # The longest of the special strings wins where several begin.
        parts = regex.split("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text)
        cut = [self._cut(p) for p in parts]
        return len(parts) - 1 + sum(n for n, _, _ in cut), [x for _, b, _ in cut for x in b], [x for _, _, s in cut for x in s]

    def count(self, texts: list[str]) -> list[int]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(self._parts(text))
            size += len(text)
            if size > SLICE:
                out += self._flush(held)
                held, size = [], 0
        return out + self._flush(held)

    def _flush(self, held) -> list[int]:
        for known in (self.bare, self.spaced):
            if len(known) > CACHE_CHUNKS:
                known.clear()
        bare, spaced = set(), set()
        for _, b, s in held:
            bare.update(filterfalse(self.bare.__contains__, b))
            spaced.update(filterfalse(self.spaced.__contains__, s))
        if bare or spaced:
            self._learn(list(bare), list(spaced))
        return [n + sum(map(self.bare.__getitem__, b)) + sum(map(self.spaced.__getitem__, s)) for n, b, s in held]


#: A line break that has white space or an end of the text beside it; a space that has white
#: space or the end behind it. Python's white space holds all that the split pattern's does.
_EDGE = re.compile(r"\n(?=\s|\Z)|(?<=\s)\n|\A\n").search
_WIDE = re.compile(r" (?=\s|\Z)").search


def _wide(line: str) -> bool:
    """Whether a space is not followed by a non-space. A printable line has no white space
    but spaces."""
    return "  " in line or line.endswith(" ") if line.isprintable() else _WIDE(line) is not None

_LOADED: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of a file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = TokenCounter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024, tokens_as: str = "n_tokens",
                 bytes_as: str = "n_bytes", over_as: str = "over_limit") -> DataFrame:
    """``docs`` with the number of UTF-8 bytes and tokens of every whole text, and whether it
    has more than ``limit`` tokens; one pass, no shuffle.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted as often as
    they occur. A column of the input that has one of the three names is replaced, the text
    too if it has one of them; an empty table gives an empty result."""
    @pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(tokenizer_path).count(texts.tolist()), dtype="int64")

    text, names = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), {bytes_as.lower(), tokens_as.lower(), over_as.lower()}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    out = docs.select(*rest, F.octet_length(text).cast("long").alias(bytes_as), tokens(text).alias(tokens_as))
    return out.withColumn(over_as, F.col(f"`{tokens_as}`") > limit)
