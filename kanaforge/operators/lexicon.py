"""Readings and dictionary conversion (AGG-4, LEX-1..3).

The longest-match conversion is the greedy left-to-right scan of a dictionary-based
converter: at each position take the longest dictionary key that starts there (and
emit its value), else pass one character through. A dictionary of measured size is
copied to every task, which scans its own lines once (Arrow batches, no shuffle); a
larger one is joined with the distinct substrings of chunks of lines that pass a bit set over
its keys, and every chunk is converted against its own part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.matching import Bloom, FlatDictionary, Windows, code_points, in_slices
from ..functions.text import katakana_to_hiragana, reading_of, strip_ws
from ..session import write_once
from .bloom import bloom_of


def concat_readings(tokens: DataFrame, line: str = "line_no", pos: str = "pos", surface: str = "surface",
                    feature: str = "feature", out: str = "reading") -> DataFrame:
    """AGG-4 (with TXT-13): one reading per line, the readings of its tokens in token
    order. The tokens of one line are bounded by the line's length."""
    r = tokens.select(line, pos, reading_of(F.col(surface), F.col(feature)).alias("_r"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("_r"))))
    return r.groupBy(line).agg(F.array_join(F.transform(ordered, lambda x: x["_r"]), "").alias(out))


def build_lexicon(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """LEX-2: the most frequent value of each key; ties go to the smaller value.
    Output (key, value, n). Counting is a partial aggregate, so a hot key is combined
    map-side before the shuffle."""
    counts = pairs.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("n").alias("c")), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(key).agg(best.alias("_b")).select(
        F.col(key).alias("key"), F.col("_b.v").alias("value"), F.col("_b.c").cast("long").alias("n"))


# Largest dictionary, in bytes of its arrays, that every task gets a copy of.
BROADCAST_MAX_BYTES = 32 << 20
# Characters of the lines of one chunk (a longer line is one alone).
CHUNK = 1 << 23


def _map_side(lines: DataFrame, lexicon: DataFrame, text: Column, out: str) -> DataFrame:
    """Every task converts its own lines against a copy of the dictionary; no shuffle."""
    rows = lexicon.toArrow()
    bound = lines.sparkSession.sparkContext.broadcast(FlatDictionary(rows.column("key").to_pylist(), rows.column("value").to_pylist()))

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return pd.Series(bound.value.convert(texts.tolist()), dtype=object)

    return lines.withColumn(out, convert(text))


def _windows_of_keys(texts: Sequence[str], prefixes: Bloom, keys: Bloom, longest: int) -> set[str]:
    """The distinct substrings that may be keys. A window grows by a character while it may begin
    a key, so most places are left after a few."""
    found: set[str] = set()
    for part in in_slices(texts):
        codes, starts = code_points(part)
        joined, windows, end = "".join(part), Windows(codes), np.repeat(starts[1:], np.diff(starts))
        at = np.arange(len(codes))
        for k in range(1, longest + 1):
            at = at[at + k <= end[at]]
            hashes = windows.hashes(at, k)
            alive = prefixes.has(hashes)
            at, hashes = at[alive], hashes[alive]
            if not len(at):
                break
            hit = keys.has(hashes)
            some = at[hit]
            _, first, group = np.unique(hashes[hit], return_index=True, return_inverse=True)
            same = np.ones(len(some), bool)  # as the one that stands for its hash
            for i in range(k):
                same &= codes[some + i] == codes[some[first][group] + i]
            found.update(joined[p:p + k] for p in [*some[first].tolist(), *some[~same].tolist()])
    return found


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _by_chunks(base: DataFrame, lexicon: DataFrame, entries: int, chars: int, longest: int, text: str, out: str) -> DataFrame:
    """The same conversion for a dictionary too large to copy. The lines are written in chunks of
    bounded size, packed as compressed Arrow; the distinct substrings of a chunk that pass a bit
    set over the keys (nearly all of them are keys) are joined with the dictionary, and each chunk
    is converted against the entries that can occur in it. Moved are the packed lines, once, and
    the distinct words of a chunk. No match crosses a character that no key has, so a chunk's
    distinct runs of the keys' characters are searched and converted, each once; a run that is a
    key is its own longest match."""
    spark = base.sparkSession
    letters = lexicon.select(F.explode(F.split("key", "")).alias("c")).filter(F.length("c") > 0).distinct().toArrow()
    runs = re.compile("([" + "".join(sorted(map(re.escape, letters.column("c").to_pylist()))) + "]+)")

    def deal(batches):
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for n in pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist():
                if size and size + n > CHUNK:
                    chunk, size = chunk + 1, 0
                numbers.append(chunk)
                size += n
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            pieces = [(numbers[x], _packed(batch.slice(x, y - x))) for x, y in zip(cuts, cuts[1:]) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pieces], pa.int64()), pa.array([p for _, p in pieces], pa.binary())], ["_chunk", "_lines"])

    dealt = write_once(base.mapInArrow(deal, "_chunk long, _lines binary"))
    bound = spark.sparkContext.broadcast((bloom_of(lexicon, "key", chars, prefixes=True), bloom_of(lexicon, "key", entries)))

    def runs_of(lines: pa.Table) -> set[str]:
        return {r for t in lines.column(text).to_pylist() if t for r in runs.findall(t)}

    def candidates(batches):
        def rows(chunk, found):
            found = _windows_of_keys(list(found), *bound.value, longest)
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), pa.array(list(found), pa.string())], ["_chunk", "key"])

        now, found = None, set()
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now != chunk:
                    if found:
                        yield rows(now, found)
                    now, found = chunk, set()
                found |= runs_of(_unpacked(packed))
        if found:
            yield rows(now, found)

    cand = dealt.mapInArrow(candidates, "_chunk long, key string")
    words = cand.join(lexicon, on="key", how="inner").select("_chunk", "key", "value")
    result = StructType([*base.schema.fields, StructField(out, StringType())])

    def convert(pieces: pa.Table, words: pa.Table) -> pa.Table:
        own = dict(zip(words.column("key").to_pylist(), words.column("value").to_pylist()))
        lines = pa.concat_tables([_unpacked(p) for p in pieces.column("_lines")])
        rest = [r for r in runs_of(lines) if r not in own]
        if rest:
            own |= dict(zip(rest, FlatDictionary(list(own), list(own.values())).convert(rest)))
        done = []
        for t in lines.column(text).to_pylist():
            if t:
                parts = runs.split(t)  # every second one is a run
                parts[1::2] = map(own.__getitem__, parts[1::2])
                t = "".join(parts)
            done.append(t)
        return lines.append_column(out, pa.array(done, pa.string()))

    return dealt.groupBy("_chunk").cogroup(words.groupBy("_chunk")).applyInArrow(convert, result)


def longest_match(lines: DataFrame, lexicon: DataFrame, line: str = "line_id", text: str = "text",
                  out: str = "converted", broadcast_max_bytes: int = BROADCAST_MAX_BYTES,
                  keep: Sequence[str] = ()) -> DataFrame:
    """LEX-1: convert each line by greedy longest match against ``lexicon`` (key,
    value); characters no key covers pass through unchanged. Keys must be unique; empty
    and null keys match nothing. ``keep``: columns of ``lines`` carried to the output.

    The dictionary is written once and measured. Up to ``broadcast_max_bytes`` of its arrays
    every task holds a copy and converts its lines in one linear pass without a shuffle; a
    larger dictionary is joined with the substrings that may be its keys, chunk by chunk of the
    lines, with the same answer.
    A key without a value matches nothing."""
    lexicon = write_once(lexicon.select("key", "value").filter((F.length("key") > 0) & F.col("value").isNotNull()))
    size = lexicon.agg(F.sum(4 * (F.length("key") + F.length("value")) + 40).alias("bytes"), F.count("*").alias("entries"),
                       F.sum(F.length("key")).alias("chars"), F.max(F.length("key")).alias("longest")).first()
    base = lines.select(F.col(line).alias("_line"), F.col(text).alias("_text"), *keep)
    if (size["bytes"] or 0) <= broadcast_max_bytes or not size["entries"]:
        done = _map_side(base, lexicon, F.col("_text"), "_out")
    else:
        done = _by_chunks(base, lexicon, size["entries"], size["chars"], size["longest"], "_text", "_out")
    return done.select(F.col("_line").alias(line), *keep, F.col("_out").alias(out))


def assign_readings(lines: DataFrame, lexicon: DataFrame, line: str = "line_id", text: str = "text",
                    out: str = "reading") -> DataFrame:
    """LEX-1 as reading assignment: written line -> reading by longest dictionary
    match; unknown characters pass through (the analyser's '*' fallback)."""
    return longest_match(lines.select(line, strip_ws(F.col(text)).alias(text)), lexicon, line, text, out)


def dictionary_convert(lines: DataFrame, lexicon: DataFrame, line: str = "line_id", text: str = "text",
                       out: str = "converted", keep: Sequence[str] = ()) -> DataFrame:
    """LEX-3: the dictionary baseline: strip, katakana -> hiragana (TXT-9), then the
    longest-match fold with a reading -> surface lexicon. Blank in, blank out."""
    prepared = lines.select(line, katakana_to_hiragana(strip_ws(F.col(text))).alias(text), *keep)
    return longest_match(prepared, lexicon, line, text, out, keep=keep)
