"""Exact substring dedup over a sparse suffix array.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else, in
the same document or another one. A suffix array sorts every suffix; here only suffixes that
can repeat are sorted:

1. Every window of ``length`` bytes names the smallest of its k-byte grams (by hash, the
   leftmost of equal ones) as its leading token. Equal windows name the same gram at the
   same place, so windows with different leading tokens never need comparing. Neighbouring
   windows that name one occurrence form a block.
2. Blocks are counted by leading token and digest. A token with one block repeats nowhere;
   equal blocks repeat as a whole. Only where a token leads several different blocks are
   bytes needed, of one block each.
3. Those blocks are range-partitioned by leading token with Spark's sampled splitters, and
   each bucket sorts the suffixes that start at the blocks' windows by multikey quicksort,
   eight bytes at a time, dropping suffixes as soon as they are alone. A token is never cut
   by a splitter, and suffixes of different tokens cannot match, so no pair straddles two
   buckets - except for a token with more than ``hot`` different blocks, whose suffixes are
   digested one by one and counted across all buckets by aggregation.
4. Repeated windows become spans of each document.

Digests are 128 bits wide; the sorted comparison is on the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import materialize

LENGTH = 400
GRAM = 64
#: Different blocks of one leading token that a single task sorts at most.
HOT = 4096
#: Bytes that are looked at together; a longer text is cut into overlapping segments.
SEGMENT = 1 << 20
#: Bytes of blocks that are sorted together.
SORT_BYTES = 4 << 20

_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse."""
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            one = np.ones(1, np.uint64)
            both = [np.concatenate([one, np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_B, pow(_B, -1, 1 << 64))]
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from every place, a function of those bytes alone."""
    up, down = _powers(len(data) + 1)
    code = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[:len(data)])])
    h = (sums[k:] - sums[:-k]) * down[:len(data) - k + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def leading_tokens(h: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` grams the place of the smallest (leftmost of equal ones)."""
    n = len(h) - width + 1
    key = (h >> np.uint64(22) << np.uint64(22)) | np.arange(len(h), dtype=np.uint64)
    pad = np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)
    tiles = np.concatenate([key, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
    return (low & np.uint64((1 << 22) - 1)).astype(np.int64)


def blocks(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT):
    """(text number, first window, number of windows, place of the token in the block, token,
    digest as two longs) as arrays, for texts that are looked at together."""
    parts = []
    packed: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        data = b"".join(d for _, _, d in packed)
        arr = np.frombuffer(data, np.uint8)
        h = gram_hashes(arr, gram)
        at = leading_tokens(h, length - gram + 1)
        sizes = np.array([len(d) - length + 1 for _, _, d in packed])
        begin = np.concatenate([[0], np.cumsum([len(d) for _, _, d in packed])[:-1]])
        windows = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        own = np.repeat(np.arange(len(packed)), sizes)
        p = at[windows]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (own[1:] != own[:-1])]))
        n = np.diff(np.concatenate([first, [len(p)]]))
        lo, token = windows[first], p[first]
        view = memoryview(data)
        raw = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist()))
        digest = np.frombuffer(raw, "<i8").reshape(-1, 2)
        which = own[first]
        text = np.array([t for t, _, _ in packed])[which]
        start = lo - begin[which] + np.array([s for _, s, _ in packed])[which]
        parts.append((text, start, n, token - lo, h[token].view(np.int64), digest[:, 0], digest[:, 1]))
        packed.clear()

    for t, data in enumerate(texts):
        for s in range(0, max(0, len(data) - length + 1), segment):
            piece = data[s:s + segment + length - 1]
            if held + len(piece) > 2 * segment:
                flush()
                held = 0
            packed.append((t, s, piece))
            held += len(piece)
    if packed:
        flush()
    if not parts:
        return [np.zeros(0, np.int64)] * 7
    return [np.concatenate(c).astype(np.int64) for c in zip(*parts)]


def repeated_windows(data: bytes, starts: np.ndarray, classes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``length`` bytes with another
    one of their class: multikey quicksort on eight-byte characters. Groups of suffixes that
    agree so far are only sorted anew when they disagree, and lone suffixes leave."""
    arr = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ndarray((len(arr) - 7,), ">u8", buffer=arr, strides=(1,))
    idx = np.argsort(classes, kind="stable")
    group = classes[idx]

    def drop_lone(idx, group):
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        alone = head & np.concatenate([head[1:], [True]]) if len(group) else head
        head_kept = head[~alone]
        return idx[~alone], np.cumsum(head_kept), np.flatnonzero(head_kept)

    idx, group, head = drop_lone(idx, group)
    for at in range(0, length, 8):
        if not len(idx):
            break
        shift = min(at, length - 8)  # the last character may overlap the one before
        w = words[starts[idx] + shift].astype(np.uint64)
        differs = w != w[head][group - 1]
        if differs.any():
            mixed = np.zeros(len(head), bool)
            mixed[group[differs] - 1] = True
            places = np.flatnonzero(mixed[group - 1])
            order = np.lexsort((w[places], group[places]))
            idx[places], w[places] = idx[places][order], w[places][order]
            cut = np.concatenate([[True], (group[1:] != group[:-1]) | (w[1:] != w[:-1])])
            idx, group, head = drop_lone(idx, np.cumsum(cut))
    out = np.zeros(len(starts), bool)
    out[idx] = True
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    """Maximal runs of true places as (from, to), the end not included."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


BLOCK = "doc_id long, h1 long, h2 long, start int, n int, place int, token long, d1 long, d2 long"
_RUN = "array<struct<a:int,b:int>>"


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), F.xxhash64(data).alias("h1"),
                       F.xxhash64(F.lit(11), data).alias("h2"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, h1, h2, spans): for every document with repeated bytes the windows that
    repeat, as runs of starts (a to b, b not included); (h1, h2) hashes its text. A
    document's rows that repeat id and text share one row."""
    keyed = _with_key(docs, id_col, text_col)

    def cut(batches):
        for batch in batches:
            doc, data, h1, h2 = (batch.column(c) for c in range(4))
            for k in range(0, batch.num_rows, 256):
                texts = [x or b"" for x in data.slice(k, 256).to_pylist()]
                text, start, n, place, token, d1, d2 = blocks(texts, length, gram)
                take = pa.array(text + k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc.take(take), h1.take(take), h2.take(take), *(pa.array(x, t) for x, t in (
                        (start, pa.int32()), (n, pa.int32()), (place, pa.int32()), (token, pa.int64()), (d1, pa.int64()), (d2, pa.int64())))],
                    ["doc_id", "h1", "h2", "start", "n", "place", "token", "d1", "d2"])

    cuts = materialize(keyed.where(F.octet_length("data") >= length).mapInArrow(cut, BLOCK))
    key = ["token", "d1", "d2"]
    counted = cuts.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h1", "h2", "start", "n", "place")).alias("one"))
    led = counted.groupBy("token").agg(F.sum("copies").alias("occurs"), F.count("*").alias("kinds")).where("occurs > 1")
    counted = materialize(counted.join(led, "token"))

    # Bytes of one block of each kind, where a token leads several kinds.
    asked = counted.where("kinds > 1").groupBy("one.doc_id", "one.h1", "one.h2").agg(F.collect_list(F.struct(
        "token", "d1", "d2", "copies", F.col("one.start").alias("start"), F.col("one.n").alias("n"), F.col("one.place").alias("place"),
        (F.col("kinds") > hot).alias("hot"))).alias("asked"))

    def fetch(batches):
        names = ["token", "d1", "d2", "copies", "n", "place", "hot", "data"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            for data, asked in zip(batch.column(0), batch.column(1)):
                data, rows = data.as_py(), asked.as_py()
                out = [[r[c] for r in rows] for c in names[:-1]]
                out.append([data[r["start"]:r["start"] + r["n"] + length - 1] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])
    kinds = keyed.join(asked, same(keyed, asked)).select(keyed["data"], "asked").mapInArrow(
        fetch, "token long, d1 long, d2 long, copies long, n int, place int, hot boolean, data binary")
    kinds = materialize(kinds)

    def settle(rows: pa.Table):
        """Runs of repeated windows for whole tokens."""
        n, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "place"))
        token, copies = rows.column("token").to_numpy(), rows.column("copies").to_numpy()
        parts = rows.column("data").to_pylist()
        begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        own = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        number = np.unique(token, return_inverse=True)[1]
        # Windows of one token match only at equal distance from it; equal kinds (of
        # repeated rows) came in once.
        classes = number[own] * (1 << 20) + (place[own] - offset)
        found = repeated_windows(b"".join(parts), begin[own] + offset, classes, length)
        found |= copies[own] > 1
        ends = np.cumsum(n)
        return [_runs(found[e - m:e]) for e, m in zip(ends.tolist(), n.tolist())]

    def sort_bucket(batches):
        def done(table):
            names = ["token", "d1", "d2"]
            first = pd.DataFrame({c: table.column(c).to_numpy() for c in names}).duplicated().to_numpy()
            table = table.filter(pa.array(~first))
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in names), pa.array(settle(table), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], [*names, "runs"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SORT_BYTES:
                table = pa.Table.from_batches(held)
                token = table.column("token").to_numpy()
                end = int(np.searchsorted(token, token[-1], "left"))
                if end:
                    yield done(table.slice(0, end))
                    table = table.slice(end)
                held, size = table.to_batches(), table.nbytes
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield done(table)

    sorted_runs = kinds.where("NOT hot").repartitionByRange("token").sortWithinPartitions("token").mapInArrow(
        sort_bucket, f"token long, d1 long, d2 long, runs {_RUN}")

    # Suffixes of hot tokens: digests counted over all buckets.
    def digests(batches):
        for batch in batches:
            for r in batch.to_pylist():
                view = memoryview(r["data"])
                raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i:i + length]) for i in range(r["n"])), "<i8").reshape(-1, 2)
                at = np.arange(r["n"], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(np.full(r["n"], r[c], np.int64)) for c in ("token", "d1", "d2", "copies")), pa.array(at),
                    pa.array((r["place"] - at).astype(np.int32)), pa.array(raw[:, 0]), pa.array(raw[:, 1])],
                    ["token", "d1", "d2", "copies", "at", "distance", "w1", "w2"])

    suffixes = kinds.where("hot").dropDuplicates(key).mapInArrow(
        digests, "token long, d1 long, d2 long, copies long, at int, distance int, w1 long, w2 long")
    twice = suffixes.groupBy("token", "distance", "w1", "w2").agg(F.count("*").alias("c"), F.max("copies").alias("m")).where("c > 1 OR m > 1")
    hot_runs = suffixes.join(twice, ["token", "distance", "w1", "w2"]).groupBy(*key).agg(
        F.array_agg(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs"))

    lone = counted.where("kinds = 1").select(*key, F.array(F.struct(F.lit(0).alias("a"), F.col("one.n").alias("b"))).cast(_RUN).alias("runs"))
    runs = materialize(lone.unionByName(sorted_runs).unionByName(hot_runs.select(*key, F.col("runs").cast(_RUN).alias("runs"))).where(F.size("runs") > 0))
    at = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    return cuts.join(runs, key).select("doc_id", "h1", "h2", at.alias("spans")).groupBy("doc_id", "h1", "h2").agg(
        F.flatten(F.collect_set("spans")).alias("spans"))


def cut_out(data: bytes, spans, length: int = LENGTH) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, remaining bytes) for runs of repeated windows."""
    edge = np.zeros(len(data) + 1, np.int64)
    a = np.array([s["a"] for s in spans], np.int64)
    b = np.array([s["b"] for s in spans], np.int64) + length - 1
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; kept holds the remaining
    bytes (binary: a cut may split a character). Null text: as empty. Documents under
    ``length`` bytes keep all; ids may be null or repeated; repeated rows remove each other."""
    spans = repeated_spans(docs, id_col, text_col, length, gram, hot)
    keyed = _with_key(docs, id_col, text_col)
    joined = keyed.join(spans.toDF("span_id", "span_h1", "span_h2", "spans"), F.col("doc_id").eqNullSafe(F.col("span_id"))
                        & (F.col("h1") == F.col("span_h1")) & (F.col("h2") == F.col("span_h2")), "left")

    @pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(data: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [(0, 0, None) if s is None else cut_out(d, s, length) for d, s in zip(data, found)]
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    # Texts without spans stay out of Python.
    out = joined.withColumn("cut", cut(F.when(F.col("spans").isNotNull(), F.col("data")), F.col("spans")))
    return out.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.col("cut.n_removed").alias("n_removed"),
                      F.col("cut.n_spans").alias("n_spans"), F.coalesce("cut.kept", "data").alias("kept"))
