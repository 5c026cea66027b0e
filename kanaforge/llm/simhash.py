"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three blocks of 23, 23 and 18 bits. Two fingerprints
that differ in at most t bits agree in one block up to t // 3 bits. The anchors of a block
are the codewords of the perfect binary Golay code of length 23: every block value lies
within the covering radius 3 of exactly one codeword, its home. A fingerprint is copied to
every anchor within covering radius plus t // 3 of its block, so the home anchor of either
partner holds both; inside an anchor each home fingerprint is compared with all copies.

Equal fingerprints meet once (they are made distinct first), and an anchor with many homes
is split into parts of bounded size, each with all its copies. A part reports a spanning
forest of its links, not the pairs.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, materialize, text_hash
from .components import connected_components

#: First bit and number of bits of each block.
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
COVERING_RADIUS = 3
#: Homes that one part of an anchor holds at most.
PART_HOMES = 8192


# --- fingerprints -----------------------------------------------------------------------

def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Majority bits of the shingles' XXH64 (seed 42), as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = partial(xxhash.xxh64_digest, seed=42)
    raw = np.frombuffer(b"".join(map(digest, grams)), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[k:k + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprint_udf(shingle: int = 4):
    """Column function: text as binary -> fingerprint as (signed) long."""
    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64), dtype="int64")

    return of


def hex_fingerprint(col) -> F.Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


# --- anchors ----------------------------------------------------------------------------

def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator."""
    v = v.astype(np.int64)
    for bit in range(22, 10, -1):
        v = np.where((v >> bit) & 1, v ^ (GOLAY << (bit - 11)), v)
    return v


def error_patterns(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the errors of at most ``radius`` bits, lightest first, as one array with
    the first place and the number of each syndrome's entries. The lightest leads home."""
    errors = np.array([sum(1 << i for i in bits) for w in range(radius + 1) for bits in itertools.combinations(range(23), w)], np.int64)
    syn = _syndromes(errors)
    order = np.argsort(syn, kind="stable")  # the errors come by weight
    counts = np.bincount(syn, minlength=2048)
    return errors[order], np.concatenate([[0], np.cumsum(counts)[:-1]]), counts


def anchors(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home): every copy of every fingerprint (unsigned 64-bit)."""
    errors, first, counts = error_patterns(COVERING_RADIUS + max_bits // len(BLOCKS))
    rows, keys, homes = [], [], []
    for b, (low, width) in enumerate(BLOCKS):
        x = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = _syndromes(x)
        n = counts[s]
        row = np.repeat(np.arange(len(fps)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(row)
        keys.append((x[row] ^ errors[first[s[row]] + nth]) | (b << 23))
        homes.append(nth == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(homes: np.ndarray, members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (member, root) of a spanning forest of the links between homes and members;
    ``members`` holds the homes too."""
    label = np.arange(len(members))
    step = max(1, (1 << 22) // max(1, len(members)))
    for k in range(0, len(homes), step):
        near = np.bitwise_count(homes[k:k + step, None] ^ members[None, :]) <= max_bits
        for row in near[near.sum(axis=1) > 1]:
            roots = np.unique(label[row])
            if len(roots) > 1:
                label[np.isin(label, roots[1:])] = roots[0]
    moved = np.flatnonzero(label != np.arange(len(members)))
    return list(zip(members[moved].tolist(), members[label[moved]].tolist()))


def _groups(batches):
    """Cut sorted Arrow batches into whole groups of equal (anchor, part)."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < (1 << 16):
                continue
        t = pa.Table.from_batches(held) if held else None
        if t is None or not t.num_rows:
            continue
        key = t.column("anchor").to_numpy() * (1 << 20) + t.column("part").to_numpy()
        fp, home = t.column("fp").to_numpy(), t.column("home").to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        end = len(key) if batch is None else (cuts[-1] if len(cuts) else 0)
        starts = [0, *[c for c in cuts if c < end]]
        if end:
            for s, e in zip(starts, [*starts[1:], end]):
                yield fp[s:e].astype(np.uint64), home[s:e]
        held = t.slice(end).to_batches() if end < len(key) else []


def fingerprint_links(fps: DataFrame, max_bits: int = 4, part_homes: int = PART_HOMES) -> DataFrame:
    """(a, b): links between distinct fingerprints at most ``max_bits`` bits apart, as
    spanning forests whose components are those of all such links. ``fps`` has one column
    ``fp`` (long); nulls are ignored."""
    def load(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            _, key, home = anchors(x, max_bits)
            key, n = np.unique(key[home], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n.astype(np.int64), pa.int64())], ["anchor", "n"])

    fps = materialize(fps.where("fp IS NOT NULL").select("fp").distinct())
    # At most 3 x 4096 anchors exist, so this table is bounded whatever the input.
    hot = fps.mapInArrow(load, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > part_homes).collect()
    parts = {r["anchor"]: -(-r["n"] // part_homes) for r in hot}

    def spread(batches):
        hot_keys = np.array(sorted(parts), np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            row, key, home = anchors(x, max_bits)
            part = np.zeros(len(key), np.int64)
            if len(hot_keys):
                is_hot = np.isin(key, hot_keys)
                at = np.flatnonzero(is_hot)
                n = np.array([parts[k] for k in key[at].tolist()], np.int64)
                own = ((x[row[at]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(n, 1)
                copy = np.repeat(np.arange(len(at)), n)
                to = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                cold = np.flatnonzero(~is_hot)
                row = np.concatenate([row[cold], row[at][copy]])
                home = np.concatenate([home[cold], home[at][copy] & (to == own[copy])])
                key = np.concatenate([key[cold], key[at][copy]])
                part = np.concatenate([part[cold], to])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part, pa.int64()), pa.array(x[row].view(np.int64), pa.int64()), pa.array(home)], ["anchor", "part", "fp", "home"])

    def compare(batches):
        for fp, home in _groups(batches):
            edges = forest(fp[home], fp, max_bits)
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    spread_out = fps.mapInArrow(spread, "anchor long, part long, fp long, home boolean")
    return spread_out.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(compare, "a long, b long")


# --- the operator -----------------------------------------------------------------------

def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row.

    fp: fingerprint as long; root: smallest fingerprint of the component; component_id: the
    smallest id reachable over links of at most ``max_bits`` differing bits. Null and empty
    texts have fingerprint 0 and are linked like any other. Null ids are rows of their own
    but never a component_id unless all ids of the component are null. Repeated rows come
    back as often as they are put in."""
    keyed = materialize(docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
                                    fingerprint_udf(shingle)(F.col(text_col).cast("binary")).alias("fp")))
    by_fp = keyed.groupBy("fp").agg(F.min("doc_id").alias("low_id"))
    comp = connected_components(fingerprint_links(keyed.select("fp"), max_bits))
    rooted = by_fp.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    low = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return keyed.join(rooted.select("fp", "root").join(low, "root"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id
    (of repeated rows with that id, one).

    Which (id, text) pairs go is settled on narrow rows, so texts are shuffled once at most.
    Only pairs that stay and occur more than once take a second step, over their own rows."""
    key, hashed, own = fresh(docs, "dedup_key", "dedup_hash", "dedup_own")
    groups = simhash_groups(docs, id_col, text_col, shingle, max_bits)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"))
    pairs = groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(first, "root", "left")
    stays = F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))
    # What goes from the whole table: pairs that lose, and repeated ones, which come back once.
    pairs = materialize(pairs.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed), stays.alias("stays"), "n").where("NOT stays OR n > 1"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mine = docs.withColumn(own, text_hash(F.col(f"`{text_col}`")))
    met = lambda p: mine[id_col].eqNullSafe(p[key]) & (mine[own] == p[hashed])
    kept = mine.join(pairs, met(pairs), "left_anti").select(*columns)
    again = pairs.where("stays")
    if again.isEmpty():
        return kept
    return kept.unionByName(mine.join(again, met(again), "left_semi").dropDuplicates([id_col, own]).select(*columns))
