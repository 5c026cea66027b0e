"""Best-fit packing by hierarchical residual packing.

Every partition packs its own items best fit, longest first, and emits the bins that are
nearly full. Underfull bins become items themselves: the partitions are merged in a tree
of small fan-in, and every node packs the bins of its children best fit again, emits what
is then nearly full and hands the rest up, until one node is left. A node of more than
``carry`` bins is packed in parts of about that many, mixed by hash, so every task is bounded
and every underfull bin still climbs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, materialize
from .tokens import tokenizer

FAN_IN = 8
CARRY = 50_000


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of every item and the fill of every bin; longest first, each into the
    fullest bin that still holds it. Free space is looked up in a bit set."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    some, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        free = some >> n
        if free:
            space = n + (free & -free).bit_length() - 1
            b = open_at[space].pop()
            if not open_at[space]:
                some &= ~(1 << space)
        else:
            b, space = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = space - n
        if left:
            open_at[left].append(b)
            some |= 1 << left
    return bins, offsets, fill


def pack(items: DataFrame, capacity: int = 4096, slack: int | None = None, fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """(item_id, sequence_id, offset) for ``items`` (item_id long, length long; other columns
    are dropped).

    Lengths lie between 0 and ``capacity``; a null or longer one is an error. Items of
    length 0 take a place of no width. Bins with at most ``slack`` free places (default: one
    in 128) are final at once. Sequence ids are arbitrary distinct numbers, offsets have no
    gaps. Repeated item ids are packed one by one."""
    slack = capacity // 128 if slack is None else slack

    def local(frames):
        got = [f for f in frames if len(f)]
        if not got:
            return
        f = pd.concat(got, ignore_index=True)
        n = f["length"]
        if n.isna().any() or n.max() > capacity or n.min() < 0:
            raise ValueError(f"item lengths must lie between 0 and {capacity}")
        bins, offsets, fill = best_fit(n.to_numpy(np.int64), capacity)
        node = TaskContext.get().partitionId()
        yield pd.DataFrame({"item_id": f["item_id"], "bin_id": bins + (node << 32), "offset": offsets, "node": node,
                            "fill": np.array(fill, np.int64)[bins], "ends": offsets + n.to_numpy(np.int64)})

    first = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("length").cast("long").alias("length"))
                        .mapInPandas(local, "item_id long, bin_id long, offset long, node int, fill long, ends long"))
    # One row of each underfull bin: its last item's, as ends = fill there alone (items of
    # length 0 may share the place, hence distinct).
    left = first.where((F.col("ends") == F.col("fill")) & (F.col("fill") < capacity - slack)).select("bin_id", "node", "fill").distinct()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        n = f["fill"].to_numpy(np.int64)
        bins, offsets, fill = best_fit(n, capacity)
        node = int(f["node"].iloc[0])
        fill = np.array(fill, np.int64)
        up = fill < capacity - slack
        # A merged bin takes the id of the child that opens it.
        head = np.zeros(len(fill), np.int64)
        head[bins[offsets == 0]] = f["bin_id"].to_numpy(np.int64)[offsets == 0]
        return pd.DataFrame({"bin_id": f["bin_id"], "node": node, "parent": head[bins], "base": offsets, "fill": fill[bins], "up": up[bins]})

    maps, nodes = [], (left.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        nodes = -(-nodes // fan_in)
        left = left.select("bin_id", "fill", F.floor(F.col("node") / fan_in).cast("int").alias("node"))
        sizes = left.groupBy("node").agg(F.ceil(F.count("*") / carry).cast("int").alias("parts")).where("parts > 1")
        parted = left.join(sizes, "node", "left").withColumn("part", F.pmod(F.xxhash64("bin_id"), F.coalesce("parts", F.lit(1))))
        step = materialize(parted.select("bin_id", "fill", "node", "part").groupBy("node", "part")
                           .applyInPandas(merge, "bin_id long, node int, parent long, base long, fill long, up boolean"))
        maps.append(step.select("bin_id", "parent", "base"))
        if nodes <= 1:
            break
        left = step.where("up AND bin_id = parent").select("bin_id", "node", "fill")
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        above = whole.select(F.col("bin_id").alias("parent"), F.col("parent").alias("top"), F.col("base").alias("more"))
        whole = m.join(above, "parent", "left").select("bin_id", F.coalesce("top", "parent").alias("parent"),
                                                       (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
    return first.join(whole, "bin_id", "left").select(
        "item_id", F.coalesce("parent", "bin_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


# --- documents --------------------------------------------------------------------------

def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, text_col: str = "text") -> DataFrame:
    """Every document's token ids, with ``end_id`` behind them, in pieces of at most
    ``capacity`` ids: the columns of ``docs`` but the text, then piece, start, length and
    ids (little-endian unsigned 32-bit numbers, as binary). Null text: as empty, so just
    the end id. Only longer documents are cut; only the last piece may be shorter. Columns of
    the input that have one of those names are replaced."""
    @pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        tok, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        out = []
        for t in texts:
            ids = tok.ids(t) + end
            out.append([ids[k:k + 4 * capacity] for k in range(0, len(ids), 4 * capacity)])
        return pd.Series(out)

    rest = [c for c in docs.columns if c.lower() not in {text_col.lower(), "piece", "start", "length", "ids"}]
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.posexplode(cut(F.col(text_col).cast("binary"))).alias("piece", "ids")).select(
        *[F.col(f"`{c}`") for c in rest], "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")


def ids_array(col: Column) -> Column:
    """The ids of a piece as array<long>."""
    @pandas_udf("array<long>")
    def of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda b: np.frombuffer(b, "<u4").astype(np.int64))

    return of(col)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, text_col: str = "text", payload=None) -> DataFrame:
    """Documents packed into sequences: ``token_pieces`` plus sequence_id and offset.

    ``payload`` may replace the pieces' columns (say, a checksum for the ids) before they
    are written; it must keep ``length``. Pieces are written once, packing reads only their
    lengths, and one join brings both together. Full pieces fill a sequence each; repeated
    documents are packed as often as they occur; the input's own columns named like those
    added here are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"sequence_id", "offset"} - {text_col.lower()}])
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, text_col)
    pieces = payload(pieces) if payload else pieces
    item, packed = fresh(pieces, "item_id", "packed_item")
    pieces = materialize(pieces.withColumn(item, F.monotonically_increasing_id()))
    placed = pack(pieces.select(F.col(item).alias("item_id"), "length"), capacity).withColumnRenamed("item_id", packed)
    return pieces.join(placed, pieces[item] == placed[packed]).drop(item, packed)
