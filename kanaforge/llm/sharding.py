"""Sharding by balanced label propagation.

Documents start in hashed shards. In every round each linked document looks at how many
documents of its group sit in each shard (its neighbours' labels, counted per group with a
partial aggregate, never as pairs) and moves to the shard that holds most. Moves are bound
by quotas: a shard of q rows takes as many linked documents as fit, since unlinked ones can
make room at no cost, and groups beyond that move on to shards with room. A group larger
than one quota asks for as many shards as it needs, so it is cut into few pieces and never
gathered. At the end shards above their quota hand rows, unlinked ones first, to shards below it, so
that row counts differ by at most one.

All work is joins, aggregates and windows over (group, shard), or over buckets of bounded
expected size; there is no Python on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 4
#: Rows that one ranking bucket holds on average.
BUCKET_ROWS = 4096


def _unit(*cols) -> Column:
    """Uniform number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def ranked(df: DataFrame, by: str, bucket: Column, order: list, buckets_as: str = "rank_bucket", rank_as: str = "rank") -> DataFrame:
    """Gapless rank from 0 within ``by``: buckets are counted, their sizes summed up in
    order, and rows ranked inside their bucket alone."""
    b = df.withColumn(buckets_as, bucket)
    sizes = b.groupBy(by, buckets_as).agg(F.count("*").alias("rank_n"))
    before = sizes.withColumn("rank_before", F.sum("rank_n").over(
        Window.partitionBy(by).orderBy(buckets_as).rowsBetween(Window.unboundedPreceding, -1))).select(by, buckets_as, F.coalesce("rank_before", F.lit(0)).alias("rank_before"))
    inside = b.withColumn("rank_in", F.row_number().over(Window.partitionBy(by, buckets_as).orderBy(*order)) - 1)
    return inside.join(before, [by, buckets_as]).withColumn(rank_as, (F.col("rank_before") + F.col("rank_in")).cast("long")).drop(
        buckets_as, "rank_before", "rank_in")


def _by_shard(rows, shards: int, key: str, value: str) -> list[int]:
    out = [0] * shards
    for r in rows:
        out[r[key]] += r[value]
    return out


def _lookup(values: list[float], at: Column) -> Column:
    """values[at] as an expression over a short list."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at + 1).cast("int"))


def propagate(linked: DataFrame, quota: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Move linked rows (rid, grp, grp_n, shard) towards their neighbours' shards.

    A group above a quota asks for ceil(grp_n / quota) shards, those that hold most of it;
    its rows move there one by one as far as quotas allow. Any other group has its home
    where most of it is, and moves there as a whole; where homes exceed what the large
    groups leave of a quota, a share of the groups, drawn by hash, goes to shards with
    room. Stops early when no row moves. The driver sees counts per shard only."""
    for turn in range(rounds):
        votes = linked.groupBy("grp", "shard").agg(F.count("*").alias("n"), F.max("grp_n").alias("grp_n"))
        place = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("n").desc(), F.xxhash64("grp", "shard")))
        best = votes.withColumn("place", place).where(F.col("place") <= F.least(F.ceil(F.col("grp_n") / quota), F.lit(shards)))
        goals = best.groupBy("grp").agg(F.max("grp_n").alias("n"), F.sort_array(F.collect_list("shard")).alias("goals"))  # at most ``shards`` of them
        goals = materialize(goals)
        ask = linked.join(goals.select("grp", "goals"), "grp")
        large = F.col("grp_n") > quota
        wish = F.when(F.array_contains("goals", F.col("shard")), F.col("shard")).otherwise(F.element_at(
            "goals", (F.pmod(F.xxhash64("rid", F.lit(turn)), F.size("goals")) + 1).cast("int")))
        flows = ask.where(large).select("shard", wish.alias("wish")).groupBy("shard", "wish").agg(F.count("*").alias("n")).collect()
        stay = _by_shard([r for r in flows if r["shard"] == r["wish"]], shards, "shard", "n")
        come = _by_shard([r for r in flows if r["shard"] != r["wish"]], shards, "wish", "n")
        gone = _by_shard([r for r in flows if r["shard"] != r["wish"]], shards, "shard", "n")
        admit = [min(1.0, max(0, quota - s) / c) if c else 0.0 for s, c in zip(stay, come)]
        held = [s + a * c for s, a, c in zip(stay, admit, come)]
        if sum(gone):  # those not admitted stay where they are, dealt like all that wish to go
            left = (sum(gone) - sum(a * c for a, c in zip(admit, come))) / sum(gone)
            held = [h + left * g for h, g in zip(held, gone)]
        home = _by_shard(goals.where(F.col("n") <= quota).groupBy(F.col("goals")[0].alias("shard")).agg(F.sum("n").alias("n")).collect(), shards, "shard", "n")
        cap = [max(0.0, quota - h) for h in held]
        evict = [max(0.0, 1 - c / n) if n else 0.0 for c, n in zip(cap, home)]
        spare = [max(0.0, c - n) for c, n in zip(cap, home)]
        draw, to, below = _unit("grp", F.lit(50 + turn)), F.col("goals")[0], 0.0
        for s in reversed(range(shards)):
            if spare[s]:
                to = F.when(draw >= 1 - (below + spare[s]) / sum(spare), F.lit(s)).otherwise(to) if below == 0.0 else F.when(
                    (draw >= 1 - (below + spare[s]) / sum(spare)) & (draw < 1 - below / sum(spare)), F.lit(s)).otherwise(to)
                below += spare[s]
        whole = F.when(_unit("grp", F.lit(100 + turn)) < _lookup(evict, F.col("goals")[0]), to).otherwise(F.col("goals")[0])
        single = F.when((wish != F.col("shard")) & (_unit("rid", F.lit(150 + turn)) < _lookup(admit, wish)), wish).otherwise(F.col("shard"))
        new = F.when(large, single).otherwise(whole).cast("int")
        moved = materialize(ask.select("rid", "grp", "grp_n", new.alias("shard"), (new != F.col("shard")).alias("moved")))
        linked = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return linked


def balanced_shards(items: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (rid unique and not null, grp: rows of equal grp are linked, null: unlinked)
    -> (rid, grp, shard int, slot long). Row counts of any two shards differ by at most one;
    slots are gapless from 0 in each shard. Empty input gives an empty result."""
    total = items.count()
    low, extra = divmod(total, shards)
    quota = low + (extra > 0)
    sizes = items.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("grp_n")).where("grp_n > 1")
    start = F.pmod(F.xxhash64(F.lit("start"), "rid"), F.lit(shards)).cast("int")
    keyed = materialize(items.select("rid", "grp").join(sizes, "grp", "left").withColumn("shard", start))
    linked = propagate(keyed.where("grp_n IS NOT NULL"), max(1, quota), shards, rounds)
    rows = keyed.where("grp_n IS NULL").unionByName(linked)
    # Linked rows first and by group, so that a surplus is made of unlinked rows and at most
    # one group per shard is cut; rows of a group above a quota are dealt over buckets.
    n = max(1, total // (shards * BUCKET_ROWS))
    spread = F.when(F.col("grp_n") > BUCKET_ROWS, F.xxhash64("rid")).otherwise(F.xxhash64("grp"))
    bucket = F.when(F.col("grp_n").isNull(), n + F.pmod(F.xxhash64("rid"), F.lit(n))).otherwise(F.pmod(spread, F.lit(n)))
    order = ranked(rows, "shard", bucket, [F.col("grp"), F.col("rid")])
    order = materialize(order)
    held = {r["shard"]: r["n"] for r in order.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # Quotas: the fullest shards take the extra rows.
    by_load = sorted(range(shards), key=lambda s: (-held.get(s, 0), s))
    goal = {s: low + (k < extra) for k, s in enumerate(by_load)}
    surplus_before, free_before, give, take = {}, [], 0, 0
    for s in range(shards):
        surplus_before[s] = give
        give += max(0, held.get(s, 0) - goal[s])
        if goal[s] > held.get(s, 0):
            free_before.append((take, take + goal[s] - held.get(s, 0), s, held.get(s, 0)))
            take += goal[s] - held.get(s, 0)
    num = lambda d: F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, d[s])]), F.col("shard"))
    over = F.col("rank") >= num(goal)
    nth = num(surplus_before) + F.col("rank") - num(goal)
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for lo, hi, s, base in free_before:
        inside = (nth >= lo) & (nth < hi)
        to, slot = F.when(inside, F.lit(s)).otherwise(to), F.when(inside, base + nth - lo).otherwise(slot)
    return order.select("rid", "grp", F.when(over, to).otherwise(F.col("shard")).cast("int").alias("shard"),
                        F.when(over, slot).otherwise(F.col("rank")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row: rows of equal text are linked.
    size: UTF-8 bytes plus 8; a null text counts as the empty text. Repeated rows are placed one by one; ids may be null or repeated."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("grp"), F.monotonically_increasing_id().alias("rid")))
    placed = balanced_shards(narrow.select("rid", "grp"), shards, rounds).select("rid", "shard", "slot")
    return narrow.join(placed, "rid").select("doc_id", "size", "text_crc32", "shard", "slot")
