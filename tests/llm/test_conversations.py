"""Conversation repair against a plain shortest-path search."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest

from kanaforge.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?").fullmatch


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(C.SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """(cost, audit, text) by best-first search over (cost, audit): no tables, no blocks."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, script, i, roles, kept = heapq.heappop(heap)
        state = roles[-1:]
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and LEGAL(roles):
            return cost, script, "\n".join(kept)
        tail = lambda r: roles[-1:] + r if roles else r
        fits = lambda r: r and tail(r) in ("s", "u", "su", "ua", "au")
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, script + "D", i + 1, roles, kept))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                if fits(role[:1]):
                    heapq.heappush(heap, (cost + extra, script + "K", i + 1, roles + role[0], (*kept, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if fits(to[0]):
                        heapq.heappush(heap, (cost + 1 + extra, script + "R", i + 1, roles + to[0], (*kept, f"{to}:{text}")))
        for to in ("user", "assistant"):
            if fits(to[0]):
                heapq.heappush(heap, (cost + 5, script + "I", i, roles + to[0], (*kept, f"{to}:")))


def plain(rows, ids):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.md5(
        f"{'-' if r[0] is None else r[0]}|{len(r[2].encode())}|{r[2]}{r[3]}".encode()).digest())
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    by = {k: list(g) for k, g in groupby(sorted(rows, key=order), key=lambda r: r[0])}
    out = {}
    for conv in ids:
        got = by.get(conv, [])
        faults = faults_of(got)
        turns = [r[1] for r in got if r[1] is not None]
        cost, audit, text = plain_repair(got, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal,
                     cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


ROLES = ("user", "assistant", "system", "tool", "", "User", "ua")
TEXTS = ("Yes.", "no", "What?", "", " \n", "a!  ", "x\n.", "日本。", "ok. then")


def random_rows(rng, conv, n):
    return [(conv, rng.choice((None, i, i, i, i // 2, i + 5)), rng.choice(ROLES[:3] * 3 + ROLES), rng.choice(TEXTS) + rng.choice(("", str(i) + "."))) for i in range(n)]


def results(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_tables_against_search():
    t, rng = C.tables(), random.Random(1)
    assert len(t.vectors) < 100
    for _ in range(1500):
        rows = random_rows(rng, 0, rng.randrange(0, 11))
        faults = faults_of(rows)
        symbols = bytes(C.GO if f in ("blank", "duplicate") else 2 + 2 * (C.ROLES.index(r[2][0]) if r[2][:1] and r[2][0] in "sua" else 3) + (f == "truncated")
                        for r, f in zip(rows, faults))
        _, start, cost = t.walk(symbols)
        script, q = t.script(symbols)
        script += t.close(q)
        want = plain_repair(rows, faults)
        assert (cost + t.vectors[start][0], C.audit(script), "\n".join(C.repaired(script, [r[2] for r in rows], [r[3] for r in rows]))) == want
        # A cut anywhere gives the same edits.
        k = rng.randrange(len(symbols) + 1)
        v, costs, state = t.function(symbols[k:])
        front, mid = t.script(symbols[:k], int(v[0]))
        back, q = t.script(symbols[k:], 0, mid)
        assert front + back + t.close(q) == script and state[0][mid] == q
        assert t.walk(symbols[:k], int(v[0]))[2] + costs[0] == cost


@pytest.mark.parametrize("piece_rows", [3, C.PIECE_ROWS])
def test_repair_by_brute_force(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(C, "PIECE_ROWS", piece_rows)
    rng = random.Random(piece_rows)
    rows = [r for conv in range(60) for r in random_rows(rng, conv, rng.randrange(0, 14))]
    rows += random_rows(rng, 777, 400) + random_rows(rng, None, 9) + [(5, None, None, None)] * 3  # a third of all rows in one
    rng.shuffle(rows)
    ids = [*range(60), 777, None, 1000]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cost", C.F.lit("clash")).withColumn("fault", C.F.lit("clash")).withColumn("digest", C.F.lit("clash"))
    got = C.repair(df, spark.createDataFrame([(i,) for i in ids * 2], "conv_id long"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert results(got) == plain(rows, ids)
    hurt = C.damage(df)
    assert sorted(map(repr, map(tuple, hurt.collect()))) == sorted(map(repr, plain_damage(rows)))
    assert results(C.repair(hurt, df.select("conv_id"))) == plain(plain_damage(rows), {r[0] for r in rows})


def test_empty_and_very_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(none), none.select("conv_id")).count() == 0
    ids = spark.createDataFrame([(1,)], "conv_id long")
    assert results(C.repair(none, ids)) == plain([], [1])
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "word " * 400_000)]
    assert results(C.repair(spark.createDataFrame(rows, SCHEMA), ids)) == plain(rows, [1])
