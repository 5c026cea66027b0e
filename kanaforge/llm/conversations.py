"""Conversation structure repair with Four-Russians block tables.

A conversation's rows become symbols: must go, or role initial (s, u, a, other) with or
without a cut end. The cheapest edits that leave ``(s?(ua)+)?`` are a walk through four states
(nothing yet, after s, after u, after a). Read from the end, what remains to be paid from each
state is a vector of four costs; less its smallest entry it is one of a few dozen vectors. A
table holds, for each of these vectors and each block of ``BLOCK`` symbols, the vector before the
block, the cost added, and the state behind the block for each state before it. So a block of
symbols is one lookup; blocks are walked from the last to the first, and then expanded: the
vectors inside are recomputed backward from the block's end, and the edits read off forward, at
each row the ASCII-least initial that still reaches the least cost, so ties fall as they should.

Block tables compose, so no conversation has to fit one task. Rows are range-partitioned in
order; a partition solves the conversations that lie wholly inside, and for pieces of the
others writes what the piece does to every vector and state. One row of about two kB a piece
settles the vectors and states between pieces, then all pieces are expanded on their own. Only
the hash of a repaired text has to read one conversation's pieces in turn, one at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import CRC32_CTE, crc32_sql, materialize

KEEP, REROLE, DELETE, INSERT, CUT_END = 0, 1, 2, 5, 5
BLOCK = 4
#: States: nothing yet, after s, after u, after a; where each role leads, -1 for nowhere.
STEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
ENDS = (0, 3)
#: Symbols: padding, a row that must go, then 2 + 2 * role + (1 if its end is cut).
PAD, GO, ROLES = 0, 1, "sua "
SYMBOLS = 2 + 2 * len(ROLES)
ROLE_NAMES = {"u": "user", "a": "assistant"}
#: Rows and bytes of text that a piece of a conversation holds at most (one row at least).
PIECE_ROWS, PIECE_BYTES = 65_536, 8 << 20
SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 20


# --- the tables -------------------------------------------------------------------------

def _with_inserts(cost: list[int]) -> tuple[int, ...]:
    c0, c1, c2, c3 = cost
    c2, c3 = min(c2, INSERT + c3), min(c3, INSERT + c2)
    return min(c0, INSERT + c2), min(c1, INSERT + c2), c2, c3


def _edits(symbol: int, q: int):
    """(initial, letter of the script, next state, cost) of the edits of a row from state q.
    Letters: D, K, u and a for a new role."""
    yield "D", "D", q, DELETE
    if symbol == GO:
        return
    role, cut = ROLES[(symbol - 2) // 2], CUT_END * (symbol % 2)
    if role in STEP and STEP[role][q] >= 0:
        yield "K", "K", STEP[role][q], KEEP + cut
    for to in "ua":
        if STEP[to][q] >= 0:
            yield "R", to, STEP[to][q], REROLE + cut


class Tables:
    """Transitions of normalised cost vectors. ``vectors[0]`` holds at the end of a
    conversation; ``before``, ``added`` and ``state`` are indexed by (vector behind a block,
    block, ...); a block's first symbol is the highest digit."""

    def __init__(self):
        end = _with_inserts([0 if q in ENDS else _FAR for q in range(4)])
        self.vectors, number = [end], {end: 0}
        before, added = [], []
        for v in self.vectors:  # grows while it is walked, until no vector is new
            before.append([])
            added.append([])
            for symbol in range(SYMBOLS):
                got = v if symbol == PAD else _with_inserts([min(v[to] + c for _, _, to, c in _edits(symbol, q)) for q in range(4)])
                least = min(got)
                normal = tuple(x - least for x in got)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                before[-1].append(number[normal])
                added[-1].append(least)
        self.one, self.plus = np.array(before), np.array(added)
        single = np.array([[[self._row(v, x, q)[1] for q in range(4)] for x in range(SYMBOLS)] for v in range(len(self.vectors))], np.int8)
        self.before, self.added, self.state = self.one, self.plus, single
        for _ in range(BLOCK - 1):
            n = len(self.vectors)
            first = lambda t: t[self.before].swapaxes(1, 2).reshape(n, -1)  # noqa: E731  by a symbol in front
            step = single[self.before].swapaxes(1, 2).reshape(n, -1, 4)
            behind = np.tile(self.state, (1, SYMBOLS, 1))
            self.state = np.take_along_axis(behind, step.astype(np.int64), 2)
            self.before, self.added = first(self.one), first(self.plus) + np.tile(self.added, SYMBOLS)
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _row(self, behind: int, symbol: int, q: int) -> tuple[str, int]:
        """(script, next state) of one row: the ASCII-least initials of least cost, inserts
        before the row included (letters U and A)."""
        if symbol == PAD:
            return "", q
        v = self.vectors[behind]
        now = [x + self.plus[behind, symbol] for x in self.vectors[self.one[behind, symbol]]]
        script = ""
        while True:
            options = [(i, letter, to, False) for i, letter, to, c in _edits(symbol, q) if c + v[to] == now[q]]
            options += [("I", to.upper(), STEP[to][q], True) for to in "ua" if STEP[to][q] >= 0 and INSERT + now[STEP[to][q]] == now[q]]
            _, letter, q, stays = min(options)
            script += letter
            if not stays:
                return script, q

    def expand(self, behind: int, block: int, q: int) -> tuple[str, int]:
        """(script, state behind) of a block that is entered in state q."""
        key = (behind, block, q)
        got = self.expanded.get(key)
        if got is None:
            symbols = [block // SYMBOLS ** k % SYMBOLS for k in range(BLOCK)]  # the last first
            inner = [behind]
            for x in symbols[:-1]:
                inner.append(int(self.one[inner[-1], x]))
            script = []
            for x, v in zip(reversed(symbols), reversed(inner)):
                part, q = self._row(v, x, q)
                script.append(part)
            if len(self.expanded) > 200_000:
                self.expanded.clear()
            got = self.expanded[key] = "".join(script), q
        return got

    def close(self, q: int) -> str:
        """Script of the inserts behind the last row."""
        return {0: "", 1: "UA", 2: "A", 3: ""}[q]

    def blocks(self, symbols: bytes) -> list[int]:
        """Block numbers of a row of symbols, padded in front."""
        padded = np.frombuffer(bytes(-len(symbols) % BLOCK) + symbols, np.uint8).reshape(-1, BLOCK).astype(np.int64)
        return (padded @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()

    def walk(self, symbols: bytes, behind: int = 0) -> tuple[list[int], int, int]:
        """(vectors behind each block, vector before the first, cost added)."""
        vectors, cost = [], 0
        for b in reversed(self.blocks(symbols)):
            vectors.append(behind)
            cost += int(self.added[behind, b])
            behind = int(self.before[behind, b])
        return vectors[::-1], behind, cost

    def script(self, symbols: bytes, behind: int = 0, q: int = 0) -> tuple[str, int]:
        """(script, state behind) of rows that are followed by vector ``behind``."""
        out = []
        for b, v in zip(self.blocks(symbols), self.walk(symbols, behind)[0]):
            part, q = self.expand(v, b, q)
            out.append(part)
        return "".join(out), q

    def function(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What rows do: of every vector behind them, the vector before, the cost added, and
        the state behind for each state before."""
        v = np.arange(len(self.vectors))
        cost, vectors, blocks = np.zeros(len(v), np.int64), [], self.blocks(symbols)
        for b in reversed(blocks):
            vectors.append(v)
            cost = cost + self.added[v, b]
            v = self.before[v, b]
        state = np.tile(np.arange(4, dtype=np.int8), (len(v), 1))
        for b, behind in zip(blocks, reversed(vectors)):
            state = np.take_along_axis(self.state[behind, b], state.astype(np.int64), 1)
        return v, cost, state


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def audit(script: str) -> str:
    return script.translate(str.maketrans("uaUA", "RRII"))


def repaired(script: str, roles: list[str], texts: list[str]) -> list[str]:
    """role:text of the rows that the script leaves."""
    rows, out = zip(roles, texts), []
    for letter in script:
        if letter in "UA":
            out.append(f"{ROLE_NAMES[letter.lower()]}:")
            continue
        role, text = next(rows)
        if letter != "D":
            out.append(f"{role if letter == 'K' else ROLE_NAMES[letter]}:{text}")
    return out


# --- damage -----------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, by crc32 of "conv_id:turn"
    modulo 20: 0 drops the row, 1 empties its text, 2 removes the characters .!? from it, 3
    repeats the row, 4 makes its role user. A null conv_id or turn counts as one space there and
    stays null; a null role or text becomes one space. Other columns are dropped."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(named("conv_id"), F.lit(":"), named("turn"))
    fault, text = F.col("fault"), F.coalesce("text", F.lit(" "))
    hurt = rows.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).cast("int").alias("fault")).where("fault <> 0")
    return hurt.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                       F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy")).drop("copy")


# --- the operator -----------------------------------------------------------------------

def _with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, rid, fault): fault is 1 blank, 2 duplicate, 3 cut
    end, 0 none. A row is a duplicate of the first one of equal role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit("|"), F.octet_length(role).cast("string"), F.lit("|"), role, text).cast("binary")))
    own = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    r = materialize(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                                digest.alias("digest"), own.alias("own"), F.monotonically_increasing_id().alias("rid")))
    told = r.where("own <> 1").select("digest", "turn", "rid")
    first = told.groupBy("digest").agg(F.min(F.struct("turn", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = told.join(first, "digest").where(F.col("rid") != F.col("first.rid")).select("rid", F.lit(2).alias("again"))
    return r.join(again, "rid", "left").withColumn("fault", F.coalesce("again", "own")).drop("again", "own")


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def _count(turns, roles, faults) -> dict:
    known = [t for t in turns if t is not None]  # in order
    pairs = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return {"blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3), "illegal": pairs,
            "turns": len(set(known)), "low": known[0] if known else None, "high": known[-1] if known else None}


def _pieces(rows: DataFrame) -> DataFrame:
    """One row for each conversation that lies in one partition, solved; else one for each
    piece, with its symbols, texts and function."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "digest", "rid").sortWithinPartitions("conv_id", "turn", "role", "digest", "rid")
    schema = (f"conv_id {conv}, whole boolean, part int, nth int, {_COUNTS}, cost long, audit string, sha string, symbols binary, "
              "roles array<string>, texts array<string>, vectors array<int>, costs array<long>, states array<int>")

    arrow = _arrow(rows, schema)

    def run(batches):
        part, nth = TaskContext.get().partitionId(), itertools.count()

        def emit(key, held, whole):
            turns, roles, texts, faults = (list(c) for c in zip(*held))
            symbols = bytes(GO if f in (1, 2) else 2 + 2 * (ROLES.index(r[0]) if r[:1] and r[0] in "sua" else 3) + (f == 3) for r, f in zip(roles, faults))
            row = {"conv_id": key, "whole": whole, "part": part, "nth": next(nth)} | _count(turns, roles, faults)
            t = tables()
            if whole:
                _, start, cost = t.walk(symbols)
                script, q = t.script(symbols)
                script += t.close(q)
                text = "\n".join(repaired(script, roles, texts))
                return row | {"cost": cost + t.vectors[start][0], "audit": audit(script), "sha": hashlib.sha256(text.encode()).hexdigest()}
            v, cost, state = t.function(symbols)
            return row | {"symbols": symbols, "roles": roles, "texts": texts, "vectors": v.tolist(), "costs": cost.tolist(), "states": state.ravel().tolist()}

        def solved():
            held, size, key, whole = [], 0, None, False  # the first conversation may have begun before
            for batch in batches:
                for c, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault"))):
                    full = len(held) >= PIECE_ROWS or size >= PIECE_BYTES
                    if held and (c != key or full):
                        yield emit(key, held, whole and c != key)
                        held, size, whole = [], 0, c != key
                    key = c
                    held.append(row)
                    size += len(row[1]) + len(row[2])
            if held:
                yield emit(key, held, False)  # the last one may go on behind

        out, size = [], 0
        for row in solved():
            out.append(row)
            size += sum(map(len, row.get("texts") or ())) + 1000
            if size > PIECE_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.mapInArrow(run, schema)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    """Arrow's schema for columns in DDL; made where there is a session."""
    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _settled(pieces: DataFrame) -> DataFrame:
    """(part, nth, behind, state, cost) for the pieces of conversations in several pieces: the
    vector behind each piece, the state before it, and the conversation's cost."""
    schema = "part int, nth int, behind int, state int, cost long"
    arrow = _arrow(pieces, schema)

    def settle(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["nth"]))
        behind, cost, vectors = [], 0, tables().vectors
        at = 0
        for r in reversed(rows):
            behind.append(at)
            cost += r["costs"][at]
            at = r["vectors"][at]
        q, out = 0, []
        for r, v in zip(rows, reversed(behind)):
            out.append({"part": r["part"], "nth": r["nth"], "behind": v, "state": q, "cost": cost + vectors[at][0]})
            q = r["states"][4 * v + q]
        return pa.Table.from_pylist(out, schema=arrow)

    return pieces.select("conv_id", "part", "nth", "vectors", "costs", "states").groupBy("conv_id").applyInArrow(settle, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """The results of conversations in several pieces; pieces are read one after the other."""
    conv = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_NAMES, "cost", "audit", "sha"]
    schema = f"conv_id {conv}, {_COUNTS}, cost long, audit string, sha string"
    arrow, parted = _arrow(pieces, schema), f"conv_id {conv}, part int, nth int, {_COUNTS}, cost long, first_role string, last_role string, audit string, text string"
    arrow_parted = _arrow(pieces, parted)

    def expand(batches):
        t = tables()
        for batch in batches:
            for r in batch.to_pylist():
                script, q = t.script(r["symbols"], r["behind"], r["state"])
                if r["final"]:
                    script += t.close(q)
                lines = repaired(script, r["roles"], r["texts"])
                out = {k: r[k] for k in ("conv_id", "part", "nth", "cost", *_NAMES)} | {
                    "first_role": r["roles"][0], "last_role": r["roles"][-1], "audit": audit(script), "text": "\n".join(lines) if lines else None}
                yield pa.RecordBatch.from_pylist([out], schema=arrow_parted)

    def join(batches):
        held = digest = None
        for batch in itertools.chain(batches, [None]):
            for r in batch.to_pylist() if batch is not None else [None]:
                if held is not None and (r is None or r["conv_id"] != held["conv_id"]):
                    held |= {"audit": "".join(held["audit"]), "sha": digest.hexdigest()}
                    yield pa.RecordBatch.from_pylist([{k: held[k] for k in names}], schema=arrow)
                    held = None
                if r is None:
                    return
                if held is None:
                    held, digest, begun = r | {"audit": []}, hashlib.sha256(), False
                else:
                    held["illegal"] += r["illegal"] + (held["last_role"][:1] + r["first_role"][:1] not in ("su", "ua", "au"))
                    held["turns"] += r["turns"] - (r["low"] is not None and r["low"] == held["high"])
                    held["low"] = held["low"] if held["low"] is not None else r["low"]
                    held["high"] = r["high"] if r["high"] is not None else held["high"]
                    held["last_role"] = r["last_role"]
                    for k in ("blank", "duplicate", "truncated"):
                        held[k] += r[k]
                held["audit"].append(r["audit"])
                if r["text"] is not None:
                    digest.update((("\n" if begun else "") + r["text"]).encode())
                    begun = True

    last = F.struct("part", "nth")
    settled = materialize(_settled(pieces))
    final = pieces.groupBy("conv_id").agg(F.max(last).alias("l")).select("l.part", "l.nth", F.lit(True).alias("final"))
    told = pieces.drop("vectors", "costs", "states", "cost", "audit", "sha", "whole").join(settled, ["part", "nth"]).join(
        final, ["part", "nth"], "left").withColumn("final", F.coalesce("final", F.lit(False)))
    return told.mapInArrow(expand, parted).repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(join, schema)


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``ids`` (conv_id) by its
    ``rows`` (conv_id, turn, role, text; other columns are ignored).

    Rows are taken by turn, nulls first, ties by role and then by md5 of conversation, role
    and text; a null role or text is one space. Columns: conv_id, gaps (turns missing between
    the least and the largest), blank, duplicate, truncated (rows by their first fault),
    illegal (neighbouring role initials other than su, ua, au), cost, audit (initials of the
    edits) and repaired_sha256. A conversation without rows has zeros, an empty audit and the
    hash of the empty text; a null conv_id is a conversation. Repeated ids come back once."""
    pieces = materialize(_pieces(_with_faults(rows)))
    names = ["conv_id", *_NAMES, "cost", "audit", "sha"]
    solved = pieces.where("whole").select(*names).unionByName(_joined(pieces.where("NOT whole")).select(*names))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ids = ids.select(F.col("conv_id").alias("id")).distinct()
    return ids.join(solved, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
        *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair_sql() -> str:
    """DuckDB SQL for ``repair(damage(conversations), conversations)``: the least (cost, audit)
    from each state, row by row from the end of every conversation."""
    named = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    opt = lambda cost, initial, line, g, when="true": (
        f"CASE WHEN {when} THEN {{'c': {cost} + {g}.c, 'a': '{initial}' || {g}.a, 't': {line} || {g}.t}} ELSE {{'c': 1000000000, 'a': '', 't': ''}} END")
    own, lf = "role || ':' || text || chr(10)", "|| chr(10)"

    def best(q: int) -> str:
        options = [opt(DELETE, "D", "''", f"g{q}")]
        for role, to in STEP.items():
            if to[q] >= 0:
                options.append(opt(f"{KEEP} + cut", "K", own, f"g{to[q]}", f"stays AND left(role, 1) = '{role}'"))
                if role in ROLE_NAMES:
                    options.append(opt(f"{REROLE} + cut", "R", f"'{ROLE_NAMES[role]}:' || text {lf}", f"g{to[q]}", "stays"))
        return f"list_min([{', '.join(options)}])"

    user, other = f"'user:' {lf}", f"'assistant:' {lf}"
    return f"""
        WITH RECURSIVE {CRC32_CTE},
        hurt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                        {crc32_sql(f"({named('conv_id')} || ':' || {named('turn')})")} % 20 AS h FROM conversations, crc),
        r AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                     CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hurt WHERE h <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat(coalesce(CAST(conv_id AS VARCHAR), '-'), '|',
                     strlen(role), '|', role, text)), copy) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM r),
        f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                             WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                     left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
        s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank,
                     count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                     count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        dp AS (SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': ''}} AS g0, {{'c': {2 * INSERT}, 'a': 'II', 't': {user} || {other}}} AS g1,
                      {{'c': {INSERT}, 'a': 'I', 't': {other}}} AS g2, {{'c': 0, 'a': '', 't': ''}} AS g3 FROM s
               UNION ALL
               SELECT conv_id, i - 1, list_min([b0, {opt(INSERT, 'I', user, 'c2')}]), list_min([b1, {opt(INSERT, 'I', user, 'c2')}]), c2, c3
               FROM (SELECT *, list_min([b2, {opt(INSERT, 'I', other, 'b3')}]) AS c2, list_min([b3, {opt(INSERT, 'I', user, 'b2')}]) AS c3
               FROM (SELECT conv_id, i, {', '.join(f'{best(q)} AS b{q}' for q in range(4))}
               FROM (SELECT dp.*, f.role, f.text, f.fault NOT IN (1, 2) AS stays, CASE WHEN f.fault = 3 THEN {CUT_END} ELSE 0 END AS cut
                     FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i WHERE dp.i > 0))))
        SELECT c.conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
               CAST(coalesce(g0.c, 0) AS BIGINT) AS cost, coalesce(g0.a, '') AS audit, sha256(coalesce(left(g0.t, greatest(length(g0.t) - 1, 0)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
             LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = 0"""
