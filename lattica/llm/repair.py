"""Repair of conversations by depth-first branch-and-bound.

Rows of a conversation, in order of turn, get edits that make its role initials ``(s?(ua)+)?`` at
the least cost: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant
5, and 5 more for a truncated row that stays; blank rows and duplicates must go. ``search`` walks
over edits with an explicit stack. A lower bound on what every suffix costs from each of the four
role states comes first, in one pass from the end. A dive along the least bounds makes the first
incumbent. Then edits are tried in ASCII order, so that the first audit found at a cost is the
least one; prefixes whose bound passes the incumbent are cut, and so are those that come to a
(row, state) at no less cost than one before them (the dominance table). The stack runs empty
when the incumbent is proved.

Rows are dealt into ranges of (conversation, turn) and sorted there, so a conversation of any size
is spread over ranges, whose number grows with the data. A task reads its range a conversation
after another and holds one piece of a conversation at a time. Pieces of conversations that cross
ranges, two a range at most, first tell a table of costs between states; from these the driver
makes each piece's suffix bounds and, once their searches are done, the state it begins in. Their
repaired lines are hashed in order by a task that streams them.

Rows of one turn are in order of role and of a digest of the row; those that agree in everything
can't be told apart. Nulls, ties and the like: a null role or text is one space, a null turn comes
first and counts for no gap, a null ``conv_id`` is a conversation. In the damage's key a null is
one space too. Very long texts are one row; very many rows of one conversation and turn are many
pieces. An empty table makes an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.llm.spelling import CRC, CRC_TABLE
from lattica.plans.cut import cut

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space of ASCII.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes and rows in a range, about; repeats that are told by broadcast at most; bytes of repaired lines in a row.
RANGE_BYTES, RANGE_ROWS = 32 << 20, 100_000
BROADCAST_ROWS = 200_000
COMMON_ROWS, COMMON_SHARE = 1000, 0.001
CHUNK = 4 << 20

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more user or assistant, whichever is due.
DUE = (USER, USER, ASSISTANT, USER)
INITIALS = "?sua"
OK, BLANK, DUPLICATE, CUT_OFF = range(4)
FAR = 1 << 30


def row_edits(code: int) -> list[list[tuple[str, int, int]]]:
    """``(letter, cost, next state)`` of the edits of a row, for each state, in ASCII order; ``code`` is ``4 * initial + fault``."""
    initial, fault = divmod(code, 4)
    extra = TRUNCATED if fault == CUT_OFF else 0
    out = []
    for state in range(4):
        ways = [("D", DELETE, state)]
        if fault in (OK, CUT_OFF):
            if initial == SYSTEM and state == START:
                ways.append(("K", extra, SYSTEM))
            if initial == DUE[state] and initial in (USER, ASSISTANT):
                ways.append(("K", extra, initial))
            ways.append(("R", REROLE + extra, DUE[state]))
        out.append(ways)
    return out


EDITS = [row_edits(code) for code in range(16)]


def before_inserts(costs: list[int]) -> list[int]:
    """Costs from each state where inserts may come first."""
    u = min(costs[USER], INSERT + costs[ASSISTANT])
    a = min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[START], INSERT + u), min(costs[SYSTEM], INSERT + u), u, a]


#: What a conversation costs from each state when its rows are over.
TAIL = before_inserts([0, FAR, FAR, 0])


def suffix_bounds(codes: bytes, tail: list[int] = TAIL) -> array:
    """The least cost of rows ``i`` and after, from each state, at ``4 * i``; ``tail`` is that of what follows."""
    n = len(codes)
    out = array("l", bytes(8 * 4 * (n + 1)))
    now = list(tail)
    out[4 * n :] = array("l", now)
    for i in range(n - 1, -1, -1):
        now = before_inserts([min(c + now[s] for _, c, s in ways) for ways in EDITS[codes[i]]])
        out[4 * i : 4 * i + 4] = array("l", now)
    return out


def search(codes: bytes, start: int = START, tail: list[int] | None = None, bounds: array | None = None) -> tuple[int, str, int]:
    """``(cost, audit, last state)`` of the cheapest edits, of the least audit among those.

    With ``tail`` other rows follow, which cost so much from each state; without it the
    conversation ends. ``bounds`` may be any lower bounds in the form of ``suffix_bounds``.
    """
    n, last = len(codes), tail is None
    if bounds is None:
        bounds = suffix_bounds(codes, TAIL if last else tail)

    def children(i: int, s: int) -> list[tuple[str, int, int, int]]:
        if i == n:
            return [("I", INSERT, i, DUE[s])] if last else []
        ways = [(a, c, i + 1, t) for a, c, t in EDITS[codes[i]][s]]
        ways.insert(1, ("I", INSERT, i, DUE[s]))
        return ways

    def ending(i: int, s: int) -> int | None:
        if i < n or last and s not in (START, ASSISTANT):
            return None
        return 0 if last else tail[s]

    # The first incumbent: along the least bounds, by letter where they are equal.
    i, s, cost = 0, start, 0
    dived: list[str] = []
    while (end := ending(i, s)) is None:
        letter, c, i, s = min(children(i, s), key=lambda x: (x[1] + bounds[4 * x[2] + x[3]], x[0]))
        cost += c
        dived.append(letter)
    best, audit, state, sure = cost + end, "".join(dived), s, False

    met = array("l", [FAR]) * (4 * (n + 1))
    stack, path = [(0, start, 0, 0, "")], []
    while stack:
        i, s, cost, depth, letter = stack.pop()
        least = cost + bounds[4 * i + s]
        if least > best or sure and least == best or cost >= met[4 * i + s]:
            continue
        met[4 * i + s] = cost
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if (end := ending(i, s)) is not None and (cost + end < best or not sure and cost + end == best):
            best, audit, state, sure = cost + end, "".join(path), s, True
            # What goes on from here has a longer audit at no less cost.
        for a, c, j, t in reversed(children(i, s)):
            stack.append((j, t, cost + c, depth + 1, a))
    return best - (0 if last else tail[state]), audit, state


def lines_of(audit: str, start: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired ``role:text`` lines of ``rows (role, text)``."""
    state = start
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "K":
            state = SYSTEM if role[:1] == "s" else DUE[state]
        else:
            state = DUE[state]
            role = "user" if state == USER else "assistant"
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, row)`` after the damage that the rows' keys decide; ``row`` tells apart those that agree in all else."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(shown[0], F.lit(":"), shown[1]), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy").withColumn("row", F.monotonically_increasing_id())


def coded(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``digest`` and ``code``, where a row of an earlier turn with the same role and text makes a duplicate.

    Repeats in one turn stand side by side after sorting and are found there.
    """
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    told = rows.withColumn("digest", F.unhex(F.sha2(whole, 256)))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    groups = told.groupBy(F.col("digest").alias("_digest")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count("*").alias("_n"))
    again = cut(groups.where(~F.col("_first").eqNullSafe(F.col("_last"))).select("_digest", "_first", "_n"))
    if again.count() <= BROADCAST_ROWS:
        joined = told.join(F.broadcast(again), told["digest"] == again["_digest"], "left")
    else:
        # The few that many rows share are told by broadcast; their rows then meet nothing, wherever they go.
        common = F.col("_n") > max(COMMON_ROWS, int(COMMON_SHARE * count))
        few = again.where(common).select(F.col("_digest").alias("_c"), F.col("_first").alias("_f"))
        rest = again.where(~common)
        met = told.join(F.broadcast(few), told["digest"] == F.col("_c"), "left")
        met = met.withColumn("_key", F.when(F.col("_c").isNull(), F.col("digest")).otherwise(F.encode(F.col("row").cast("string"), "UTF-8")))
        joined = met.join(rest, F.col("_key") == F.col("_digest"), "left").withColumn("_first", F.coalesce("_f", "_first"))
    late = F.col("_first").isNotNull() & ~at.eqNullSafe(F.col("_first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(late, DUPLICATE).when(~(bare.endswith(".") | bare.endswith("!") | bare.endswith("?")), CUT_OFF).otherwise(OK)
    initial = F.when(F.col("role").startswith("s"), SYSTEM).when(F.col("role").startswith("u"), USER).when(F.col("role").startswith("a"), ASSISTANT).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "digest", "row", (4 * initial + fault).cast("int").alias("code"))


def ranged(rows: DataFrame, count: int, size: int) -> DataFrame:
    """``coded`` rows, ``count`` of ``size`` bytes, dealt into sorted ranges and kept in the shared folder; ``part`` is a row's range."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(count / RANGE_ROWS), math.ceil(size / RANGE_BYTES))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order).drop("row")  # rows that agree in all else may part
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, int | None, dict[str, list]]]:
    """``(part, conv_id, values)`` of each piece of a conversation, in order; repeats in one turn become duplicates."""
    key, held, before = None, {}, None
    for batch in batches:
        at = {name: batch.column(name).to_pylist() for name in ("part", "conv_id", "turn", "digest", "code", *columns)}
        for k in range(batch.num_rows):
            mine = at["part"][k], at["conv_id"][k]
            if mine != key:
                if key is not None:
                    yield *key, held
                key, held, before = mine, {c: [] for c in ("turn", "digest", "code", *columns)}, None
            row = at["turn"][k], at["digest"][k]
            code = at["code"][k]
            if row == before and code % 4 != BLANK:
                code += DUPLICATE - code % 4
            before = row
            for c in ("turn", "digest", *columns):
                held[c].append(at[c][k])
            held["code"].append(code)
    if key is not None:
        yield *key, held


def _place(turn: int | None, digest: bytes) -> bytes:
    return (b"" if turn is None else str(turn).encode()) + b":" + digest


def borders(rows: DataFrame) -> DataFrame:
    """``(part, conv_id, first, last, codes)`` of each range's first and last pieces, which others may continue; ``codes`` has a byte for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for part, conv, held in pieces(batches, []):
            ends = found.setdefault(part, [])
            ends[1:] = [(part, conv, _place(held["turn"][0], held["digest"][0]), _place(held["turn"][-1], held["digest"][-1]), bytes(held["code"]))]
        rows = [x for ends in found.values() for x in ends]
        yield pa.RecordBatch.from_pylist([dict(zip(BORDER.names, x, strict=True)) for x in rows], schema=BORDER)

    BORDER = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("codes", pa.binary())])
    return rows.select("part", "conv_id", "turn", "digest", "code").mapInArrow(work, "part int, conv_id long, first binary, last binary, codes binary")


def _repeated(codes: bytes, is_repeat: bool) -> bytes:
    """``codes`` whose first row repeats the last one of the piece before."""
    return bytes([codes[0] - codes[0] % 4 + DUPLICATE]) + codes[1:] if is_repeat and codes[0] % 4 != BLANK else codes


def joints(rows: DataFrame) -> dict[tuple[int, int | None], tuple[bool, int, list[int] | None]]:
    """What pieces of conversations that cross ranges need to know: whether the first row repeats
    the last one of the piece before, the state they begin in, and the cost of what follows from each state.

    All that comes to the driver is two rows of a few numbers for each range.
    """
    ends = cut(borders(rows))
    parts: dict[int | None, list] = {}
    for r in sorted(ends.select("part", "conv_id", "first", "last").collect(), key=lambda r: r["part"]):
        parts.setdefault(r["conv_id"], []).append(r)
    chains = {conv: x for conv, x in parts.items() if len(x) > 1}
    if not chains:
        return {}
    repeats = {(b["part"], conv): a["last"] == b["first"] for conv, x in chains.items() for a, b in zip([{"last": None}, *x], x, strict=False)}

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part, conv, codes in zip(frame["part"].tolist(), frame["conv"].tolist(), frame["codes"], strict=True):
                key = part, int(conv) if conv else None
                if key in repeats:
                    now = _repeated(codes, repeats[key])
                    out.append((part, conv, [list(suffix_bounds(now, [0 if t == s else FAR for s in range(4)])[:4]) for t in range(4)]))
            yield pd.DataFrame(out, columns=["part", "conv", "costs"])

    named = ends.select("part", F.col("conv_id").cast("string").alias("conv"), "codes")  # pandas has no null in longs
    known = {(r["part"], int(r["conv"]) if r["conv"] else None): r["costs"] for r in named.mapInPandas(tables, "part int, conv string, costs array<array<long>>").collect()}
    follows: dict[tuple, list[int] | None] = {}
    for conv, chain in chains.items():
        tail = None
        for r in reversed(chain):
            key = r["part"], conv
            follows[key] = tail
            after = TAIL if tail is None else tail
            tail = [min(known[key][t][s] + after[t] for t in range(4)) for s in range(4)]

    def moves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part, conv, codes in zip(frame["part"].tolist(), frame["conv"].tolist(), frame["codes"], strict=True):
                key = part, int(conv) if conv else None
                if key in repeats and follows[key] is not None:
                    now = _repeated(codes, repeats[key])
                    bounds = suffix_bounds(now, follows[key])
                    out.append((part, conv, [search(now, s, follows[key], bounds)[2] for s in range(4)]))
            yield pd.DataFrame(out, columns=["part", "conv", "ends"])

    turns = {(r["part"], int(r["conv"]) if r["conv"] else None): r["ends"] for r in named.mapInPandas(moves, "part int, conv string, ends array<long>").collect()}
    out = {}
    for conv, chain in chains.items():
        state = START
        for r in chain:
            key = r["part"], conv
            out[key] = repeats[key], state, follows[key]
            if key in turns:
                state = turns[key][state]
    return out


PIECE = "conv_id long, part int, chunk int, crosses boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, ends string, cost long, audit string, lines binary, repaired_sha256 string"
_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("crosses", pa.bool_()), *((c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")), ("ends", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.binary()), ("repaired_sha256", pa.string())])
LEGAL = {"su", "ua", "au"}


def repaired_pieces(rows: DataFrame, known: dict) -> DataFrame:
    """A row for each piece with its counts, cost and audit; pieces of conversations that cross ranges have their repaired lines too, in chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        size = 0
        for part, conv, held in pieces(batches, ["role", "text"]):
            is_repeat, start, tail = known.get((part, conv), (False, START, None))
            codes = _repeated(bytes(held["code"]), is_repeat)
            cost, audit, _ = search(codes, start, tail)
            faults = [c % 4 for c in codes]
            initials = "".join(INITIALS[c // 4] for c in codes)
            turns = [t for t in held["turn"] if t is not None]
            row = {"conv_id": conv, "part": part, "chunk": 0, "crosses": (part, conv) in known, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF), "illegal": sum(initials[k : k + 2] not in LEGAL for k in range(len(codes) - 1)), "ends": initials[0] + initials[-1], "cost": cost, "audit": audit, "lines": None, "repaired_sha256": None}
            lines = lines_of(audit, start, iter(zip(held["role"], held["text"], strict=True)))
            if not row["crosses"]:
                row["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
                ready.append(row)
            else:
                ready.append(row)
                for k, chunk in enumerate(_chunks(lines)):
                    ready.append({"conv_id": conv, "part": part, "chunk": k + 1, "crosses": True, "lines": chunk})
                    size += len(chunk)
            size += len(audit)
            if len(ready) >= 4096 or size > CHUNK:
                yield pa.RecordBatch.from_pylist(ready, schema=_PIECE)
                ready, size = [], 0
        yield pa.RecordBatch.from_pylist(ready, schema=_PIECE)

    return rows.mapInArrow(work, PIECE)


def _chunks(lines: Iterator[str]) -> Iterator[bytes]:
    """Whole lines, joined, of about ``CHUNK`` bytes."""
    held, size = [], 0
    for line in lines:
        held.append(line.encode())
        size += len(held[-1])
        if size > CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DONE = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def merged(crossing: DataFrame) -> DataFrame:
    """A row for each conversation that crosses ranges, from its pieces streamed in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def done() -> pa.RecordBatch:
            out = {"conv_id": now["conv_id"], "gaps": 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([out | {c: now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}], schema=_DONE)

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield done()
                    now = {"conv_id": r["conv_id"], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "lines": 0, "end": None}
                if r["chunk"]:
                    now["hash"].update(b"\n" * bool(now["lines"]) + r["lines"])
                    now["lines"] += 1
                    continue
                if now["end"] is not None and now["end"] + r["ends"][0] not in LEGAL:
                    now["illegal"] += 1
                now["end"] = r["ends"][1]
                if r["turns"]:  # in order of turns, so one turn at most is in two pieces
                    now["turns"] += r["turns"] - (now["high"] == r["low"])
                    now["low"] = r["low"] if now["low"] is None else now["low"]
                    now["high"] = r["high"]
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += r[c]
                now["audit"].append(r["audit"])
        if now is not None:
            yield done()

    return crossing.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(work, DONE)


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation of ``rows (conv_id, turn, role, text, row)``."""
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    dealt = ranged(coded(rows, size["n"]), size["n"], size["bytes"] or 0)
    known = joints(dealt)
    found = repaired_pieces(dealt, known)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    columns = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    if not known:
        return found.select("conv_id", gaps, *columns)
    found = cut(found)
    whole = found.where("not crosses").select("conv_id", gaps, *columns)
    return whole.unionByName(merged(found.where("crosses")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by their keys and repaired at the least cost."""
    conversations = table(spark, sf_dir, "conversations")
    done = repair(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = every.join(done, every["conv_id"].eqNullSafe(done["_id"]), "left").drop("_id")
    return both.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def oracle() -> str:
    """DuckDB SQL for ``op12_repair``: the best prefix in each state, row by row, in place of a search."""
    best = lambda *x: f"list_sort([{', '.join(x)}], 'ASC', 'NULLS LAST')[1]"
    put = lambda x, letter, cost, line: f"CASE WHEN {x} IS NOT NULL THEN {{'cost': {x}.cost + {cost}, 'audit': {x}.audit || '{letter}', 'lines': {x}.lines || {line}}} END"
    insert = lambda x, role: put(x, "I", INSERT, f"'{role}:' || chr(10)")
    drop = lambda x: put(x, "D", DELETE, "''")
    keep = lambda x, initial: f"CASE WHEN fault IN (0, 3) AND c = '{initial}' THEN {put(x, 'K', 't', 'role || chr(58) || text || chr(10)')} END"
    rerole = lambda x, role: f"CASE WHEN fault IN (0, 3) THEN {put(x, 'R', f'{REROLE} + t', f'{chr(39)}{role}:{chr(39)} || text || chr(10)')} END"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = CRC.format(b=f"list_transform(string_split({key}, ''), lambda ch: ord(ch)::BIGINT)")
    ready = lambda source: f"(SELECT *, {best('a', insert('u1', 'assistant'))} AS a1 FROM (SELECT *, {best('u', insert('z', 'user'), insert('s', 'user'), insert('a', 'user'))} AS u1 FROM {source}))"
    step = ready("r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv AND f.i = r.k + 1")
    return f"""WITH RECURSIVE {CRC_TABLE}, k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(coalesce(conv_id::VARCHAR, ' ') || ':' || length(role)::VARCHAR || ':' || role || text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS MATERIALIZED (SELECT *, left(role, 1) AS c, CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END AS t FROM (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM n)),
r AS (SELECT DISTINCT conv_id AS conv, 0::BIGINT AS k, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS z, NULL::STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR) AS s, NULL::STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR) AS u, NULL::STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR) AS a FROM f
UNION ALL SELECT conv, i, {drop('z')}, {best(drop('s'), keep('z', 's'))}, {best(drop('u1'), keep('x', 'u'), rerole('x', 'user'))}, {best(drop('a1'), keep('u1', 'a'), rerole('u1', 'assistant'))} FROM (SELECT *, {best('z', 's', 'a1')} AS x FROM {step})),
c AS (SELECT conv_id AS conv, max(i) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM f) GROUP BY 1),
e AS (SELECT c.*, {best('z', 'a1')} AS w FROM c JOIN {ready('r')} q ON q.conv IS NOT DISTINCT FROM c.conv AND q.k = c.m)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(left(w.lines, greatest(length(w.lines) - 1, 0)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN e ON e.conv IS NOT DISTINCT FROM o.conv_id"""
