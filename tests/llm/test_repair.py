import hashlib
import heapq
import random
import re
import zlib
from array import array
from collections import defaultdict

import pytest

from lattica.llm import repair as R

FORM = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, extra string, part string, code string"


def cheapest(codes):
    """Brute force: the least (cost, audit) first, over all edits; a role string that fits no beginning of the form is left."""
    best = {}
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(codes) and FORM.fullmatch(roles):
            return cost, audit, roles
        state = i, roles[-1:], len(roles) > 1
        if best.get(state, 0):
            continue
        best[state] = 1
        nexts = [(5, "I", i, x) for x in "ua"]
        if i < len(codes):
            initial, fault = divmod(codes[i], 4)
            nexts.append((2, "D", i + 1, ""))
            if fault in (0, 3):
                extra = 5 if fault == 3 else 0
                nexts += [(extra, "K", i + 1, "?sua"[initial])] + [(1 + extra, "R", i + 1, x) for x in "ua"]
        for c, letter, j, x in nexts:
            new = roles + x
            if any(FORM.fullmatch(new + end) for end in ("", "a", "ua")):
                heapq.heappush(heap, (cost + c, audit + letter, j, new))


def test_search_is_exact():
    rng = random.Random(3)
    for k in range(600):
        codes = bytes(4 * rng.choice([0, 1, 2, 2, 3, 3]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(0, 9)))
        cost, audit, roles = cheapest(codes)
        assert R.search(codes)[:2] == (cost, audit), codes
        rows = [("?sua"[c // 4], str(i)) for i, c in enumerate(codes)]
        lines = list(R.lines_of(audit, R.START, iter(rows)))
        assert "".join(x[0] for x in lines) == roles
        if k % 3 == 0:  # weak bounds: dominance and incumbents alone must still prove the same
            weak = array("l", [0]) * (4 * (len(codes) + 1))
            assert R.search(codes, bounds=weak)[:2] == (cost, audit)


def test_pieces_join_exactly():
    rng = random.Random(5)
    for _ in range(200):
        codes = bytes(4 * rng.choice([0, 1, 2, 3]) + rng.choice([0, 0, 1, 3]) for _ in range(rng.randint(2, 30)))
        at = rng.randint(1, len(codes) - 1)
        tail = list(R.suffix_bounds(codes[at:])[:4])
        a = R.search(codes[:at], R.START, tail)
        b = R.search(codes[at:], a[2])
        assert (a[0] + b[0], a[1] + b[1]) == R.search(codes)[:2]


def test_long_conversation():
    rng = random.Random(8)
    codes = bytes(4 * rng.choice([0, 1, 2, 3]) + rng.choice([0, 0, 1, 2, 3]) for _ in range(200_000))
    cost, audit, _ = R.search(codes)
    assert cost == R.suffix_bounds(codes)[0] and sum(x != "I" for x in audit) == len(codes)


def brute(rows):
    """The whole contract, a conversation at a time."""
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv]
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in groups.items():
        ident = " " if conv is None else conv
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{ident}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes, counts = set(), [], [0] * 4
        for _, role, text in found:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            codes.append(4 * max("?sua".find(role[:1]) if role else 0, 0) + fault)
        initials = [role[:1] for _, role, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [t for t, *_ in found if t is not None]
        cost, audit, roles = cheapest(bytes(codes)) if len(codes) < 40 else (*R.search(bytes(codes))[:2], None)
        lines = "\n".join(R.lines_of(audit, R.START, iter([r[1:] for r in found])))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts[1:], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    texts = ["fine.", "yes!", "no end", "", " \t\n", "why?", "fine.\n", "end.) ", "Ünd ß. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for conv in [*range(60), None, -3]:
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice([*texts, None, f"said {turn}."]), "x", "y", "z"))
    rows += [(7, 2, "user", "the same.", "", "", "")] * 40
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t // 3}." if t % 7 else "open", "", "", "") for t in range(700)]
    return rows


def result(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, talk, small, tmp_path, monkeypatch):
    """Ranges of a few rows make conversations cross them, and all repeats meet by shuffle."""
    if small:
        for name, value in (("RANGE_ROWS", 40), ("BROADCAST_ROWS", 0), ("COMMON_ROWS", 3), ("CHUNK", 200)):
            monkeypatch.setattr(R, name, value)
    spark.createDataFrame(talk, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = result(R.op12_repair(spark, str(tmp_path))), brute(talk)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op12_repair(spark, str(tmp_path)).count() == 0
