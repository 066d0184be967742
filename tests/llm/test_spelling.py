import random
import re
import zlib
from collections import Counter

import pytest
from lattica.llm import spelling as S


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """The contract over all pairs of words."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus(seed, alphabet, stems):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 12))) for _ in range(stems)]
    words = list(base)
    for w in base:
        for _ in range(rng.randint(0, 6)):
            k, c = rng.randrange(len(w)), rng.choice(alphabet)
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w + c]))
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice(words[: rng.randint(20, len(words))]) for _ in range(rng.randint(0, 400)))))
    return rows + [(None, rows[0][1]), (3, None), (4, ""), (5, "Straße Étude ×÷×÷× " * 5), (6, "a" * 30_000 + " " + "a" * 30_001 + " x") , (7, "a" * 30_000), (8, "a" * 30_000), (9, "a" * 30_001), (10, "a" * 30_001)]


@pytest.mark.parametrize(("alphabet", "rare", "most"), [("abcé", 2, 3), ("abcdefghijklmnop", 4, 64), ("ab", 32, 5)])
def test_words(spark, tmp_path, monkeypatch, alphabet, rare, most):
    """Few letters make frequent grams and long lists; low limits take every way."""
    monkeypatch.setattr(S, "RARE", rare)
    monkeypatch.setattr(S, "LIST", most)
    monkeypatch.setattr(S, "HELD", 100)
    monkeypatch.setattr(S, "LONG", 8)
    rows = corpus(len(alphabet), alphabet, 150)
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = result(S.op13_spelling(spark, str(tmp_path))), brute(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}
    assert any(v[0] for v in got.values()) and any(v[0] != v[1] and v[0] for v in got.values())


def test_entries_outlive_edits():
    """Whatever the edit and the dictionary, two near words have an entry in common."""
    rng = random.Random(1)
    for _ in range(3000):
        letters = rng.choice(["ab", "abcdé"])
        frequent = frozenset("".join(rng.choice("^$" + letters) for _ in range(rng.choice([2, 3]))) for _ in range(rng.choice([0, 10, 200])))
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
        k, c = rng.randrange(len(w)), rng.choice(letters)
        x = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w + c])
        if x == w:
            continue
        keys = [{(side, f"^{y}$"[-n:] if side else f"^{y}$"[:n]) for side, n in S.entries(y, frequent)} for y in (w, x)]
        assert keys[0] & keys[1], (w, x)


def test_empty(spark, empty):
    assert S.op13_spelling(spark, empty).count() == 0
