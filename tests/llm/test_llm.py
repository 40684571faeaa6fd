"""Operators for training data against brute force, round trips and held-out accuracy, with awkward rows."""

import ast
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import formatting, leaks, mixing, neighbours, overlaps, splitting, subjects
from sextant.llm.documented import documented_functions, is_trivial, name_words, unread_files
from sextant.llm.grammars import definitions

WORD = re.compile(r"[^\W_]+")


def clash(df):
    """The same rows with columns whose names operators use inside."""
    extra = ("id", "key", "v", "w", "n", "digest", "canon", "vid", "tokens", "cleaned", "spans", "low")
    for c in extra:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


# ---- splitting ----
TEXTS = [
    "short",
    None,
    "",
    " " * 60,
    "word " * 40,
    "x" * 130,
    "one two\nthree four\n\n" * 6,
    "a line of words here\n" * 9,
    ("p" * 18 + "\n\n") * 5 + "y" * 55 + " tail",
    "l1\r\nl2 \r\n \r\n" * 12,
    "é" * 31 + " " + "ü" * 31,
]


def test_split_round_trip(spark):
    df = clash(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "row long, text string"))
    got = {}
    for r in splitting.split_oversized(df, limit=30, overlap=6).orderBy("row", "piece").collect():
        got.setdefault(r["row"], []).append(r)
    assert set(got) == {i for i, t in enumerate(TEXTS) if t and len(t) > 30}
    for i, pieces in got.items():
        text = TEXTS[i]
        assert "".join(text[p["start"] : p["stop"]] for p in pieces) == text
        assert [p["piece"] for p in pieces] == list(range(1, pieces[0]["pieces"] + 1))
        for before, p in zip(pieces, pieces[1:]):
            assert p["piece_text"].startswith(before["piece_text"][-6:])
        assert all(0 < len(p["piece_text"]) <= 30 for p in pieces)
    assert got[5][0]["boundary"] == "none" and got[4][0]["boundary"] == "space" and got[7][0]["boundary"] == "line" and got[6][0]["boundary"] == "blank"
    assert all(p["cut"] in ("blank", "end") for p in got[6]) and all(p["cut"] in ("line", "end") for p in got[7])
    assert splitting.split_oversized(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=5, overlap=5)


def test_split_is_optimal():
    rng = random.Random(0)
    for _ in range(30):
        text = "".join(rng.choice(["ab ", "c\n", "dd\n\n", "eee"]) for _ in range(25))
        positions, levels = splitting.candidates(text, *splitting.structure(text)[:2], 12)
        best = splitting.cuts(positions, levels, 16, 4)

        def cost(path):
            total = 0.0
            for a, b in zip(path, path[1:]):
                size, cap = positions[b] - positions[a], 16 if a == 0 else 12
                total += ((cap - size) / cap) ** 2 + (splitting.PENALTIES[levels[b]] if b < len(positions) - 1 else 0)
            return total

        table = {0: 0.0}
        for j in range(1, len(positions)):
            table[j] = min(table[i] + cost([i, j]) for i in range(j) if positions[j] - positions[i] <= (16 if i == 0 else 12))
        assert cost(best) == pytest.approx(table[len(positions) - 1])


# ---- formatting ----
VALUES = ["Ab c!", "abc", "A B C", None, "", "?!", "abd", "name: Joe X\nage: 5", '{"AGE": "5", "name": "joe-x"}', "age:5\nname: joex", '{"name": "joe", "n": 5}', "abc", "É a", "é-A", '{"k": "v"}', "k v"]


def canon(s):
    return "".join(c for c in s.casefold() if c.isalnum())


def record(s):
    if s is None or not canon(s):
        return None
    pairs = None
    try:
        o = json.loads(s)
        pairs = list(o.items()) if isinstance(o, dict) and o and all(isinstance(v, str) for v in o.values()) else None
    except ValueError:
        lines = [re.fullmatch(r"\s*([^\W_]+)\s*:(.*\S.*)", x) for x in s.splitlines() if x.strip()]
        pairs = [(m[1], m[2]) for m in lines] if lines and all(lines) else None
    return tuple(sorted((canon(a), canon(b)) for a, b in pairs)) if pairs and len(pairs) > 1 else canon(s)


def brute_copies(values):
    groups = {}
    for i, v in enumerate(values):
        if (k := record(v)) is not None:
            groups.setdefault(k, []).append(i)
    return {(i, g[0], len(g)) for g in groups.values() if len(g) > 1 for i in g}


@pytest.mark.parametrize("least", [10_000, 1])
def test_formatting(spark, monkeypatch, least):
    monkeypatch.setattr(formatting, "HOT_LEAST", least)  # with 1, repeated values take the way of hot ones
    df = clash(spark.createDataFrame(list(enumerate(VALUES)), "row long, text string"))
    assert {tuple(r) for r in formatting.formatting_duplicates(df).collect()} == brute_copies(VALUES)
    _, records = formatting.distinct_records(df, "row", "text")
    assert {r["low"]: r["copies"] for r in records.collect() if r["copies"] > 1} == {low: n for _, low, n in brute_copies(VALUES)}
    assert formatting.formatting_duplicates(df.where("false")).count() == 0


# ---- overlaps ----
def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        for limit in (0, 1, 3, 20):
            d = lev(a, b)
            assert overlaps.edit_distance(a, b, limit) == min(d, limit + 1), (a, b, limit)


def test_windows_are_the_cheapest():
    from itertools import combinations

    rng = random.Random(2)
    costs, need = [np.array([rng.randint(0, 5) for _ in range(rng.randint(6, 10))]) for _ in range(50)], [rng.randint(1, 3) for _ in range(50)]
    for c, k, got in zip(costs, need, overlaps.cheapest_windows(costs, 2, need)):
        best = min(sum(c[i] for i in w) for w in combinations(range(len(c)), k) if all(y - x >= 2 for x, y in zip(w, w[1:])))
        assert len(got) == k and all(y - x >= 2 for x, y in zip(got, got[1:])) and c[got].sum() == best
    long = [np.arange(9000) % 7, np.arange(5)]  # cut into segments
    for c, k, got in zip(long, [1500, 2], overlaps.probes(long, 4, [1500, 2])):
        assert len(got) == k and (np.diff(got) >= 4).all() and got.max() < len(c)


def test_winnowing_agrees_on_shared_stretches():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, 1 << 10)
    for _ in range(50):
        shared = rng.integers(0, 1 << 62, 5).astype(np.uint64)
        sides = []
        for n in rng.integers(0, 9, 2):
            own = rng.integers(0, 1 << 62, n).astype(np.uint64)
            grams = overlaps.rolling(np.concatenate([own, shared, own[::-1]]), 3)
            sides.append(set(grams[overlaps.winnow(grams, counts[(grams % np.uint64(1 << 10)).astype(int)], 3)].tolist()))
        assert sides[0] & sides[1]


def mutate(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        i = rng.randrange(len(ws))
        how = rng.randrange(3)
        if how == 0:
            ws[i] = f"m{rng.randint(0, 99)}"
        elif how == 1 and len(ws) > 1:
            del ws[i]
        else:
            ws.insert(i, f"i{rng.randint(0, 99)}")
    return ws


def test_overlaps(spark, rows):
    rng = random.Random(3)
    train, held = [("t-null", None), ("t-none", "?!"), ("t1", "Only one"), ("t1", "Only one"), ("t2", "x")], [("e-null", None), ("e1", "only ONE!"), ("e2", "x"), ("e3", "y")]
    for i in range(60):
        n = rng.choice([3, 6, 7, 9, 13, 14, 19, 20, 23, 30, 60, 120])
        base = [f"{rng.choice('abcdef')}{rng.randint(0, 30)}" for _ in range(n)] if i % 3 else ["the", "first", "line", "holds"] * (n // 4 + 1)
        train.append((f"t{i + 10}", " ".join(base)))
        held.append((f"e{i + 10}", ", ".join(mutate(rng, base, rng.randint(0, max(1, n // 5))))))
    want = set()
    for t, a in train:
        for e, b in held:
            x, y = WORD.findall((a or "").lower()), WORD.findall((b or "").lower())
            if x and y and lev(x, y) <= 15 * max(len(x), len(y)) // 100:
                want.add((t, e))
    make = lambda d: clash(spark.createDataFrame(d, "qid string, text string"))
    got = overlaps.cross_split_overlaps(make(train), make(held))
    found = {(r["train_id"], r["eval_id"]): r for r in got.collect()}
    assert set(found) == want and len(want) > 40
    assert found["t1", "e1"]["coverage"] == 1 and all(0.85 - 1e-9 <= r["coverage"] <= 1 for r in found.values())
    # tables that fill up let more fingerprints through, the result stays
    assert {(r["train_id"], r["eval_id"]) for r in overlaps.cross_split_overlaps(make(train), make(held), sketch_bits=4, map_bits=4, spare=0).collect()} == want
    assert overlaps.cross_split_overlaps(make(train).where("false"), make(held)).count() == 0
    report = overlaps.overlap_report(got, spark.createDataFrame([("e1", "test", None), ("e1", "test", None), ("e3", "test", "s")], "qid string, split string, source string"))
    assert rows(report.select("split", "source", "records", "overlapping")) == [("test", "s", 1, 0), ("test", None, 1, 1)]


def test_overlaps_of_very_long_and_hot_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(6000)]
    plain = "the first line holds one number and the second line holds another number of the same kind " * 3
    train = [("long", " ".join(base))] + [(f"t{i}", plain + f"note {i} {i * 7}") for i in range(40)] + [(f"copy{i}", plain) for i in range(30)]
    held = [("near", " ".join(mutate(rng, base, 800))), ("far", " ".join(mutate(rng, base, 1300)))] + [(f"e{i}", plain + f"remark {i} {i * 11}") for i in range(40)]
    make = lambda d: spark.createDataFrame(d, "qid string, text string")
    got = {(r["train_id"], r["eval_id"]) for r in overlaps.cross_split_overlaps(make(train), make(held)).collect()}
    assert {x for x in got if "long" in x} == {("long", "near")}
    assert got - {("long", "near")} == {(t, e) for t, _ in train[1:] for e, _ in held[2:]}


# ---- neighbours ----
def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 64))
    v = (centres[rng.integers(0, 12, 900)] + 0.7 * rng.normal(size=(900, 64))).astype(np.float32)
    v[100:140] = v[100]  # copies
    v[200] = 3 * v[201]  # not of unit length
    data = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0] * 32), (1004, [None] + [1.0] * 63)]
    df = clash(spark.createDataFrame(data, "row long, embedding array<float>"))
    got = {}
    for r in neighbours.nearest_vectors(df).collect():
        got.setdefault(r["row"], {})[r["rank"]] = (r["neighbour"], r["cosine"])
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    edge = -np.partition(-s, 9, axis=1)[:, 9]
    assert set(got) == set(range(900)) and all(sorted(x) == list(range(1, 11)) for x in got.values())
    recall = np.mean([s[i, n] >= edge[i] - 1e-5 for i, x in got.items() for n, _ in x.values()])
    assert recall >= 0.9
    assert all(n != i for i, x in got.items() for n, _ in x.values()) and all(len({n for n, _ in x.values()}) == 10 for x in got.values())
    assert [n for n, _ in (got[105][k] for k in range(1, 11))] == list(range(100, 105)) + list(range(106, 111))
    assert neighbours.nearest_vectors(df.where("false")).count() == 0
    assert neighbours.nearest_vectors(df.where("row = 5")).count() == 0
    assert neighbours.nearest_vectors(df.where("row in (5, 6)")).count() == 2


def test_neighbours_blocks(spark, monkeypatch):
    """Small blocks, as hot pivots would have, give the same result."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(rng.normal(size=(300, 64)).astype(np.float32))], "row long, embedding array<float>")
    monkeypatch.setattr(neighbours, "calibrate", lambda *_: (4, 10_000, 1.0))
    run = lambda: {(r["row"], r["rank"]): (r["neighbour"], round(r["cosine"], 4)) for r in neighbours.nearest_vectors(df, pivots=4).collect()}
    whole = run()
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    again = run()
    assert set(again) == set(whole) and sum(again[k] != whole[k] for k in whole) <= 3  # rounding of single precision


def test_neighbours_without_clusters(spark):
    """Calibration keeps the recall where vectors have no structure at all."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argpartition(-s, 10, axis=1)[:, :10]
    found = {}
    for r in neighbours.nearest_vectors(df).collect():
        found.setdefault(r["row"], set()).add(r["neighbour"])
    assert np.mean([len(found[i] & set(t.tolist())) / 10 for i, t in enumerate(true)]) >= 0.93


def test_neighbours_leave_out_nothing_that_is_met(spark, monkeypatch):
    """Where all files are visited the result is that of brute force, however few candidates a ranking would take."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(700, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, embedding array<float>")
    monkeypatch.setattr(neighbours, "calibrate", lambda *_: (26, 1, 1.0))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    edge = -np.partition(-s, 9, axis=1)[:, 9]
    got = neighbours.nearest_vectors(df, pivots=26).collect()
    assert len(got) == 7000 and len({(r["row"], r["neighbour"]) for r in got}) == 7000
    assert all(s[r["row"], r["neighbour"]] >= edge[r["row"]] - 1e-5 for r in got)


def test_neighbours_search_costs_little_more_than_the_product():
    """Choosing the best of a block takes a few times its matrix product at most (ranking by footrule took some twenty times)."""
    import time

    rng = np.random.default_rng(9)
    unit = rng.normal(size=(20_000, 64)).astype(np.float32)
    posts = [np.uint16(x).tobytes() for x in rng.integers(0, 40, len(unit))]
    block = neighbours.Block(np.arange(len(unit)), np.zeros(len(unit), bool), unit, posts, np.uint16, 40)
    queries = unit[:256]

    def took(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    product = min(took(lambda: unit @ queries.T) for _ in range(5))
    search = min(took(lambda: block.search(queries, np.arange(40), 11)) for _ in range(5))
    assert search < 8 * product
    at, cosine = block.search(queries, np.arange(0, 40, 2), 11)
    there = np.isin(np.frombuffer(b"".join(posts), np.uint16), np.arange(0, 40, 2))
    true = np.sort(np.where(there[:, None], unit @ queries.T, -np.inf), axis=0)[::-1][:11].T
    assert there[at].all() and np.allclose(np.sort(cosine, axis=1)[:, ::-1], true, atol=1e-3)


def test_footrule_against_definition():
    rng = np.random.default_rng(7)
    q, d = (np.array([rng.permutation(20) for _ in range(n)]) for n in (5, 9))
    got = neighbours.footrule(neighbours.ranks_of(q, 20, 6), d[:, :6])
    for a in range(5):
        for b in range(9):
            assert got[a, b] == sum(abs(min(q[a].tolist().index(p), 6) - place) for place, p in enumerate(d[b, :6]))


def test_pack_is_lossless():
    v = np.array([[0.5, 0.25], [0.1, 1e-9], [1e6, 3.0]], np.float32)
    import pandas as pd

    assert np.allclose(neighbours.unpack(pd.Series(neighbours.pack(v)), 2), v / np.linalg.norm(v, axis=1, keepdims=True))


# ---- documented functions ----
SOURCE = '''"""Module text that is long enough."""
import os
@decorated(
    x)
async def fetch(a, b: "x:y" = ")",
          c={1: 2}) -> 'list[int]':  # note
    """Fetch the rows of every page."""
    def inner(): "Count all the open pages."; return 1
    if a:
        class Local:
            def method(self):
                r\'\'\'Give back \\d the raw
                text as found.\'\'\'
                return f"{a["k"]} {{}}"
    return inner
class Big(Base):
    \'\'\'Class text here is long.\'\'\'
    x = """
def not_a_function(): "no"
"""
    def plain(self):
        # comment first
        ("Joined text of"
         " two parts.")
    def todo(self):
        """TODO write this text later."""
    def getRowCount(self):
        """Get the row count of a row."""
    def bytes(self):
        b"Bytes are no docstring here."
    def formatted(self):
        f"Formatted is no docstring either."
    def part(self):
        "This one is a %s string" % 1
    def short(self): "Too short text"
def tabbed():
\tif 1:
\t\tpass
\t"""Not the first statement of it."""
def last():
    """The last one\\
 continues over lines."""'''


def by_ast(text):
    out = set()

    def walk(node, above):
        for c in ast.iter_child_nodes(node):
            named = isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            if named and not isinstance(c, ast.ClassDef):
                out.add((".".join([*above, c.name]), c.lineno, ast.get_docstring(c, clean=False)))
            walk(c, [*above, c.name] if named else above)

    walk(ast.parse(text), [])
    return out


def by_grammar(text):
    source, found, _ = definitions(text, ".py")
    out = set()

    def walk(ds, above):
        for d in ds:
            if d.kind == "function":
                out.add((".".join([*above, d.name]), source.count("\n", 0, d.start) + 1, d.documentation))
            walk(d.inner, [*above, d.name])

    walk(found, [])
    return out


def test_grammar_agrees_with_ast():
    assert by_grammar(SOURCE) == by_ast(SOURCE)
    odd = "def a():\n    x = f'{b['c']}'; y = f'#{d}'\n    if x:\n        z = [1,\n  2]\n        def e():\n            \"Four words are here.\"\n        g = {'h': (i, [j])}\n\n# out of place\n    def k(l='m:', *, n=(o, {p: q})) -> 'r': 's'\n\nt = rb'\\'' + b\"\"\nclass U: v = 1\n"
    assert by_grammar(odd) == by_ast(odd)
    folder = os.path.dirname(os.__file__)
    for path in sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".py")):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        assert by_grammar(text) == by_ast(text), path


def test_documented(spark, rows):
    files = [("a.py", SOURCE), ("a.py", SOURCE), ("b.py", None), ("c.py", ""), ("d.py", "print 'x'"), ("e.txt", SOURCE), (None, SOURCE), ("f.py", "﻿def f():\r\n\t'''Do it with four words.'''\r\n")]
    df = clash(spark.createDataFrame(files, "file string, text string"))
    got = {(r["file"], r["qualname"]) for r in documented_functions(df).collect()}
    assert got == {("a.py", x) for x in ("fetch", "fetch.inner", "fetch.Local.method", "Big.plain", "last")} | {("f.py", "f")}
    one = documented_functions(df).where("qualname = 'fetch'").first()
    assert one["start_line"] == 5 and one["code"].startswith("async def fetch") and one["code"].endswith("return inner")
    assert name_words("getRowCount_v2") == {"get", "row", "count", "v2"} and is_trivial("The getter of a row x", "get_row") is False


def test_unread_files(spark, rows):
    nested = "".join("    " * i + f"def f{i}():\n" for i in range(90)) + "    " * 90 + "'Four words say it.'\n"
    files = [("a.py", "def f(:"), ("b.py", nested), ("c.py", "x = " + "(" * 190 + ")" * 190), ("d.js", "(" * 60_000), ("e.js", "(" * 5000 + ")" * 5000), ("f.py", None)]
    df = spark.createDataFrame(files, "file string, text string")
    assert rows(unread_files(df)) == [("a.py", "not valid"), ("d.js", "nests too deep")]
    assert [r["qualname"].count(".") for r in documented_functions(df).collect()] == [89]


def test_javascript():
    text = "/** Adds two numbers safely. */\nexport function add(a, b) { return a + b; }\nclass A {\n  /** Says hello to you. */\n  hi(x) { if (x) { return '}'; } }\n}\nfunction bare() {}\n"
    _, found, _ = definitions(text, ".js")
    got = {(d.name, d.kind, d.documentation) for d in found} | {(i.name, i.kind, i.documentation) for d in found for i in d.inner}
    assert ("add", "function", "Adds two numbers safely.") in got and ("A", "class", None) in got and ("bare", "function", None) in got
    assert ("hi", "function", "Says hello to you.") in got


# ---- leaks ----
@pytest.mark.parametrize("most", [10**9, 0])
def test_leaks(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "BROADCAST_CHARS", most)  # with 0, n-grams meet in a shuffled join
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(6)] + [(6, "too short"), (7, None), (8, "")]
    docs = [(100, None), (101, ""), (102, " ".join(rng.choice(vocabulary) for _ in range(50)))]
    for i in range(20):
        it = items[i % 6][1].split()
        a = rng.randint(0, 6)
        docs.append((i, "Intro İ " + "-".join(it[a : a + rng.randint(3, 9)]).upper() + " outro\n" + " ".join(rng.choice(vocabulary) for _ in range(5))))
    n = 5
    want = set()
    for d, t in docs:
        ws = WORD.findall((t or "").lower())
        for i, q in items:
            qs = WORD.findall((q or "").lower())
            if {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} & {tuple(qs[k : k + n]) for k in range(len(qs) - n + 1)}:
                want.add((d, i))
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    found = leaks.leaked_passages(df, spark.createDataFrame(items, "item_id long, text string"), words=n)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and want
    # null and repeated ids: every row is searched for itself, whatever the number of scans
    odd = spark.createDataFrame([(None, docs[10][1]), (7, docs[10][1]), (7, docs[11][1]), (7, docs[11][1])], "doc_id long, text string")
    at = lambda i: [x[1:] for x in sorted((r["doc_id"], r["item_id"], r["start"]) for r in found.collect()) if x[0] == i]
    assert sorted((r["doc_id"] is None, r["item_id"], r["start"]) for r in leaks.leaked_passages(odd, spark.createDataFrame(items, "item_id long, text string"), words=n).collect()) == sorted([(True, *x) for x in at(docs[10][0])] + [(False, *x) for x in at(docs[10][0]) + 2 * at(docs[11][0])])
    cleaned = {r["doc_id"]: r for r in leaks.without_passages(spark.createDataFrame(docs, "doc_id long, text string"), found).collect()}
    texts = dict(docs)
    assert set(cleaned) == set(texts)
    for d, r in cleaned.items():
        assert (r["removed_chars"] > 0) == any(x == d for x, _ in want) and len(texts[d] or "") - len(r["text"] or "") == r["removed_chars"]
    assert leaks.leaked_passages(df.where("false"), spark.createDataFrame(items, "item_id long, text string"), words=n).count() == 0


# ---- mixing ----
def test_fit_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 15), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 4) for _ in lengths])
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rng.randint(0, int((lengths * counts).sum()) + 3)
        take = mixing.fit(lengths, counts, budget, window=10**6)
        assert ((0 <= take) & (take <= counts)).all()
        got = int((take * lengths).sum())
        if budget <= (lengths * counts).sum():
            # the even share is fixed first, so the rest is optimal given it; with enough lengths left it is exact
            assert abs(got - budget) <= max(lengths)


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 7), " Big " if i % 2 else "BIG") for i in range(300)] + [(1000 + i, "one two three", "small") for i in range(3)] + [(2000, None, "small"), (2001, "x", None), (2002, "x", "unlisted"), (None, "a b", "big")]
    targets = [("big", 0.5, 1), ("Small", 0.3, 2), ("absent", 0.2, 3), ("nulls", None, None)]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(d, t)
    s = {r["target"]: r for r in shares.collect()}
    assert s["Small"]["short"] and s["absent"]["short"] and not s["big"]["short"] and s["absent"]["got"] == 0
    assert s["Small"]["got"] == 2 * s["Small"]["size"] and abs(s["big"]["got"] - s["big"]["wanted"]) <= 1
    rows = chosen.collect()
    assert max(r["copies"] for r in rows if r["target"] == "Small") == 2 and all(r["copies"] == 1 for r in rows if r["target"] == "big")
    assert sum(r["tokens"] * r["copies"] for r in rows) == sum(r["got"] for r in s.values())
    assert {tuple(r) for r in mixing.mix(d, t)[0].collect()} == {tuple(r) for r in rows}
    assert mixing.mix(d.where("false"), t)[0].count() == 0


def test_p8_found_runs_the_selection(spark, monkeypatch, tmp_path):
    from sextant.llm import queries

    spark.createDataFrame([(i, "word " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("A", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    assert [r["source"] for r in queries.p8_found(spark, str(tmp_path)).collect()] == ["A"]

    def broken(*_):
        raise ValueError("fit was called")

    monkeypatch.setattr(mixing, "fit", broken)
    with pytest.raises(Exception, match="fit was called"):
        queries.p8_found(spark, str(tmp_path)).collect()


# ---- subjects ----
def test_subjects_held_out(spark):
    rng = random.Random(6)
    nouns = {"law": [f"court{c}" for c in "abcdefgh"], "sport": [f"ball{c}" for c in "abcdefgh"], "music": [f"song{c}" for c in "abcdefgh"]}
    filler = ["The answer fits in a word", "Print nothing else after this", "Inputs above the limit are read"]
    docs, truth = [], {}
    for i in range(400):
        mine = rng.sample(sorted(nouns), rng.choice([1, 1, 2]))
        lines = [f"{rng.choice(['Somebody', 'Nobody', 'Once', 'Late'])} put the {rng.choice(nouns[s])} near the {rng.choice(nouns[s])} again" for s in mine for _ in range(rng.randint(4, 6))]
        other = rng.choice(sorted(set(nouns) - set(mine)))
        lines += [f"Once saw the {rng.choice(nouns[other])} there", *rng.sample(filler, 2)]
        rng.shuffle(lines)
        docs.append((i, ". ".join(lines) + ".", "src"))
        truth[i] = set(mine)
    docs += [(1000, None, "src"), (1001, "  ", None), (1002, "Nothing of this kind.", None)]
    labels = [(i, s.upper() if i % 5 == 0 else s, "r") for i in range(80) for s in truth[i]] + [(3, "unknown", "r"), (None, "law", "r")]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    names = spark.createDataFrame([(s, "") for s in nouns], "subject string, description string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    got = {}
    for r in subjects.document_subjects(d, lab, names).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = range(80, 400)
    hit = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert hit / sum(len(truth[i]) for i in held) > 0.95 and hit / sum(len(got.get(i, set())) for i in held) > 0.95
    assert not {1000, 1001, 1002} & set(got)
    assert subjects.document_subjects(d, lab.where("false"), names).count() == 0


def test_subjects_one_rule_and_bounds(spark, monkeypatch):
    """Words of three labelled texts count at any number of labels; more words or subjects than the bounds are an error."""
    docs = [(i, f"text {'rareword' if i < 3 else 'other'} number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x") for i in range(1200)]
    d = spark.createDataFrame(docs, "id long, text string")
    lab = spark.createDataFrame([(i, "law" if i < 300 else "sport") for i in range(1200)], "id long, subject string")
    assert subjects.learn_lexicon(d, lab, ["law", "sport"], rounds=0)["rareword"][0] == 0
    with pytest.raises(ValueError, match="words speak for one subject"):
        subjects.learn_lexicon(d, lab, ["law", "sport"], rounds=0, size=0)
    monkeypatch.setattr(subjects, "SUBJECTS", 1)
    with pytest.raises(ValueError, match="subjects"):
        subjects.document_subjects(d.withColumn("source", F.lit("s")), lab, spark.createDataFrame([("law",), ("sport",)], "subject string"), id="id")


def test_only_the_entry_names_this_package():
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "sextant")):
        if os.path.basename(folder) != "llm":
            for n in (x for x in names if x.endswith(".py")):
                with open(os.path.join(folder, n)) as f:
                    assert "sextant.llm" not in f.read(), n
