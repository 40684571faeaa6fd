import ast

from pyspark.sql import functions as F

from sextant.operators import code as C
from sextant.operators import dense as D
from sextant.operators import lexical as L
from sextant.operators import shape as S
from sextant.operators import versions as V


def test_hash_forms():
    assert V.hash_form("a = 1  # note\n\n\tb  =  2 \r\n") == V.hash_form("a = 1\n    b = 2")
    assert V.hash_form("s = '# no'") == "s = '# no'" and V.hash_form("") == ""
    assert V.match_form("    x = 1  # c\n\n    y = 2\n") == "x = 1\ny = 2"
    assert V.match_form("def (") == "def ("


def test_change_labels_and_asof(spark, rows):
    d = spark.createDataFrame([(1, "r", "a", 1, "x"), (2, "r", "a", 2, "x"), (3, "r", "a", 3, "y"), (4, "r", "b", 1, "q"), (5, "r", "b", 3, "q"), (6, "r", None, 1, "q")], "row long, repo string, lineage_id string, version int, content_hash string")
    got = {(r["lineage_id"], r["version"]): r["change"] for r in V.change_labels(d, ["repo"]).collect()}
    assert got == {("a", 1): "added", ("a", 2): "unchanged", ("a", 3): "modified", ("b", 1): "added", ("b", 3): "added"}
    assert rows(V.as_of(d.where("lineage_id is not null"), 2, ["lineage_id"]).select("row")) == [(2,), (4,)]


def test_compare_rankings(spark):
    side = lambda xs: spark.createDataFrame([("q", i + 1, s, s) for i, s in enumerate(xs)], "qid string, rank int, lineage_id string, content_hash string")
    got = {r["lineage_id"]: r["status"] for r in V.compare_rankings(side(["s1", "s2", "s3", "s4"]), side(["s2", "s1", "s5", "s4"])).collect()}
    assert sorted(got.values()) == ["appeared", "disappeared", "moved", "moved", "same"]


def test_renames(spark):
    body = "def {}(items):\n    total = 0\n    for x in items:\n        total += x\n    return total\n"
    d = [("r", "removed", "a", "function", "old", body.format("old")), ("r", "added", "b", "function", "new", body.format("new")), ("r", "added", "c", "function", "far", "def far():\n    import os\n    return os.listdir('.') or [1, 2, 3]\n"), ("r", "added", "n", "function", "x", None)]
    out = V.rename_links(spark.createDataFrame(d, "repo string, side string, id string, kind string, name string, text string"), ["repo"]).collect()
    assert [(r["old"], r["new"], r["similarity"]) for r in out] == [("a", "b", 1.0)]
    from collections import Counter

    assert V.multiset_jaccard(Counter("aab"), Counter("abb")) == 2 / 4


def test_renames_by_shared_tokens(spark):
    """Every pair that brute force finds, matched best first, also where tokens repeat and sizes sit at the bound."""
    import random
    from collections import Counter

    rng, d = random.Random(3), []
    for side in ("removed", "added"):
        for i in range(40):
            words = [rng.choice("abcd")] * rng.randint(0, 3) + [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(8, 12))] + ["("] * 12
            d.append((i % 2, side, f"{side}{i:02}", "function", "f", " ".join(words) + " '"))
    want = []
    for g in (0, 1):
        of = lambda side: [(r[2], Counter(V.body_tokens(r[5], "f"))) for r in d if r[0] == g and r[1] == side]  # noqa: B023,E731
        scored = sorted((-round(V.multiset_jaccard(a, b), 6), o, n) for o, a in of("removed") for n, b in of("added"))
        used = set()
        for s, o, n in scored:
            if -s >= 0.8 and not {o, n} & used:
                used |= {o, n}
                want.append((g, o, n, -s))
    got = V.rename_links(spark.createDataFrame(d, "version int, side string, id string, kind string, name string, text string"), ["version"]).collect()
    assert len(want) > 10 and sorted(tuple(r) for r in got) == sorted(want)


def test_rename_links_of_every_snapshot(spark, tmp_path):
    """Renames after version 2 and across a snapshot that was not delivered."""
    from sextant.plans import versions as P

    body = "def {}(items):\n    total = 0\n    for x in items:\n        total += x\n    return total\n"
    names = {1: "a", 3: "b", 4: "b", 5: "c"}
    d = [(i, "r", "s", "f.py::a", v, "f.py", "function", n, n, body.format(n), "h") for i, (v, n) in enumerate(names.items())]
    spark.createDataFrame(d, "row long, repo string, subdir string, lineage_id string, version int, file string, kind string, name string, qualname string, text string, content_hash string").write.parquet(str(tmp_path / "index_versions.parquet"))
    got = sorted((r["version"], r["old"], r["new"]) for r in P.rename_links(spark, str(tmp_path)).collect())
    assert got == [(3, "f.py::a", "f.py::b"), (5, "f.py::b", "f.py::c")]


def test_reindex_plan(spark, rows):
    mk = lambda d: V.occurrence_keys(spark.createDataFrame(d, "file string, kind string, qualname string, start_line int, end_line int, text string"))
    old = mk([("f", "function", "a", 1, 2, "x"), ("f", "function", "b", 3, 4, "y"), ("f", "function", "b", 5, 6, "y2")])
    new = mk([("f", "function", "a", 9, 10, "x"), ("f", "function", "b", 3, 4, "z"), ("g", None, "d", 1, 1, "w")])
    assert sorted(r["status"] for r in V.reindex_plan(old, new).collect()) == ["added", "modified", "removed", "unchanged"]


def test_every_snapshot_is_compared(spark, tmp_path):
    """Later snapshots, one that was not delivered, and an ingest without snapshot 1."""
    from sextant.plans import versions as P

    texts = {("r", 1): {"a": "x"}, ("r", 3): {"a": "y", "b": "x"}, ("r", 4): {"b": "x"}, ("q", 2): {"a": "x"}, ("q", 3): {"a": "x\nz"}}
    d = [(repo, "s", f"f.py::{n}", v, "f.py", "function", n, 1, 1, t, t) for (repo, v), of in texts.items() for n, t in of.items()]
    d = [(i, *r) for i, r in enumerate(d)]
    spark.createDataFrame(d, "row long, repo string, subdir string, lineage_id string, version int, file string, kind string, qualname string, start_line int, end_line int, text string, content_hash string").write.parquet(str(tmp_path / "index_versions.parquet"))
    got = {(r["repo"], r["version"], r["status"]): r["n"] for r in P.reindex_history(spark, str(tmp_path)).collect()}
    assert got == {("q", 2, "added"): 1, ("q", 3, "modified"): 1, ("r", 1, "added"): 1, ("r", 3, "added"): 1, ("r", 3, "modified"): 1, ("r", 4, "removed"): 1, ("r", 4, "unchanged"): 1}
    assert sorted((r["repo"], r["version"], r["added"], r["removed"]) for r in P.version_diffs(spark, str(tmp_path)).collect()) == [("q", 3, 1, 0), ("r", 3, 1, 1)]
    assert sorted((r["qid"], r["version"], r["lineage_id"][-1], r["status"]) for r in P.version_compare_history(spark, str(tmp_path)).collect()) == [("q/s", 3, "a", "same"), ("r/s", 3, "a", "same"), ("r/s", 3, "b", "appeared"), ("r/s", 4, "a", "disappeared"), ("r/s", 4, "b", "moved")]
    assert sorted((r["qid"], r["version"]) for r in P.lineage_groups_history(spark, str(tmp_path)).collect()) == [("q/s", 2), ("q/s", 3), ("r/s", 1), ("r/s", 3), ("r/s", 3), ("r/s", 4)]


SOURCES = [
    ("x.py", "from y import helper as h\nimport os\n\ndef run(rows):\n    h(rows)\n    for r in rows:\n        sorted(rows)\n    return local(rows)\n\ndef local(q):\n    return 'text value'\n"),
    ("y.py", "class A:\n    def helper(self, n):\n        return self.helper(n - 1)\n\ndef helper(a):\n    os.listdir(a)\n"),
    ("bad.py", "def ("),
    ("none.py", None),
]


def test_facts_and_edges(spark):
    files = spark.createDataFrame(SOURCES, "file string, text string")
    f = C.structural_facts(files)
    assert {(r["qualname"], r["kind"]) for r in f["defs"].collect()} == {("run", "function"), ("local", "function"), ("A", "class"), ("A.helper", "method"), ("helper", "function")}
    edges = {(r["file"], r["callee_text"]): r for r in C.call_edges(f["defs"], f["calls"], f["imports"]).collect()}
    assert edges["x.py", "local"]["callee_key"] == "x.py::local" and edges["x.py", "h"]["ambiguous"] and edges["x.py", "sorted"]["external"]
    assert {r["line"] for r in C.where_imported(f["imports"], "os").collect()} == {2}
    assert C.calls_in_order(f["calls"], "h", "sorted").first()["file"] == "x.py"
    assert {r["how"] for r in C.where_used(f["names"], f["strings"], "rows").collect()} == {"reference"}
    assert [r["file"] for r in C.parse_failures(files).collect()] == ["bad.py"]
    assert {r["qualname"] for r in C.find_definitions(f["defs"], "helper").collect()} == {"A.helper", "helper"}


def test_chunks(spark):
    got = {r["chunk_id"]: r for r in C.chunk_files(spark.createDataFrame(SOURCES, "file string, text string"), methods=True).collect()}
    assert {"x.py:4-8", "y.py:1-3", "y.py:2-3"} <= set(got) and got["y.py:2-3"]["kind"] == "method"
    assert ast.parse(got["x.py:4-8"]["text"])


def test_families_and_smells(spark, rows):
    texts = {
        1: "def walk(n, memo={}):\n    return walk(n - 1)",
        2: "def down(n):\n    return down(n - 1)",
        3: "x = sorted(y)",
        4: "def (",
        5: "",
        6: "import heapq",
        7: "def f(g):\n    for v in g.neighbors:\n        visited = v",
        8: "for i in a:\n    for j in b:\n        c[i][j] = d[i]",
        9: "pad = s.strip().lower()",
        10: None,
    }
    df = spark.createDataFrame(list(texts.items()), "row long, text string").withColumn("parses", F.lit("clash"))
    got = {r["row"]: (r["ast_family"], r["ast_reason"]) for r in S.families(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "dynamic_programming", 2: "recursion", 3: "sorting", 4: "other", 5: "other", 6: "heap_priority", 7: "graph_search", 8: "matrix_grid", 9: "string_processing"}
    assert got[7][1] == "graph vocabulary (neighbors, visited)" and got[4][1] == "does not parse as Python"
    body = "def f(rows):\n    known = []\n    out = ''\n    for r in rows:\n        if r in known:\n            out += 'a'\n        for q in rows:\n            pass\n        len(rows)\n"
    code = spark.createDataFrame([(1, 11, body), (2, 1, "known = []\nwhile a:\n    b = a in known"), (3, 1, "def g():\n    pass\nfor x in y:\n    for z in y:\n        pass"), (4, 1, None)], "row long, at int, text string")
    found = rows(S.smells(code, start=F.col("at")).select("row", "line", "check", "severity"))
    assert found == [(1, 15, "membership_test_on_list", "medium"), (1, 16, "string_concat_in_loop", "medium"), (1, 17, "nested_loop_same_collection", "high"), (1, 19, "loop_invariant_call", "low"), (2, 3, "membership_test_on_list", "medium")]
    told = {r["check"]: r["detail"] for r in S.smells(code).collect()}
    assert told["loop_invariant_call"].startswith("`len(...)` inside a loop uses none of the loop variables (r)")
    assert S.smells(code.limit(0)).count() == 0 and S.families(df.limit(0)).count() == 0
    deep = "x = " + "(" * 50 + "1" + ")" * 50 + "\n" + "".join("    " * i + "if a:\n" for i in range(90)) + "    " * 90 + "pass\n"
    assert S.shape_of(deep)[0]


def test_bm25_against_plain(spark):
    import math
    from collections import Counter

    docs = {1: "def add(a, b): return a", 2: "sort list quick", 3: None, 4: "list list add", 5: "other words", 6: "more of them"}
    q = {"q": "add list list", "oov": "zzz"}
    tok = lambda t: ["".join(c for c in w if c.isalnum()) for w in (t or "").replace("(", " ").replace(",", " ").replace(")", " ").replace(":", " ").lower().split()]
    bags = {i: Counter(tok(t)) for i, t in docs.items()}
    n, avg = len(docs), sum(sum(b.values()) for b in bags.values()) / len(docs)
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    want = {}
    for i, b in bags.items():
        s = sum(idf[w] * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) for w in tok(q["q"]) if b[w])
        if any(b[w] for w in tok(q["q"])):
            want[i] = round(s, 6)
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], "row long, text string, tok string")
    got = L.bm25_scores(d, spark.createDataFrame(list(q.items()), "qid string, text string")).collect()
    assert {r["row"]: r["score"] for r in got} == want and all(r["qid"] == "q" for r in got)


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "row long, embedding array<float>")
    asked = spark.createDataFrame([("q", [3.0, 0.0])], "qid string, embedding array<float>")
    got = D.dense_topk(v, asked, k=2, dim=2).orderBy("rank").collect()
    assert [(r["row"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)]
    assert D.dense_topk(v.where("false"), asked, dim=2).count() == 0 and D.dense_topk(v, asked.where("false"), dim=2).count() == 0
    km = {r["row"]: r["cluster"] for r in D.spherical_kmeans(v, clusters=2, dim=2).collect()}
    assert km[1] == km[2] and set(km) == {1, 2, 3}


def test_delta_round_trip(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, f"l{i % 3}", f"h{i // 2}", [float(x) for x in rng.normal(size=8)]) for i in range(12)]
    df = spark.createDataFrame(rows, "row long, lineage string, hash string, embedding array<double>")
    base, entries = D.delta_entries(df)
    back = {(r["lineage"], r["hash"]): r["embedding"] for r in D.delta_vectors(base, entries).collect()}
    for _, lineage, h, e in rows:
        assert np.allclose(back[lineage, h], e, atol=0.03)


def test_delta_search_in_blocks(spark, rows, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, f"l{i % 5}", f"h{i}", [float(x) for x in rng.normal(size=8)]) for i in range(30)], "row long, lineage string, hash string, embedding array<double>")
    base, entries = D.delta_entries(df)
    asked = df.select(F.col("row").alias("qid"), "embedding")
    whole = rows(D.delta_search(base, entries, asked, k=3, lineage_k=2, dim=8))
    monkeypatch.setattr(D, "QUERY_BLOCK", 8)
    assert len(whole) == 90 and rows(D.delta_search(base, entries, asked, k=3, lineage_k=2, dim=8)) == whole


def test_plan_has_group_limit(spark):
    from sextant.operators.ranking import top_k

    s = spark.range(100).selectExpr("cast(id % 3 as string) as qid", "id as row", "rand() as score")
    assert "WindowGroupLimit" in top_k(s, 5)._jdf.queryExecution().toString()
    assert F is not None


def test_exact_matches_and_code_groups(spark, rows):
    docs = spark.createDataFrame([(1, "x = 1  # note\n"), (2, "    x = 1"), (3, "x = 2"), (4, None), (5, "# only a note"), (6, "s = \"\"\"a  \n b\"\"\""), (7, "s = \"\"\"a\n b\"\"\"")], "row long, text string")
    asked = spark.createDataFrame([("q", "x = 1"), ("none", ""), ("null", None), ("text", "s = \"\"\"a  \n b\"\"\"  ")], "qid string, text string")
    assert rows(V.exact_matches(asked, docs)) == [("q", 1, 1.0), ("q", 2, 1.0)] + []  # the last query's line is held as it is, blanks and all
    hashed = {r["row"]: r["code_hash"] for r in V.with_content_hash(docs).collect()}
    assert hashed[1] == V.with_content_hash(spark.createDataFrame([(1, "x = 1")], "row long, text string")).first()["code_hash"] and hashed[4] is None and hashed[2] != hashed[1]


def test_matched_terms(spark):
    hits = spark.createDataFrame([("sort the items by size", "def sortItems(rows):\n    return sorted(rows, key=item_size)"), (None, "x"), ("a b", None)], "query string, text string")
    got = [[(m["term"], m["identifiers"]) for m in r["matched"]] for r in C.matched_terms(hits).collect()]
    assert got == [[("items", ["item_size", "sortItems"]), ("size", ["item_size"]), ("sort", ["sortItems"])], [], []]


def test_cluster_terms(spark, rows):
    docs = spark.createDataFrame([(i, "alpha common" if i < 4 else "beta common", int(i >= 4)) for i in range(8)] + [(9, None, 1)], "row long, text string, cluster int")
    got = {(c, place): term for c, place, term in rows(D.cluster_terms(docs, top=1))}
    assert got == {(0, 1): "alpha", (1, 1): "beta"} and D.cluster_terms(docs.limit(0)).count() == 0


def test_audit(spark):
    texts = [(1, "import os.path, sys\nfrom a.b import c\n\ndef f(x):\n    return g(x) + len(x) + c(1) + int(input())\n"), (2, "def ("), (3, ""), (4, None), (5, "import sys\nfor line in sys.stdin:\n    print(line)")]
    d = spark.createDataFrame(texts, "row long, text string").withColumn("parses", F.lit("clash"))
    got = {r["row"]: tuple(r)[1:] for r in C.audit_docs(d).collect()}
    assert got == {1: (True, ["a.b", "os.path", "sys"], ["g"], True, 5), 2: (False, [], [], False, 1), 3: (True, [], [], False, 0), 5: (True, ["sys"], [], True, 3)}
    one = C.corpus_audit(d).first()
    assert (one["n"], one["parse_pct"], one["import_pct"], one["stdin_pct"], one["undefined_pct"], one["median_lines"]) == (4, 75.0, 50.0, 50.0, 25.0, 2.0)
    assert C.audit_docs(d.limit(0)).count() == 0


def test_documented_version_queries(spark):
    old, new = "def f(a):\n    \"\"\"Adds numbers of a list together.\"\"\"\n    return a\n", "def f(a):\n    \"\"\"Adds numbers of a list together.\"\"\"\n    totals = a\n    return totals\n"
    d = spark.createDataFrame([(1, "r", "l", 1, old, "f", "x.py"), (2, "r", "l", 2, new, "f", "x.py"), (3, "r", "m", 1, "def g(): pass", "g", "x.py"), (4, "r", "m", 2, "def g(): longer", "g", "x.py")], "row long, repo string, lineage_id string, version int, text string, qualname string, file string")
    got = {r["lineage_id"]: (r["token"], r["query"], r["acceptable"]) for r in V.version_queries(d, ["repo"], documented=True).collect()}
    assert got == {"l": ("totals", "Adds numbers of a list together. totals", [2]), "m": ("longer", "g in x.py longer", [2])}
