import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import evaluate, pipeline, ranking, reports
from sextant.operators import versions as V


def test_paired_report_and_gates(spark):
    frame = lambda xs: spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(xs)], "qid string, rank int")
    base, better = [4, 2, 40, 1] * 60, [1, 2, 9, 1] * 60
    r = reports.paired_report(frame(better), frame(base)).first()
    assert r["delta_mrr"] == pytest.approx((0.75 + 1 / 9) / 4, abs=1e-6) and 0 < r["mrr_ci_low"] < r["delta_mrr"] < r["mrr_ci_high"] and r["adopt"]
    gaps = spark.createDataFrame([(f"q{i}", 0.05 if i % 4 in (0, 2) else 5.0) for i in range(240)], "qid string, gap double")
    sweep = reports.gate_report(gaps, frame(base), frame(better), [0.01, 0.1, 99.0])
    assert reports.best_gate(sweep).first()["threshold"] == 0.1
    assert reports.best_gate(sweep.where("threshold < 0.1")).count() == 0
    assert {x["qid"]: x["mrr_10"] for x in reports.per_query(frame([1, 4, 11])).collect()} == {"q0": 1.0, "q1": 0.25, "q2": 0.0}


def test_groups(spark, rows):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", None, 0.0), (None, "x", 0.5), ("a", "x", 0.5)], "kind string, label string, score double")
    assert rows(reports.group_shares(d, ["kind"])) == [("a", 3, 0.75), (None, 1, 0.25)]
    got = rows(reports.grouped_scores(d, ["kind", "label"], ["score"]).select("kind", "label", "n", "score", "level"))
    assert got == [("a", None, 3, 0.5, 1), (None, "x", 3, 0.666667, 2), (None, None, 1, 0.0, 2), (None, None, 1, 0.5, 1), (None, None, 4, 0.5, 3)]


def test_family_tiebreak(spark, rows):
    s = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.9), ("p", 1, 1.0)], "qid string, row long, score double")
    q, d = spark.createDataFrame([("q", "sorting"), ("p", None)], "qid string, family string"), spark.createDataFrame([(1, None), (2, "sorting")], "row long, family string")
    assert rows(reports.family_tiebreak(s, q, d, 0.2)) == [("p", 1, 1.0), ("q", 1, 1.0), ("q", 2, 1.1)]


def test_delta_report(spark):
    hits = lambda xs: spark.createDataFrame(xs, "qid string, lineage string, version int")
    labels = spark.createDataFrame([("a", "l", 1, [1, 2]), ("b", "m", 2, [2])], "qid string, lineage string, version int, acceptable array<int>")
    r = reports.delta_report(hits([("a", "l", 2), ("b", "l", 1)]), hits([("a", "l", 1)]), labels).first()
    assert (r["plain_lineage"], r["plain_exact"], r["plain_consistent"], r["delta_exact"], r["agreement"]) == (0.5, 0, 0.5, 0.5, 0)


def test_sparse_fuse_equals_dense(spark):
    rng = np.random.default_rng(3)
    dense = [np.where(rng.random((4, 30)) < 0.4, rng.random((4, 30)).round(3), 0) for _ in range(2)]
    frame = lambda m: spark.createDataFrame([(f"q{i}", int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "qid string, row long, score double")
    n = spark.createDataFrame([(30,)], "n long")
    for how, norm in (("zscore", lambda m: (m - m.mean(1, keepdims=True)) / m.std(1, keepdims=True)), ("minmax", lambda m: (m - m.min(1, keepdims=True)) / (m.max(1, keepdims=True) - m.min(1, keepdims=True)))):
        want = 0.7 * norm(dense[0]) + 0.3 * norm(dense[1])
        for r in ranking.sparse_fuse(*map(frame, dense), n, 0.3, how).collect():
            assert r["score"] == pytest.approx(want[int(r["qid"][1:]), r["row"]], abs=2e-6)
    with pytest.raises(ValueError):
        ranking.sparse_fuse(*map(frame, dense), n, how="other")


def test_nearest_rank_against_rows(spark):
    rng = random.Random(1)
    data = [(g, float(rng.randint(0, 9))) for g in "abc" for _ in range(rng.randint(1, 40))] + [("d", None)]
    got = {r["g"]: r for r in evaluate.nearest_rank(spark.createDataFrame(data, "g string, v double"), "v", [1, 50, 95], ["g"]).collect()}
    for g in "abc":
        v = sorted(x for k, x in data if k == g)
        assert [got[g][f"p{p}"] for p in (1, 50, 95)] == [v[max(0, min(len(v) - 1, round(p / 100 * len(v) + 0.5) - 1))] for p in (1, 50, 95)]
    assert "d" not in got


def test_canonical_lineages(spark, rows):
    """A function that is renamed twice keeps its first key; one that comes back without a link starts again."""
    at = {"a": [1, 2], "b": [3], "c": [4, 6], "x": [1, 2, 3, 4, 6], "y": [1, 3], "z": [6]}
    data = [("r", k, v) for k, vs in at.items() for v in vs] + [("other", "a", 1), ("other", "b", 2)]
    links = [("r", 3, "a", "b"), ("r", 4, "b", "c"), ("r", 6, "gone", "z")]
    got = V.canonical_lineages(spark.createDataFrame(data, "repo string, key string, version int"), spark.createDataFrame(links, "repo string, version int, old string, new string"), ["repo"])
    name = {(r["key"], r["version"]): r["lineage_id"] for r in got.where("repo = 'r'").collect()}
    assert name["b", 3] == name["c", 4] == name["c", 6] == name["a", 1] == "a" and name["x", 6] == "x" and name["y", 3] == "y" and name["z", 6] == "z"
    assert rows(got.where("repo = 'other'").select("key", "lineage_id")) == [("a", "a"), ("b", "b")]
    long = [("r", f"k{i}", i) for i in range(60)]
    chain = spark.createDataFrame([("r", i, f"k{i - 1}", f"k{i}") for i in range(1, 60)], "repo string, version int, old string, new string")
    assert {r["lineage_id"] for r in V.canonical_lineages(spark.createDataFrame(long, "repo string, key string, version int"), chain, ["repo"]).collect()} == {"k0"}


def test_totals_and_nested_rows(spark, rows):
    d = spark.createDataFrame([(1, "r", "a", 1, "x"), (2, "r", "b", 1, "x"), (3, "r", "a", 3, "x"), (4, "r", "c", 3, "x")], "row long, repo string, lineage_id string, version int, content_hash string")
    assert rows(V.change_totals(d, ["repo"]).select("version", "added", "removed")) == [(1, 2, 0), (3, 2, 1)]
    nested = spark.createDataFrame([("s", [(1, "x"), (2, "y")]), ("t", []), ("u", None)], "snippet_id string, versions array<struct<version:int,text:string>>")
    assert rows(V.rows_for(nested, [2]).select("doc_id", "text")) == [("s@v2", "y")] and V.rows_for(nested).count() == 2


def test_text_functions(spark):
    one = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert one("Crème brûlée ﬁn", T.strip_accents) == "Creme brulee fin" and one(None, T.strip_accents) is None
    assert one(" a \t\n b ", T.normalize_whitespace) == "a b"
    assert one("The Quick, brown fox", lambda c: T.highlight(c, F.lit("quick FOX"))) == "The **Quick,** brown **fox**"
    assert one("``This function adds numbers.`\nMore", T.clean_description) == "adds numbers." and one(None, T.clean_description) == ""
    assert one("p", lambda c: T.judge_prompt(c, F.lit(" code "))).endswith("PROBLEM:\np\nCODE:\ncode")
    assert one("which files call `open_it` before close_it()?", T.subject_pair) == ("open_it", "close_it") and one("who calls x", T.subject_pair) is None


def test_labellers(spark, rows):
    code = "import os, sys\nfrom a.b import sys as s\n# sorted(x)\ndef sorted(x):\n    return x.sorted() + sorted(1)\nasync def g(a):\n\n    '''Says what it does at length.'''\ndef h(a):\n    \"\"\"TODO write this one day soon\"\"\"\n"
    lines = pipeline.source_lines(spark.createDataFrame([("f.py", code), ("f.py", code), ("n.py", None)], "file string, text string"))
    assert rows(pipeline.grep_calls(lines, "sorted")) == [("f.py", 5)] and rows(pipeline.grep_imports(lines, "sys")) == [("f.py", 1), ("f.py", 2)]
    assert rows(pipeline.grep_defs(lines)) == [("g", "f.py", 6), ("h", "f.py", 9), ("sorted", "f.py", 4)] and rows(pipeline.grep_text(lines, "TODO")) == [("f.py", 10)]
    assert rows(pipeline.docstring_questions(lines)) == [("Says what it does at length.", "g", "f.py", 6)]


def test_score_pairs_sorts_by_length(spark, rows):
    def score(queries, texts):
        assert [len(q) + len(t) for q, t in zip(queries, texts)] == sorted((len(q) + len(t) for q, t in zip(queries, texts)), reverse=True)
        return [float(len(t)) for t in texts]

    d = spark.createDataFrame([(i, "q", "x" * (7 * i % 11)) for i in range(40)] + [(99, None, None)], "row long, query string, text string").coalesce(1)
    got = {r["row"]: r["second"] for r in pipeline.score_pairs(d, score, batch=8).collect()}
    assert got == {i: 7 * i % 11 for i in range(40)} | {99: 0}
