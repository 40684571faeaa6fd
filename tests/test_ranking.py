import math

import pytest

from sextant.operators import evaluate as E
from sextant.operators import ranking as R


def scores(spark, lists):
    return spark.createDataFrame([(q, i, float(s)) for q, xs in lists.items() for i, s in enumerate(xs)], "qid string, row long, score double")


def ranked(spark, lists):
    return spark.createDataFrame([(q, i + 1, r, 1.0 / (i + 1)) for q, xs in lists.items() for i, r in enumerate(xs)], "qid string, rank int, row long, score double")


def order(df):
    return [r["row"] for r in df.orderBy("rank").collect()]


def test_top_k_ties(spark):
    assert order(R.top_k(scores(spark, {"q": [0.1, 0.9, 0.5, 0.9, 0.2]}), 3)) == [1, 3, 2]
    assert R.top_k(scores(spark, {"q": [1]}), 0).count() == 0


def test_rrf(spark):
    lists = {"a": [40, 70, 20, 10], "b": [20, 90, 70]}
    out = R.rrf([ranked(spark, {"q": lists["a"]}), ranked(spark, {"q": lists["b"]})], [1.0, 0.5], k=10)
    want = {row: sum(w / (10 + x.index(row) + 1) for x, w in zip(lists.values(), (1.0, 0.5)) if row in x) for row in {*lists["a"], *lists["b"]}}
    got = {r["row"]: r["score"] for r in out.collect()}
    assert got == {row: pytest.approx(v, abs=1e-9) for row, v in want.items()}
    assert order(out) == sorted(want, key=lambda row: -want[row])
    # equal scores: the row that the first list ranks best comes first
    assert order(R.rrf([ranked(spark, {"q": [7, 5]}), ranked(spark, {"q": [5, 7]})])) == [7, 5]


def test_normalise_and_fuse(spark):
    s = scores(spark, {"q": [1, 2, 3], "flat": [5, 5]})
    from pyspark.sql import functions as F

    got = {(r["qid"], r["row"]): (r["z"], r["m"]) for r in s.select("qid", "row", R.normalise(F.col("score"), ["qid"]).alias("z"), R.normalise(F.col("score"), ["qid"], "minmax").alias("m")).collect()}
    assert [got["q", i][1] for i in range(3)] == [0, 0.5, 1] and got["flat", 0] == (0, 0.5)
    fused = R.score_fuse(scores(spark, {"q": [3, 2, 1]}), scores(spark, {"q": [1, 2, 3]}), 0.5)
    assert all(r["score"] == 0 for r in fused.collect())


def test_rerank(spark):
    first = spark.createDataFrame([("q", i + 1, 10 + i, s) for i, s in enumerate([0.9, 0.5, 0.1])], "qid string, rank int, row long, score double")
    second = spark.createDataFrame([("q", 10 + i, s) for i, s in enumerate([0.0, 0.1, 0.9])], "qid string, row long, second double")
    assert order(R.rerank(first, second, 3, 1.0)) == [10, 11, 12]
    assert order(R.rerank(first, second, 3, 0.0)) == [12, 11, 10]
    tail = R.rerank(first, second, 2, 0.0)
    got = {r["row"]: (r["rank"], r["score"]) for r in tail.collect()}
    assert got[12] == (3, 0.1) and got[10] == (2, pytest.approx(0.1 + 1e-6))
    assert order(R.rerank(first, second.where("row = 10"), 3, 0.0)) == [10, 11, 12]


def test_gap_and_rejudge(spark):
    r = spark.createDataFrame([("q", i + 1, i, s) for i, s in enumerate([3.0, 2.0, 1.0, 0.0])], "qid string, rank int, row long, score double")
    assert R.confidence_gap(r).first()["gap"] == pytest.approx(1 / math.sqrt(1.25))
    h = spark.createDataFrame([("q", i + 1, i, s) for i, s in enumerate([0.50, 0.49, 0.48, 0.10, 0.05])], "qid string, rank int, row long, score double")
    j = spark.createDataFrame([("q", 0, 0.1), ("q", 1, 0.9), ("q", 2, 0.5)], "qid string, row long, judge double")
    out = R.rejudge(h, j, top=3, beta=1.0)
    assert order(out) == [1, 2, 0, 3, 4] and out.where("rank = 1").first()["score"] == 0.5


def test_finalize(spark):
    assert order(R.finalize(ranked(spark, {"q": [5, 3]}), ranked(spark, {"q": [3, 1, 5, 2]}), 3)) == [5, 3, 1]


def test_metrics(spark):
    s = spark.createDataFrame([(str(q), i, x) for q in range(3) for i, x in enumerate([0.9, 0.1, 0.5])], "qid string, row long, score double")
    ranks = E.ranks_from_scores(s, spark.createDataFrame([("0", 0), ("1", 2), ("2", 1)], "qid string, row long"))
    assert sorted(r["rank"] for r in ranks.collect()) == [1, 2, 3]
    m = E.summarise(ranks).first()
    assert m["mrr_10"] == pytest.approx((1 + 1 / 2 + 1 / 3) / 3, abs=1e-6) and m["n"] == 3
    assert E.summarise(ranks.where("false")).first()["n"] == 0


def test_graded(spark):
    l = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "qid string, rank int, doc_id string")
    g = spark.createDataFrame([("q", "a", 1), ("q", "b", 3), ("q", "b", 3), ("x", "a", 1), ("q", "c", None)], "qid string, doc_id string, gain int")
    got = {r["qid"]: r["ndcg"] for r in E.graded_ndcg(l, g).collect()}
    assert got["q"] == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)), abs=1e-6) and got["x"] == 0


def test_paired(spark):
    base = spark.createDataFrame([(f"{i}-{k}", r) for k in range(200) for i, r in enumerate([3, 3, 3, 1, 50])], "qid string, rank int")
    new = spark.createDataFrame([(f"{i}-{k}", r) for k in range(200) for i, r in enumerate([1, 1, 3, 1, 50])], "qid string, rank int")
    c = E.adopted(E.paired(new, base)).first()
    assert (c["improved"], c["worsened"]) == (400, 0) and c["ci_low"] > 0 and c["adopt"]


def test_location_hits(spark):
    p = spark.createDataFrame([("q", 1, "src/a.py", 5, 9), ("q", 2, "b.py", 1, 2)], "qid string, rank int, file string, start int, stop int")
    e = spark.createDataFrame([("q", "a.py", 9, 12), ("z", "a.py", 1, 1)], "qid string, file string, start int, stop int")
    got = {r["qid"]: (r["hits"], r["precision"], r["recall"]) for r in E.location_hits(p, e).collect()}
    assert got == {"q": (1, 0.5, 1.0), "z": (0, 0.0, 0.0)}


def test_search_lists_equal_the_join(spark, rows, monkeypatch):
    """Lists of the search in blocks are those of the join: ties, repeated bags, rare and frequent terms, several parts and rounds."""
    import random

    from pyspark.sql import functions as F

    from sextant.operators import lexical as L
    from sextant.operators import search as S
    from sextant.runtime import cut

    for name, value in (("ROUND", 9), ("STEP", 16), ("DENSE", 5), ("POSTINGS", 700)):
        monkeypatch.setattr(S, name, value)
    draw = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    text = lambda n: " ".join(words[min(int(draw.expovariate(0.07)), 89)] for _ in range(n))
    texts = [text(draw.randint(1, 25)) for _ in range(140)]
    docs = spark.createDataFrame([*enumerate(texts + texts[:30] + [None, "", "onlyone"])], "row long, text string")
    asked = [(f"q{i}", text(12)) for i in range(20)] + [("twice", words[1]), ("twice", words[2]), ("none", "unknown"), ("null", None), ("empty", "")]
    queries = spark.createDataFrame(asked, "qid string, text string")
    corpus = S.Corpus(docs, queries)
    assert corpus.plain and corpus.parts > 1
    got = cut(S.top_lists(docs, queries, 7))
    index = L.build_index(docs)
    merged = queries.where("text is not null").groupBy("qid").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    for li, want in ((S.BM25, L.bm25_topk(index, merged, 7)), (S.TFIDF, L.tfidf_topk(index, merged, 7))):
        assert rows(got.where(F.col("li") == li).select("qid", "rank", "row", "score")) == rows(want)
    fused = R.top_k(R.sparse_fuse(L.bm25_scores(index, merged), L.tfidf_scores(index, merged), index.documents, 0.4, "minmax"), 7)
    assert rows(S.minmax_over_all(docs, merged, 0.4, 7)) == rows(fused)
    lists = [x.select("qid", "rank", "row", "score") for x in (got.where("li = 0"), got.where("li = 1"))]
    for how in ("zscore", "minmax"):
        assert rows(R.score_fuse_tagged(got, 0.3, how)) == rows(R.score_fuse(*lists, 0.3, how))
    repeated = docs.unionByName(docs.where("row < 3"))
    assert not S.Corpus(repeated, queries).plain
    assert rows(S.top_lists(repeated, merged, 3, (S.BM25,)).drop("li")) == rows(L.bm25_topk(repeated, merged, 3))


def test_zscore_fuse_asks_with_every_query(spark):
    """Every query with a text has a list, not every 20th."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    asked = {r.qid for r in spark.read.parquet(f"{folder}/queries.parquet").where("text is not null").collect()}
    assert {r.qid for r in entry.queries()["zscore_fuse"](spark, folder).select("qid").distinct().collect()} == asked
    assert "% 20" not in entry.oracle_sql()["zscore_fuse"]
