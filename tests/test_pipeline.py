import pytest
from pyspark.sql import functions as F

from sextant.operators import pipeline as P


def ranked(spark, xs):
    return spark.createDataFrame([("q", i + 1, r, 1.0 / (i + 1)) for i, r in enumerate(xs)], "qid string, rank int, row long, score double")


def test_config_is_closed():
    assert P.merge_config({"rerank": {"k": 5}})["rerank"] == {"enabled": False, "k": 5, "alpha": 0.0}
    with pytest.raises(ValueError, match="rerank.depth"):
        P.merge_config({"rerank": {"depth": 5}})


def test_stages(spark):
    dense, lexical = ranked(spark, [1, 2, 3]), ranked(spark, [3, 2, 9])
    assert [r["row"] for r in P.run_stages(dense).orderBy("rank").collect()] == [1, 2, 3]
    both = P.run_stages(dense, {"bm25": {"enabled": True}}, lexical)
    assert [r["row"] for r in both.orderBy("rank").collect()] == [3, 2, 1, 9]
    flipped = P.run_stages(dense, {"rerank": {"enabled": True, "k": 2}}, second=lambda head: head.select("qid", "row", F.col("row").cast("double").alias("second")))
    assert [r["row"] for r in flipped.orderBy("rank").collect()] == [2, 1, 3]
    assert [r["score"] for r in P.run_scores(both).orderBy("rank").collect()] == [4, 3, 2, 1]


def test_small_operators(spark, rows):
    assert rows(P.hard_negatives(ranked(spark, [1, 2, 3]), ranked(spark, [2]), 2).select("row")) == [(1,), (3,)]
    files = spark.createDataFrame([("a", "x\r\ny = sorted(z)"), ("b", None)], "file string, text string")
    assert rows(P.line_matches(files, "sorted")) == [("a", 2, "y = sorted(z)")]
    hits = spark.createDataFrame([("q", 1, "l", 2)], "qid string, rank int, lineage string, version int")
    want = spark.createDataFrame([("q", "l", 3, [2, 3]), ("z", "l", 1, [1])], "qid string, lineage string, version int, acceptable array<int>")
    assert tuple(P.version_accuracy(hits, want).first()) == (2, 0.5, 0.0, 0.5)
