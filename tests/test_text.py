import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.code import looks_like_code


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize("ident, parts", [("maxSubArray_v2", ["max", "sub", "array", "v", "2"]), ("HTTPServer", ["http", "server"]), ("snake_case_name", ["snake", "case", "name"])])
def test_split_identifier(spark, ident, parts):
    assert one(spark, ident, T.split_identifier) == parts


def test_code_tokens(spark):
    assert sorted(one(spark, "x = 12 + maxSub_v2", T.code_tokens)) == sorted(["x", "12", "max", "sub", "v", "2", "maxsub_v2"])
    assert one(spark, None, T.code_tokens) is None
    assert one(spark, "", T.code_tokens) == []


def test_query_terms(spark):
    assert one(spark, "Find the Shortest path, the path of a tree", T.query_terms) == ["shortest", "path", "tree"]
    assert one(spark, None, T.query_terms) == []


@pytest.mark.parametrize("reply, score", [('{"score": 0.7, "reason": "x"}', 0.7), ("score: 0.25", 0.25), ("I say 1", 1.0), ('{"score": 7}', 1.0), ("nothing", None), (None, None)])
def test_reply_score(spark, reply, score):
    assert one(spark, reply, T.reply_score) == score


def test_narrative_keeps_short_texts(spark):
    long = "word " * 40 + "\nInput:\n1 2\nOutput:\n3"
    assert one(spark, long, lambda c: T.transform_query(c, "narrative")) == ("word " * 40).strip()
    assert one(spark, "short\nInput:\n1", lambda c: T.transform_query(c, "narrative")) == "short\nInput:\n1"


@pytest.mark.parametrize(
    "query, kind, intent, subject",
    [
        ("who calls parse_config", "structural", "who_calls", "parse_config"),
        ("what does load call", "structural", "what_calls", "load"),
        ("where is numpy imported", "structural", "where_imported", "numpy"),
        ("def f(x):\n    return x", "code_query", None, None),
        ("sort a list quickly", "nl_intent", None, None),
        ("x\nInput:\n1\nOutput:\n2", "problem_statement", None, None),
        ("", "nl_intent", None, None),
    ],
)
def test_route(spark, query, kind, intent, subject):
    r = spark.createDataFrame([(query,)], "t string").select(T.route(F.col("t"), looks_like_code("t")).alias("r")).first()["r"]
    assert (r["kind"], r["intent"], r["subject"]) == (kind, intent, subject)


def test_ids(spark):
    r = one(spark, "a.py::f@v2@v13", T.doc_id_parts)
    assert (r["snippet_id"], r["version"]) == ("a.py::f@v2", 13)


def test_textkit(spark):
    assert one(spark, "One two. Three? Four", T.split_sentences) == ["One two.", "Three?", "Four"]
    assert one(spark, "a b c d", lambda c: T.truncate_words(c, 2)) == "a b..."
    assert one(spark, "a b c", lambda c: T.ngrams(F.split(c, " "), 2)) == ["a b", "b c"]
