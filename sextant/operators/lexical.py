"""Lexical retrieval: Okapi BM25 and TF-IDF over an inverted index that is a plain DataFrame."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import SEVERAL_PARTS, code_tokens
from sextant.operators.ranking import top_k
from sextant.runtime import busy, cut, together

#: Rows of query terms that are broadcast, at most (some 60 bytes each).
BROADCAST_TERMS = 500_000
_CAPITALS, _PART = re.compile("([A-Z])([A-Z][a-z])"), re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NAME, _SEVERAL = re.compile("[A-Za-z_][A-Za-z0-9_]*"), re.compile(SEVERAL_PARTS)


def tokens_of(text: str) -> list[str]:
    """The bag of functions.text.code_tokens, in Python: one pass of a compiled pattern is several times cheaper there."""
    whole = [w for w in _NAME.findall(text) if _SEVERAL.search(w)]
    return " ".join(_PART.findall(_CAPITALS.sub(r"\1 \2", text)) + whole).lower().split()


def postings(docs: DataFrame, id: str = "row", text: str = "text", least: int = 1) -> DataFrame:
    """(id, tok, tf, dl): term counts and document lengths. Null texts have no terms.

    Terms are counted where the text is read; only counts are shuffled, once, by id. What is summed per document later
    then needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, toks, tfs, lengths = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                counts = Counter(w for w in tokens_of(t) if len(w) >= least)
                rows += [i] * len(counts)
                lengths += [counts.total()] * len(counts)
                toks += counts.keys()
                tfs += counts.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, kind) for x, kind in ((toks, pa.string()), (tfs, pa.int64()), (lengths, pa.int64()))]], names=[id, "tok", "tf", "dl"])

    kind = docs.schema[id].dataType.simpleString()
    counted = busy(docs.select(id, text).where(F.col(text).isNotNull())).mapInArrow(run, f"{id} {kind}, tok string, tf long, dl long")
    return together(counted, id).groupBy(id, "dl", "tok").agg(F.sum("tf").alias("tf"))


@dataclass
class Index:
    """An inverted index: written postings (id, dl, tok, tf), document frequencies (tok, df) and the number of documents (one row, n)."""

    postings: DataFrame
    frequencies: DataFrame
    documents: DataFrame
    id: str


def build_index(docs: DataFrame, id: str = "row", text: str = "text") -> Index:
    """The postings are written once and read by every search and statistic."""
    tf = cut(postings(docs, id, text))
    return Index(tf, cut(tf.groupBy("tok").agg(F.count("*").alias("df"))), docs.agg(F.count("*").alias("n")), id)


def _small(terms: DataFrame) -> DataFrame:
    """Query terms, broadcast as long as they are few; beyond that the join shuffles."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def _idf(index: Index, epsilon: float) -> DataFrame:
    raw = index.frequencies.crossJoin(F.broadcast(index.documents)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n")
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("tok", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_idf(docs: DataFrame | Index, id: str = "row", text: str = "text", epsilon: float = 0.25) -> DataFrame:
    """(tok, df, idf): ln(N - df + .5) - ln(df + .5); negative ones become epsilon times the mean over all terms."""
    return _idf(docs if isinstance(docs, Index) else build_index(docs, id, text), epsilon)


def bm25_scores(docs: DataFrame | Index, queries: DataFrame, id: str = "row", text: str = "text", qid: str = "qid", query: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(qid, id, score) of all documents that share a term with the query; every other document scores 0.

    Terms of the query count as often as they occur; terms that no document has are dropped. docs may be an Index.
    """
    index = docs if isinstance(docs, Index) else build_index(docs, id, text)
    asked = queries.select(F.col(qid).alias("qid"), F.explode(code_tokens(F.col(query))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qtf"))
    length = index.postings.agg(F.sum("tf").alias("all")).crossJoin(F.broadcast(index.documents)).select(F.when(F.col("n") > 0, F.col("all") / F.col("n")).alias("avgdl"))  # one row
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    terms = cut(asked.join(_idf(index, epsilon).select("tok", "idf"), "tok").crossJoin(F.broadcast(length)))
    per_term = index.postings.join(_small(terms), "tok")
    return per_term.groupBy("qid", index.id).agg(F.round(F.sum(F.col("qtf") * weight), 6).alias("score"))


def bm25_topk(docs: DataFrame | Index, queries: DataFrame, k: int = 10, **options) -> DataFrame:
    """(qid, rank, row, score): the k best matching documents, ties by row; documents without any query term never rank."""
    return top_k(bm25_scores(docs, queries, **options), k)


def tfidf_scores(docs: DataFrame | Index, queries: DataFrame, id: str = "row", text: str = "text", qid: str = "qid", query: str = "text") -> DataFrame:
    """(qid, id, score): TF-IDF cosine of documents that share a term; idf = ln((1 + N) / (1 + df)) + 1 over the documents, tf relative to the length."""
    index = docs if isinstance(docs, Index) else build_index(docs, id, text)
    idf = index.frequencies.crossJoin(F.broadcast(index.documents)).select("tok", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    asked = cut(postings(queries.select(F.col(qid).alias("qid"), F.col(query).alias("q")), "qid", "q").join(idf, "tok").select("qid", "tok", (F.col("tf") / F.col("dl") * F.col("idf")).alias("qw")))
    q_norm = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    vocabulary = _small(cut(idf))
    weighted = index.postings.join(vocabulary, "tok").select(index.id, "tok", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w"))
    norm = weighted.groupBy(index.id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    dots = weighted.join(_small(asked), "tok").groupBy("qid", index.id).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    normed = dots.join(norm, index.id).join(F.broadcast(q_norm), "qid")  # as many rows as queries, fewer than their terms
    return normed.select("qid", index.id, F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))


def tfidf_topk(docs: DataFrame | Index, queries: DataFrame, k: int = 10, id: str = "row", **options) -> DataFrame:
    """(qid, rank, row, score): the k documents of greatest TF-IDF cosine, ties by row."""
    return top_k(tfidf_scores(docs, queries, id=id, **options), k, row=docs.id if isinstance(docs, Index) else id)
