"""Queries over whole retrieval runs and the smaller operators around them, with the SQL they must equal."""

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import dense, pipeline
from sextant.plans import retrieval as R
from sextant.runtime import cut, table


def full_pipeline(spark, folder):
    lexical, first = R._both(spark, folder, 50)
    config = {"bm25": {"enabled": True}, "rrf": {"depth": 50}, "rerank": {"enabled": True, "k": 10, "alpha": 0.25}, "final_depth": 50}
    return pipeline.run_scores(pipeline.run_stages(first, config, lexical, second=lambda head: R._judged(spark, folder, head)))


def encoded_pipeline(spark, folder):
    """The pipeline at its default depths: hashing encoder and vector search, BM25, fusion, reranking and re-judging by a mock judge."""
    docs, asked = R._docs(spark, folder), R._asked(spark, folder)
    vectors = cut(dense.dense_vectors(dense.hashing_encoder(docs, "row", "text"), "row"))
    queries = dense.dense_vectors(dense.hashing_encoder(asked, "qid", "text"), "qid")
    first = cut(dense.dense_topk(vectors, queries, 1000))
    config = {"bm25": {"enabled": True}, "rerank": {"enabled": True}, "rejudge": {"enabled": True}}
    judge = lambda head: R._judged(spark, folder, head)
    return pipeline.run_scores(pipeline.run_stages(first, config, R._bm25(spark, folder, 100), second=judge, judge=lambda head: judge(head).withColumnRenamed("second", "judge")))


def hard_negatives(spark, folder):
    return pipeline.hard_negatives(R._bm25(spark, folder, 20), R._targets(spark, folder))


def mock_descriptions(spark, folder):
    rows = table(spark, folder, "index_rows").where("text is not null")
    return rows.select("row", pipeline.mock_description(F.col("text")).alias("description"), F.substring(F.sha2("text", 256), 1, 24).alias("snippet_key"))


def line_matches(spark, folder):
    return pipeline.line_matches(table(spark, folder, "source_files"), r"\bsorted\(")


def word_bigrams(spark, folder):
    return pipeline.bigrams(table(spark, folder, "documents"), "doc_id", "text")


def sentence_lengths(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select("source", F.explode(T.split_sentences(F.col("text"))).alias("s"))
    return d.groupBy("source").agg(F.count("*").alias("sentences"), F.round(F.avg(F.length("s")), 6).alias("mean_chars"))


def hourly_events(spark, folder):
    from sextant.streaming.reindex import windowed_counts

    return windowed_counts(table(spark, folder, "events"), window="1 hour").select("start", "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (full_pipeline, encoded_pipeline, hard_negatives, mock_descriptions, line_matches, word_bigrams, sentence_lengths, hourly_events)}
_RUN = f"""{R._BM25}, {R._TFIDF}, l as (select qid, row, rank, 0 as li from bmr where false union all select qid, row, rank, 0 from tir where rank <= 50 union all select qid, row, rank, 1 from bmr where rank <= 50),
f as (select qid, row, round(sum(1 / (60 + rank)), 9) as score, min(li * 1000 + rank) as first from l group by all), fr as (select qid, row, score, row_number() over (partition by qid order by score desc, first, row) as rank from f),
j as (select b.qid, b.row, round(least(1.0, 2 * ({R._JACCARD(R._LOW('a.text'), R._LOW('d.text'))})), 3) as second from fr b join asked a using (qid) join index_rows d on d.row = b.row where rank <= 10),
head as (select b.*, second from fr b join j using (qid, row) where b.rank <= 10), mixed as (select *, round(0.25 * ({R._Z}) + 0.75 * ({R._Z.replace('score', 'second')}), 9) as mixed from head),
rr as (select qid, row, row_number() over (partition by qid order by mixed desc, rank) as rank from mixed union all select qid, row, rank from fr where rank > 10),
p as (select qid, row, 0 as part, rank from rr union all select qid, row, 1, rank from tir t where rank <= 50 and not exists (select 1 from rr where rr.qid = t.qid and rr.row = t.row)),
o as (select qid, row, row_number() over (partition by qid order by part, rank, row) as rank from p)"""

SQL = {
    "full_pipeline": f"with {_RUN} select qid, rank, row, count(*) over (partition by qid) - rank + 1 as score from o where rank <= 50",
    "hard_negatives": f"""with {R._BM25}, {R._TARGETS}, w as (select b.qid, b.row, b.rank from bmr b where rank <= 20 and not exists (select 1 from targets t where t.qid = b.qid and t.row = b.row)),
      p as (select qid, row, row_number() over (partition by qid order by rank) as place from w) select qid, place, row from p where place <= 5""",
    "mock_descriptions": "select row, substr(lower(array_to_string(list_filter(list_slice(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), 1, 8), lambda w: length(w) > 2), ' ')), 1, 120) as description, substr(sha256(text), 1, 24) as snippet_key from index_rows where text is not null",
    "line_matches": r"with l as (select file, regexp_split_to_array(text, '\r\n|\r|\n') as ls from source_files where text is not null), n as (select file, unnest(range(1, len(ls) + 1)) as line, ls from l) select distinct file, cast(line as int) as line, ls[line] as content from n where regexp_matches(ls[line], '\bsorted\(')",
    "word_bigrams": r"with w as (select regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null), b as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bigram from w where len(w) > 1) select bigram, count(*) as n from b group by bigram order by n desc, bigram limit 20",
    "sentence_lengths": r"with s as (select source, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as s from documents where text is not null) select source, count(*) as sentences, round(avg(length(s)), 6) as mean_chars from s where trim(s) <> '' group by source",
    "hourly_events": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
}
