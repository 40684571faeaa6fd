"""Queries over the retrieval tables, with the SQL they must equal. Searches ask with every row or query whose number is divisible by 20, zscore_fuse with every query."""

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import dense, evaluate, lexical, ranking, search
from sextant.runtime import cut, table


def _docs(spark, folder):
    return table(spark, folder, "index_rows").select("row", "doc_id", "text")


def _queries(spark, folder):
    """Every query that has a text."""
    return table(spark, folder, "queries").where("text is not null").select("qid", "text").distinct()


def _asked(spark, folder):
    """Every 20th query that has a text."""
    return _queries(spark, folder).where("cast(substr(qid, 2) as bigint) % 20 = 0")


def _vectors(spark, folder):
    rows = table(spark, folder, "index_rows").select("row", "text", "embedding")
    return rows, rows.where("row % 20 = 0").select(F.col("row").alias("qid"), "embedding")


def _targets(spark, folder):
    """The relevant row of each asked query: the least of those with a gain."""
    gains = table(spark, folder, "qrels").where("gain > 0").select("qid", "doc_id").distinct()
    rows = table(spark, folder, "index_rows").groupBy("doc_id").agg(F.max("row").alias("row"))
    return gains.join(_asked(spark, folder).select("qid"), "qid").join(rows, "doc_id").groupBy("qid").agg(F.min("row").alias("row"))


def _index(spark, folder):
    """The inverted index of all rows, written once for all searches of a query."""
    return lexical.build_index(_docs(spark, folder))


def _bm25(spark, folder, k=10):
    return search.top_lists(_docs(spark, folder), _asked(spark, folder), k, (search.BM25,)).drop("li")


def _tfidf(spark, folder, k=10):
    return search.top_lists(_docs(spark, folder), _asked(spark, folder), k, (search.TFIDF,)).drop("li")


def _lists(spark, folder, k):
    """BM25 (li 0) and TF-IDF (li 1) lists of length k, by one search."""
    return search.top_lists(_docs(spark, folder), _asked(spark, folder), k)


def _both(spark, folder, k):
    """The same as two tables, written once."""
    lists = cut(_lists(spark, folder, k))
    return [lists.where(F.col("li") == li).drop("li") for li in (search.BM25, search.TFIDF)]


def _judged(spark, folder, ranked):
    """Mock judgements of ranked rows."""
    return ranked.join(_asked(spark, folder).withColumnRenamed("text", "problem"), "qid").join(_docs(spark, folder).select("row", "text"), "row").select("qid", "row", T.mock_judge(F.col("problem"), F.col("text")).alias("second"))


def dense_topk(spark, folder):
    return dense.dense_topk(*_vectors(spark, folder))


def dense_topk_filtered(spark, folder):
    rows, asked = _vectors(spark, folder)
    return dense.dense_topk(rows.where(F.col("text").contains("sorted(")), asked)


def dense_rank_gaps(spark, folder):
    return ranking.gaps_to_next(dense.dense_topk(*_vectors(spark, folder)))


def dense_collapsed(spark, folder):
    rows, asked = _vectors(spark, folder)
    hits = dense.dense_topk(rows, asked, 50).join(rows.select("row", F.sha2("text", 256).alias("lineage")), "row").where("lineage is not null")
    return ranking.best_per_group(hits, "lineage", 10).select("qid", "rank", "row", "score")


def duplication_at_k(spark, folder):
    from sextant.operators.versions import duplication

    rows, asked = _vectors(spark, folder)
    return duplication(dense.dense_topk(rows, asked).join(rows.select("row", F.coalesce("text", F.lit("")).alias("lineage")), "row"), "lineage")


def label_rank_metrics(spark, folder):
    """Retrieval metrics over embeddings: the best other vector of the same label is the target."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), "embedding", "label")
    hits = dense.dense_topk(v, v.where("row % 20 = 0").select(F.col("row").alias("qid"), "embedding"), 100, exclude_self=True)
    labels = v.select("row", "label")
    same = hits.join(labels, "row").join(labels.select(F.col("row").alias("qid"), F.col("label").alias("want")), "qid").where("label = want")
    found = same.groupBy("qid").agg(F.min("rank").alias("rank"))
    every = v.where("row % 20 = 0").select(F.col("row").alias("qid"))
    return evaluate.summarise(every.join(found, "qid", "left").select("qid", F.coalesce("rank", F.lit(evaluate.RANK_CAP)).alias("rank")))


def bm25_idf(spark, folder):
    return lexical.bm25_idf(_docs(spark, folder)).select("tok", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, folder):
    return _bm25(spark, folder)


def tfidf_topk(spark, folder):
    return _tfidf(spark, folder)


def rrf_hybrid(spark, folder):
    lists = _lists(spark, folder, 100).withColumn("weight", F.when(F.col("li") == search.BM25, 1.0).otherwise(0.5))
    return ranking.rrf_tagged(lists, depth=10)


def zscore_fuse(spark, folder):
    """Asks with every query."""
    lists = search.top_lists(_docs(spark, folder), _queries(spark, folder), 100)
    return ranking.top_k(ranking.score_fuse_tagged(lists, 0.25), 10)


def minmax_fuse(spark, folder):
    return ranking.top_k(ranking.score_fuse_tagged(_lists(spark, folder, 100), 0.4, "minmax"), 10)


def zscore_fuse_all(spark, folder):
    """Fusion of BM25 and TF-IDF scores that are normalised over every document, those that share no term scoring 0."""
    index, asked = _index(spark, folder), _asked(spark, folder)
    scores = lexical.bm25_scores(index, asked), lexical.tfidf_scores(index, asked)
    return ranking.top_k(ranking.sparse_fuse(*scores, index.documents, 0.25, "zscore"), 10)


def minmax_fuse_all(spark, folder):
    return search.minmax_over_all(_docs(spark, folder), _asked(spark, folder), 0.4, 10)


def finalize_lists(spark, folder):
    bm25, tfidf = _both(spark, folder, 30)
    fused = ranking.rrf([x.where("rank <= 5") for x in (bm25, tfidf)], depth=5)
    return ranking.finalize(fused, bm25, 20)


def rerank_interpolate(spark, folder):
    ranked = cut(_bm25(spark, folder, 30))  # read for head, tail and judge
    return ranking.rerank(ranked, _judged(spark, folder, ranked.where("rank <= 10")), 10, 0.25)


def confidence_gaps(spark, folder):
    return ranking.confidence_gap(_bm25(spark, folder, 10)).select("qid", F.round("gap", 6).alias("gap"))


def confidence_gate_sweep(spark, folder):
    ranked, targets = cut(_bm25(spark, folder, 30)), _targets(spark, folder)
    again = ranking.rerank(ranked, _judged(spark, folder, ranked.where("rank <= 10")), 10, 0.25)
    ranks = [evaluate.ranks_from_lists(x, targets) for x in (ranked, again)]
    return ranking.gate_sweep(ranking.confidence_gap(ranked), *ranks, [0, 0.1, 0.2, 0.3, 0.5, 0.75, 1, 1.5, 2, 99])


def rejudge_margin(spark, folder):
    ranked = cut(_bm25(spark, folder, 10))
    return ranking.rejudge(ranked, _judged(spark, folder, ranked.where("rank <= 3")).withColumnRenamed("second", "judge"))


def ir_metrics(spark, folder):
    return evaluate.summarise(evaluate.ranks_from_lists(_bm25(spark, folder, 100), _targets(spark, folder)))


def ranks_by_score(spark, folder):
    return evaluate.ranks_from_scores(lexical.bm25_scores(_docs(spark, folder), _asked(spark, folder)), _targets(spark, folder))


def graded_ndcg(spark, folder):
    ranked = _bm25(spark, folder, 50).join(_docs(spark, folder).select("row", "doc_id"), "row")
    first = ranked.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    return evaluate.graded_ndcg(first, table(spark, folder, "qrels").join(_asked(spark, folder).select("qid"), "qid", "left_semi"))


def paired_compare(spark, folder):
    targets = _targets(spark, folder)
    ranks = [evaluate.ranks_from_lists(x, targets) for x in _both(spark, folder, 100)]
    return evaluate.adopted(evaluate.paired(*ranks))


def ranking_overlap(spark, folder):
    return evaluate.top_overlap(*_both(spark, folder, 10))


def hashing_encoder(spark, folder):
    return dense.hashing_encoder(table(spark, folder, "documents"), "doc_id", "text")


def average_vectors(spark, folder):
    mean = dense.average_vectors(table(spark, folder, "embeddings"), "label", "embedding")
    return mean.select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def _delta(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("lineage"), F.col("vec_id").alias("hash"), F.col("vec_id").alias("row"), "embedding")
    return rows, *dense.delta_entries(rows)


def delta_quantize(spark, folder):
    _, _, entries = _delta(spark, folder)
    return entries.select("lineage", "hash", "pos", F.col("residual").cast("int").alias("residual"), F.round("scale", 9).alias("scale"))


def delta_two_stage(spark, folder):
    rows, base, entries = _delta(spark, folder)
    return dense.delta_search(base, entries, rows.where("row % 20 = 0").select(F.col("row").alias("qid"), "embedding"))


def kmeans_terms(spark, folder):
    rows = table(spark, folder, "index_rows")
    clusters = dense.spherical_kmeans(rows)
    return dense.cluster_terms(rows.select("row", "text").join(clusters, "row"))


def query_terms(spark, folder):
    return table(spark, folder, "queries").select("qid", T.query_terms(F.col("text")).alias("terms")).distinct()


def query_family(spark, folder):
    return table(spark, folder, "queries").select("qid", T.query_family(F.col("text")).alias("family")).distinct()


def query_narrative(spark, folder):
    return table(spark, folder, "queries").where("text is not null").select("qid", T.transform_query(F.col("text"), "narrative").alias("query"), T.format_query(F.col("text"), "solution+no_examples").alias("encoded")).distinct()


def query_routes(spark, folder):
    from sextant.operators.code import looks_like_code

    return table(spark, folder, "queries").select("qid", T.route(F.col("text"), looks_like_code("text")).alias("r")).distinct().select("qid", "r.*")


def explained_hits(spark, folder):
    from sextant.operators.code import matched_terms

    hits = _bm25(spark, folder, 3).join(_asked(spark, folder).withColumnRenamed("text", "query"), "qid").join(_docs(spark, folder).select("row", "text"), "row")
    return matched_terms(hits).select("qid", "rank", "row", F.to_json("matched").alias("matched"))


def failure_groups(spark, folder):
    """Why targets are missed in the first ten."""
    ranked, targets, asked = cut(_bm25(spark, folder, 10)), _targets(spark, folder), _asked(spark, folder)
    missed = evaluate.ranks_from_lists(ranked, targets).where("rank > 10").select("qid")
    docs = _docs(spark, folder).select("row", T.name_set(F.col("text")).alias("names"))
    expected = targets.join(missed, "qid").join(docs.withColumnRenamed("names", "want"), "row").select("qid", "want")
    best = ranked.join(missed, "qid", "left_semi").join(docs, "row").join(expected, "qid").groupBy("qid").agg(F.max(F.round(T.jaccard(F.col("want"), F.col("names")), 6)).alias("best"))
    median = asked.agg(F.percentile(F.length("text"), 0.5).alias("median"))  # one row
    joined = asked.join(missed, "qid").join(best, "qid", "left").crossJoin(F.broadcast(median))
    group = F.when(F.length("text") > 3 * F.col("median"), "very_long_query").when(F.coalesce("best", F.lit(0.0)) >= 0.6, "near_duplicate_corpus").when(F.size(T.name_set(F.col("text"))) < 25, "generic_wording").otherwise("other")
    return joined.groupBy(group.alias("reason")).agg(F.count("*").alias("n"))


def document_make_up(spark, folder):
    d = table(spark, folder, "documents").select("kind", "lang", F.length("text").alias("chars"))
    g = d.groupingSets([[F.col("kind"), F.col("lang")], [F.col("kind")], [F.col("lang")], []], F.col("kind"), F.col("lang"))
    return g.agg(F.count("*").alias("n"), F.count("chars").alias("with_text"), F.sum("chars").alias("chars"), (F.grouping("kind") * 2 + F.grouping("lang")).alias("level"))


def latency_percentiles(spark, folder):
    values = table(spark, folder, "history_ingest").select("repo", "walk_seconds")
    return evaluate.nearest_rank(values, "walk_seconds", [50, 95, 99], ["repo"])


_PARTS = r"list_transform(regexp_extract_all(regexp_replace(i, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
_TOKENS = f"flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda i: case when len({_PARTS}) > 1 then list_append({_PARTS}, lower(i)) else {_PARTS} end))"
_TWENTIETH = " and cast(substr(qid, 2) as bigint) % 20 = 0"
_ASKED = f"asked as (select distinct qid, text from queries where text is not null{_TWENTIETH})"
_TARGETS = "targets as (select g.qid, min(r.row) as row from (select distinct qid, doc_id from qrels where gain > 0) g join asked using (qid) join (select doc_id, max(row) as row from index_rows group by doc_id) r using (doc_id) group by g.qid)"
_BM25 = f"""{_ASKED},
toks as (select row, {_TOKENS} as t from index_rows),
stats as (select count(*) as n, sum(len(t)) / count(*) as avgdl from toks),
tf as (select row, dl, tok, count(*) as tf from (select row, len(t) as dl, unnest(t) as tok from toks) group by all),
raw as (select tok, count(*) as df, ln((select n from stats) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf group by tok),
idf as (select tok, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
qt as (select qid, tok, count(*) as qtf from (select qid, unnest({_TOKENS}) as tok from asked) group by all),
bm as (select qid, row, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avgdl from stats)))), 6) as score from qt join idf using (tok) join tf using (tok) group by all),
bmr as (select qid, row, score, row_number() over (partition by qid order by score desc, row) as rank from bm)"""
_TFIDF = """tidf as (select tok, ln((1 + (select n from stats)) / (1 + count(*))) + 1 as idf from tf group by tok),
dw as (select row, tok, tf / dl * idf as w from tf join tidf using (tok)), dn as (select row, sqrt(sum(w * w)) as dn from dw group by row),
ql as (select qid, sum(qtf) as ql from qt group by qid), qw as (select qid, tok, qtf / ql * idf as qw from qt join ql using (qid) join tidf using (tok)), qn as (select qid, sqrt(sum(qw * qw)) as qn from qw group by qid),
ti as (select qid, row, round(dot / (dn * qn), 6) as score from (select qid, row, sum(w * qw) as dot from dw join qw using (tok) group by all) join dn using (row) join qn using (qid)),
tir as (select qid, row, score, row_number() over (partition by qid order by score desc, row) as rank from ti)"""
_FUSED = lambda how, w: f"""{_BM25}, {_TFIDF}, na as (select qid, row, {how} as a from bmr where rank <= 100), nb as (select qid, row, {how} as b from tir where rank <= 100),
f as (select qid, row, round(a * {1 - w} + b * {w}, 6) as score from na join nb using (qid, row)),
fr as (select *, row_number() over (partition by qid order by score desc, row) as rank from f) select qid, rank, row, score from fr where rank <= 10"""  # noqa: E731
_STATS_ALL = lambda t: f"(select qid, sum(score) as s, sum(score * score) as q, (select n from stats) as n, least(min(score), case when count(*) < (select n from stats) then 0 else min(score) end) as lo, greatest(max(score), case when count(*) < (select n from stats) then 0 else max(score) end) as hi from {t} group by qid)"
_FUSED_ALL = lambda norm, w: f"""{_BM25}, {_TFIDF}, u as (select qid, row from bm union select qid, row from ti),
na as (select u.qid, u.row, {norm} as a from u join {_STATS_ALL('bm')} x using (qid) left join bm using (qid, row)), nb as (select u.qid, u.row, {norm} as b from u join {_STATS_ALL('ti')} x using (qid) left join ti using (qid, row)),
f as (select qid, row, round(a * {1 - w} + b * {w}, 6) as score from na join nb using (qid, row)), fr as (select *, row_number() over (partition by qid order by score desc, row) as rank from f) select qid, rank, row, score from fr where rank <= 10"""  # noqa: E731
_Z = "case when stddev_pop(score) over (partition by qid) > 1e-12 then (score - avg(score) over (partition by qid)) / stddev_pop(score) over (partition by qid) else 0 end"
_M = "case when max(score) over (partition by qid) > min(score) over (partition by qid) then (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) else 0.5 end"
_DENSE = """v as (select row, text, cast(embedding as double[]) as e from index_rows where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
u as (select row, text, e, sqrt(list_dot_product(e, e)) as n from v)"""
_HITS = lambda where="true": f"""{_DENSE}, s as (select q.row as qid, d.row, round(list_dot_product(q.e, d.e) / (q.n * d.n), 6) as score from u q join u d on {where} where q.row % 20 = 0),
r as (select qid, row, score, row_number() over (partition by qid order by score desc, row) as rank from s)"""  # noqa: E731
_WORDSET = lambda c: f"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda w: lower(w)))"
_JACCARD = lambda a, b: f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) else 0 end"
_LOW = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z]{{3,}}'))"
_JUDGE = f"judged as (select b.qid, b.row, round(least(1.0, 2 * ({_JACCARD(_LOW('a.text'), _LOW('d.text'))})), 3) as second from bmr b join asked a using (qid) join index_rows d on d.row = b.row where rank <= 10)"
_RERANK = f"""{_JUDGE}, head as (select b.qid, b.rank, b.row, b.score, j.second from bmr b join judged j using (qid, row) where b.rank <= 10),
mixed as (select *, round(0.25 * ({_Z}) + 0.75 * ({_Z.replace('score', 'second')}), 9) as mixed from head),
tail as (select qid, max(score) as tail_top from bmr where rank between 11 and 30 group by qid),
rr as (select qid, row_number() over (partition by qid order by mixed desc, rank) as rank, row, round(mixed - min(mixed) over (partition by qid) + coalesce(tail_top, 0) + 1e-6, 6) as score from mixed left join tail using (qid)
  union all select qid, rank, row, score from bmr where rank between 11 and 30)"""
_GAP = "gap as (select qid, case when count(*) < 2 then cast('inf' as double) when stddev_pop(score) < 1e-9 then 0 else (max(case when rank = 1 then score end) - max(case when rank = 2 then score end)) / stddev_pop(score) end as gap from bmr where rank <= 10 group by qid)"
_METRICS = """count(*) as n, round(avg(case when rank <= 10 then 1 / log2(rank + 1) else 0 end), 6) as ndcg_10, round(avg(case when rank <= 10 then 1 / rank else 0 end), 6) as mrr_10,
 round(avg(cast(rank <= 1 as int)), 6) as recall_1, round(avg(cast(rank <= 10 as int)), 6) as recall_10, round(avg(cast(rank <= 100 as int)), 6) as recall_100, round(avg(cast(rank <= 1000 as int)), 6) as recall_1000, quantile_cont(rank, 0.5) as median_rank"""


def _narrative_sql(words):
    pattern = rf"(?im)^[ \t#*\-]*(?:{words})\b[^\n]{{0,25}}$"
    head = rf"regexp_replace(regexp_replace(text, '{pattern}(?s:.*)', ''), '\s+$', '')"
    return rf"case when regexp_matches(text, '{pattern}') and length({head}) >= 120 then {head} else text end"


QUERIES = {
    f.__name__: f
    for f in (
        *(dense_topk, dense_topk_filtered, dense_rank_gaps, dense_collapsed, duplication_at_k, label_rank_metrics, bm25_idf, bm25_topk, tfidf_topk, rrf_hybrid, zscore_fuse, minmax_fuse, zscore_fuse_all, minmax_fuse_all, finalize_lists),
        *(rerank_interpolate, confidence_gaps, confidence_gate_sweep, rejudge_margin, ir_metrics, ranks_by_score, graded_ndcg, paired_compare, ranking_overlap, hashing_encoder, average_vectors, delta_quantize, delta_two_stage, kmeans_terms),
        *(query_terms, query_family, query_narrative, query_routes, explained_hits, failure_groups, document_make_up, latency_percentiles),
    )
}
SQL = {
    "dense_topk": f"with {_HITS()} select qid, rank, row, score from r where rank <= 10",
    "dense_topk_filtered": f"with {_HITS("contains(d.text, 'sorted(')")} select qid, rank, row, score from r where rank <= 10",
    "dense_rank_gaps": f"with {_HITS()} select qid, rank, row, score, round(score - lead(score) over (partition by qid order by rank), 6) as gap from r where rank <= 10",
    "dense_collapsed": f"""with {_HITS()}, c as (select r.*, i.text, row_number() over (partition by qid, i.text order by rank) as place from r join index_rows i using (row) where rank <= 50 and i.text is not null),
      d as (select qid, row, score, row_number() over (partition by qid order by rank) as rank from c where place = 1) select qid, rank, row, score from d where rank <= 10""",
    "duplication_at_k": f"with {_HITS()} select qid, count(*) as slots, count(distinct coalesce(i.text, '')) as lineages, round(100.0 * (count(*) - count(distinct coalesce(i.text, ''))) / count(*), 4) as duplicate_pct from r join index_rows i using (row) where rank <= 10 group by qid",
    "label_rank_metrics": f"""with e as (select vec_id, label, cast(embedding as double[]) as e from embeddings), s as (select q.vec_id as qid, d.vec_id as row, q.label as want, d.label, round(list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(d.e, d.e)), 6) as score from e q join e d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0),
      r as (select *, row_number() over (partition by qid order by score desc, row) as k from s), t as (select qid, coalesce(min(case when label = want and k <= 100 then k end), 1001) as rank from r group by qid) select {_METRICS} from t""",
    "bm25_idf": f"with {_BM25} select tok, df, round(idf, 6) as idf from idf",
    "bm25_topk": f"with {_BM25} select qid, rank, row, score from bmr where rank <= 10",
    "tfidf_topk": f"with {_BM25}, {_TFIDF} select qid, rank, row, score from tir where rank <= 10",
    "rrf_hybrid": f"""with {_BM25}, {_TFIDF}, l as (select qid, row, rank, 0 as li, 1.0 as w from bmr where rank <= 100 union all select qid, row, rank, 1, 0.5 from tir where rank <= 100),
      f as (select qid, row, round(sum(w / (60 + rank)), 9) as score, min(li * 1000 + rank) as first from l group by all), fr as (select *, row_number() over (partition by qid order by score desc, first, row) as rank from f) select qid, rank, row, score from fr where rank <= 10""",
    "zscore_fuse": "with " + _FUSED(_Z, 0.25).replace(_ASKED, _ASKED.replace(_TWENTIETH, "")),
    "minmax_fuse": "with " + _FUSED(_M, 0.4),
    "zscore_fuse_all": "with " + _FUSED_ALL("case when sqrt(greatest(q / n - (s / n) ** 2, 0)) > 1e-12 then (coalesce(score, 0) - s / n) / sqrt(greatest(q / n - (s / n) ** 2, 0)) else 0 end", 0.25),
    "minmax_fuse_all": "with " + _FUSED_ALL("case when hi > lo then (coalesce(score, 0) - lo) / (hi - lo) else 0.5 end", 0.4),
    "finalize_lists": f"""with {_BM25}, {_TFIDF}, l as (select qid, row, rank, 0 as li from bmr where rank <= 5 union all select qid, row, rank, 1 from tir where rank <= 5),
      f as (select qid, row, round(sum(1 / (60 + rank)), 9) as score, min(li * 1000 + rank) as first from l group by all), fr as (select qid, row, row_number() over (partition by qid order by score desc, first, row) as rank from f),
      p as (select qid, row, 0 as part, rank from fr where rank <= 5 union all select qid, row, 1, rank from bmr b where rank <= 30 and not exists (select 1 from fr where fr.rank <= 5 and fr.qid = b.qid and fr.row = b.row)),
      o as (select qid, row, row_number() over (partition by qid order by part, rank, row) as rank from p) select qid, rank, row from o where rank <= 20""",
    "rerank_interpolate": f"with {_BM25}, {_RERANK} select qid, rank, row, score from rr",
    "confidence_gaps": f"with {_BM25}, {_GAP} select qid, round(gap, 6) as gap from gap",
    "confidence_gate_sweep": f"""with {_BM25}, {_TARGETS}, {_RERANK}, {_GAP}, b as (select qid, coalesce(rank, 1001) as b from targets left join (select qid, row, rank from bmr where rank <= 30) using (qid, row)), a as (select qid, coalesce(rank, 1001) as r from targets left join rr using (qid, row))
      select threshold, round(avg(cast(gap < threshold as int)), 6) as reranked, round(avg(1 / case when gap < threshold then r else b end), 6) as mrr from gap join b using (qid) join a using (qid), (select cast(unnest([0, 0.1, 0.2, 0.3, 0.5, 0.75, 1, 1.5, 2, 99]) as double) as threshold) group by threshold""",
    "rejudge_margin": f"""with {_BM25}, {_JUDGE}, {_GAP}, head as (select b.*, second from bmr b join judged using (qid, row) join gap using (qid) where b.rank <= 3 and gap < 0.5),
      m as (select *, round(0.5 * ({_M}) + 0.5 * second, 9) as f from head), n as (select qid, row, row_number() over (partition by qid order by f desc, rank) as rank from m)
      select n.qid, n.rank, n.row, head.score from n join head on n.qid = head.qid and n.rank = head.rank union all select qid, rank, row, score from bmr b where rank <= 10 and not exists (select 1 from head h where h.qid = b.qid and h.rank = b.rank)""",
    "ir_metrics": f"with {_BM25}, {_TARGETS}, t as (select coalesce(rank, 1001) as rank from targets left join (select qid, row, rank from bmr where rank <= 100) using (qid, row)) select {_METRICS} from t",
    "ranks_by_score": f"with {_BM25}, {_TARGETS}, k as (select qid, row, rank() over (partition by qid order by score desc) as k from bm) select qid, least(coalesce(k, 1001), 1001) as rank from targets left join k using (qid, row)",
    "graded_ndcg": f"""with {_BM25}, g as (select qid, doc_id, max(gain) as gain from qrels join asked using (qid) where gain > 0 group by all), i as (select qid, gain, row_number() over (partition by qid order by gain desc, doc_id) as r from g),
      ideal as (select qid, sum(gain / log2(r + 1)) as idcg from i where r <= 10 group by qid), l as (select qid, doc_id, min(rank) as rank from bmr join index_rows using (row) where rank <= 50 group by all),
      got as (select qid, sum(gain / log2(rank + 1)) as dcg, min(rank) as first from l join g using (qid, doc_id) where rank <= 10 group by qid) select qid, round(coalesce(dcg / idcg, 0), 6) as ndcg, round(coalesce(1 / first, 0), 6) as mrr from ideal left join got using (qid)""",
    "ranking_overlap": f"""with {_BM25}, {_TFIDF}, a as (select qid, list(row order by rank) as a from bmr where rank <= 10 group by qid), b as (select qid, list(row order by rank) as b from tir where rank <= 10 group by qid)
      select count(*) as queries, round(avg(len(list_intersect(a, b)) / greatest(len(a), 1)), 6) as overlap, round(avg(cast(a[1] <> b[1] as int)), 6) as first_changed, round(avg(cast(a = b as int)), 6) as identical from a join b using (qid)""",
    "hashing_encoder": r"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from documents), k as (select doc_id, unnest(case when len(t) > 0 then t else ['__empty__'] end) as tok from t),
      h as (select doc_id, sha256(tok) as h from k), s as (select doc_id, cast(cast('0x' || substr(h, 1, 8) as bigint) % 64 as int) as bucket, sum(case when cast('0x' || substr(h, 9, 2) as int) % 2 = 1 then 1 else -1 end) as v from h group by all),
      n as (select *, sqrt(sum(v * v) over (partition by doc_id)) as norm from s) select doc_id, bucket, round(v / greatest(norm, 1e-12), 6) as value from n where v <> 0""",
    "average_vectors": """with p as (select label, unnest(range(64)) as pos, embedding as e, sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) as n from embeddings), m as (select label, pos, avg(cast(e[pos + 1] as double) / n) as x from p group by all)
      select label, list(round(x / norm, 6) order by pos) as embedding from (select *, sqrt(sum(x * x) over (partition by label)) as norm from m) group by label""",
    "delta_quantize": """with p as (select label as lineage, vec_id as hash, unnest(range(64)) as pos, embedding as e from embeddings), x as (select lineage, hash, cast(pos as int) as pos, cast(e[pos + 1] as double) as v from p), b as (select lineage, pos, round(avg(v), 6) as base from x group by all),
      d as (select lineage, hash, pos, v - base as d from x join b using (lineage, pos)), s as (select *, case when max(abs(d)) over (partition by lineage, hash) > 0 then max(abs(d)) over (partition by lineage, hash) / 127 else 1 end as scale from d)
      select lineage, hash, pos, cast(greatest(-127, least(127, round_even(d / scale, 0))) as int) as residual, round(scale, 9) as scale from s""",
    "delta_two_stage": """with x as (select label as lineage, vec_id as hash, unnest(range(1, 65)) as pos, cast(embedding as double[]) as e from embeddings), b as (select lineage, pos, round(avg(e[pos]), 6) as base from x group by all),
      d as (select x.lineage, hash, x.pos, e[x.pos] - base as d, base from x join b on x.lineage = b.lineage and x.pos = b.pos), m as (select *, max(abs(d)) over (partition by lineage, hash) as peak from d),
      v as (select lineage, hash, list(base + greatest(-127, least(127, round_even(d / case when peak > 0 then peak / 127 else 1 end, 0))) * case when peak > 0 then peak / 127 else 1 end order by pos) as v from m group by all),
      q as (select vec_id as qid, list_transform(embedding, lambda y: cast(y as double) / greatest(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 1e-12)) as q from embeddings where vec_id % 20 = 0),
      bl as (select lineage, list(base order by pos) as b from b group by lineage),
      f as (select qid, lineage, row_number() over (partition by qid order by round(list_dot_product(q, b) / greatest(sqrt(list_dot_product(b, b)), 1e-12), 6) desc, lineage) as n from q, bl),
      s as (select qid, v.lineage, hash, round(list_dot_product(q, v), 6) as score from f join v on v.lineage = f.lineage join q using (qid) where n <= 30)
      select qid, rank, lineage, hash, score from (select *, row_number() over (partition by qid order by score desc, lineage, hash) as rank from s) where rank <= 10""",
    "query_terms": f"select distinct qid, list_distinct_ordered as terms from (select qid, list_reduce(list_prepend([], list_transform(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9]*'), lambda w: lower(w)), lambda w: length(w) >= 3 and w not in ({', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in T.STOPWORDS)})), lambda w: [w])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as list_distinct_ordered from queries)",
    "query_family": "select distinct qid, case greatest("
    + ", ".join("(" + " + ".join(f"cast(contains(lower(coalesce(text, '')), '{h}') as int)" for h in hints) + ")" for hints in T.QUERY_HINTS.values())
    + ") when 0 then null "
    + " ".join("when (" + " + ".join(f"cast(contains(lower(coalesce(text, '')), '{h}') as int)" for h in hints) + f") then '{family}'" for family, hints in T.QUERY_HINTS.items())
    + " end as family from queries",
    "query_narrative": f"select distinct qid, {_narrative_sql(T.SPEC_WORDS)} as query, 'Instruct: {T.INSTRUCTIONS['solution']}' || chr(10) || 'Query: ' || {_narrative_sql(T.EXAMPLE_WORDS)} as encoded from queries where text is not null",
    "failure_groups": f"""with {_BM25}, {_TARGETS}, missed as (select qid, t.row from targets t left join (select qid, row, rank from bmr where rank <= 10) b using (qid, row) where b.rank is null),
      w as (select m.qid, {_WORDSET('d.text')} as want from missed m join index_rows d using (row)), h as (select b.qid, {_WORDSET('d.text')} as names from bmr b join missed m on m.qid = b.qid join index_rows d on d.row = b.row where rank <= 10),
      best as (select qid, max(round({_JACCARD('want', 'names')}, 6)) as best from h join w using (qid) group by qid)
      select case when length(a.text) > 3 * (select quantile_cont(length(text), 0.5) from asked) then 'very_long_query' when coalesce(best, 0) >= 0.6 then 'near_duplicate_corpus' when len({_WORDSET('a.text')}) < 25 then 'generic_wording' else 'other' end as reason, count(*) as n
      from asked a join missed using (qid) left join best using (qid) group by reason""",
    "document_make_up": "select kind, lang, count(*) as n, count(text) as with_text, sum(length(text)) as chars, grouping(kind) * 2 + grouping(lang) as level from documents group by grouping sets ((kind, lang), (kind), (lang), ())",
    "latency_percentiles": "with n as (select repo, walk_seconds as v, row_number() over (partition by repo order by walk_seconds) - 1 as i, count(*) over (partition by repo) as n from history_ingest where walk_seconds is not null) select repo, "
    + ", ".join(f"max(case when i = greatest(0, least(n - 1, cast(round_even({p / 100} * n + 0.5, 0) as bigint) - 1)) then v end) as p{p}" for p in (50, 95, 99))
    + " from n group by repo",
}
