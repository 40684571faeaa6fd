"""Queries of reports, labellers and text functions, with the SQL they must equal."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions import text as T
from sextant.operators import evaluate, pipeline, ranking, reports, shape, versions
from sextant.plans import retrieval as R
from sextant.plans import versions as V
from sextant.runtime import cut, table

GATES = [0.1, 0.5, 1.0, 99.0]


def _ranks(spark, folder):
    """Ranks of the targets by BM25 and by TF-IDF over one index."""
    targets = cut(R._targets(spark, folder))
    return [evaluate.ranks_from_lists(x, targets) for x in R._both(spark, folder, 100)]


def per_query_scores(spark, folder):
    return reports.per_query(_ranks(spark, folder)[0])


def paired_report(spark, folder):
    return reports.paired_report(*map(cut, _ranks(spark, folder)))


def metrics_by_source(spark, folder):
    """Metrics of BM25 over all asked queries, and by partition and by source alone."""
    sources = table(spark, folder, "queries").groupBy("qid").agg(F.max("partition").alias("partition"), F.max("source").alias("source"))
    return reports.grouped_scores(per_query_scores(spark, folder).join(sources, "qid"), ["partition", "source"], ["ndcg_10", "mrr_10"], ["rank"])


def document_shares(spark, folder):
    return reports.group_shares(table(spark, folder, "documents"), ["kind"])


def gate_choice(spark, folder):
    """The cheapest gate that keeps what reranking gains."""
    ranked, targets = cut(R._bm25(spark, folder, 30)), cut(R._targets(spark, folder))
    again = ranking.rerank(ranked, R._judged(spark, folder, ranked.where("rank <= 10")), 10, 0.25)
    base, always = (cut(evaluate.ranks_from_lists(x, targets)) for x in (ranked, again))
    return reports.gate_report(ranking.confidence_gap(ranked), base, always, GATES)


def category_tiebreak(spark, folder):
    """BM25 scores with a bonus where the query's family is the document's."""
    rows = R._docs(spark, folder)
    families = shape.families(rows).select("row", F.col("ast_family").alias("family"))
    asked = R._asked(spark, folder).select("qid", T.query_family(F.col("text")).alias("family"))
    return ranking.top_k(reports.family_tiebreak(R._bm25(spark, folder, 30), asked, families, 2.0), 10)


def delta_sizes(spark, folder):
    rows, base, entries = R._delta(spark, folder)
    return reports.delta_bytes(rows, base, entries)


def precision_comparison(spark, folder):
    """Embeddings against themselves in steps of an eighth: cosines, and what that does to the first ten."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    coarse = v.select("row", F.transform("embedding", lambda x: (F.round(x * 8) / 8).cast("float")).alias("embedding"))
    from sextant.operators.dense import dense_topk

    sides = [(x.where("row % 20 = 0").select(F.col("row").alias("qid"), "embedding"), x) for x in (v, coarse)]
    tops = [dense_topk(x, asked) for asked, x in sides]
    return reports.precision_report(sides[0][0], sides[1][0], *tops)


def _labelled(spark, folder):
    """Embeddings as versions (vec_id modulo 4) of lineages (labels): rows, hits of every 20th among the others, and what it asks for."""
    from sextant.operators.dense import dense_topk

    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), "embedding", F.col("label").cast("string").alias("lineage"), F.pmod("vec_id", F.lit(4)).cast("int").alias("version"))
    asked = v.where("row % 20 = 0")
    hits = dense_topk(v, asked.select(F.col("row").alias("qid"), "embedding"), 100, exclude_self=True).join(v.select("row", "lineage", "version"), "row")
    return v, cut(hits.select("qid", "rank", "row", "lineage", "version")), asked.select(F.col("row").alias("qid"), "lineage", "version", F.array(F.col("version"), F.pmod(F.col("version") + 1, F.lit(4))).alias("acceptable"))


def documented_queries(spark, folder):
    return versions.version_queries(V._rows(spark, folder), V.BY, documented=True)


def lineage_keys(spark, folder):
    return table(spark, folder, "index_versions").select("row", T.lineage_parts(F.col("lineage_id")).alias("p")).select("row", "p.*")


def audited_rows(spark, folder):
    from sextant.operators.code import audit_docs

    return audit_docs(table(spark, folder, "index_rows"))


def tagged_families(spark, folder):
    from sextant.sources.build import family_counts, tag_rows

    return family_counts(tag_rows(table(spark, folder, "index_rows")))


def lineage_evaluation(spark, folder):
    _, hits, wanted = _labelled(spark, folder)
    return reports.evaluate_retrieval(hits, wanted)


def delta_accuracy(spark, folder):
    """First hits by cosine over all vectors against those of the two-stage delta search."""
    from sextant.operators.dense import delta_search, dense_topk

    v, _, wanted = _labelled(spark, folder)
    asked = v.where("row % 20 = 0").select(F.col("row").alias("qid"), "embedding")
    _, base, entries = R._delta(spark, folder)
    plain = dense_topk(v, asked, 1).join(v.select("row", "lineage", "version"), "row").select("qid", "lineage", "version")
    two = delta_search(base, entries, asked, 1).select("qid", F.col("lineage").cast("string").alias("lineage"), F.pmod("hash", F.lit(4)).cast("int").alias("version"))
    return reports.delta_report(plain, two, wanted)


def incremental_encoding(spark, folder):
    """Contents of snapshots after the first with a vector that is made once a hash, or taken from the first snapshots."""
    rows = V._rows(spark, folder).select("row", "version", "content_hash", "text")
    encode = lambda work: work.withColumn("embedding", F.array(F.length("text").cast("double")))
    done = encode(versions.distinct_work(rows.where("version = 1"))).select("content_hash", "embedding")
    later = versions.encode_distinct(rows.where("version > 1"), encode, done)
    return later.select("row", F.get("embedding", F.lit(0)).alias("value"))


def description_fuse(spark, folder):
    """Text scores with description scores (here TF-IDF) added at a weight."""
    return ranking.top_k(ranking.score_fuse_tagged(R._lists(spark, folder, 100), 0.3, convex=False), 10)


def hit_previews(spark, folder):
    ranked = R._bm25(spark, folder, 10).join(R._docs(spark, folder), "row")
    return ranked.select("qid", "rank", "doc_id", F.substring("text", 1, 240).alias("preview"), (F.length("text") > 240).alias("truncated"))


def version_totals(spark, folder):
    return versions.change_totals(V._slim(spark, folder), V.BY)


def nested_rows(spark, folder):
    """Versions 1 and 3 out of nested histories: the filter of versions is the operator."""
    rows = V._rows(spark, folder).where("doc_id is not null and version is not null and lineage_id is not null").select(F.concat_ws("/", *V.BY, "lineage_id").alias("snippet_id"), "version", "row", "text")
    nested = rows.groupBy("snippet_id").agg(F.collect_list(F.struct("version", "row", "text")).alias("versions"))  # the versions of one function
    return versions.rows_for(nested, [1, 3]).select("doc_id", "snippet_id", "version", "row", F.length("text").alias("chars"))


def renamed_lineages(spark, folder):
    """Functions by place with the place their lineage began at, carried over links between delivered snapshots."""
    place = F.concat_ws("::", "file", "qualname")
    rows = V._rows(spark, folder).where("file is not null and qualname is not null and version is not null").groupBy(*V.BY, place.alias("key"), "version").agg(F.max("lineage_id").alias("delivered_id"))
    links = V.rename_links(spark, folder).select(*V.BY, "version", "old", "new")
    return versions.canonical_lineages(rows, links, V.BY).where("lineage_id <> key").select(*V.BY, "key", "version", "lineage_id", "delivered_id")


def _lines(spark, folder):
    return pipeline.source_lines(table(spark, folder, "source_files"))


def grep_calls(spark, folder):
    return pipeline.grep_calls(_lines(spark, folder), "sorted")


def grep_imports(spark, folder):
    return pipeline.grep_imports(_lines(spark, folder), "sys")


def grep_text(spark, folder):
    return pipeline.grep_text(_lines(spark, folder), "lambda")


def grep_defs(spark, folder):
    return pipeline.grep_defs(_lines(spark, folder))


def docstring_questions(spark, folder):
    return pipeline.docstring_questions(_lines(spark, folder))


def judge_prompts(spark, folder):
    ranked = R._bm25(spark, folder, 3).join(R._asked(spark, folder).withColumnRenamed("text", "problem"), "qid").join(R._docs(spark, folder).select("row", "text"), "row")
    return ranked.select("qid", "row", T.judge_prompt(F.col("problem"), F.col("text"), 400).alias("prompt"))


def clean_descriptions(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.clean_description(F.col("text")).alias("description"))


def word_frequencies(spark, folder):
    return pipeline.word_frequencies(table(spark, folder, "documents"), top=50)


def plain_texts(spark, folder):
    """White space made single blanks."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


def failure_examples(spark, folder):
    """The first queries of each source that miss their target in the first ten."""
    missed = _ranks(spark, folder)[0].where("rank > 10").join(table(spark, folder, "queries").groupBy("qid").agg(F.max("source").alias("source")), "qid")
    w = Window.partitionBy("source").orderBy("qid")
    return missed.withColumn("place", F.row_number().over(w)).where("place <= 3").select("source", "place", "qid", "rank")


_BMRANK = f"{R._BM25}, {R._TARGETS}, pq as (select t.qid, coalesce(rank, 1001) as rank from targets t left join (select qid, row, rank from bmr where rank <= 100) b on t.qid = b.qid and t.row = b.row)"
_PQ = "select qid, rank, round(case when rank <= 10 then 1 / log2(rank + 1) else 0 end, 6) as ndcg_10, round(case when rank <= 10 then 1 / rank else 0 end, 6) as mrr_10 from pq"
_LINES = r"l as (select distinct file, text from source_files where text is not null), n as (select file, string_split(text, chr(10)) as ls from l), s as (select file, unnest(range(1, len(ls) + 1)) as line, unnest(ls) as content from n)"
_SLIM_TOTALS = """lt as (select repo, subdir, version, count(*) as lineages, count(*) filter (change = 'added') as added, count(*) filter (change = 'modified') as modified, count(*) filter (change = 'unchanged') as unchanged from lab group by all),
nx as (select repo, subdir, version, lead(version) over (partition by repo, subdir order by version) as after from lt),
gone as (select l.repo, l.subdir, nx.after as version, count(*) as removed from lab l join nx on l.repo is not distinct from nx.repo and l.subdir is not distinct from nx.subdir and l.version = nx.version
  where after is not null and not exists (select 1 from lab m where m.repo is not distinct from l.repo and m.subdir is not distinct from l.subdir and m.lineage_id = l.lineage_id and m.version = nx.after) group by all)"""

QUERIES = {
    f.__name__: f
    for f in (
        *(per_query_scores, paired_report, metrics_by_source, document_shares, gate_choice, category_tiebreak, delta_sizes, precision_comparison, version_totals, nested_rows, renamed_lineages, documented_queries, lineage_keys, audited_rows, tagged_families, lineage_evaluation, delta_accuracy, incremental_encoding, description_fuse, hit_previews),
        *(grep_calls, grep_imports, grep_text, grep_defs, docstring_questions, judge_prompts, clean_descriptions, word_frequencies, plain_texts, failure_examples),
    )
}
SQL = {
    "per_query_scores": f"with {_BMRANK} {_PQ}",
    "metrics_by_source": f"""with {_BMRANK}, ps as ({_PQ}), j as (select ps.*, partition, source from ps join (select qid, max(partition) as partition, max(source) as source from queries group by qid) q using (qid))
      select partition, source, count(*) as n, round(avg(ndcg_10), 6) as ndcg_10, round(avg(mrr_10), 6) as mrr_10, quantile_cont(rank, 0.5) as median_rank, grouping(partition) * 2 + grouping(source) as level from j group by grouping sets ((), (partition), (source))""",
    "document_shares": "select kind, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share from documents group by kind",
    "delta_sizes": """with c as (select count(*) as rows, count(distinct label) as lineages, count(distinct (label, vec_id)) as entries from embeddings)
      select rows, lineages, entries, rows * 128 as plain_bytes, lineages * 128 + entries * 72 + rows * 4 as delta_bytes, round((lineages * 128 + entries * 72 + rows * 4) / greatest(rows * 128, 1), 4) as ratio from c""",
    "precision_comparison": """with v as (select vec_id as row, cast(embedding as double[]) as a, list_transform(embedding, lambda x: cast(cast(round(x * 8) / 8 as float) as double)) as b from embeddings),
      q as (select * from v where row % 20 = 0), top as (select q.row as qid, d.row, round(list_dot_product(q.a, d.a) / sqrt(list_dot_product(q.a, q.a) * list_dot_product(d.a, d.a)), 6) as s, round(list_dot_product(q.b, d.b) / sqrt(list_dot_product(q.b, q.b) * list_dot_product(d.b, d.b)), 6) as t from q, v d),
      ra as (select qid, row, row_number() over (partition by qid order by s desc, row) as rank from top), rb as (select qid, row, row_number() over (partition by qid order by t desc, row) as rank from top where not isnan(t)),
      la as (select qid, list(row order by rank) as x from ra where rank <= 10 group by qid), lb as (select qid, list(row order by rank) as y from rb where rank <= 10 group by qid),
      o as (select count(*) as queries, round(avg(len(list_intersect(x, y)) / greatest(len(x), 1)), 6) as overlap, round(avg(cast(x[1] <> y[1] as int)), 6) as first_changed, round(avg(cast(x = y as int)), 6) as identical from la join lb using (qid)),
      c as (select round(avg(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 1e-12)), 6) as mean_cosine, round(min(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 1e-12)), 6) as min_cosine from q) select * from c, o""",
    "lineage_keys": r"""select row, case when regexp_extract(lineage_id, '(?s)^(.*?)::(.+)$', 2) <> '' then regexp_extract(lineage_id, '(?s)^(.*?)::(.+)$', 1) end as file, nullif(regexp_extract(lineage_id, '(?s)^(.*?)::(.+)$', 2), '') as qualname from index_versions""",
    "lineage_evaluation": """with e as (select vec_id, label, vec_id % 4 as version, cast(embedding as double[]) as e from embeddings), s as (select q.vec_id as qid, d.vec_id as row, q.label as want, q.version as wv, d.label, d.version, round(list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(d.e, d.e)), 6) as score from e q join e d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0),
      r as (select * from (select *, row_number() over (partition by qid order by score desc, row) as rank from s) where rank <= 100), c as (select qid, want, label, row_number() over (partition by qid order by min(rank)) as rank from r group by qid, want, label),
      p as (select qid, round(100.0 * (count(*) - count(distinct label)) / count(*), 4) as dup from r where rank <= 10 group by qid), f as (select * from r where rank = 1), q as (select vec_id as qid from e where vec_id % 20 = 0)
      select count(*) as queries, round(avg(case when f.label = want then 1 else 0 end), 6) as lineage, round(avg(case when f.label = want and version = wv then 1 else 0 end), 6) as exact_version, round(avg(case when f.label = want and version in (wv, (wv + 1) % 4) then 1 else 0 end), 6) as token_consistent, (select round(avg(dup), 4) from p) as duplicate_pct,
      round((select count(distinct qid) from r where rank <= 10 and label = want) / greatest(count(*), 1), 6) as recall_all, round((select count(distinct qid) from c where rank <= 10 and label = want) / greatest(count(*), 1), 6) as recall_collapsed from q left join f using (qid)""",
    "delta_accuracy": R.SQL["delta_two_stage"].replace("with x as", "with e as (select vec_id, label, cast(embedding as double[]) as e from embeddings), pl as (select qid, label, vec_id from (select q.vec_id as qid, d.label, d.vec_id, row_number() over (partition by q.vec_id order by round(list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(d.e, d.e)), 6) desc, d.vec_id) as rank from e q, e d where q.vec_id % 20 = 0) where rank = 1), x as", 1)
    .replace("where n <= 30)", "where n <= 20), dl as (", 1)
    .replace("where rank <= 10", """where rank = 1)
      select count(*) as queries, round(avg(cast(pl.label = w.label as int)), 4) as plain_lineage, round(avg(cast(pl.label = w.label and pl.vec_id % 4 = w.vec_id % 4 as int)), 4) as plain_exact, round(avg(cast(pl.label = w.label and pl.vec_id % 4 in (w.vec_id % 4, (w.vec_id + 1) % 4) as int)), 4) as plain_consistent,
      round(avg(cast(dl.lineage = w.label as int)), 4) as delta_lineage, round(avg(cast(dl.lineage = w.label and dl.hash % 4 = w.vec_id % 4 as int)), 4) as delta_exact, round(avg(cast(dl.lineage = w.label and dl.hash % 4 in (w.vec_id % 4, (w.vec_id + 1) % 4) as int)), 4) as delta_consistent, round(avg(cast(pl.label = dl.lineage and pl.vec_id % 4 = dl.hash % 4 as int)), 4) as agreement
      from e w join pl on pl.qid = w.vec_id join dl on dl.qid = w.vec_id""", 1),
    "incremental_encoding": r"""with r as (select row, version, text, lower(regexp_replace(content_hash, '[^\p{L}\p{N}]', '', 'g')) as h from index_versions),
      d as (select h, text from r where version = 1 and h is not null qualify row_number() over (partition by h order by row) = 1), n as (select h, text from r where version > 1 and h is not null and h not in (select h from d) qualify row_number() over (partition by h order by row) = 1)
      select r.row, cast(length(coalesce(d.text, n.text)) as double) as value from r left join d using (h) left join n using (h) where version > 1""",
    "description_fuse": "with " + R._FUSED(R._Z, 0.3).replace("a * 0.7 + b * 0.3", "a + b * 0.3"),
    "hit_previews": f"with {R._BM25} select qid, rank, doc_id, substr(text, 1, 240) as preview, length(text) > 240 as truncated from bmr join index_rows using (row) where rank <= 10",
    "version_totals": f"with {V._ONE}, {_SLIM_TOTALS} select lt.*, coalesce(removed, 0) as removed from lt left join gone on lt.repo is not distinct from gone.repo and lt.subdir is not distinct from gone.subdir and lt.version = gone.version",
    "nested_rows": "select concat_ws('/', repo, subdir, lineage_id) || '@v' || version as doc_id, concat_ws('/', repo, subdir, lineage_id) as snippet_id, version, row, length(text) as chars from index_versions where doc_id is not null and lineage_id is not null and version in (1, 3)",
    "grep_calls": rf"with {_LINES} select file, line from s where regexp_matches(content, '(?:^|[^\w.])sorted\s*\(') and not regexp_matches(content, '^\s*(?:async\s+)?def\s+sorted\s*\(') and not regexp_matches(content, '^\s*#')",
    "grep_imports": rf"with {_LINES} select file, line from s where regexp_matches(content, '^\s*(?:from\s+[\w.]+\s+import\s+.*\bsys\b|import\s+.*\bsys\b)')",
    "grep_text": f"with {_LINES} select file, line from s where contains(content, 'lambda')",
    "grep_defs": rf"with {_LINES} select regexp_extract(content, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(', 1) as name, file, line from s where regexp_matches(content, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(')",
    "docstring_questions": rf"""with {_LINES}, t as (select file, line, content, regexp_replace(lead(content, 1) over w, '^\s+|\s+$', '', 'g') as one, regexp_replace(lead(content, 2) over w, '^\s+|\s+$', '', 'g') as two from s window w as (partition by file order by line)),
      u as (select regexp_extract(content, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(.*?:\s*$', 1) as name, file, line, case when one <> '' then one else two end as opening from t),
      q as (select regexp_replace(opening, '^["'' ]+|["'' ]+$', '', 'g') as question, name, file, line from u where name <> '' and (starts_with(opening, repeat(chr(34), 3)) or starts_with(opening, repeat(chr(39), 3))))
      select * from q where length(question) >= 20 and not regexp_matches(lower(question), '^(?:todo|fixme)')""",
    "judge_prompts": f"""with {R._BM25} select b.qid, b.row, '{T.JUDGE_PROMPT.replace(chr(39), chr(39) * 2)}' || 'PROBLEM:' || chr(10) || regexp_replace(substr(a.text, 1, 400), '^\\s+|\\s+$', '', 'g') || chr(10) || 'CODE:' || chr(10) || regexp_replace(substr(coalesce(d.text, ''), 1, 400), '^\\s+|\\s+$', '', 'g') as prompt
      from bmr b join asked a using (qid) join index_rows d on d.row = b.row where rank <= 3""",
    "clean_descriptions": r"""with f as (select doc_id, trim(regexp_extract(regexp_replace(coalesce(text, ''), '^\s+', ''), '^[^\n]*'), ' ') as t from documents)
      select doc_id, trim(substr(regexp_replace(trim(regexp_replace(t, '^`+|`+$', '', 'g'), ' '), '^(?:This function|This code|The function|The code|It) ', ''), 1, 220), ' ') as description from f""",
    "word_frequencies": r"with w as (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as word from documents where text is not null) select word, count(*) as n from w group by word order by n desc, word limit 50",
    "plain_texts": r"select doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as text from documents where text is not null",
    "failure_examples": f"with {_BMRANK}, m as (select qid, rank, source, row_number() over (partition by source order by qid) as place from pq join (select qid, max(source) as source from queries group by qid) q using (qid) where rank > 10) select source, place, qid, rank from m where place <= 3",
}
