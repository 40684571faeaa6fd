"""Queries over version histories and sources, with the SQL they must equal where SQL can express them."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions import text as T
from sextant.operators import code, evaluate, shape, versions
from sextant.runtime import canonical, table

BY = ["repo", "subdir"]


def _rows(spark, folder):
    rows = table(spark, folder, "index_versions")
    return rows.withColumn("content_hash", canonical(F.col("content_hash")))


def _slim(spark, folder):
    return _rows(spark, folder).select("row", *BY, "lineage_id", "version", "content_hash")


def _snapshots(spark, folder):
    """The delivered snapshots of each ingest with the versions delivered before and after, null at the ends."""
    w = Window.partitionBy(*BY).orderBy("version")
    one = table(spark, folder, "index_versions").select(*BY, "version").where("version is not null").distinct()
    return one.withColumn("before", F.lag("version").over(w)).withColumn("after", F.lead("version").over(w))


def _files(spark, folder):
    """Source files, byte-order marks dropped."""
    return table(spark, folder, "source_files").select("file", F.regexp_replace("text", "^﻿", "").alias("text"))


def version_changes(spark, folder):
    return versions.change_labels(_slim(spark, folder), BY)


def version_change_totals(spark, folder):
    labels = versions.change_labels(_slim(spark, folder), BY)
    count = lambda k: F.sum((F.col("change") == k).cast("long")).alias(k)
    return labels.groupBy(*BY, "version").agg(F.count("*").alias("lineages"), count("added"), count("modified"), count("unchanged"))


def asof_snapshot(spark, folder):
    return versions.as_of(_slim(spark, folder), 3, [*BY, "lineage_id"])


def content_reuse(spark, folder):
    return versions.reuse_stats(_slim(spark, folder), by=BY)


def distinct_work(spark, folder):
    return versions.distinct_work(_rows(spark, folder))


def _ranking(spark, folder, version=None):
    """The ten longest functions of each ingest at a version, or at every one, as a ranking."""
    rows = _rows(spark, folder).where("version is not null" if version is None else F.col("version") == version).select("row", F.concat_ws("/", *BY).alias("qid"), "version", "lineage_id", "content_hash", F.length("text").alias("score"))
    one = rows.where("score is not null").groupBy("qid", "version", "lineage_id").agg(F.max_by(F.struct("content_hash", "score"), "row").alias("x")).select("qid", "version", "lineage_id", "x.*")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "version").orderBy(F.desc("score"), "lineage_id"))).where("rank <= 10")


def version_compare(spark, folder):
    return versions.compare_rankings(_ranking(spark, folder, 1), _ranking(spark, folder, 2))


def lineage_groups(spark, folder):
    hits = _ranking(spark, folder, 1).select("qid", "rank", F.regexp_extract("lineage_id", "^[^:]+", 0).alias("file"))
    return versions.group_lineages(hits, "file")


def version_compare_history(spark, folder):
    """version_compare of every delivered snapshot with the one before; version is the later one's."""
    ranked = _ranking(spark, folder).withColumn("ingest", F.col("qid"))
    near = _snapshots(spark, folder).select(F.concat_ws("/", *BY).alias("ingest"), "version", "before").where("before is not null")
    b = ranked.join(near, ["ingest", "version"]).withColumn("qid", F.struct("ingest", "version"))
    a = ranked.withColumnRenamed("version", "before").join(near, ["ingest", "before"]).withColumn("qid", F.struct("ingest", "version"))
    out = versions.compare_rankings(a, b)
    return out.select(F.col("qid.ingest").alias("qid"), F.col("qid.version").alias("version"), *out.columns[1:])


def lineage_groups_history(spark, folder):
    """lineage_groups of every delivered snapshot."""
    hits = _ranking(spark, folder).select(F.struct("qid", "version").alias("qid"), "rank", F.regexp_extract("lineage_id", "^[^:]+", 0).alias("file"))
    out = versions.group_lineages(hits, "file")
    return out.select("qid.*", *out.columns[1:])


def version_diffs(spark, folder):
    """Diffs of lineages against the snapshot delivered before; version is the later one's."""
    rows = _rows(spark, folder).groupBy(*BY, "lineage_id", "version").agg(F.max_by(F.struct("text"), "row").alias("x")).select(*BY, "lineage_id", "version", "x.text")
    near = _snapshots(spark, folder).where("before is not null").select(*BY, "version", "before")
    b = rows.withColumnRenamed("text", "text_b").join(near, [*BY, "version"])
    a = rows.withColumnRenamed("text", "text_a").withColumnRenamed("version", "before")
    return versions.diffs(a.join(b, [*BY, "lineage_id", "before"])).where("not identical").select(*BY, "lineage_id", "version", "diff", "added", "removed")


def reindex_classify(spark, folder):
    rows = table(spark, folder, "index_versions").select(F.concat_ws("/", *BY, "file").alias("file"), "kind", "qualname", "start_line", "end_line", "text", "version", "row")
    side = lambda v: versions.occurrence_keys(rows.where(F.col("version") == v), order=("start_line", "end_line", "row"))
    return versions.reindex_plan(side(1), side(2)).groupBy("file", "status").agg(F.count("*").alias("n"))


def reindex_history(spark, folder):
    """reindex_classify of every delivered snapshot against the one before, the first against nothing; version is the later one's."""
    rows = table(spark, folder, "index_versions").select(*BY, "file", "kind", "qualname", "start_line", "end_line", "text", "version", "row")
    at = [*BY, "version", "file", "kind", "qualname"]
    keyed = versions.occurrence_keys(rows.where("version is not null"), key=at, order=("start_line", "end_line", "row"))
    near = _snapshots(spark, folder).where("after is not null").select(*BY, "version", "after")
    before = keyed.join(near, [*BY, "version"]).drop("version").withColumnRenamed("after", "version")
    plan = versions.reindex_plan(before, keyed, key=[*at, "n"])
    return plan.groupBy(*BY, "version", "file", "status").agg(F.count("*").alias("n"))


def rename_links(spark, folder):
    """Functions removed at a snapshot linked to those added at it, against the snapshot delivered before; version is the later one's.

    A function is known by its place, `file::qualname`: lineage ids are kept over renames and would hide them.
    """
    place = F.concat_ws("::", "file", "qualname")
    rows = _rows(spark, folder).where("file is not null and qualname is not null").groupBy(*BY, place.alias("id"), "version").agg(F.max_by(F.struct("kind", "name", "text"), "row").alias("x")).select(*BY, "id", "version", "x.*")
    near = Window.partitionBy(*BY, "id").orderBy("version")
    placed = rows.join(_snapshots(spark, folder), [*BY, "version"]).withColumn("was", F.lag("version").over(near)).withColumn("comes", F.lead("version").over(near))
    side = lambda other, here, version, name: placed.where(F.col(other).isNotNull() & ~F.col(other).eqNullSafe(F.col(here))).select(*BY, F.col(version).alias("version"), "id", "kind", "name", "text", F.lit(name).alias("side"))
    return versions.rename_links(side("after", "comes", "after", "removed").unionByName(side("before", "was", "version", "added")), [*BY, "version"])


def version_queries(spark, folder):
    return versions.version_queries(_rows(spark, folder), BY)


def code_hash_groups(spark, folder):
    """Rows whose code is the same but for comments and layout."""
    hashed = versions.with_content_hash(table(spark, folder, "index_rows").select("row", "text")).where("code_hash is not null")
    return hashed.groupBy("code_hash").agg(F.min("row").alias("row"), F.count("*").alias("n")).where("n > 1")


def exact_match_lookup(spark, folder):
    rows = table(spark, folder, "index_rows").select("row", "text")
    return versions.exact_matches(rows.where("row % 20 = 0").select(F.col("row").alias("qid"), "text"), rows).select("qid", "row", "score")


def doc_ids(spark, folder):
    rows = table(spark, folder, "index_versions")
    return rows.select("row", T.doc_id_parts(F.col("doc_id")).alias("p"), T.readable_phrase(F.col("qualname"), F.col("file")).alias("phrase")).select("row", "p.*", "phrase")


def latest_history(spark, folder):
    """The last delivered row of every version in the ingest log."""
    h = table(spark, folder, "history_ingest")
    return h.groupBy(*BY, "version").agg(F.max("modified").alias("modified"), F.max("lineages").alias("lineages"))


def code_chunks(spark, folder):
    return code.chunk_files(_files(spark, folder), methods=True)


def parse_failures(spark, folder):
    return code.parse_failures(_files(spark, folder))


def structural_counts(spark, folder):
    facts = code.structural_facts(_files(spark, folder))
    return code.union_all([f.groupBy().agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n") for k, f in facts.items()])


def _edges(spark, folder):
    facts = code.structural_facts(_files(spark, folder))
    return code.call_edges(facts["defs"], facts["calls"], facts["imports"])


def call_graph_edges(spark, folder):
    return _edges(spark, folder)


def who_calls(spark, folder):
    return code.who_calls(_edges(spark, folder), "sorted")


def what_calls(spark, folder):
    return code.what_calls(_edges(spark, folder), "scan_tokens")


def where_imported(spark, folder):
    return code.where_imported(code.structural_facts(_files(spark, folder))["imports"], "sys")


def where_used(spark, folder):
    facts = code.structural_facts(_files(spark, folder))
    return code.where_used(facts["names"], facts["strings"], "rows")


def call_order(spark, folder):
    return code.calls_in_order(code.structural_facts(_files(spark, folder))["calls"], "sorted", "enumerate")


def find_definitions(spark, folder):
    return code.find_definitions(table(spark, folder, "defs").drop("args"), "scan_tokens")


def enclosing_definitions(spark, folder):
    return code.function_spans(table(spark, folder, "defs").select("file", "qualname", "start_line", "end_line").distinct())


def location_hits(spark, folder):
    """Places of an older walk scored against the definitions in the sources."""
    now = code.structural_facts(_files(spark, folder))["defs"].select(F.col("file").alias("qid"), "file", F.col("start_line").alias("start"), F.col("end_line").alias("stop"))
    from pyspark.sql.window import Window

    old = table(spark, folder, "defs").where("end_line is not null").select(F.col("file").alias("qid"), "file", F.col("start_line").alias("start"), F.col("end_line").alias("stop")).distinct()
    return evaluate.location_hits(old.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("start", "stop"))), now)


def ast_families(spark, folder):
    return shape.families(table(spark, folder, "index_rows"))


def performance_smells(spark, folder):
    return shape.smells(table(spark, folder, "index_rows"))


def corpus_audit(spark, folder):
    return code.corpus_audit(table(spark, folder, "index_rows"))


_ONE = """r as (select row, repo, subdir, lineage_id, version, lower(regexp_replace(content_hash, '[^\\p{L}\\p{N}]', '', 'g')) as content_hash, text, file from index_versions),
one as (select * from r where lineage_id is not null and version is not null qualify row_number() over (partition by repo, subdir, lineage_id, version order by row desc) = 1),
lab as (select repo, subdir, lineage_id, version, content_hash, case when lag(version) over w = version - 1 then case when lag(content_hash) over w is not distinct from content_hash then 'unchanged' else 'modified' end else 'added' end as change
  from one window w as (partition by repo, subdir, lineage_id order by version))"""
_RANK = lambda v: f"""(select *, row_number() over (partition by qid order by score desc, lineage_id) as rank from (select concat_ws('/', repo, subdir) as qid, lineage_id, lower(regexp_replace(content_hash, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as content_hash, length(text) as score
  from index_versions where version = {v} and text is not null qualify row_number() over (partition by repo, subdir, lineage_id order by row desc) = 1) qualify row_number() over (partition by qid order by score desc, lineage_id) <= 10)"""  # noqa: E731
_KEYS = lambda v: f"(select concat_ws('/', repo, subdir, file) as file, kind, qualname, sha256(text) as h, row_number() over (partition by concat_ws('/', repo, subdir, file), kind, qualname order by start_line nulls first, end_line nulls first, row) - 1 as n, true as there from index_versions where version = {v})"
_SNAPS = "(select *, lag(version) over (partition by repo, subdir order by version) as before from (select distinct repo, subdir, version from index_versions where version is not null))"
_RANKS = r"""(select concat_ws('/', repo, subdir) as qid, *, row_number() over (partition by repo, subdir, version order by score desc, lineage_id) as rank from (select repo, subdir, version, lineage_id, lower(regexp_replace(content_hash, '[^\p{L}\p{N}]', '', 'g')) as content_hash, length(text) as score
  from index_versions where version is not null and text is not null qualify row_number() over (partition by repo, subdir, version, lineage_id order by row desc) = 1) qualify row_number() over (partition by repo, subdir, version order by score desc, lineage_id) <= 10)"""

QUERIES = {
    f.__name__: f
    for f in (
        *(version_changes, version_change_totals, asof_snapshot, content_reuse, distinct_work, version_compare, version_compare_history, lineage_groups, lineage_groups_history, version_diffs, reindex_classify, reindex_history, rename_links, version_queries, code_hash_groups, exact_match_lookup, doc_ids, latest_history),
        *(code_chunks, parse_failures, structural_counts, call_graph_edges, who_calls, what_calls, where_imported, where_used, call_order, find_definitions, enclosing_definitions, location_hits, ast_families, performance_smells, corpus_audit),
    )
}
SQL = {
    "version_changes": f"with {_ONE} select * from lab",
    "version_change_totals": f"with {_ONE} select repo, subdir, version, count(*) as lineages, count(*) filter (change = 'added') as added, count(*) filter (change = 'modified') as modified, count(*) filter (change = 'unchanged') as unchanged from lab group by all",
    "asof_snapshot": f"with {_ONE} select row, repo, subdir, lineage_id, version, content_hash from r where version <= 3 qualify row_number() over (partition by repo, subdir, lineage_id order by version desc, row desc) = 1",
    "content_reuse": f"""with {_ONE}, d as (select repo, subdir, version, content_hash, count(*) as n from r where content_hash is not null group by all), f as (select *, min(version) over (partition by repo, subdir, content_hash) as first from d)
      select repo, subdir, version, sum(n) as rows, count(*) as hashes, sum(cast(first = version as int)) as fresh, round(100.0 * (count(*) - sum(cast(first = version as int))) / count(*), 4) as reused_pct from f group by all""",
    "distinct_work": f"with {_ONE} select content_hash, text, row, count as uses from (select *, count(*) over (partition by content_hash) as count, row_number() over (partition by content_hash order by row) as i from r where content_hash is not null) where i = 1",
    "version_compare": f"""select coalesce(a.qid, b.qid) as qid, coalesce(a.lineage_id, b.lineage_id) as lineage_id, a.rank as rank_a, b.rank as rank_b, case when a.rank is null then 'appeared' when b.rank is null then 'disappeared' when a.rank = b.rank then 'same' else 'moved' end as status,
      a.rank - b.rank as rank_change, case when a.rank is not null and b.rank is not null then a.content_hash is distinct from b.content_hash end as content_changed from {_RANK(1)} a full join {_RANK(2)} b on a.qid = b.qid and a.lineage_id = b.lineage_id""",
    "lineage_groups": f"with h as (select qid, rank, regexp_extract(lineage_id, '^[^:]+') as file from {_RANK(1)}), f as (select *, min(rank) over (partition by qid, file) as first from h) select qid, rank, file, dense_rank() over (partition by qid order by first) as group_rank from f",
    "reindex_classify": f"""select coalesce(n.file, o.file) as file, case when o.there is null then 'added' when n.there is null then 'removed' when o.h is not distinct from n.h then 'unchanged' else 'modified' end as status, count(*) as n
      from {_KEYS(1)} o full join {_KEYS(2)} n on o.file is not distinct from n.file and o.kind is not distinct from n.kind and o.qualname is not distinct from n.qualname and o.n = n.n group by all""",
    "version_compare_history": f"""with k as {_RANKS}, s as {_SNAPS}, b as (select k.* from k join s using (repo, subdir, version) where before is not null), a as (select k.* replace (s.version as version) from k join s on k.repo = s.repo and k.subdir = s.subdir and k.version = s.before)
      select coalesce(a.qid, b.qid) as qid, coalesce(a.version, b.version) as version, coalesce(a.lineage_id, b.lineage_id) as lineage_id, a.rank as rank_a, b.rank as rank_b, case when a.rank is null then 'appeared' when b.rank is null then 'disappeared' when a.rank = b.rank then 'same' else 'moved' end as status,
      a.rank - b.rank as rank_change, case when a.rank is not null and b.rank is not null then a.content_hash is distinct from b.content_hash end as content_changed from a full join b on a.qid = b.qid and a.version = b.version and a.lineage_id = b.lineage_id""",
    "lineage_groups_history": f"with h as (select qid, version, rank, regexp_extract(lineage_id, '^[^:]+') as file from {_RANKS}), f as (select *, min(rank) over (partition by qid, version, file) as first from h) select qid, version, rank, file, dense_rank() over (partition by qid, version order by first) as group_rank from f",
    "reindex_history": f"""with k as (select repo, subdir, version, file, kind, qualname, sha256(text) as h, row_number() over (partition by repo, subdir, version, file, kind, qualname order by start_line nulls first, end_line nulls first, row) as n from index_versions where version is not null),
      o as (select k.* replace (s.version as version) from k join {_SNAPS} s on k.repo = s.repo and k.subdir = s.subdir and k.version = s.before)
      select coalesce(k.repo, o.repo) as repo, coalesce(k.subdir, o.subdir) as subdir, coalesce(k.version, o.version) as version, coalesce(k.file, o.file) as file, case when o.n is null then 'added' when k.n is null then 'removed' when o.h is not distinct from k.h then 'unchanged' else 'modified' end as status, count(*) as n
      from o full join k on o.repo = k.repo and o.subdir = k.subdir and o.version = k.version and o.file is not distinct from k.file and o.kind is not distinct from k.kind and o.qualname is not distinct from k.qualname and o.n = k.n group by all""",
    "doc_ids": r"""select row, nullif(regexp_extract(doc_id, '(?s)^(.+)@v(\d+)$', 1), '') as snippet_id, try_cast(regexp_extract(doc_id, '@v(\d+)$', 1) as int) as version,
      lower(regexp_replace(regexp_replace(qualname, '[_.]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')) || ' in ' || file as phrase from index_versions""",
    "latest_history": "select repo, subdir, version, max(modified) as modified, max(lineages) as lineages from history_ingest group by all",
    "version_queries": r"""with one as (select repo, subdir, lineage_id, version, text, qualname, file from index_versions where lineage_id is not null and text is not null qualify row_number() over (partition by repo, subdir, lineage_id, version order by row desc) = 1),
      n as (select *, list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) as names from one), p as (select *, lag(names) over (partition by repo, subdir, lineage_id order by version) as before from n),
      f as (select * exclude (names, before), list_filter(names, lambda t: length(t) >= 4 and not list_contains(before, t)) as fresh from p where before is not null),
      t as (select *, list_sort(list_transform(fresh, lambda t: {l: -length(t), t: t}))[1].t as token, row_number() over (partition by repo, subdir, lineage_id order by version) as i from f where len(fresh) > 0)
      select t.repo, t.subdir, t.lineage_id, t.version, token, lower(regexp_replace(regexp_replace(t.qualname, '[_.]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')) || ' in ' || t.file || ' ' || token as query, list_sort(list(distinct o.version)) as acceptable
      from t join one o on o.repo is not distinct from t.repo and o.subdir is not distinct from t.subdir and o.lineage_id = t.lineage_id and contains(o.text, token) where i <= 1 group by all""",
    "code_hash_groups": r"""with t as (select row, string_split(regexp_replace(replace(replace(replace(text, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\t', '    ', 'g'), chr(10)) as ls from index_rows where text is not null),
      k as (select row, list_filter(list_transform(ls, lambda x: regexp_replace(regexp_extract(x, '^(?:[^''"#]|''(?:[^''\\]|\\.)*(?:''|\\?$)|"(?:[^"\\]|\\.)*(?:"|\\?$))*', 0), '\s+$', '')), lambda x: x <> '') as ls from t),
      h as (select row, sha256(array_to_string(list_transform(ls, lambda x: regexp_replace(x, '(\S) {2,}', '\1 ', 'g')), chr(10))) as code_hash from k) select code_hash, min(row) as row, count(*) as n from h group by code_hash having count(*) > 1""",
    "find_definitions": """with t as (select file, name, qualname, kind, start_line, end_line, docstring, case when file || '::' || qualname = 'scan_tokens' then 1 when name = 'scan_tokens' then 2 when ends_with(qualname, '.scan_tokens') then 3 end as tier from defs)
      select * exclude tier from t where tier = (select min(tier) from t)""",
    "enclosing_definitions": """with d as (select distinct file, qualname, start_line, end_line from defs) select d.file, d.qualname, d.start_line, o.qualname as outer from d join d o on d.file = o.file and o.start_line <= d.start_line and o.end_line >= d.end_line and o.qualname <> d.qualname
      qualify row_number() over (partition by d.file, d.qualname, d.start_line order by o.start_line desc, o.end_line) = 1""",
}
