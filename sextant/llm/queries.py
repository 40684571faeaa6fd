"""Queries of the training-data operators, with SQL where SQL can express them."""

from pyspark.sql import functions as F

from sextant.llm.documented import documented_functions, unread_files
from sextant.llm.formatting import distinct_records, formatting_duplicates
from sextant.llm.leaks import leaked_passages, without_passages
from sextant.llm.mixing import mix
from sextant.llm.neighbours import nearest_vectors
from sextant.llm.overlaps import cross_split_overlaps, overlap_report
from sextant.llm.splitting import split_oversized
from sextant.llm.subjects import document_subjects
from sextant.runtime import cut, table


def p2_found(spark, folder):
    pieces = split_oversized(table(spark, folder, "index_rows"))
    return pieces.where("piece = 1").select(F.col("row").alias("row_id"), "boundary").distinct()


def p2_pieces(spark, folder):
    return split_oversized(table(spark, folder, "index_rows"))


def p3_found(spark, folder):
    def pairs(name, value):
        copies = formatting_duplicates(table(spark, folder, name), "row", value)
        return copies.where("row <> low").select(F.lit(name).alias("table_name"), F.col("low").alias("row_a"), F.col("row").alias("row_b"))

    return pairs("index_rows", "text").unionByName(pairs("index_versions", "content_hash"))


def p3_records(spark, folder):
    def records(name, value):
        _, out = distinct_records(table(spark, folder, name), "row", value)
        return out.select(F.lit(name).alias("table_name"), F.col("low").alias("row"), "copies", "variants")

    return records("index_rows", "text").unionByName(records("index_versions", "content_hash"))


def _splits(spark, folder):
    """Training (tune) and evaluation (holdout, test) queries; the latter with their split."""
    part = table(spark, folder, "query_split").select("qid", F.lower(F.regexp_replace("part", r"^\s+|\s+$", "")).alias("part")).distinct()
    parted = table(spark, folder, "queries").select("qid", "text", "source", "partition").join(part, "qid", "left")
    split = F.when(F.col("partition") == "test", "test").when((F.col("partition") == "train") & (F.col("part") == "holdout"), "holdout")
    held = parted.withColumn("split", split).where("split is not null").select("qid", "text", "source", "split")
    return parted.where("partition = 'train' and part = 'tune'").select("qid", "text", "source"), held


def p4_found(spark, folder):
    pairs = cross_split_overlaps(*_splits(spark, folder))
    return pairs.select(F.least("train_id", "eval_id").alias("qid_a"), F.greatest("train_id", "eval_id").alias("qid_b")).where("qid_a < qid_b").distinct()


def p4_report(spark, folder):
    train, evaluation = _splits(spark, folder)
    return overlap_report(cross_split_overlaps(train, evaluation), evaluation)


def p5_found(spark, folder):
    near = nearest_vectors(table(spark, folder, "index_rows")).where("cosine >= 0.9")
    return near.select(F.least("row", "neighbour").alias("row_a"), F.greatest("row", "neighbour").alias("row_b")).distinct()


def p5_neighbours(spark, folder):
    return nearest_vectors(table(spark, folder, "index_rows"))


def p6_found(spark, folder):
    return documented_functions(table(spark, folder, "source_files")).select("file", "qualname", "start_line").distinct()


def p6_pairs(spark, folder):
    return documented_functions(table(spark, folder, "source_files"))


def p6_unread(spark, folder):
    return unread_files(table(spark, folder, "source_files"))


def p7_found(spark, folder):
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "test_items")).select("doc_id", "item_id").distinct()


def p7_passages(spark, folder):
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "test_items"))


def p7_without_passages(spark, folder):
    documents = table(spark, folder, "documents")
    return without_passages(documents, leaked_passages(documents, table(spark, folder, "test_items"))).select("doc_id", "text", "removed_chars")


def p8_found(spark, folder):
    """Targets that the cap keeps short, by the whole mix: the shares are cut, or the optimizer would drop the selection behind `got`."""
    shares = cut(mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1])
    return shares.where("short").select(F.col("target").alias("source")).distinct()


def p8_mix(spark, folder):
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark, folder):
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def _subjects(spark, folder):
    return document_subjects(*(table(spark, folder, t) for t in ("documents", "labels", "subjects")))


def p9_found(spark, folder):
    return _subjects(spark, folder).select("doc_id", "subject").distinct()


def p9_make_up(spark, folder):
    """Documents by source and subject, with the share of the source's documents that have a text."""
    documents = table(spark, folder, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "text").where(F.col("text").rlike(r"\S"))
    sizes = documents.groupBy("source").agg(F.count("*").alias("n"))
    counts = documents.select("doc_id", "source").join(_subjects(spark, folder), "doc_id").groupBy("source", "subject").agg(F.count("*").alias("documents"))
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    return counts.alias("c").join(F.broadcast(sizes.alias("s")), same).select("c.source", "subject", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p6_unread": p6_unread,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p7_without_passages": p7_without_passages,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_make_up": p9_make_up,
}
_CANON = lambda c: f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_RECORDS = f"""with t as (select 'index_rows' as table_name, row, text as value from index_rows where text is not null union all select 'index_versions', row, content_hash from index_versions where content_hash is not null),
d as (select distinct value, trim(value, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as bare from t),
l as (select value, list_filter(regexp_split_to_array(value, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '\\S')) as ls from d where regexp_matches(bare, '^[\\p{{L}}\\p{{N}}]+\\s*:')),
fl as (select value, list_transform(ls, lambda x: [{_CANON("regexp_extract(x, '^\\s*([\\p{L}\\p{N}]+)\\s*:', 1)")}, {_CANON("regexp_replace(x, '^\\s*[\\p{L}\\p{N}]+\\s*:', '')")}]) as pairs from l where len(list_filter(ls, lambda x: not regexp_matches(x, '^\\s*[\\p{{L}}\\p{{N}}]+\\s*:.*\\S'))) = 0),
j as (select value, bare, unnest(json_keys(bare)) as k from d where starts_with(bare, '{{') and json_valid(bare)),
fj as (select value, list([{_CANON('k')}, {_CANON("json_extract_string(bare, '$.' || chr(34) || k || chr(34))")}]) as pairs from j group by value, bare having bool_and(json_type(bare, '$.' || chr(34) || k || chr(34)) = 'VARCHAR')),
f as (select value, case when len(pairs) = 1 then pairs[1][1] || pairs[1][2] else array_to_string(list_sort(list_transform(pairs, lambda p: p[1] || chr(31) || p[2])), chr(30)) end as canon from (select * from fl union all select * from fj)),
c as (select table_name, row, coalesce(f.canon, {_CANON('t.value')}) as canon from t left join f using (value)),
r as (select *, min(row) over (partition by table_name, canon) as low from c where regexp_matches(canon, '[\\p{{L}}\\p{{N}}]'))"""
_LIMIT = 2000
SQL = {
    "p2_found": f"""with t as (select row as row_id, text, regexp_replace(regexp_replace(text, '^\\s*\\n', ''), '\\n\\s*$', '') as body from index_rows where length(text) > {_LIMIT}),
      u as (select row_id, list_max(list_transform(regexp_split_to_array(body, '\\r?\\n\\s*\\n'), lambda x: length(regexp_replace(x, '\\r$', '')))) as p, list_max(list_transform(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '\\S')), lambda x: length(x))) as l, list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: length(x))) as s from t)
      select distinct row_id, case when coalesce(p, 0) <= {_LIMIT} then 'blank' when l <= {_LIMIT} then 'line' when s <= {_LIMIT} then 'space' else 'none' end as boundary from u""",
    "p3_found": _RECORDS + " select distinct table_name, low as row_a, row as row_b from r where row <> low",
    "p3_records": _RECORDS + ", v as (select r.*, t.value from r join t using (table_name, row)) select table_name, low as row, count(*) as copies, count(distinct value) as variants from v group by table_name, low",
    "p5_found": """with v as (select row, cast(embedding as double[]) as e from index_rows where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
      select distinct a.row as row_a, b.row as row_b from v a join v b on a.row < b.row where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9""",
    "p7_found": """with w as (select doc_id as id, 0 as side, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null union all select item_id, 1, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') from test_items where text is not null),
      g as (select distinct id, side, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(list_slice(w, i, i + 19), ' '))) as g from w where len(w) >= 20)
      select distinct a.id as doc_id, b.id as item_id from g a join g b on a.g = b.g and a.side = 0 and b.side = 1""",
}
