"""Reports over per-query results: paired comparison on two metrics, grouped metrics, gate choice, delta and precision reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.dense import dot
from sextant.operators.evaluate import adopted, ndcg10, paired, top_overlap


def reciprocal10(rank: Column) -> Column:
    """Reciprocal rank within the first ten, else 0."""
    return F.when(rank <= 10, 1 / rank).otherwise(F.lit(0.0))


def per_query(ranks: DataFrame) -> DataFrame:
    """(qid, rank, ndcg_10, mrr_10): what a paired comparison is made of."""
    return ranks.select("qid", "rank", F.round(ndcg10(F.col("rank")), 6).alias("ndcg_10"), F.round(reciprocal10(F.col("rank")), 6).alias("mrr_10"))


def paired_report(ranks: DataFrame, base: DataFrame, boots: int = 2000, seed: int = 0) -> DataFrame:
    """One row: the NDCG comparison with its verdict, and delta_mrr with its interval mrr_ci_low, mrr_ci_high."""
    ndcg = adopted(paired(ranks, base, boots, seed))
    mrr = paired(ranks, base, boots, seed, reciprocal10).select(F.col("delta").alias("delta_mrr"), F.col("ci_low").alias("mrr_ci_low"), F.col("ci_high").alias("mrr_ci_high"))
    return ndcg.crossJoin(F.broadcast(mrr))  # one row each


def group_shares(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, share): rows of each group and their part of all; null is a group."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).withColumn("share", F.round(F.col("n") / F.col("all"), 6)).drop("all")


def grouped_scores(scores: DataFrame, by: Sequence[str], means: Sequence[str], medians: Sequence[str] = ()) -> DataFrame:
    """Means and medians over all rows and per value of each `by` column alone, as grouping sets.

    level has a bit for every `by` column that is summed over, the first column's being the greatest, so a null value is told
    from all values.
    """
    g = scores.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by])
    level = sum((F.grouping(c).cast("int") * 2 ** (len(by) - 1 - i) for i, c in enumerate(by)), F.lit(0))
    return g.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in means], *[F.percentile(c, 0.5).alias(f"median_{c}") for c in medians], level.alias("level"))


def best_gate(sweep: DataFrame, loss: float = 0.001) -> DataFrame:
    """The cheapest gate of a sweep (threshold, reranked, adopt, delta_vs_always) that is adopted and loses at most `loss` against reranking always; ties by threshold."""
    return sweep.where(F.col("adopt") & (F.col("delta_vs_always") >= -loss)).orderBy("reranked", "threshold").limit(1)


def gate_report(gaps: DataFrame, base: DataFrame, reranked: DataFrame, thresholds: Sequence[float], boots: int = 2000) -> DataFrame:
    """Per threshold: share reranked, comparison with never reranking, verdict, and the NDCG difference to reranking always.

    A query is reranked where its gap is below the threshold. gaps: (qid, gap); base, reranked: (qid, rank).
    """
    joined = gaps.join(base.select("qid", F.col("rank").alias("b")), "qid").join(reranked.select("qid", F.col("rank").alias("r")), "qid")
    out = None
    for t in thresholds:  # a handful of settings
        chosen = F.when(F.col("gap") < t, F.col("r")).otherwise(F.col("b"))
        mixed = joined.select("qid", chosen.alias("rank"), "b", "r", (F.col("gap") < t).cast("double").alias("asked"))
        loss = mixed.agg(F.round(F.avg("asked"), 6).alias("reranked"), F.round(F.avg(ndcg10(F.col("rank")) - ndcg10(F.col("r"))), 6).alias("delta_vs_always"))
        one = adopted(paired(mixed, base, boots)).crossJoin(F.broadcast(loss)).withColumn("threshold", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out


def family_tiebreak(scores: DataFrame, queries: DataFrame, documents: DataFrame, weight: float) -> DataFrame:
    """Scores (qid, row, score) with `weight` added where the query's family (qid, family) is the document's (row, family)."""
    q, d = queries.select("qid", F.col("family").alias("_q")), documents.select("row", F.col("family").alias("_d"))
    bonus = F.when(F.col("_q") == F.col("_d"), F.lit(float(weight))).otherwise(F.lit(0.0))
    return scores.join(q, "qid", "left").join(d, "row", "left").select("qid", "row", F.round(F.col("score") + bonus, 6).alias("score"))


def delta_bytes(rows: DataFrame, base: DataFrame, entries: DataFrame, dim: int = 64, lineage: str = "lineage", hash: str = "hash") -> DataFrame:
    """One row: rows, lineages, entries, plain_bytes (a half-precision vector a row), delta_bytes and ratio.

    A lineage has a half-precision base; an entry the number of its lineage, a byte a value and a single-precision scale; a
    row the number of its entry.
    """
    n = rows.agg(F.count("*").alias("rows"))
    lineages = base.agg(F.count_distinct(lineage).alias("lineages"))
    counted = entries.agg(F.count_distinct(lineage, hash).alias("entries"))
    whole = n.crossJoin(F.broadcast(lineages)).crossJoin(F.broadcast(counted))  # one row each
    sized = whole.withColumn("plain_bytes", F.col("rows") * 2 * dim).withColumn("delta_bytes", F.col("lineages") * 2 * dim + F.col("entries") * (4 + dim + 4) + F.col("rows") * 4)
    return sized.withColumn("ratio", F.round(F.col("delta_bytes") / F.greatest("plain_bytes", F.lit(1)), 4))


def delta_report(plain: DataFrame, delta: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: accuracy of the first hits of two searches and how often they agree.

    plain, delta: (qid, lineage, version), the first hit of each query; labels: (qid, lineage, version, acceptable). A query
    without a hit counts as wrong.
    """
    side = lambda hits, x: hits.select("qid", F.col("lineage").alias(f"{x}_l"), F.col("version").alias(f"{x}_v"))
    both = labels.join(side(plain, "plain"), "qid", "left").join(side(delta, "delta"), "qid", "left")
    mean = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4).alias(name)
    out = [F.count("*").alias("queries")]
    for x in ("plain", "delta"):
        right = F.col(f"{x}_l") == F.col("lineage")
        out += [mean(right, f"{x}_lineage"), mean(right & (F.col(f"{x}_v") == F.col("version")), f"{x}_exact"), mean(right & F.array_contains("acceptable", F.col(f"{x}_v")), f"{x}_consistent")]
    return both.agg(*out, mean((F.col("plain_l") == F.col("delta_l")) & (F.col("plain_v") == F.col("delta_v")), "agreement"))


def precision_report(reference: DataFrame, other: DataFrame, reference_top: DataFrame, other_top: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean and least cosine between two encodings (qid, embedding) of the same texts, and the overlap of their rankings."""
    both = reference.select("qid", F.col("embedding").alias("a")).join(other.select("qid", F.col("embedding").alias("b")), "qid")
    cosine = dot(F.col("a"), F.col("b")) / F.greatest(F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))), F.lit(1e-12))
    vectors = both.agg(F.round(F.avg(cosine), 6).alias("mean_cosine"), F.round(F.min(cosine), 6).alias("min_cosine"))
    return vectors.crossJoin(F.broadcast(top_overlap(reference_top, other_top, k)))  # one row each


def evaluate_retrieval(hits: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """One row about versioned retrieval: first hits, duplicates, and recall with and without collapsing lineages.

    hits: (qid, rank, lineage, version), deeper than k so that collapsing has something to take up; wanted: (qid, lineage,
    version, acceptable). Returns queries, lineage, exact_version, token_consistent, duplicate_pct of the first k, recall_all
    and recall_collapsed at k. Queries without hits count as missed and have no duplicates.
    """
    from sextant.operators.pipeline import version_accuracy
    from sextant.operators.ranking import best_per_group
    from sextant.operators.versions import duplication

    found = lambda ranked, name: ranked.where(F.col("rank") <= k).join(wanted.select("qid", "lineage"), ["qid", "lineage"]).select("qid").distinct().agg(F.count("*").alias(name))
    duplicates = duplication(hits, "lineage", k).agg(F.round(F.avg("duplicate_pct"), 4).alias("duplicate_pct"))
    whole = version_accuracy(hits, wanted)
    for part in (duplicates, found(hits, "_all"), found(best_per_group(hits, "lineage", k), "_collapsed")):  # one row each
        whole = whole.crossJoin(F.broadcast(part))
    share = lambda c: F.round(F.col(c) / F.greatest("queries", F.lit(1)), 6)
    return whole.withColumn("recall_all", share("_all")).withColumn("recall_collapsed", share("_collapsed")).drop("_all", "_collapsed")
