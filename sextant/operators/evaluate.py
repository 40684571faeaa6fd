"""Retrieval metrics, paired comparison, adoption, and the analyses built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rank of what was not found (a fixed value).
RANK_CAP = 1001


def ranks_from_scores(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, rank): 1 + rows with a greater score than the target's, at most RANK_CAP; RANK_CAP where it has no score.

    scores: (qid, row, score); targets: (qid, row), one per query.
    """
    ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score"))))
    return targets.select("qid", "row").join(ranked, ["qid", "row"], "left").select("qid", F.least(F.coalesce("rank", F.lit(RANK_CAP)), F.lit(RANK_CAP)).alias("rank"))


def ranks_from_lists(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, rank): place of the target in the list, RANK_CAP if it is not there."""
    return targets.select("qid", "row").join(ranked.select("qid", "row", "rank"), ["qid", "row"], "left").select("qid", F.coalesce("rank", F.lit(RANK_CAP)).alias("rank"))


def ndcg10(rank: Column) -> Column:
    """NDCG@10 of a query with one relevant document at that rank."""
    return F.when(rank <= 10, 1 / F.log2(rank + 1.0)).otherwise(F.lit(0.0))


def summarise(ranks: DataFrame) -> DataFrame:
    """One row: n, ndcg_10, mrr_10, recall at 1, 10, 100 and 1000, median rank; nulls but n on an empty table."""
    within = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_{k}")
    mrr = F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(F.lit(0.0))
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg(ndcg10(F.col("rank"))), 6).alias("ndcg_10"), F.round(F.avg(mrr), 6).alias("mrr_10"), *[within(k) for k in (1, 10, 100, 1000)], F.percentile("rank", 0.5).alias("median_rank"))


def graded_ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, mrr) by graded gains; queries without ranking count 0, gains of 0 or less and nulls are no judgement.

    ranked: (qid, rank, doc_id); qrels: (qid, doc_id, gain), repeated rows count once with their greatest gain.
    """
    gains = qrels.where("gain > 0").groupBy("qid", "doc_id").agg(F.max("gain").alias("gain"))
    discount = lambda g, r: g / F.log2(r + 1.0)
    ideal = gains.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "doc_id"))).where(F.col("r") <= k).groupBy("qid").agg(F.sum(discount(F.col("gain"), F.col("r"))).alias("idcg"))
    got = ranked.where(F.col("rank") <= k).join(gains, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(discount(F.col("gain"), F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    return ideal.join(got, "qid", "left").select("qid", F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def paired(ranks: DataFrame, base: DataFrame, boots: int = 2000, seed: int = 0, metric: Callable[[Column], Column] = ndcg10) -> DataFrame:
    """One row: improved, worsened, same, delta (of the metric) and its percentile bootstrap interval ci_low, ci_high.

    The interval resamples groups of equal differences (few: ranks above 10 all give 0) by a seeded multinomial draw in
    one task, so its cost does not grow with the number of queries.
    """
    both = ranks.select("qid", F.col("rank").alias("r")).join(base.select("qid", F.col("rank").alias("b")), "qid")
    d = metric(F.col("r")) - metric(F.col("b"))
    groups = both.groupBy(F.round(d, 12).alias("d")).agg(F.count("*").alias("n"), F.sum((F.col("r") < F.col("b")).cast("long")).alias("improved"), F.sum((F.col("r") > F.col("b")).cast("long")).alias("worsened"), F.sum((F.col("r") == F.col("b")).cast("long")).alias("same"))

    def boot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches))  # at most 121 differences
        if not len(g):
            return
        g = g.sort_values("d")
        n, value = g["n"].to_numpy(), g["d"].to_numpy()
        total = int(n.sum())
        drawn = np.random.RandomState(seed).multinomial(total, n / total, size=boots) @ value / total
        low, high = np.percentile(drawn, [2.5, 97.5])
        yield pd.DataFrame({"n": [total], "improved": [int(g["improved"].sum())], "worsened": [int(g["worsened"].sum())], "same": [int(g["same"].sum())], "delta": [round(float((n * value).sum() / total), 6)], "ci_low": [round(float(low), 6)], "ci_high": [round(float(high), 6)]})

    return groups.coalesce(1).mapInPandas(boot, "n long, improved long, worsened long, same long, delta double, ci_low double, ci_high double")


def adopted(c: DataFrame, gain: float = 0.005, worse: float = 0.5) -> DataFrame:
    """The comparison with column adopt: enough gain, interval above 0, worsened at most a share of improved, some improved."""
    return c.withColumn("adopt", (F.col("delta") >= gain) & (F.col("ci_low") > 0) & (F.col("worsened") <= worse * F.col("improved")) & (F.col("improved") > 0))


def nearest_rank(values: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """by + pN columns: nearest-rank percentiles at index round-half-even(p / 100 * n + .5) - 1, within the values.

    Equal values are counted first, so a group's distinct values, not its rows, are ordered.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.lit(p / 100.0) * F.col("n") + 0.5).cast("long") - 1))
    return upto.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{p}") for p in percents])


def top_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row comparing two rankings: queries, mean overlap of their first k, share with another first, share equal."""
    lists = lambda x, n: x.where(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "row"))), lambda s: s["row"]).alias(n))  # noqa: E731  # k rows a query
    both = lists(a, "a").join(lists(b, "b"), "qid")
    return both.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.lit(1))), 6).alias("overlap"),
        F.round(F.avg((F.get("a", F.lit(0)) != F.get("b", F.lit(0))).cast("double")), 6).alias("first_changed"),
        F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("identical"),
    )


def location_hits(predicted: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(qid, hits, precision, recall) of places: equal file or one a path suffix of the other, and overlapping lines.

    predicted: (qid, rank, file, start, stop); expected: (qid, file, start, stop). Joined on the query and file name.
    """
    name = lambda c: F.regexp_extract(c, r"[^/]+$", 0)
    p = predicted.where(F.col("rank") <= k).select("qid", "rank", F.col("file").alias("pf"), F.col("start").alias("ps"), F.col("stop").alias("pe"), name(F.col("file")).alias("name"))
    e = expected.distinct().select("qid", F.col("file").alias("ef"), F.col("start").alias("es"), F.col("stop").alias("ee"), name(F.col("file")).alias("name"))
    same = (F.col("pf") == F.col("ef")) | F.col("pf").endswith(F.concat(F.lit("/"), F.col("ef"))) | F.col("ef").endswith(F.concat(F.lit("/"), F.col("pf")))
    met = p.join(e, ["qid", "name"]).where(same & (F.greatest("ps", "es") <= F.least("pe", "ee")))
    hits = met.groupBy("qid").agg(F.count_distinct("rank").alias("hits"), F.count_distinct("ef", "es", "ee").alias("found"))
    sizes = e.groupBy("qid").agg(F.count("*").alias("expected")).join(p.groupBy("qid").agg(F.count("*").alias("given")), "qid", "left")
    return sizes.join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce(F.col("hits") / F.col("given"), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.col("found") / F.col("expected"), F.lit(0.0)), 6).alias("recall"))
