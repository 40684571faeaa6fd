"""Ranked lists in long form: top-k, fusion, normalisation, reranking, gating, re-judging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(scores: DataFrame, k: int, qid: str = "qid", row: str = "row", score: str = "score") -> DataFrame:
    """(qid, rank, row, score): the k greatest scores of each query, ties by row. k of 0 or less gives no rows."""
    w = Window.partitionBy(qid).orderBy(F.desc(score), row)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(qid, "rank", row, score)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (qid, rank, row) lists: sum of weight / (k + rank); ties by first list, then rank there."""
    weights = weights or [1.0] * len(lists)
    tagged = [x.select("qid", "row", F.col("rank").cast("int").alias("rank"), F.lit(i).alias("li"), F.lit(float(w)).alias("weight")) for i, (x, w) in enumerate(zip(lists, weights))]
    return rrf_tagged(reduce(DataFrame.unionByName, tagged), k, depth)


def rrf_tagged(lists: DataFrame, k: int = 60, depth: int | None = None) -> DataFrame:
    """rrf of lists in one table (qid, row, rank, li, weight); no shuffle of its own where the rows of a query lie together."""
    fused = lists.groupBy("qid", "row").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("li", "rank")).alias("first"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "row")
    out = fused.withColumn("rank", F.row_number().over(w))
    return (out if depth is None else out.where(F.col("rank") <= depth)).select("qid", "rank", "row", "score")


def normalise(score: Column, by: list[str], how: str = "zscore") -> Column:
    """zscore (population; flat gives 0) or minmax (flat gives 0.5) over the rows of each `by` group."""
    w = Window.partitionBy(*by)
    if how == "zscore":
        sd = F.stddev_pop(score).over(w)
        return F.when(sd > 1e-12, (score - F.avg(score).over(w)) / sd).otherwise(F.lit(0.0))
    if how == "minmax":
        low, high = F.min(score).over(w), F.max(score).over(w)
        return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.5))
    raise ValueError(f"unknown normalisation {how!r}")


def score_fuse(a: DataFrame, b: DataFrame, weight: float = 0.5, how: str = "zscore", convex: bool = True) -> DataFrame:
    """(1 - w) norm(a) + w norm(b) over (qid, row, score) frames with the same rows; convex=False keeps norm(a) whole."""
    left = a.select("qid", "row", normalise(F.col("score"), ["qid"], how).alias("a"))
    right = b.select("qid", "row", normalise(F.col("score"), ["qid"], how).alias("b"))
    return left.join(right, ["qid", "row"]).select("qid", "row", F.round(F.col("a") * ((1 - weight) if convex else 1.0) + F.col("b") * weight, 6).alias("score"))


def score_fuse_tagged(lists: DataFrame, weight: float = 0.5, how: str = "zscore", convex: bool = True) -> DataFrame:
    """score_fuse of two lists in one table (qid, li, row, score); no shuffle of its own where the rows of a query lie together."""
    x = lists.select("qid", "row", "li", normalise(F.col("score"), ["qid", "li"], how).alias("x"))
    both = x.groupBy("qid", "row").agg(F.max(F.when(F.col("li") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("li") == 1, F.col("x"))).alias("b")).where("a is not null and b is not null")
    return both.select("qid", "row", F.round(F.col("a") * ((1 - weight) if convex else 1.0) + F.col("b") * weight, 6).alias("score"))


def sparse_fuse(a: DataFrame, b: DataFrame, documents: DataFrame, weight: float = 0.5, how: str = "zscore") -> DataFrame:
    """(1 - w) norm(a) + w norm(b), normalised over all documents: those that a frame does not list score 0 in it.

    a, b: (qid, row, score); documents: one row (n). Returns the rows that either lists; all others share one lower score.
    """
    if how not in ("zscore", "minmax"):
        raise ValueError(f"unknown normalisation {how!r}")

    def side(scores: DataFrame, name: str) -> DataFrame:
        none = F.when(F.count("*") < F.col("n"), 0.0)
        per = scores.crossJoin(F.broadcast(documents)).groupBy("qid", "n").agg((F.sum("score") / F.col("n")).alias("mean"), (F.sum(F.col("score") * F.col("score")) / F.col("n")).alias("square"), F.least(F.min("score"), none).alias("low"), F.greatest(F.max("score"), none).alias("high"))
        sd = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
        return per.select("qid", *([F.col("mean").alias(f"{name}_shift"), sd.alias(f"{name}_scale")] if how == "zscore" else [F.col("low").alias(f"{name}_shift"), (F.col("high") - F.col("low")).alias(f"{name}_scale")]))

    def norm(name: str) -> Column:
        flat = F.lit(0.0) if how == "zscore" else F.lit(0.5)
        return F.when(F.col(f"{name}_scale") > (1e-12 if how == "zscore" else 0), (F.coalesce(F.col(name), F.lit(0.0)) - F.col(f"{name}_shift")) / F.col(f"{name}_scale")).otherwise(flat)

    both = a.select("qid", "row", F.col("score").alias("a")).join(b.select("qid", "row", F.col("score").alias("b")), ["qid", "row"], "full")
    scaled = both.join(side(a, "a"), "qid").join(side(b, "b"), "qid")
    return scaled.select("qid", "row", F.round(norm("a") * (1 - weight) + norm("b") * weight, 6).alias("score"))


def rerank(ranked: DataFrame, scored: DataFrame, k: int = 20, alpha: float = 0.0) -> DataFrame:
    """Rerank the first k of each list: alpha z(first) + (1 - alpha) z(second) within the candidates, ties keep their order.

    ranked: (qid, rank, row, score); scored: (qid, row, second). The tail keeps its order and scores; head scores are
    lifted so that the least of them is 1e-6 above the tail's best (0 without a tail). Queries any of whose candidates
    lack a second score stay as they are.
    """
    head = ranked.where(F.col("rank") <= k).join(scored.select("qid", "row", "second"), ["qid", "row"], "left")
    per = Window.partitionBy("qid")
    head = head.withColumn("complete", F.count("second").over(per) == F.count("*").over(per))
    mixed = head.where("complete").withColumn("mixed", F.round(alpha * normalise(F.col("score"), ["qid"]) + (1 - alpha) * normalise(F.col("second"), ["qid"]), 9))
    mixed = mixed.withColumn("new", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("mixed"), "rank")))
    tail_top = ranked.where(F.col("rank") > k).groupBy("qid").agg(F.max("score").alias("tail_top"))
    lifted = mixed.withColumn("low", F.min("mixed").over(per)).join(tail_top, "qid", "left").select("qid", F.col("new").alias("rank"), "row", F.round(F.col("mixed") - F.col("low") + F.coalesce("tail_top", F.lit(0.0)) + 1e-6, 6).alias("score"))
    kept = head.where("not complete").select("qid", "rank", "row", "score")
    return lifted.unionByName(kept).unionByName(ranked.where(F.col("rank") > k).select("qid", "rank", "row", "score"))


def finalize(fused: DataFrame, dense: DataFrame, depth: int) -> DataFrame:
    """Pad a list with the rest of the dense order, without repeats, to depth."""
    rest = dense.join(fused.select("qid", "row"), ["qid", "row"], "left_anti").select("qid", "row", F.lit(1).alias("part"), "rank")
    both = fused.select("qid", "row", F.lit(0).alias("part"), "rank").unionByName(rest)
    w = Window.partitionBy("qid").orderBy("part", "rank", "row")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("qid", "rank", "row")


def confidence_gap(ranked: DataFrame, depth: int = 10) -> DataFrame:
    """(qid, gap): (s1 - s2) / population deviation of the first `depth`; infinite below two hits, 0 where flat."""
    head = ranked.where(F.col("rank") <= depth).groupBy("qid").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.stddev_pop("score").alias("sd"))
    return head.select("qid", F.when(F.col("n") < 2, F.lit(float("inf"))).when(F.col("sd") < 1e-9, 0.0).otherwise((F.col("s1") - F.col("s2")) / F.when(F.col("sd") > 0, F.col("sd"))).alias("gap"))


def gate_sweep(gaps: DataFrame, base: DataFrame, reranked: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: share of queries reranked (gap below it) and mean reciprocal rank; base, reranked: (qid, rank)."""
    joined = gaps.join(base.select("qid", F.col("rank").alias("b")), "qid").join(reranked.select("qid", F.col("rank").alias("r")), "qid")
    swept = joined.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    chosen = F.when(F.col("gap") < F.col("threshold"), F.col("r")).otherwise(F.col("b"))
    return swept.groupBy("threshold").agg(F.round(F.avg((F.col("gap") < F.col("threshold")).cast("double")), 6).alias("reranked"), F.round(F.avg(1 / chosen), 6).alias("mrr"))


def rejudge(ranked: DataFrame, judged: DataFrame, top: int = 3, margin: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Reorder the first `top` of uncertain queries: (1 - beta) minmax(score) + beta judge; positions keep their scores.

    Uncertain: (s1 - s2) / deviation of the first ten below `margin`. judged: (qid, row, judge); a null or missing
    judgement counts as the retrieval part alone.
    """
    unsure = confidence_gap(ranked, 10).where(F.col("gap") < margin).select("qid")
    head = ranked.where(F.col("rank") <= top).join(unsure, "qid", "left_semi")
    scored = head.join(judged.select("qid", "row", "judge"), ["qid", "row"], "left").withColumn("part", normalise(F.col("score"), ["qid"], "minmax"))
    final = F.round((1 - beta) * F.col("part") + beta * F.coalesce("judge", "part"), 9)
    moved = scored.withColumn("new", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(final), "rank"))).select("qid", F.col("new").alias("rank"), "row")
    positions = head.select("qid", "rank", "score")
    rest = ranked.where(F.col("rank") > top).unionByName(ranked.where(F.col("rank") <= top).join(unsure, "qid", "left_anti")).select("qid", "rank", "row", "score")
    return moved.join(positions, ["qid", "rank"]).select("qid", "rank", "row", "score").unionByName(rest)


def gaps_to_next(ranked: DataFrame) -> DataFrame:
    """Ranked rows with the score gap to the next hit (null for the last)."""
    w = Window.partitionBy("qid").orderBy("rank")
    return ranked.withColumn("gap", F.round(F.col("score") - F.lead("score").over(w), 6))


def best_per_group(ranked: DataFrame, group: str, k: int | None = None) -> DataFrame:
    """The best hit of each group (lineage) in ranking order; k limits the groups after collapsing."""
    first = ranked.withColumn("place", F.row_number().over(Window.partitionBy("qid", group).orderBy("rank"))).where("place = 1").drop("place")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return out if k is None else out.where(F.col("rank") <= k)
