"""Dense retrieval: hashing encoder, exact top-k in blocks, averaged and delta-coded vectors, spherical k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators.ranking import top_k
from sextant.runtime import busy, cut

#: Queries that are broadcast at once, at most (65,536 vectors of 64 doubles are 33 MB), and hits that a task holds for them;
#: more queries are worked on in several scans. Queries of one matrix product.
QUERY_BLOCK, HELD, PRODUCT = 65_536, 4_000_000, 512


def usable(embedding: Column, dim: int) -> Column:
    """Vectors of that length without null or NaN that are not all zero."""
    return (F.size(embedding) == dim) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(embedding, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector over its length (at least 1e-12)."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def hashing_encoder(docs: DataFrame, id: str, text: str, dim: int = 64, most: int | None = None) -> DataFrame:
    """(id, bucket, value): signed feature hashing of word tokens by SHA-256, of unit length; buckets of value 0 are left out.

    A text without any token counts as the one token `__empty__`. `most` keeps the first tokens only.
    """
    found = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    tokens = F.when(F.size(found) > 0, found if most is None else F.slice(found, 1, most)).otherwise(F.array(F.lit("__empty__")))
    counted = busy(docs.select(id, text)).select(F.col(id), F.explode(tokens).alias("tok")).groupBy(id, "tok").agg(F.count("*").alias("n"))
    hashed = counted.withColumn("h", F.sha2("tok", 256))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    sums = hashed.groupBy(id, bucket.alias("bucket")).agg(F.sum(sign * F.col("n")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id)).cast("double"))
    return sums.withColumn("norm", norm).where("v <> 0").select(id, "bucket", F.round(F.col("v") / F.greatest("norm", F.lit(1e-12)), 6).alias("value"))


def dense_vectors(sparse: DataFrame, id: str, dim: int = 64) -> DataFrame:
    """(id, embedding) of vectors given as (id, bucket, value); buckets that are not listed are 0."""
    whole = sparse.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))  # at most dim entries
    return whole.select(id, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))


def dense_topk(docs: DataFrame, queries: DataFrame, k: int = 10, id: str = "row", embedding: str = "embedding", qid: str = "qid", dim: int = 64, exclude_self: bool = False) -> DataFrame:
    """(qid, rank, row, score): exact cosine top-k of every query, score at 6 digits, ties by row.

    Queries go to the tasks in blocks of bounded size; each task keeps its k best rows per query over all its batches, by
    matrix products, and only those are shuffled. Unusable vectors neither ask nor answer.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(qid).alias("qid"), F.col(embedding).alias("e")).where(usable(F.col("e"), dim))
    keep = max(k, 0) + int(exclude_self)
    blocks = max(1, -(-asked.count() // min(QUERY_BLOCK, max(1, HELD // max(keep, 1)))))
    slim = busy(docs.select(F.col(id).cast("long").alias("row"), F.col(embedding).alias("e")).where(usable(F.col("e"), dim)))
    kind = asked.schema["qid"].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = part.toPandas()  # about QUERY_BLOCK vectors
        q = np.stack(rows["e"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast((rows["qid"].to_numpy(dtype=object), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, unit_q = shared.value
            best: list = [None] * -(-len(ids) // PRODUCT)
            for batch in batches:
                if not len(batch) or not keep:
                    continue
                row = batch["row"].to_numpy()
                d = np.stack(batch["e"].to_numpy()).astype(np.float64)[np.argsort(row, kind="stable")]
                row, d = np.sort(row, kind="stable"), d / np.linalg.norm(d, axis=1, keepdims=True)
                for i in range(len(best)):
                    score = (unit_q[i * PRODUCT : (i + 1) * PRODUCT] @ d.T).round(6)
                    best[i] = _best(score, np.broadcast_to(row, score.shape), keep, best[i])
            for i, found in enumerate(best):
                if found is not None:
                    yield pd.DataFrame({"qid": np.repeat(ids[i * PRODUCT : (i + 1) * PRODUCT], found[0].shape[1]), "row": found[1].ravel(), "score": found[0].ravel()})

        scores = slim.mapInPandas(scan, f"qid {kind}, row long, score double")
        out = scores if out is None else out.unionByName(scores)
    if exclude_self:
        out = out.where(F.col("qid") != F.col("row"))
    return top_k(out, k)


def _best(score: np.ndarray, row: np.ndarray, k: int, before: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, row) of each line and of what it had before; ties by row. Rows of a line rise."""
    n = score.shape[1]
    if n > k:  # whole numbers of millionths, then the place: all keys differ, so the k greatest are the ones
        key = np.rint(score * 1e6).astype(np.int64) * (1 << 32) + (n - np.arange(n))
        at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        score, row = np.take_along_axis(score, at, 1), np.take_along_axis(row, at, 1)
    if before is not None:
        score, row = np.concatenate([before[0], score], axis=1), np.concatenate([before[1], row], axis=1)
    order = np.lexsort((row, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(row, order, 1)


def average_vectors(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """(id, embedding): mean of the unit vectors of each id, of unit length again."""
    parts = vectors.select(id, F.posexplode(unit(F.col(embedding))).alias("pos", "x")).groupBy(id, "pos").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(id).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))  # dim values
    return mean.select(id, unit(F.col("v")).alias("embedding"))


def delta_entries(rows: DataFrame, lineage: str = "lineage", hash: str = "hash", embedding: str = "embedding", row: str = "row") -> tuple[DataFrame, DataFrame]:
    """Delta-coded vectors: bases (lineage, pos, base) and entries (lineage, hash, pos, residual, scale).

    An entry is the first row (by row) of a (lineage, hash); the base is the mean of a lineage's entries; residuals are
    8-bit steps of scale = greatest residual / 127 (1 where all are 0).
    """
    first = rows.groupBy(lineage, hash).agg(F.min_by(F.struct(F.col(embedding).alias("e")), row).alias("x")).select(lineage, hash, F.posexplode("x.e").alias("pos", "v"))
    base = first.groupBy(lineage, "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("base"))
    diff = first.join(base, [lineage, "pos"]).withColumn("d", F.col("v").cast("double") - F.col("base"))
    peak = F.max(F.abs("d")).over(Window.partitionBy(lineage, hash))
    scaled = diff.withColumn("scale", F.when(peak > 0, peak / 127).otherwise(1.0))
    step = F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(F.col("d") / F.col("scale"))))
    return base, scaled.select(lineage, hash, "pos", step.cast("tinyint").alias("residual"), "scale")


def delta_vectors(base: DataFrame, entries: DataFrame, lineage: str = "lineage", hash: str = "hash") -> DataFrame:
    """(lineage, hash, embedding): vectors rebuilt as base + residual * scale."""
    full = entries.join(base, [lineage, "pos"]).select(lineage, hash, "pos", (F.col("base") + F.col("residual") * F.col("scale")).alias("x"))
    return full.groupBy(lineage, hash).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))


def delta_search(base: DataFrame, entries: DataFrame, queries: DataFrame, k: int = 10, lineage_k: int | None = None, lineage: str = "lineage", hash: str = "hash", dim: int = 64) -> DataFrame:
    """Two-stage search: the best lineages by their unit base, then their rebuilt vectors by plain dot product.

    queries: (qid, embedding). Bases are ranked by matrix products as in dense_topk, ties by the order of lineages.
    Returns qid, rank, lineage, hash, score.
    """
    keep = lineage_k or max(3 * k, 20)
    bases = base.groupBy(lineage).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda p: p["base"]).alias("embedding"))
    # numbers that rise with the lineage, by ranges: no task orders all of them
    ranged = cut(bases.repartitionByRange(lineage).sortWithinPartitions(lineage).withColumn("row", F.monotonically_increasing_id()))
    asked = queries.select("qid", unit(F.col("embedding")).alias("embedding"))
    near = dense_topk(ranged, asked, keep, dim=dim).join(ranged.select("row", lineage), "row").select("qid", lineage)
    scored = delta_vectors(base, entries, lineage, hash).join(near, lineage).join(asked.withColumnRenamed("embedding", "q"), "qid")
    return scored.select("qid", lineage, hash, F.round(dot(F.col("q"), F.col("embedding")), 6).alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), lineage, hash))).where(F.col("rank") <= k).select("qid", "rank", lineage, hash, "score")


def spherical_kmeans(vectors: DataFrame, id: str = "row", embedding: str = "embedding", clusters: int = 12, rounds: int = 10, dim: int = 64) -> DataFrame:
    """(id, cluster): Lloyd rounds by cosine, started from the vectors of least hash; an empty cluster keeps its centre."""
    spark = vectors.sparkSession
    slim = busy(vectors.select(F.col(id).alias("id"), F.col(embedding).alias("e")).where(usable(F.col("e"), dim)))
    seeds = slim.orderBy(F.xxhash64("id"), "id").limit(clusters).select("e").toPandas()
    if not len(seeds):
        return slim.select(F.col("id").alias(id), F.lit(0).alias("cluster"))
    centres = np.stack(seeds["e"].to_numpy()).astype(float)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def nearest(shared):
        def run(batches):
            for b in batches:
                if len(b):
                    v = np.stack(b["e"].to_numpy()).astype(float)
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    yield b["id"], v, (v @ shared.value.T).round(9).argmax(1)

        return run

    for _ in range(rounds):
        step = nearest(spark.sparkContext.broadcast(centres))

        def sums(batches, step=step):
            total, seen = np.zeros((clusters, dim)), np.zeros(clusters, np.int64)
            for _, v, c in step(batches):
                np.add.at(total, c, v)
                np.add.at(seen, c, 1)
            yield pd.DataFrame({"c": np.arange(clusters), "n": seen, "s": list(total)})

        # one row a cluster and partition is reduced on the executors, one row a cluster comes back
        parts = slim.mapInPandas(sums, "c int, n long, s array<double>").select("c", "n", F.posexplode("s").alias("pos", "x")).groupBy("c", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).where("n > 0").toPandas()
        moved = centres.copy()
        for c, group in parts.groupby("c"):
            v = group.sort_values("pos")["x"].to_numpy()
            if np.linalg.norm(v) > 1e-12:
                moved[int(c)] = v / np.linalg.norm(v)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    step = nearest(spark.sparkContext.broadcast(centres))

    def assign(batches):
        for ids, _, c in step(batches):
            yield pd.DataFrame({"id": ids, "cluster": c.astype(np.int32)})

    return slim.mapInPandas(assign, f"id {slim.schema['id'].dataType.simpleString()}, cluster int").withColumnRenamed("id", id)


def cluster_terms(docs: DataFrame, id: str = "row", text: str = "text", cluster: str = "cluster", top: int = 3) -> DataFrame:
    """(cluster, place, term): terms that a cluster's documents hold more often: inside * ln(inside / overall), ties by term descending."""
    from sextant.functions.text import name_set

    terms = docs.select(cluster, F.explode(name_set(F.col(text))).alias("term"))
    sizes, n = docs.groupBy(cluster).agg(F.count("*").alias("size")), docs.agg(F.count("*").alias("n"))
    inside = terms.groupBy(cluster, "term").agg(F.count("*").alias("c"))
    overall = inside.groupBy("term").agg(F.sum("c").alias("all"))
    rated = inside.where("c >= 2").join(overall, "term").join(F.broadcast(sizes), cluster).crossJoin(F.broadcast(n))
    share, whole = F.col("c") / F.col("size"), F.col("all") / F.col("n")
    scored = rated.withColumn("score", F.round(share * F.log((share + 1e-9) / (whole + 1e-9)), 9))
    w = Window.partitionBy(cluster).orderBy(F.desc("score"), F.desc("term"))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(cluster, "place", "term")
