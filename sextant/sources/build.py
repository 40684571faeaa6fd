"""Jobs that make indexes: of a git history, and the categories of an index that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.dense import cluster_terms, spherical_kmeans
from sextant.operators.shape import families
from sextant.operators.versions import encode_distinct
from sextant.runtime import cut
from sextant.sources.encoders import Encoder
from sextant.sources.git import tracked_history
from sextant.sources.index import load_index, write_index


def build_history_index(spark: SparkSession, repo: str, folder: str, encoder: Encoder, most: int | None = None, subdir: str | None = None) -> dict:
    """Index every function at every commit of a repository; each distinct content is encoded once. Returns the manifest."""
    rows = tracked_history(spark, repo, most, subdir).withColumn("doc_id", F.concat_ws("@v", "lineage_id", "version")).withColumn("row", F.xxhash64("key", "version"))
    vectors = encode_distinct(rows, lambda work: work.join(encoder.encode_docs(work, "content_hash"), "content_hash"))
    return write_index(cut(vectors), folder, encoder.dim, task="history", repo=repo, subdir=subdir, most=most, **encoder.manifest())


def tag_rows(rows: DataFrame, clusters: int = 12, dim: int = 64) -> DataFrame:
    """Rows with ast_family, ast_reason, cluster and cluster_label (its three leading terms); null where a row has none."""
    grouped = cut(spherical_kmeans(rows, clusters=clusters, dim=dim))
    terms = cluster_terms(rows.select("row", "text").join(grouped, "row")).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ").alias("cluster_label"))  # three terms each
    return rows.join(families(rows), "row", "left").join(grouped, "row", "left").join(terms, "cluster", "left")


def family_counts(tagged: DataFrame) -> DataFrame:
    """(ast_family, n), most first, ties by name."""
    return tagged.groupBy("ast_family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ast_family")


def build_categories(spark: SparkSession, folder: str, clusters: int = 12) -> dict:
    """Tag the rows of an index anew and write it back; returns the manifest with the counts of families."""
    rows, manifest = load_index(spark, folder)
    plain = rows.drop("ast_family", "ast_reason", "cluster", "cluster_label")
    tagged = cut(tag_rows(plain, clusters, manifest["dim"]))
    meta = {k: v for k, v in manifest.items() if k not in ("kind", "n_docs", "dim", "created", "columns", "files")}
    return write_index(tagged, folder, manifest["dim"], **meta | {"families": {r["ast_family"]: r["n"] for r in family_counts(tagged).collect()}})  # a dozen families
