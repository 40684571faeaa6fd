"""Git histories as relations: commits, files at a commit, renames, and the versions of every function."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators.code import SKIP_DIRS, chunk_files
from sextant.operators.versions import canonical_lineages, tracked_links, with_content_hash
from sextant.runtime import cut


def git(repo: str, *args: str, check: bool = True) -> bytes:
    """Output of a git command in a repository."""
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True, timeout=600)
    if check and done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace")[:500])
    return done.stdout


def list_commits(spark: SparkSession, repo: str, most: int | None = None, subdir: str | None = None) -> DataFrame:
    """(version, sha, short, date, subject) of the first-parent history, oldest first; `most` keeps the latest."""
    out = git(repo, "log", "--reverse", "--first-parent", "--format=%H%x1f%h%x1f%cI%x1f%s", *(["--", subdir] if subdir else [])).decode(errors="replace")
    rows = [line.split("\x1f") for line in out.splitlines() if line]
    rows = rows[-most:] if most else rows
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "version int, sha string, short string, date string, subject string")


def files_at(commits: DataFrame, repo: str, subdir: str | None = None) -> DataFrame:
    """(version, sha, file, blob) of every Python file at every commit. The repository must be readable on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for version, sha in zip(b["version"], b["sha"]):
                for line in git(repo, "ls-tree", "-r", sha, *(["--", subdir] if subdir else [])).decode(errors="replace").splitlines():
                    head, path = line.split("\t", 1)
                    if path.endswith(".py") and not set(path.split("/")[:-1]) & set(SKIP_DIRS):
                        out.append((version, sha, path, head.split()[2]))
            yield pd.DataFrame(out, columns=["version", "sha", "file", "blob"])

    return commits.select("version", "sha").mapInPandas(run, "version int, sha string, file string, blob string")


def blob_texts(files: DataFrame, repo: str) -> DataFrame:
    """(blob, text) of the distinct blobs, null text where it is not UTF-8; a file that did not change is read once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for blob in b["blob"]:
                try:
                    texts.append(git(repo, "cat-file", "blob", blob).decode("utf-8"))
                except UnicodeDecodeError:
                    texts.append(None)
            yield pd.DataFrame({"blob": b["blob"], "text": texts})

    return files.select("blob").distinct().mapInPandas(run, "blob string, text string")


def file_renames(commits: DataFrame, repo: str) -> DataFrame:
    """(version, old, new) of files that git takes for renamed at a commit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for version, sha in zip(b["version"], b["sha"]):
                for line in git(repo, "diff", "-M", "--name-status", "--diff-filter=R", f"{sha}^", sha, check=False).decode(errors="replace").splitlines():
                    _, old, new = line.split("\t")
                    out.append((version, old, new))
            yield pd.DataFrame(out, columns=["version", "old", "new"])

    return commits.select("version", "sha").mapInPandas(run, "version int, old string, new string")


def function_versions(spark: SparkSession, repo: str, most: int | None = None, subdir: str | None = None) -> DataFrame:
    """Every function at every commit: version, lineage_id (`file::qualname`), its place, text and content_hash.

    Each distinct blob is read and parsed once; of functions that share a qualname in a file the first counts.
    """
    commits = list_commits(spark, repo, most, subdir)
    files = files_at(commits, repo, subdir)
    texts = blob_texts(files, repo)
    chunks = chunk_files(texts.withColumnRenamed("blob", "file"), methods=True, most=None).where("kind <> 'module'").withColumnRenamed("file", "blob").drop("chunk_id")
    first = chunks.groupBy("blob", "qualname").agg(F.min_by(F.struct("start_line", "end_line", "kind", "name", "text"), "start_line").alias("x")).select("blob", "qualname", "x.*")
    hashed = with_content_hash(first, name="content_hash")
    return files.join(hashed, "blob").join(commits.select("version", "short", "date", "subject"), "version").withColumn("lineage_id", F.concat_ws("::", "file", "qualname")).drop("blob")


def function_links(spark: SparkSession, repo: str, most: int | None = None, subdir: str | None = None, threshold: float = 0.8) -> DataFrame:
    """(version, old, new, similarity, scope, kind) of functions that go on under another `file::qualname` at a commit.

    Functions of a file that git takes for renamed go on at the same qualname in the new file (scope file); of the others,
    those that were removed go on in added ones of alike bodies (scope function).
    """
    commits = list_commits(spark, repo, most, subdir)
    near = Window.partitionBy("lineage_id").orderBy("version")
    placed = cut(function_versions(spark, repo, most, subdir)).withColumn("was", F.lag("version").over(near)).withColumn("comes", F.lead("version").over(near))
    gone = placed.where("comes is null or comes > version + 1").withColumn("version", F.col("version") + 1).join(commits.select("version"), "version", "left_semi").withColumn("side", F.lit("removed"))
    come = placed.where("version > 1 and (was is null or was < version - 1)").withColumn("side", F.lit("added"))
    changes = gone.unionByName(come).select("version", "side", F.col("lineage_id").alias("id"), "file", "kind", "name", "qualname", "text")
    return tracked_links(changes, file_renames(commits, repo), ["version"], threshold)


def tracked_history(spark: SparkSession, repo: str, most: int | None = None, subdir: str | None = None, threshold: float = 0.8) -> DataFrame:
    """function_versions with lineages carried through renames: key (`file::qualname`), lineage_id (the first key), change
    (added, modified or unchanged against the commit before, by lineage), and of links their kind, similarity, scope and origin.
    """
    rows = cut(function_versions(spark, repo, most, subdir).withColumnRenamed("lineage_id", "key"))
    links = cut(function_links(spark, repo, most, subdir, threshold))
    ones = rows.withColumn("repo", F.lit(repo))
    carried = canonical_lineages(ones, links.withColumn("repo", F.lit(repo)), ["repo"]).drop("repo")
    w = Window.partitionBy("lineage_id").orderBy("version")
    near = F.lag("version").over(w) == F.col("version") - 1
    change = F.when(F.coalesce(near, F.lit(False)), F.when(F.lag("content_hash").over(w).eqNullSafe(F.col("content_hash")), "unchanged").otherwise("modified")).otherwise("added")
    told = links.select("version", F.col("new").alias("key"), F.col("kind").alias("link_kind"), F.col("similarity").alias("link_similarity"), F.col("scope").alias("link_scope"), F.col("old").alias("link_from"))
    return carried.withColumn("change", change).join(told, ["version", "key"], "left")
