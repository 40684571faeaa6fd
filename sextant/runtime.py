"""What operators need of the session: lineage cuts, table access, sizes and hashing shared by the JVM and NumPy."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` in `folder`."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder that all executors share.

    The folder is the session's own (spark.checkpoint.dir). Only where none is set and the master is local, so that one
    machine holds everything, a temporary one is made; on a cluster a missing setting raises RuntimeError.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sextant-"))
    return df.checkpoint()


#: Bytes (as Catalyst estimates them) for each core under which a scan counts as small.
SMALL_PER_CORE = 32 << 20


def busy(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input over all cores before CPU-bound work per row; large scans have partitions enough and stay.

    With keys equal rows of them come together, so that a distinct that follows needs no shuffle of its own. Inputs of as
    many files as there are cores are spread already. The size is Catalyst's estimate of the plan; nothing is executed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * SMALL_PER_CORE or (not keys and len(df.inputFiles()) >= cores):
        return df
    return df.repartition(cores, *keys)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Bring equal keys together: a small input in as many parts as there are cores, a large one in parts of the size that the session asks for."""
    spread = busy(df, *keys)
    return df.repartition(*keys) if spread is df else spread


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path, so that object stores and local folders are treated alike."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on whatever file system it lies."""
    files, hadoop = _path(spark, path)
    return files.exists(hadoop)


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its file system, as scans report it (`file:/...` on this machine)."""
    files, hadoop = _path(spark, path)
    return files.makeQualified(hadoop).toString()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    files, hadoop = _path(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(hadoop)) if files.exists(hadoop) else []


def canonical(text: Column) -> Column:
    """Letters and digits of a string in order, letter case ignored (upper first, so that multi-letter cases agree)."""
    return F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}\p{N}]", "")


def words(text: Column) -> Column:
    """The words of a string: longest runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# Constants of the public XXH64 algorithm (fixed values).
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64(*columns, seed: int = 42) -> np.ndarray:
    """XXH64 of 64-bit integers, equal to Spark's xxhash64 over BIGINT columns; arrays or scalars, int64 result."""
    h = np.uint64(seed)
    with np.errstate(over="ignore"):
        for c in columns:
            x = np.atleast_1d(np.asarray(c, dtype=np.int64)).view(np.uint64)
            h = h + _P5 + np.uint64(8)
            h = h ^ (_rotl(x * _P2, 31) * _P1)
            h = _rotl(h, 27) * _P1 + _P4
            h = h ^ (h >> np.uint64(33))
            h = h * _P2
            h = h ^ (h >> np.uint64(29))
            h = h * _P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)
