"""Runtime indexes on disk: Parquet rows and a manifest that is written last and names every file's digest."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
OPTIONAL = {"versions": "lineage_id", "chunks": "chunk_id", "categories": "ast_family"}


def write_json_atomic(path: str, value: object) -> None:
    """Write JSON beside the target and move it there, so that a reader never sees half of it."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, sort_keys=True, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def index_kind(columns: list[str]) -> str:
    """`versioned` with lineages, else `code` with chunks, else `flat`."""
    return "versioned" if "lineage_id" in columns else "code" if "chunk_id" in columns else "flat"


def _digests(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Digest and size of each data file; one row per file comes to the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(os.path.join(folder, "rows"))
    rows = files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("sha256"), "length").collect()
    return {r["name"]: {"sha256": r["sha256"], "bytes": r["length"]} for r in rows}


def write_index(rows: DataFrame, folder: str, dim: int = 64, **meta) -> dict:
    """Write rows (row, doc_id, text, embedding and any sidecar columns) as an index and return its manifest.

    Row numbers must be unique and not null, non-null embeddings of length dim; else ValueError, and nothing is written.
    An index that is there is replaced; its manifest is removed first and the new one written last.
    """
    missing = {"row", "doc_id", "text", "embedding"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    spark = rows.sparkSession
    check = rows.agg(F.count("*").alias("n"), F.count_distinct("row").alias("rows"), F.sum((F.size("embedding") != dim).cast("long")).alias("bad")).first()
    if check["n"] != check["rows"]:
        raise ValueError("row numbers are null or repeated")
    if check["bad"]:
        raise ValueError(f"{check['bad']} embeddings are not of length {dim}")
    os.makedirs(folder, exist_ok=True)
    manifest = os.path.join(folder, MANIFEST)
    if os.path.exists(manifest):
        os.remove(manifest)
    rows.write.mode("overwrite").parquet(os.path.join(folder, "rows"))
    value = {"kind": index_kind(rows.columns), "n_docs": check["n"], "dim": dim, "created": time.strftime("%Y-%m-%dT%H:%M:%S"), "columns": rows.columns, "files": _digests(spark, folder)} | meta
    write_json_atomic(manifest, value)
    return value


def read_manifest(folder: str) -> dict:
    """The manifest; FileNotFoundError that says how to build the index if there is none."""
    path = os.path.join(folder, MANIFEST)
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is missing; build the index with `python -m sextant.cli build`")
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Rows and manifest of an index."""
    manifest = read_manifest(folder)
    return spark.read.parquet(os.path.join(folder, "rows")), manifest


def verify_index(spark: SparkSession, folder: str) -> list[str]:
    """What does not agree with the manifest: missing, changed or unlisted files; empty if all is well."""
    want, have = read_manifest(folder)["files"], _digests(spark, folder)
    problems = [f"missing: {n}" for n in sorted(set(want) - set(have))] + [f"not listed: {n}" for n in sorted(set(have) - set(want))]
    return problems + [f"changed: {n}" for n in sorted(set(want) & set(have)) if want[n]["sha256"] != have[n]["sha256"]]
