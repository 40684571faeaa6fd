"""Bring an index up to date with its source: plan, reuse vectors by content, write only what changed; and who may ask for it."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators.versions import occurrence_keys, reindex_plan
from sextant.runtime import cut
from sextant.sources.files import chunk_folder
from sextant.sources.git import tracked_history
from sextant.sources.index import load_index, read_manifest, write_index

#: Kinds of source that can be scanned again, and what the manifest must name for them.
SOURCES = {"folder": "source_root", "history": "repo"}
#: Columns that tags are kept in; after the rows changed they would be wrong.
TAGS = ("ast_family", "ast_reason", "cluster_label")


class ReindexError(Exception):
    """A refusal; `status` is that of the HTTP answer."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def reindexable(folder: str, protected: Iterable[str] = ()) -> dict:
    """reindexable, kind and reason of an index, from its manifest alone. Protected folders are never scanned again."""
    if os.path.realpath(folder) in {os.path.realpath(p) for p in protected}:
        return {"reindexable": False, "kind": None, "reason": "the official indexes are never scanned again"}
    try:
        manifest = read_manifest(folder)
    except (OSError, ValueError):
        return {"reindexable": False, "kind": None, "missing": True, "reason": "no readable manifest"}
    kind = next((k for k, named in SOURCES.items() if manifest.get("task") in (k, None) and manifest.get(named)), None)
    return {"reindexable": kind is not None, "kind": kind, "reason": "" if kind else "no folder or history to scan again"}


def allowed_names(named: Mapping[str, str], default: str | None, environ: Mapping[str, str]) -> set[str]:
    """Indexes that a request may name: the named ones, the server's default and those in ALLOWED_INDEXES."""
    listed = {x.strip() for x in environ.get("ALLOWED_INDEXES", "").split(",")}
    return (set(named) | {default or ""} | listed) - {""}


def check_name(name: object, named: Mapping[str, str], default: str | None, environ: Mapping[str, str]) -> str:
    """The name if it is one that may be asked for, else ReindexError."""
    if not isinstance(name, str) or not 0 < len(name) <= 512 or "\0" in name:
        raise ReindexError("invalid index name")
    if name not in allowed_names(named, default, environ):
        raise ReindexError(f"index {name!r} is not on the list of allowed indexes")
    return name


def _scan(spark: SparkSession, manifest: dict, kind: str) -> tuple[DataFrame, dict, tuple[str, ...]]:
    """Current rows of the source with their content hash, statistics, and the columns that the plan compares by."""
    if kind == "folder":
        chunks, stats = chunk_folder(spark, manifest["source_root"])
        return chunks.withColumn("doc_id", F.col("chunk_id")), stats, ("file", "kind", "qualname")
    rows = tracked_history(spark, manifest["repo"], manifest.get("most"), manifest.get("subdir"))
    return rows.withColumn("doc_id", F.concat_ws("@v", "lineage_id", "version")).withColumn("snippet_id", F.col("lineage_id")), {"repo": manifest["repo"]}, ("lineage_id", "version")


def reindex_index(spark: SparkSession, folder: str, encode: Callable[[DataFrame], DataFrame], dry_run: bool = False, protected: Iterable[str] = ()) -> dict:
    """Scan the source of an index again and bring the index up to date; returns a report.

    encode: (hash, text) -> DataFrame with hash and embedding; it gets only contents without a stored vector, each once, and
    is not called when there are none. A dry run plans only. Nothing is written if rows and texts are the same. Tags of the
    old rows are dropped. ReindexError if the index has no source that may be scanned.
    """
    start = time.time()
    info = reindexable(folder, protected)
    if not info["reindexable"]:
        raise ReindexError(f"{folder} cannot be reindexed: {info['reason']}", 404 if info.get("missing") else 400)
    old, manifest = load_index(spark, folder)
    scanned, stats, key = _scan(spark, manifest, info["kind"])
    hashed = cut(scanned.withColumn("hash", F.sha2("text", 256)))
    order = tuple(c for c in ("start_line", "end_line") if c in hashed.columns and c in old.columns) or ("doc_id",)
    keyed = lambda rows: occurrence_keys(rows.select("doc_id", *key, *[c for c in order if c != "doc_id"], "text"), key, order)
    plan = cut(reindex_plan(keyed(old), keyed(hashed), (*key, "n")))
    counts = {s: 0 for s in ("added", "modified", "unchanged", "removed")} | {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}
    places = lambda rows: rows.select("doc_id", F.sha2("text", 256).alias("hash"))
    same = counts["added"] == counts["removed"] == counts["modified"] == 0 and places(old).exceptAll(places(hashed)).isEmpty() and places(hashed).exceptAll(places(old)).isEmpty()
    held = old.select(F.sha2("text", 256).alias("hash"), "embedding").where("hash is not null").groupBy("hash").agg(F.first("embedding").alias("embedding"))
    work = cut(hashed.select("hash", "text").where("hash is not null").dropDuplicates(["hash"]).join(held.select("hash"), "hash", "left_anti"))
    total, fresh = hashed.count(), work.count()
    report = {"index": folder, "kind": info["kind"], "dry_run": dry_run, **counts, "n_docs_before": manifest["n_docs"], "n_docs_after": total, "embeddings_recomputed": fresh, "embeddings_reused": total - fresh, "written": False, "categories_dropped": False}
    if not dry_run and not same:
        vectors = held if not fresh else held.unionByName(encode(work).select("hash", "embedding"))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("hash"))
        numbered = hashed.join(cut(vectors), "hash").withColumn("row", F.xxhash64("doc_id", place))
        meta = {k: v for k, v in manifest.items() if k not in ("kind", "n_docs", "dim", "created", "columns", "files")}
        meta["last_reindex"] = {"at": time.strftime("%Y-%m-%d %H:%M:%S"), "added": counts["added"], "modified": counts["modified"], "removed": counts["removed"], "embeddings_recomputed": fresh}
        write_index(cut(numbered.drop("hash")), folder, manifest["dim"], **meta)
        report |= {"written": True, "categories_dropped": bool(set(TAGS) & set(old.columns))}
    return report | {"stats": stats, "elapsed_seconds": round(time.time() - start, 3)}
