"""Folders of source files, JSON lines logs, a content-addressed cache of vectors, and synthetic data."""

from __future__ import annotations

import hashlib
import json
import os
import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.functions.text import mock_judge
from sextant.operators.code import CHUNK_CHARS, SKIP_DIRS, chunk_files, parse_failures
from sextant.runtime import cut, folder_exists, resolved


def read_sources(spark: SparkSession, root: str, pattern: str = "*.py", skip: Sequence[str] = tuple(SKIP_DIRS)) -> DataFrame:
    """(file, text) of every matching file under root, file relative to it; files inside skipped directories are left out."""
    if not folder_exists(spark, root):
        raise NotADirectoryError(root)
    base = resolved(spark, root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "file:/")
    named = raw.select(F.substring(path, len(base) + 1, 1_000_000).alias("file"), F.decode("content", "UTF-8").alias("text"))
    dirs = F.slice(F.split("file", "/"), 1, F.greatest(F.size(F.split("file", "/")) - 1, F.lit(0)))
    return named.where(~F.arrays_overlap(dirs, F.array(*[F.lit(s) for s in skip])))


def chunk_folder(spark: SparkSession, root: str, methods: bool = False) -> tuple[DataFrame, dict]:
    """Chunks of a folder and its statistics: files, failures (at most 20 named), chunks by kind, and how many were too large."""
    files = read_sources(spark, root)
    whole = cut(chunk_files(files, methods=methods, most=None))
    chunks = whole.where(F.length("text") <= CHUNK_CHARS)
    bad = parse_failures(files)
    kinds = {r["kind"]: r["count"] for r in chunks.groupBy("kind").count().collect()}  # four kinds
    stats = {"root": root, "files_scanned": files.count(), "files_failed": bad.count(), "failures": [r["file"] for r in bad.orderBy("file").limit(20).collect()], "chunks": sum(kinds.values()), "by_kind": kinds, "oversize": whole.count() - sum(kinds.values())}
    return chunks, stats


def append_jsonl(path: str, record: dict) -> None:
    """Append one record to a log."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a log; lines that are not whole (as the last may be) are dropped."""
    raw = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.get_json_object("value", "$").alias("whole"))
    return raw.where("whole is not null").select("r.*")


def still_to_do(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet, each key once."""
    return rows.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def latest_records(log: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return log.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def cached_vectors(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], folder: str, model: str, name: str, text: str = "text") -> DataFrame:
    """Vectors of rows from the cache, built on a miss. The key is model, name and a digest over all texts in row order."""
    spark = rows.sparkSession
    each = rows.agg(F.sha2(F.concat_ws("", F.bit_xor(F.xxhash64("row", text)).cast("string"), F.sum(F.xxhash64("row", text).cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")), 256).alias("h")).first()["h"]
    path = os.path.join(folder, hashlib.sha256("\0".join((model, name, each)).encode()).hexdigest()[:24])
    if not folder_exists(spark, os.path.join(path, "_SUCCESS")):
        encode(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class CacheMissError(LookupError):
    """Vectors that a cache-only read does not find."""


def cached_only(rows: DataFrame, folder: str, model: str, name: str = "docs", text: str = "text") -> DataFrame:
    """Vectors of rows from the cache; CacheMissError that says what to run if they are not there. Nothing is ever encoded."""

    def refuse(_: DataFrame) -> DataFrame:
        raise CacheMissError(f"no cached vectors of {name!r} for model {model!r}; build them with `python -m sextant.cli build` or cached_vectors(...)")

    return cached_vectors(rows, refuse, folder, model, name, text)


def load_test(read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], allow_test: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of the test split, which is reserved: PermissionError unless allowed.

    Judgements without gain, of unknown documents or of queries without text are dropped, and queries without judgement.
    """
    if not allow_test:
        raise PermissionError("the test split is reserved for the official run; use the train split, or pass allow_test=True")
    corpus, queries, qrels = read()
    asked = queries.where(F.trim("text") != "").dropDuplicates(["qid"])
    kept = qrels.where("gain > 0").join(corpus.select("doc_id").distinct(), "doc_id", "left_semi").join(asked, "qid", "left_semi").groupBy("qid", "doc_id").agg(F.max("gain").alias("gain"))
    return corpus, asked.join(kept, "qid", "left_semi"), kept


def reply_key(provider: str, model: str, prompt: Column, system: str | None = None) -> Column:
    """The cache key of a reply: SHA-256 of the JSON list of provider, model, prompt and system prompt."""
    return F.sha2(F.to_json(F.array(F.lit(provider), F.lit(model), prompt, F.lit(system).cast("string"))), 256)


def cached_replies(prompts: DataFrame, call: Callable[[DataFrame], DataFrame], folder: str, provider: str = "mock", model: str = "mock", system: str | None = None) -> DataFrame:
    """prompts (prompt, ...) with their reply. Only prompts without cached reply reach `call`, each once.

    call: (key, prompt) -> DataFrame with key and reply. New replies are appended to the folder; of repeated keys the
    first in order counts.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("key", reply_key(provider, model, F.col("prompt"), system))
    schema = "key string, reply string"
    if not folder_exists(spark, folder):
        spark.createDataFrame([], schema).write.parquet(folder)
    held = spark.read.schema(schema).parquet(folder)
    missing = cut(keyed.select("key", "prompt").where("prompt is not null").dropDuplicates(["key"]).join(held, "key", "left_anti"))
    if not missing.isEmpty():
        call(missing).select("key", "reply").write.mode("append").parquet(folder)
    known = spark.read.schema(schema).parquet(folder).groupBy("key").agg(F.min("reply").alias("reply"))
    return keyed.join(known, "key", "left").drop("key")


def mock_replies(missing: DataFrame) -> DataFrame:
    """Replies of a deterministic judge: a score for prompts that hold a problem and code, else a fixed word."""
    problem, code = F.regexp_extract("prompt", r"(?s)PROBLEM:\n(.*?)\nCODE:\n(.*)", 1), F.regexp_extract("prompt", r"(?s)PROBLEM:\n(.*?)\nCODE:\n(.*)", 2)
    judged = F.to_json(F.struct(mock_judge(problem, code).alias("score"), F.lit("mock").alias("reason")))
    return missing.withColumn("reply", F.when(F.col("prompt").rlike(r"(?s)PROBLEM:\n.*?\nCODE:\n"), judged).otherwise("mock response"))


def experiment_view(log: DataFrame) -> DataFrame:
    """The latest row of each experiment (preset, grp, exp, split, n), best NDCG first."""
    return latest_records(log, ["preset", "grp", "exp", "split", "n"], "at").orderBy(F.desc("ndcg_10"), "exp")


def choose_experiment(log: DataFrame) -> DataFrame:
    """The adopted experiment that is no reference: best NDCG, then least added time, then name."""
    return experiment_view(log).where("adopted and not reference").orderBy(F.desc("ndcg_10"), "added_ms", "exp").limit(1)


def hash_split(rows: DataFrame, key: str, holdout: float = 0.2, seed: int = 13) -> DataFrame:
    """Rows with part tune or holdout, by a seeded hash of the key: the same for equal keys, whatever else is there."""
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000))
    return rows.withColumn("part", F.when(at < int(holdout * 1_000_000), "holdout").otherwise("tune"))


MUTATIONS = ("rename", "logic", "add_lines", "remove_lines", "unchanged")


def version_fixture(spark: SparkSession, snippets: int = 50, versions: int = 4, seed: int = 0) -> DataFrame:
    """Small synthetic histories with known mutations: (snippet_id, version, mutation, text). For tests and demos."""
    rng, rows = random.Random(seed), []
    for s in range(snippets):
        name, body = f"task_{s}", [f"    total = {rng.randint(1, 99)}", "    for x in items:", "        total += x", "    return total"]
        for v in range(1, versions + 1):
            how = rng.choice(MUTATIONS) if v > 1 else "base"
            if how == "rename":
                name = f"task_{s}_v{v}"
            elif how == "logic":
                body = [line.replace("+=", "-=") if "+=" in line else line.replace("-=", "+=") for line in body]
            elif how == "add_lines":
                body = [body[0], f"    guard_{v} = len(items)", *body[1:]]
            elif how == "remove_lines" and len(body) > 4:
                body = [body[0], *body[2:]]
            elif how != "base":
                how = "unchanged"
            rows.append((f"s{s}", v, how, "\n".join([f"def {name}(items):", *body])))
    return spark.createDataFrame(rows, "snippet_id string, version int, mutation string, text string")
