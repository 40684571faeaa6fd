"""The search service: one call from a query to annotated hits, with exact match, filters, collapsing and compare."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators import versions as V
from sextant.operators.dense import dot, unit, usable
from sextant.operators.ranking import gaps_to_next
from sextant.sources.index import load_index

Provider = Callable[[DataFrame], DataFrame]


class QueryCache:
    """Least recently used vectors of queries on the driver; size 0 turns it off."""

    def __init__(self, size: int = 128):
        self.size, self.held, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, key: tuple, make: Callable[[], np.ndarray]) -> np.ndarray:
        if key in self.held:
            self.held.move_to_end(key)
            self.hits += 1
            return self.held[key].copy()
        self.misses += 1
        vector = np.array(make(), dtype=float)
        vector.setflags(write=False)
        if self.size:
            self.held[key] = vector
            while len(self.held) > self.size:
                self.held.popitem(last=False)
        return vector.copy()


def hashing_query(text: str, dim: int = 64) -> np.ndarray:
    """The hashing encoder's vector of one query, on the driver."""
    import re

    v = np.zeros(dim)
    for token in [t for t in re.split(r"[^\w]|_", text.lower()) if t] or ["__empty__"]:
        h = hashlib.sha256(token.encode()).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] % 2 else -1
    return v / max(np.linalg.norm(v), 1e-12)


class SearchService:
    """Queries over one index (row, doc_id, text, embedding and optional lineage, version, category columns)."""

    def __init__(self, rows: DataFrame, encode: Callable[[str], np.ndarray] | None = None, dim: int = 64, cache: int = 128, manifest: dict | None = None, cap: int | None = None):
        self.rows, self.dim, self.manifest, self.cap = rows, dim, manifest or {}, cap
        self.encode = encode or (lambda text: hashing_query(text, dim))
        self.cache, self.providers = QueryCache(cache), []
        self.versioned = "lineage_id" in rows.columns

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options) -> SearchService:
        rows, manifest = load_index(spark, folder)
        return cls(rows, dim=manifest["dim"], manifest=manifest, **options)

    def register(self, provider: Provider) -> None:
        """Add a function hits -> hits that joins more columns on `row`."""
        self.providers.append(provider)

    def _filtered(self, version: int | None, category: str | None) -> DataFrame:
        rows = self.rows
        if version is not None:
            if not self.versioned:
                raise ValueError("the index has no versions")
            rows = rows.where(F.col("version") == version)
            if rows.isEmpty():
                raise ValueError(f"no rows at version {version}")
        if category is not None:
            want = category.lower()
            tests = [F.lower("ast_family") == want] if "ast_family" in rows.columns else []
            tests += [F.lower("cluster_label").contains(want)] if "cluster_label" in rows.columns else []
            if not tests:
                raise ValueError("the index has no categories")
            rows = rows.where(tests[0] if len(tests) == 1 else tests[0] | tests[1])
        return rows

    def search(self, query: str, k: int = 10, version: int | None = None, all_versions: bool = False, preview: int = 240, factor: int | None = None, category: str | None = None, exact: bool = True) -> DataFrame:
        """(rank, row, doc_id, score, preview, truncated, gap, ...) of the k best rows.

        Documents equal to the query as code come alone, with score 1. On a versioned index the best row of each lineage
        counts, unless a version is given or all_versions. `factor` limits the rows that are collapsed to
        max(factor k, k + 20); without it collapsing is exact. Filters apply before ranking.
        """
        rows = self._filtered(version, category)
        spark = rows.sparkSession
        out = ["row", "doc_id", "text", *(c for c in ("lineage_id", "version") if c in rows.columns)]
        if exact:
            asked = spark.createDataFrame([("q", query)], "qid string, text string")
            same = V.exact_matches(asked, rows.select("row", "text")).select("row", "score")
            hits = rows.select(*out).join(same, "row")
            if not hits.isEmpty():
                return self._present(hits, k, preview)
        key = (self.manifest.get("model"), self.manifest.get("query_prefix", ""), self.cap, self.dim, query)
        vector = self.cache.get(key, lambda: self.encode(self.manifest.get("query_prefix", "") + self._capped(query)))
        q = unit(F.array(*[F.lit(float(x)) for x in vector]))
        scored = rows.where(usable(F.col("embedding"), self.dim)).select(*out, F.round(dot(unit(F.col("embedding")), q), 6).alias("score"))
        if self.versioned and version is None and not all_versions:
            if factor:
                scored = scored.orderBy(F.desc("score"), "row").limit(max(factor * k, k + 20))
            best = Window.partitionBy("lineage_id").orderBy(F.desc("score"), "row")
            scored = scored.withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i")
        return self._present(scored, k, preview)

    def _present(self, hits: DataFrame, k: int, preview: int) -> DataFrame:
        top = hits.orderBy(F.desc("score"), "row").limit(max(k, 0))
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "row")))  # k rows
        shown = gaps_to_next(ranked.withColumn("qid", F.lit(0))).drop("qid").withColumn("preview", F.substring("text", 1, preview)).withColumn("truncated", F.length("text") > preview).drop("text")
        for provider in self.providers:
            shown = provider(shown)
        return shown.orderBy("rank")

    def get_doc(self, doc_id: str) -> dict:
        """The last row of a document id, with n_lines and first_line; KeyError if there is none."""
        row = self.rows.where(F.col("doc_id") == doc_id).orderBy(F.desc("row")).limit(1).drop("embedding").collect()
        if not row:
            raise KeyError(doc_id)
        lines = (row[0]["text"] or "").splitlines()
        return row[0].asDict() | {"n_lines": len(lines), "first_line": lines[0] if lines else "", "has_source_file": bool(row[0].asDict().get("file"))}

    def compare(self, query: str, a: int, b: int, k: int = 10) -> DataFrame:
        """The hits of a query at two versions side by side; the query is encoded once."""
        side = lambda v: self.search(query, k, version=v, exact=False).join(self.rows.select("row", "content_hash"), "row").withColumn("qid", F.lit("q"))
        return V.compare_rankings(side(a), side(b)).drop("qid")

    def diff(self, snippet: str, a: int, b: int, context: int = 3) -> dict:
        """Unified diff of a snippet between two versions; KeyError if either is missing."""
        found = {r["version"]: r for r in self.rows.where((F.col("lineage_id") == snippet) & F.col("version").isin(a, b)).select("version", "text", "content_hash").collect()}
        if {a, b} - set(found):
            raise KeyError(snippet)
        pair = self.rows.sparkSession.createDataFrame([(found[a]["text"], found[b]["text"])], "text_a string, text_b string")
        return V.diffs(pair, context=context).first().asDict() | {"same_content_hash": found[a]["content_hash"] == found[b]["content_hash"]}

    def history(self, snippet: str) -> DataFrame:
        """All versions of a lineage, oldest first."""
        return V.history(self.rows, snippet, "lineage_id")

    def categories(self) -> DataFrame:
        """Rows per family, most first, ties by name."""
        return self.rows.groupBy("ast_family").count().orderBy(F.desc("count"), "ast_family")

    def _capped(self, query: str) -> str:
        return query if not self.cap else " ".join(query.split()[: self.cap])

    def describe(self) -> dict:
        """What is served: facts of the manifest, what the rows have, and the state of the cache."""
        m, has = self.manifest, set(self.rows.columns)
        versions = [r["version"] for r in self.rows.select("version").distinct().orderBy("version").collect()] if "version" in has else []  # snapshots, few
        return {k: m.get(k) for k in ("kind", "n_docs", "dim", "model", "query_prefix", "source_root")} | {"versioned": self.versioned, "chunked": "chunk_id" in has, "categorized": "ast_family" in has, "versions": versions, "max_query_tokens": self.cap, "query_cache": {"size": self.cache.size, "held": len(self.cache.held), "hits": self.cache.hits, "misses": self.cache.misses}}

    def performance(self, query: str) -> dict:
        """What a query costs: its tokens (parted by white space), the cap, and whether the encoder sees all of it."""
        tokens = len(query.split())
        return {"query_tokens": tokens, "query_cap": self.cap, "truncated": bool(self.cap and tokens > self.cap), "model": self.manifest.get("model"), "index_docs": self.manifest.get("n_docs"), "index_dim": self.dim, "index_bytes": sum(f["bytes"] for f in self.manifest.get("files", {}).values())}
