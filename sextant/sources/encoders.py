"""Encoders as plug-ins: prefixes, the cap on queries, and a factory over manifests. The hashing encoder needs no model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import transform_query
from sextant.operators.dense import dense_vectors, hashing_encoder
from sextant.operators.pipeline import by_length

#: Tokens that a query is cut at when nothing is said, and the name of the encoder without a model (fixed values).
SERVING_TOKENS, HASHING = 1024, "mock/hashing-encoder"
Embed = Callable[[DataFrame], DataFrame]


def query_cap(value: int | str | None) -> int | None:
    """The cap on a query's tokens: None is the serving default, 0 or less no cap."""
    return SERVING_TOKENS if value is None else int(value) if int(value) > 0 else None


@dataclass
class Encoder:
    """embed: (id, text) -> (id, embedding). Prefixes are put before texts; the cap holds for queries, never for documents."""

    model: str
    embed: Embed
    dim: int
    query_prefix: str = ""
    doc_prefix: str = ""
    max_query_tokens: int | None = SERVING_TOKENS

    def encode_queries(self, rows: DataFrame, id: str = "qid", text: str = "text") -> DataFrame:
        """(id, embedding) of queries: white-space tokens beyond the cap are cut off, then the prefix is put on."""
        whole = F.coalesce(F.col(text), F.lit(""))
        cut_off = whole if self.max_query_tokens is None else F.regexp_extract(whole, rf"^(?s:\s*(?:\S+\s*){{0,{self.max_query_tokens}}})", 0)
        return self._run(rows.select(F.col(id).alias("id"), F.concat(F.lit(self.query_prefix), cut_off).alias("text")), id)

    def encode_docs(self, rows: DataFrame, id: str = "row", text: str = "text") -> DataFrame:
        """(id, embedding) of documents, whole; longest first in each partition, so that batches hold like lengths."""
        return self._run(by_length(rows.select(F.col(id).alias("id"), F.concat(F.lit(self.doc_prefix), F.coalesce(F.col(text), F.lit(""))).alias("text"))), id)

    def _run(self, rows: DataFrame, id: str) -> DataFrame:
        return self.embed(rows).select(F.col("id").alias(id), "embedding")

    def manifest(self) -> dict:
        """What an index keeps of its encoder."""
        return {"model": self.model, "query_prefix": self.query_prefix, "doc_prefix": self.doc_prefix}


def hashing(dim: int = 64, **options) -> Encoder:
    """The encoder without a model."""
    return Encoder(HASHING, lambda rows: dense_vectors(hashing_encoder(rows, "id", "text", dim), "id", dim), dim, **options)


def make_encoder(manifest: dict, models: dict[str, Embed] | None = None, cap: int | None = None, transform: str = "full") -> Encoder:
    """The encoder that an index was built with.

    An index of the hashing encoder always gets it; other models must be among `models`. Variants that rewrite the query's
    text cannot be served, because documents were not encoded for them: ValueError.
    """
    if transform != "full":
        raise ValueError(f"variant {transform!r} rewrites the text; encode transform_query({transform_query.__name__}) offline instead")
    options = {"query_prefix": manifest.get("query_prefix", ""), "doc_prefix": manifest.get("doc_prefix", ""), "max_query_tokens": query_cap(cap)}
    model = manifest.get("model") or HASHING
    if model == HASHING:
        return hashing(manifest.get("dim", 64), **options)
    if model not in (models or {}):
        raise LookupError(f"no encoder registered for model {model!r}")
    return Encoder(model, models[model], manifest["dim"], **options)
