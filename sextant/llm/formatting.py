"""Records that are identical but for formatting: white space, letter case, punctuation, order of fields.

Byte-identical values collapse first, with counts (combined on the map side, so a value that fills a third of the table
never reaches one task as rows). Only the distinct survivors are canonicalised, once each, and those are grouped again on
their full canonical text, held by its SHA-256. To name the members, a digest of the raw value leads each row back to its
record; records with very many copies travel by broadcast (there can be at most HOT_PARTS of them), the others by a
shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import canonical, cut

#: A record is hot when it holds more than this part of all rows; so at most so many are hot.
HOT_PARTS = 1000
#: Below so many copies no record is hot.
HOT_LEAST = 10_000
_LINE = r"^\s*[\p{L}\p{N}]+\s*:.*\S"


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _joined(pairs: Column) -> Column:
    """Canonical text of a set of (name, value) pairs; one pair alone reads like plain text."""
    one = F.transform(pairs, lambda p: F.concat(canonical(p["n"]), F.lit("\x1f"), canonical(p["v"])))
    text = F.array_join(F.sort_array(one), "\x1e")
    text = F.when(F.size(pairs) == 1, F.replace(text, F.lit("\x1f"), F.lit(""))).otherwise(text)
    return F.when(canonical(text) == "", F.lit("")).otherwise(text)


def canonical_text(text: Column) -> Column:
    """Letters and digits in order, letter case ignored; sets of fields (JSON objects of strings, or lines that all read
    `name: value`) as their sorted fields. Empty where there is no letter or digit; null for null."""
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    by_line = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*([\p{L}\p{N}]+)\s*:", 1).alias("n"), F.regexp_replace(x, r"^\s*[\p{L}\p{N}]+\s*:", "").alias("v")))
    parsed = F.try_parse_json(trimmed)
    members = F.from_json(trimmed, "map<string,string>")
    strings = F.schema_of_variant(parsed).rlike(r"^OBJECT<") & ~F.regexp_replace(F.schema_of_variant(parsed), r"`[^`]*`", "x").rlike(r"(: )(?!STRING)")
    by_name = F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("n"), e["value"].alias("v")))
    is_json = trimmed.rlike(r"^\{(?s:.*)\}$") & F.coalesce(strings, F.lit(False)) & members.isNotNull() & (F.size(members) > 0)
    is_lines = trimmed.rlike(r"^[\p{L}\p{N}]+\s*:") & F.forall(lines, lambda x: x.rlike(_LINE))
    return F.when(trimmed.startswith("{") & is_json, _joined(by_name)).when(is_lines, _joined(by_line)).otherwise(canonical(text))


def hot_join(big: DataFrame, small: DataFrame, key: str, copies: str, rows: int) -> DataFrame:
    """Inner join of big with small, unique in key; keys with so many copies that one task would choke are broadcast."""
    least = max(HOT_LEAST, rows // HOT_PARTS)
    hot = F.broadcast(small.where(F.col(copies) > least))  # at most HOT_PARTS rows of some 60 bytes: their copies sum to no more than all rows
    cold = small.where(F.col(copies) <= least)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cold, key))


def distinct_records(rows: DataFrame, id: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Survivors (one row per distinct raw value) and records (one row per canonical value).

    survivors: digest, record (digest of the canonical text), raw_copies. records: record, low (least id), copies,
    variants (distinct raw values). Nulls and values without letter or digit are left out of both.
    """
    slim = rows.select(F.col(id).alias("id"), F.col(value).alias("value")).where(F.col("value").rlike(r"[\p{L}\p{N}]"))
    raw = slim.groupBy("value").agg(F.count("*").alias("raw_copies"), F.min("id").alias("raw_low"))
    survivors = cut(raw.select(_digest(F.col("value")).alias("digest"), _digest(canonical_text(F.col("value"))).alias("record"), "raw_copies", "raw_low"))
    survivors = survivors.where(F.col("record") != _digest(F.lit("")))  # fields of escaped white space alone
    records = survivors.groupBy("record").agg(F.min("raw_low").alias("low"), F.sum("raw_copies").alias("copies"), F.count("*").alias("variants"))
    return survivors.drop("raw_low"), records


def formatting_duplicates(rows: DataFrame, id: str = "row", value: str = "text") -> DataFrame:
    """One row for each row that is a copy: (id, low, copies), low being the least id of its record.

    Rows whose record has no other row are not returned, nor nulls and values without letter or digit; the row with the
    least id of a record is returned with low = id. Ties cannot arise where ids are unique; of repeated ids one row each
    comes out. Empty tables give no rows. Columns other than id and value are ignored.
    """
    total = rows.count()
    survivors, records = distinct_records(rows, id, value)
    several = cut(records.where("copies > 1"))
    lead = hot_join(survivors, several, "record", "variants", total).select("digest", "raw_copies", "low", "copies")
    lead = cut(lead)
    digests = rows.where(F.col(value).isNotNull()).select(F.col(id).alias("id"), _digest(F.col(value)).alias("digest"))
    return hot_join(digests, lead, "digest", "raw_copies", total).select(F.col("id").alias(id), "low", "copies").distinct()
