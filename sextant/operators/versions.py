"""Version analytics over lineages: hashes, reuse, exact match, changes, as-of, history, compare, renames, reindexing."""

from __future__ import annotations

import difflib
import hashlib
import io
import re
import textwrap
import tokenize
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from sextant.runtime import busy, cut


# ---- canonical code ----
def without_comment(line: str) -> str:
    """The line up to a # that stands outside of string literals of this line."""
    m = re.match(r"""(?:[^'"#]|'(?:[^'\\]|\\.)*(?:'|\\?\Z)|"(?:[^"\\]|\\.)*(?:"|\\?\Z))*""", line, re.S)
    return m[0]


def hash_form(text: str) -> str:
    """Canonical code for hashing: comments, blank lines, trailing and repeated inner spaces removed, line by line."""
    text = text.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ")
    kept = (without_comment(line).rstrip() for line in text.split("\n"))
    return "\n".join(re.sub(r"(?<=\S) {2,}", " ", line) for line in kept if line.strip())


def match_form(text: str) -> str:
    """Canonical code for exact match: comments by the tokenizer, blank lines dropped, dedented unless strings span lines.

    Lines that a string spans stay as they are; what cannot be read only loses its last line ends.
    """
    text = re.sub("\r\n?", "\n", text)
    try:
        marks = [(t.type, *t.start, t.end[0]) for t in tokenize.generate_tokens(io.StringIO(text).readline)]
    except (tokenize.TokenError, SyntaxError):
        return text.rstrip("\n")
    remark = {row: column for kind, row, column, _ in marks if kind == tokenize.COMMENT}
    held = {n for kind, row, _, last in marks if kind == tokenize.STRING for n in range(row, last + 1) if last > row}
    shaped = ((n in held, line[: remark.get(n)]) for n, line in enumerate(text.splitlines(), 1))
    body = "\n".join(line if fixed else line.rstrip() for fixed, line in shaped if fixed or line.strip())
    return body if held else textwrap.dedent(body)


def _digests(form):
    @F.pandas_udf(StringType())
    def digest(texts: pd.Series) -> pd.Series:
        forms = [None if t is None else form(t) for t in texts]
        return pd.Series([hashlib.sha256(f.encode("utf-8", "surrogatepass")).hexdigest() if f or (f is not None and form is hash_form) else None for f in forms], dtype=object)

    return digest


content_hash = _digests(hash_form)
match_hash = _digests(match_form)


def with_content_hash(rows: DataFrame, text: str = "text", name: str = "code_hash") -> DataFrame:
    """Rows with the SHA-256 of their canonical code; null for null texts."""
    return rows.withColumn(name, content_hash(F.col(text)))


def exact_matches(queries: DataFrame, docs: DataFrame, qid: str = "qid", id: str = "row", text: str = "text") -> DataFrame:
    """(qid, id, score 1.0) of documents equal to a query as code; texts with nothing left match nothing."""
    asked = queries.select(F.col(qid).alias("qid"), match_hash(F.col(text)).alias("digest")).where("digest is not null")
    held = docs.select(F.col(id), match_hash(F.col(text)).alias("digest")).where("digest is not null")
    return asked.join(held, "digest").select("qid", id, F.lit(1.0).alias("score"))


def distinct_work(rows: DataFrame, hash: str = "content_hash", text: str = "text", row: str = "row") -> DataFrame:
    """(hash, text, row, uses): the first row of each hash; what an encoder has to work on once. Null hashes are left out."""
    return rows.where(F.col(hash).isNotNull()).groupBy(hash).agg(F.min_by(F.struct(F.col(text)), row).alias("x"), F.min(row).alias(row), F.count("*").alias("uses")).select(hash, f"x.{text}", row, "uses")


def encode_distinct(rows: DataFrame, encode, done: DataFrame | None = None, hash: str = "content_hash", **options) -> DataFrame:
    """Rows with the vector of their hash: only hashes that are not in `done` (hash, embedding) reach `encode`.

    encode is a DataFrame -> DataFrame function of (hash, text) that adds embedding.
    """
    work = distinct_work(rows, hash, **options).select(hash, "text")
    new = encode(work if done is None else work.join(done.select(hash), hash, "left_anti")).select(hash, "embedding")
    return rows.join(new if done is None else done.select(hash, "embedding").unionByName(new), hash, "left")


def reuse_stats(rows: DataFrame, hash: str = "content_hash", version: str = "version", by: Sequence[str] = ()) -> DataFrame:
    """by, version, rows, hashes (a full rebuild encodes them), fresh (first seen at this version), reused_pct."""
    by = list(by)
    known = rows.where(F.col(hash).isNotNull())
    distinct = known.groupBy(*by, version, hash).agg(F.count("*").alias("n"))
    first = distinct.withColumn("first", F.min(version).over(Window.partitionBy(*by, hash)))
    out = first.groupBy(*by, version).agg(F.sum("n").alias("rows"), F.count("*").alias("hashes"), F.sum((F.col("first") == F.col(version)).cast("long")).alias("fresh"))
    return out.withColumn("reused_pct", F.round(100.0 * (F.col("hashes") - F.col("fresh")) / F.col("hashes"), 4))


def duplication(ranked: DataFrame, lineage: str, k: int = 10) -> DataFrame:
    """(qid, slots, lineages, duplicate_pct) of the first k hits."""
    per = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.count("*").alias("slots"), F.count_distinct(lineage).alias("lineages"))
    return per.withColumn("duplicate_pct", F.round(100.0 * (F.col("slots") - F.col("lineages")) / F.col("slots"), 4))


# ---- lineages over versions ----
def change_labels(rows: DataFrame, by: Sequence[str], lineage: str = "lineage_id", version: str = "version", hash: str = "content_hash", row: str = "row") -> DataFrame:
    """One row per (by, lineage, version) with its change: added, modified or unchanged against the snapshot one version before.

    A lineage that was missing one version before is added again. Of repeated rows the one of greatest `row` counts.
    """
    by = list(by)
    one = rows.where(F.col(lineage).isNotNull() & F.col(version).isNotNull()).groupBy(*by, lineage, version).agg(F.max_by(F.struct(F.col(hash).alias("h")), row).alias("x")).select(*by, lineage, version, F.col("x.h").alias(hash))
    w = Window.partitionBy(*by, lineage).orderBy(version)
    near = F.lag(version).over(w) == F.col(version) - 1
    label = F.when(F.coalesce(near, F.lit(False)), F.when(F.lag(hash).over(w).eqNullSafe(F.col(hash)), "unchanged").otherwise("modified")).otherwise("added")
    return one.withColumn("change", label)


def change_totals(rows: DataFrame, by: Sequence[str], lineage: str = "lineage_id", version: str = "version", **options) -> DataFrame:
    """(by, version, lineages, added, modified, unchanged, removed) of every delivered snapshot.

    Labels are those of change_labels; removed are lineages of the snapshot delivered before that are not in this one.
    """
    by = list(by)
    labels = change_labels(rows, by, lineage, version, **options)
    count = lambda k: F.sum((F.col("change") == k).cast("long")).alias(k)
    counts = labels.groupBy(*by, version).agg(F.count("*").alias("lineages"), count("added"), count("modified"), count("unchanged"))
    after = counts.select(*by, version, F.lead(version).over(Window.partitionBy(*by).orderBy(version)).alias("_after")).where("_after is not null")
    comes = labels.withColumn("_comes", F.lead(version).over(Window.partitionBy(*by, lineage).orderBy(version))).select(*by, version, "_comes")
    gone = comes.join(after, [*by, version]).where(F.col("_comes").isNull() | (F.col("_comes") != F.col("_after"))).groupBy(*by, F.col("_after").alias(version)).agg(F.count("*").alias("removed"))
    return counts.join(gone, [*by, version], "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))


def rows_for(nested: DataFrame, versions: Sequence[int] | None = None, snippet: str = "snippet_id", inner: str = "versions") -> DataFrame:
    """Rows of nested histories (snippet, versions: array of structs with version, text and more), of the wanted versions only.

    Adds doc_id `snippet@vN`. A null or empty list gives no rows.
    """
    flat = nested.select(F.col(snippet), F.explode(inner).alias("_v")).select(snippet, "_v.*")
    kept = flat if versions is None else flat.where(F.col("version").isin([int(v) for v in versions]))
    return kept.withColumn("doc_id", F.concat(F.col(snippet), F.lit("@v"), F.col("version")))


def as_of(rows: DataFrame, version: int, key: Sequence[str], column: str = "version", row: str = "row") -> DataFrame:
    """The rows in force at a version: of each key the row with the greatest version not above it, ties by row."""
    w = Window.partitionBy(*key).orderBy(F.desc(column), F.desc(row))
    return rows.where(F.col(column) <= version).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def history(rows: DataFrame, snippet: str, id: str = "snippet_id", version: str = "version") -> DataFrame:
    """All versions of a snippet, oldest first; an unknown snippet raises KeyError."""
    out = rows.where(F.col(id) == snippet).orderBy(version)
    if out.isEmpty():
        raise KeyError(snippet)
    return out


def compare_rankings(a: DataFrame, b: DataFrame, lineage: str = "lineage_id", hash: str = "content_hash") -> DataFrame:
    """Hits of two versions side by side: appeared, disappeared, moved or same, rank_change = rank_a - rank_b, content_changed.

    a, b: (qid, rank, lineage, hash), one row a lineage.
    """
    left = a.select("qid", lineage, F.col("rank").alias("rank_a"), F.col(hash).alias("hash_a"))
    right = b.select("qid", lineage, F.col("rank").alias("rank_b"), F.col(hash).alias("hash_b"))
    status = F.when(F.col("rank_a").isNull(), "appeared").when(F.col("rank_b").isNull(), "disappeared").when(F.col("rank_a") == F.col("rank_b"), "same").otherwise("moved")
    both = F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()
    return left.join(right, ["qid", lineage], "full").select("qid", lineage, "rank_a", "rank_b", status.alias("status"), (F.col("rank_a") - F.col("rank_b")).alias("rank_change"), F.when(both, ~F.col("hash_a").eqNullSafe(F.col("hash_b"))).alias("content_changed"))


@F.pandas_udf(StructType([StructField("diff", StringType()), StructField("identical", BooleanType()), StructField("added", IntegerType()), StructField("removed", IntegerType())]))
def _diff(a: pd.Series, b: pd.Series, context: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, n in zip(a, b, context):
        lines = list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "a", "b", lineterm="", n=int(n)))
        body = lines[2:]
        out.append(("\n".join(lines), (x or "") == (y or ""), sum(s.startswith("+") for s in body), sum(s.startswith("-") for s in body)))
    return pd.DataFrame(out, columns=["diff", "identical", "added", "removed"])


def diffs(pairs: DataFrame, a: str = "text_a", b: str = "text_b", context: int = 3) -> DataFrame:
    """Pairs with diff (unified), identical, added and removed lines. Nulls count as empty texts."""
    return pairs.withColumn("d", _diff(F.col(a), F.col(b), F.lit(context))).select(*pairs.columns, "d.*")


def group_lineages(ranked: DataFrame, lineage: str) -> DataFrame:
    """Hits with group_rank: the order in which their lineage first appears."""
    first = F.min("rank").over(Window.partitionBy("qid", lineage))
    return ranked.withColumn("first", first).withColumn("group_rank", F.dense_rank().over(Window.partitionBy("qid").orderBy("first"))).drop("first")


# ---- renames ----
_LAYOUT = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}


def body_tokens(text: str, own: str | None) -> list[str]:
    """Tokens without layout and comments, the function's own name as <self>; of what cannot be read those before the fault."""
    found: list[str] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type not in _LAYOUT:
                found.append("<self>" if t.type == tokenize.NAME and t.string == own else t.string)
    except (tokenize.TokenError, SyntaxError):
        pass
    return found


def multiset_jaccard(a: Counter, b: Counter) -> float:
    """Sum of least counts over sum of greatest; 0 for two empty ones."""
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 0.0


def rename_links(changes: DataFrame, by: Sequence[str], threshold: float = 0.8, least: int = 8) -> DataFrame:
    """One-to-one links of removed to added functions of the same kind with multiset Jaccard of at least `threshold`.

    changes: by, side (`removed` or `added`), id, kind, name, text; ids are unique within by and side. Best pairs first,
    ties by ids. Pairs meet where they share a token that the threshold calls for: Jaccard of at least t leaves at most
    n - ceil(t * n) of the n tokens of either side out, so that one more of its rarest tokens (of the same by and kind;
    repeated tokens are numbered) must be among the rarest of the other side as well.
    """
    by = list(by)
    floor = threshold - 1e-6  # similarity is rounded

    @F.pandas_udf("array<string>")
    def tokens(text: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else body_tokens(t, n) for t, n in zip(text, name)], dtype=object)

    @F.pandas_udf("array<string>")
    def numbered(toks: pd.Series) -> pd.Series:
        out = []
        for found in toks:
            seen: Counter = Counter()
            for t in found:
                seen[t] += 1
            out.append([f"{i} {t}" for t, n in seen.items() for i in range(n)])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([multiset_jaccard(Counter(x), Counter(y)) for x, y in zip(a, b)])

    slim = changes.where(F.col("text").isNotNull()).select(*by, "side", "id", "kind", "name", "text")
    sized = cut(busy(slim).withColumn("tok", tokens("text", "name")).where(F.size("tok") >= least).select(*by, "side", "id", "kind", "tok"))
    n = F.size("tok")
    spread = sized.select(*by, "side", "id", "kind", n.alias("n"), F.explode(numbered("tok")).alias("t"))
    rare = F.row_number().over(Window.partitionBy(*by, "side", "id").orderBy("df", "t"))
    needed = F.greatest(F.lit(1), F.ceil(F.lit(floor) * F.col("n")))
    head = spread.withColumn("df", F.count("*").over(Window.partitionBy(*by, "kind", "t"))).withColumn("place", rare).where(F.col("place") <= F.col("n") - needed + 1)
    old = head.where("side = 'removed'").select(*by, "kind", "t", F.col("id").alias("old"), F.col("n").alias("n_old"))
    new = head.where("side = 'added'").select(*by, "kind", "t", F.col("id").alias("new"), F.col("n").alias("n_new"))
    near = F.least("n_old", "n_new") >= F.lit(floor) * F.greatest("n_old", "n_new")
    met = old.join(new, [*by, "kind", "t"]).where(near).select(*by, "old", "new").distinct()
    text = lambda side, id, name: sized.where(F.col("side") == side).select(*by, F.col("id").alias(id), F.col("tok").alias(name))
    both = met.join(text("removed", "old", "a"), [*by, "old"]).join(text("added", "new", "b"), [*by, "new"])
    pairs = both.withColumn("similarity", F.round(alike("a", "b"), 6)).where(F.col("similarity") >= threshold).select(*by, "old", "new", "similarity")

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        used_old, used_new, keep = set(), set(), []
        for r in group.sort_values(["similarity", "old", "new"], ascending=[False, True, True]).itertuples():
            free = r.old not in used_old and r.new not in used_new
            keep.append(free)
            if free:
                used_old.add(r.old)
                used_new.add(r.new)
        return group.sort_values(["similarity", "old", "new"], ascending=[False, True, True])[keep]

    return pairs.groupBy(*by).applyInPandas(greedy, pairs.schema)


def file_rename_links(changes: DataFrame, renames: DataFrame, by: Sequence[str]) -> DataFrame:
    """Links (by, old, new, similarity) of removed functions of a renamed file to the added ones of the same qualname in the new file.

    changes: by, side, id, file, qualname, name, text; renames: by, old, new (paths). Bodies may differ by any amount.
    """
    by = list(by)

    @F.pandas_udf("double")
    def alike(a: pd.Series, a_name: pd.Series, b: pd.Series, b_name: pd.Series) -> pd.Series:
        count = lambda text, name: Counter(body_tokens(text or "", name))
        return pd.Series([multiset_jaccard(count(x, m), count(y, n)) for x, m, y, n in zip(a, a_name, b, b_name)])

    paths = renames.select(*by, F.col("old").alias("file"), F.col("new").alias("path"))
    old = changes.where("side = 'removed'").select(*by, "file", "qualname", F.col("id").alias("old"), F.col("text").alias("a"), F.col("name").alias("a_name")).join(paths, [*by, "file"]).drop("file")
    new = changes.where("side = 'added'").select(*by, F.col("file").alias("path"), "qualname", F.col("id").alias("new"), F.col("text").alias("b"), F.col("name").alias("b_name"))
    return old.join(new, [*by, "path", "qualname"]).select(*by, "old", "new", F.round(alike("a", "a_name", "b", "b_name"), 6).alias("similarity"))


def tracked_links(changes: DataFrame, renames: DataFrame, by: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Links with scope and kind: `file` by file renames first, `function` by alike bodies among what is left.

    A link is a `rename` if the function stays in its file (or in what its file was renamed to), else a `move`.
    """
    by = list(by)
    moved = cut(file_rename_links(changes, renames, by))
    left = lambda side, end: changes.where(F.col("side") == side).join(moved.select(*by, F.col(end).alias("id")), [*by, "id"], "left_anti")
    alike = rename_links(left("removed", "old").unionByName(left("added", "new")), by, threshold)
    file = lambda side, end: changes.where(F.col("side") == side).select(*by, F.col("id").alias(end), F.col("file").alias(f"{end}_file"))
    paths = renames.select(*by, F.col("old").alias("old_file"), F.col("new").alias("renamed"))
    placed = alike.join(file("removed", "old"), [*by, "old"]).join(file("added", "new"), [*by, "new"]).join(paths, [*by, "old_file"], "left")
    stays = F.coalesce("renamed", "old_file") == F.col("new_file")
    within = placed.select(*alike.columns, F.lit("function").alias("scope"), F.when(stays, "rename").otherwise("move").alias("kind"))
    return moved.withColumn("scope", F.lit("file")).withColumn("kind", F.lit("rename")).unionByName(within)


def canonical_lineages(rows: DataFrame, links: DataFrame, by: Sequence[str], key: str = "key", version: str = "version") -> DataFrame:
    """Rows (by, key, version, ...) with lineage_id, the key that a function was first given, carried over its links.

    links: (by, version, old, new): at that version the function of key old goes on as new. A key keeps its lineage while it
    is there at every version of `by`; a key that comes back without a link starts a lineage of its own key again. Chains
    of links are followed by pointer doubling, in a number of rounds that grows with the logarithm of their length.
    """
    by = list(by)
    known = rows.select(*by, version).distinct().withColumn("_before", F.lag(version).over(Window.partitionBy(*by).orderBy(version)))
    placed = rows.select(*by, key, version).distinct().join(known, [*by, version])
    last = F.lag(version).over(Window.partitionBy(*by, key).orderBy(version))
    starts = placed.withColumn("_new", (last.isNull() | ~last.eqNullSafe(F.col("_before"))).cast("int"))
    runs = cut(starts.withColumn("_run", F.sum("_new").over(Window.partitionBy(*by, key).orderBy(version))))
    node = F.struct(F.col(key), F.col("_run"))
    heads = runs.where("_new = 1").select(*by, version, "_before", key, node.alias("node"))
    ends = runs.select(*by, F.col(version).alias("_before"), F.col(key).alias("old"), node.alias("parent"))
    linked = heads.join(links.select(*by, version, "old", F.col("new").alias(key)).dropDuplicates([*by, version, key]), [*by, version, key]).join(ends, [*by, "_before", "old"]).select(*by, "node", "parent")
    up = cut(heads.select(*by, "node").join(linked, [*by, "node"], "left").withColumn("parent", F.coalesce("parent", "node")))
    while True:
        above = up.select(*by, F.col("node").alias("parent"), F.col("parent").alias("_next"))
        further = cut(up.join(above, [*by, "parent"]).select(*by, "node", F.col("_next").alias("parent"), (F.col("_next") != F.col("parent")).alias("moved")))
        done = further.where("moved").isEmpty()
        up = further.drop("moved")
        if done:
            break
    named = runs.select(*by, key, version, node.alias("node")).join(up, [*by, "node"]).select(*by, key, version, F.col(f"parent.{key}").alias("lineage_id"))
    return rows.join(named, [*by, key, version])


# ---- reindexing ----
def occurrence_keys(chunks: DataFrame, key: Sequence[str] = ("file", "kind", "qualname"), order: Sequence[str] = ("start_line", "end_line")) -> DataFrame:
    """Chunks with n (0-based occurrence of their key) and text_hash (of the exact text)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return chunks.withColumn("n", F.row_number().over(w) - 1).withColumn("text_hash", F.sha2("text", 256))


def reindex_plan(old: DataFrame, new: DataFrame, key: Sequence[str] = ("file", "kind", "qualname", "n"), hash: str = "text_hash") -> DataFrame:
    """key, status: added, removed, modified or unchanged, by a full join on the key; null keys are values like others."""
    o, n = old.select(*key, F.col(hash).alias("h"), F.lit(True).alias("there")).alias("o"), new.select(*key, F.col(hash).alias("h"), F.lit(True).alias("there")).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    status = F.when(F.col("o.there").isNull(), "added").when(F.col("n.there").isNull(), "removed").when(F.col("o.h").eqNullSafe(F.col("n.h")), "unchanged").otherwise("modified")
    return o.join(n, cond, "full").select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key], status.alias("status"))


def first_docstring_line(text: str, least: int = 12) -> str | None:
    """First line of the first function's docstring, unless it is short or a to-do note."""
    import ast

    try:
        tree = ast.parse(textwrap.dedent(text))
    except (SyntaxError, ValueError):
        return None
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            line = ((ast.get_docstring(node) or "").strip().splitlines() or [""])[0].strip()
            return line if len(line) >= least and not line.upper().startswith("TODO") else None
    return None


def _docstring_lines(texts: pd.Series) -> pd.Series:
    return texts.map(first_docstring_line, na_action="ignore")


def version_queries(rows: DataFrame, by: Sequence[str], most: int = 1, least: int = 4, lineage: str = "lineage_id", version: str = "version", text: str = "text", row: str = "row", documented: bool = False) -> DataFrame:
    """Labelled queries about changed versions: the longest identifier that a version introduced, first of the alphabet on ties.

    Returns by, lineage, version, token, query (readable phrase with the token) and acceptable (versions whose text holds it).
    At most `most` versions of a lineage, the earliest. With `documented` the first line of the docstring, where there is a
    telling one, takes the place of the phrase.
    """
    from sextant.functions.text import readable_phrase

    by = list(by)
    one = rows.where(F.col(lineage).isNotNull() & F.col(text).isNotNull()).groupBy(*by, lineage, version).agg(F.max_by(F.struct(text, "qualname", "file"), row).alias("x")).select(*by, lineage, version, "x.*")
    names = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))
    w = Window.partitionBy(*by, lineage).orderBy(version)
    fresh = F.filter(F.array_except(names, F.lag(names).over(w)), lambda t: F.length(t) >= least)
    new = one.withColumn("fresh", fresh).where(F.size("fresh") > 0)
    token = F.element_at(F.sort_array(F.transform("fresh", lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), 1)["t"]
    picked = new.withColumn("token", token).withColumn("i", F.row_number().over(w)).where(F.col("i") <= most)
    held = one.select(*by, lineage, F.col(version).alias("v"), F.col(text).alias("t"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*by, lineage)]
    found = picked.alias("p").join(held.alias("h"), same).where(F.col("h.t").contains(F.col("p.token")))
    phrase = readable_phrase(F.col("p.qualname"), F.col("p.file"))
    if documented:
        line = F.pandas_udf(_docstring_lines, StringType())
        phrase = F.coalesce(line(F.col("p." + text)), phrase)
    return found.withColumn("_query", F.concat(phrase, F.lit(" "), F.col("p.token"))).groupBy(*[F.col(f"p.{c}").alias(c) for c in (*by, lineage, version)], F.col("p.token").alias("token"), F.col("_query").alias("query")).agg(F.sort_array(F.collect_set("h.v")).alias("acceptable"))
