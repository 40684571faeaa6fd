"""Whole retrieval runs from a closed configuration, and the smaller operators around them."""

from __future__ import annotations

import re
from collections.abc import Callable
from copy import deepcopy

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.operators import ranking
from sextant.runtime import busy

# ---- fixed values: defaults of the pipeline ----
DEFAULTS = {
    "bm25": {"enabled": False, "k1": 1.5, "b": 0.75},
    "rrf": {"k": 60, "w_dense": 1.0, "w_bm25": 1.0, "depth": 100},
    "rerank": {"enabled": False, "k": 20, "alpha": 0.0},
    "rejudge": {"enabled": False, "top": 3, "margin": 0.5, "beta": 0.5},
    "final_depth": 1000,
}
# ---- end of fixed values ----


def merge_config(user: dict | None = None) -> dict:
    """Defaults with the user's values; unknown names raise ValueError."""

    def merge(base: dict, more: dict, path: str) -> dict:
        unknown = set(more) - set(base)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(path + u for u in unknown)}")
        return {k: merge(v, more[k], f"{path}{k}.") if isinstance(v, dict) and k in more else more.get(k, deepcopy(v)) for k, v in base.items()}

    return merge(DEFAULTS, user or {}, "")


def run_stages(dense: DataFrame, config: dict | None = None, lexical: DataFrame | None = None, second: Callable[[DataFrame], DataFrame] | None = None, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, rank, row): first stage, rerank, re-judge and padding, as configured.

    dense, lexical: ranked (qid, rank, row, score); second and judge are functions of ranked candidates that return
    (qid, row, second) and (qid, row, judge). A stage without its input is left out.
    """
    c = merge_config(config)
    r, depth = c["rrf"], max(c["rrf"]["depth"], c["rerank"]["k"])
    head = lambda x, n: x.where(F.col("rank") <= n)
    if c["bm25"]["enabled"] and lexical is not None:
        out = ranking.rrf([head(dense, r["depth"]), head(lexical, r["depth"])], [r["w_dense"], r["w_bm25"]], r["k"])
    else:
        out = head(dense, depth).select("qid", "rank", "row", "score")
    if c["rerank"]["enabled"] and second is not None:
        out = ranking.rerank(out, second(head(out, c["rerank"]["k"])), c["rerank"]["k"], c["rerank"]["alpha"])
    if c["rejudge"]["enabled"] and judge is not None:
        j = c["rejudge"]
        out = ranking.rejudge(out, judge(head(out, j["top"])), j["top"], j["margin"], j["beta"])
    return ranking.finalize(out, dense, c["final_depth"])


def run_scores(final: DataFrame) -> DataFrame:
    """Ranked rows with strictly decreasing scores, the length of the list down to 1."""
    return final.withColumn("score", F.count("*").over(Window.partitionBy("qid")) - F.col("rank") + 1)


def hard_negatives(ranked: DataFrame, positives: DataFrame, n: int = 5) -> DataFrame:
    """(qid, place, row): the best n ranked rows that are no positive of the query."""
    wrong = ranked.join(positives.select("qid", "row"), ["qid", "row"], "left_anti")
    return wrong.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("place") <= n).select("qid", "place", "row")


def by_length(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows longest first within each partition, so that batches of an encoder hold texts of like length."""
    return busy(rows).sortWithinPartitions(F.desc(F.length(text)))


def mock_description(text: Column) -> Column:
    """The first eight identifiers longer than two letters, lower case, cut at 120 characters."""
    idents = F.slice(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), 1, 8)
    return F.substring(F.lower(F.array_join(F.filter(idents, lambda w: F.length(w) > 2), " ")), 1, 120)


def line_matches(files: DataFrame, pattern: str, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, content) of every line that matches a pattern, lines counted from 1."""
    lines = files.select(F.col(file).alias("file"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("i", "content"))
    return lines.where(F.col("content").rlike(pattern)).select("file", (F.col("i") + 1).alias("line"), "content").distinct()


def version_accuracy(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row about first hits: queries, right lineage, right version, acceptable version (shares).

    hits: (qid, rank, lineage, version); wanted: (qid, lineage, version, acceptable array<int>).
    """
    first = hits.where("rank = 1").select("qid", F.col("lineage").alias("l"), F.col("version").alias("v"))
    both = wanted.join(first, "qid", "left")
    same = F.coalesce(F.col("l") == F.col("lineage"), F.lit(False))
    share = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(name)
    return both.agg(F.count("*").alias("queries"), share(same, "lineage"), share(same & (F.col("v") == F.col("version")), "exact_version"), share(same & F.array_contains("acceptable", F.col("v")), "token_consistent"))


def routed(queries: DataFrame, ask: Callable[[DataFrame], DataFrame] | None = None, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, kind, route, intent, subject, confidence, source) of every query, by rules; uncertain ones by `ask`, if given.

    ask: (qid, text) of queries whose rule is of low confidence -> (qid, kind); an unknown or missing kind leaves the rule's.
    """
    from sextant.functions.text import ROUTES, route
    from sextant.operators.code import looks_like_code

    ruled = queries.select(F.col(qid).alias("qid"), F.col(text).alias("text"), route(F.col(text), looks_like_code(text)).alias("r")).select("qid", "text", "r.*", F.lit("rules").alias("source"))
    if ask is None:
        return ruled.drop("text")
    given = ask(ruled.where("confidence = 'low'").select("qid", "text")).where(F.col("kind").isin(*ROUTES)).select("qid", F.col("kind").alias("_kind"))
    ways = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    both = ruled.join(given, "qid", "left")
    told = F.col("_kind").isNotNull()
    return both.select("qid", F.coalesce("_kind", "kind").alias("kind"), F.when(told, F.element_at(ways, F.col("_kind"))).otherwise(F.col("route")).alias("route"), "intent", "subject", "confidence", F.when(told, "asked").otherwise("rules").alias("source"))


def bigrams(docs: DataFrame, id: str, text: str, top: int = 20) -> DataFrame:
    """(bigram, n): the most frequent pairs of neighbouring words, ties by bigram."""
    from sextant.functions.text import ngrams
    from sextant.runtime import busy, words

    pairs = busy(docs.select(id, text)).select(F.explode(ngrams(words(F.col(text)), 2)).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(top)


# ---- labellers over raw lines ----
def source_lines(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, content) of all lines, parted at \\n only; repeated files count once."""
    lines = busy(files.where(F.col(text).isNotNull()).select(file, text), file, text).distinct()
    return lines.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "content")).select("file", (F.col("i") + 1).alias("line"), "content")


_DEF = r"^\s*(?:async\s+)?def\s+"


def grep_calls(lines: DataFrame, name: str) -> DataFrame:
    """Lines with a textual call of a plain name, without its definition and comment lines."""
    call = (F.col("content").rlike(rf"(?:^|[^\w.]){re.escape(name)}\s*\("), ~F.col("content").rlike(rf"{_DEF}{re.escape(name)}\s*\("), ~F.col("content").rlike(r"^\s*#"))
    return lines.where(call[0] & call[1] & call[2]).select("file", "line")


def grep_imports(lines: DataFrame, name: str) -> DataFrame:
    """Lines that import a name."""
    return lines.where(F.col("content").rlike(rf"^\s*(?:from\s+[\w.]+\s+import\s+.*\b{re.escape(name)}\b|import\s+.*\b{re.escape(name)}\b)")).select("file", "line")


def grep_text(lines: DataFrame, needle: str) -> DataFrame:
    """Lines that hold a text."""
    return lines.where(F.col("content").contains(needle)).select("file", "line")


def grep_defs(lines: DataFrame) -> DataFrame:
    """(name, file, line) of every textual definition."""
    name = F.regexp_extract("content", _DEF + r"([A-Za-z_]\w*)\s*\(", 1)
    return lines.select(name.alias("name"), "file", "line").where("name <> ''")


def docstring_questions(lines: DataFrame, least: int = 20) -> DataFrame:
    """(question, name, file, line): the opening line of a docstring that follows a one-line header within two lines."""
    w = Window.partitionBy("file").orderBy("line")
    bare = lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    one, two = bare(F.lead("content", 1).over(w)), bare(F.lead("content", 2).over(w))
    opening = F.when(one != "", one).otherwise(two)
    found = lines.select(F.regexp_extract("content", _DEF + r"([A-Za-z_]\w*)\s*\(.*?:\s*$", 1).alias("name"), "file", "line", opening.alias("opening")).where("name <> ''")
    quoted = F.col("opening").startswith('"""') | F.col("opening").startswith("'''")
    text = F.regexp_replace("opening", "^[\"' ]+|[\"' ]+$", "")
    asked = found.where(quoted).select(text.alias("question"), "name", "file", "line")
    return asked.where((F.length("question") >= least) & ~F.lower("question").rlike("^(?:todo|fixme)"))


def score_pairs(candidates: DataFrame, score: Callable[[list[str], list[str]], list[float]], query: str = "query", text: str = "text", batch: int = 32) -> DataFrame:
    """candidates with `second`, the score of each (query, text) pair by a scorer that takes lists, longest pairs first."""

    @F.pandas_udf("double")
    def scored(queries: pd.Series, texts: pd.Series) -> pd.Series:
        order = (queries.str.len().fillna(0) + texts.str.len().fillna(0)).sort_values(ascending=False, kind="stable").index
        out = pd.Series(index=queries.index, dtype=float)
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            out[at] = score(queries[at].fillna("").tolist(), texts[at].fillna("").tolist())
        return out

    return busy(candidates).withColumn("second", scored(query, text))


def word_frequencies(rows: DataFrame, text: str = "text", top: int | None = None) -> DataFrame:
    """(word, n): how often each word occurs, most first, ties by word."""
    counts = rows.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(top) if top is not None else counts
