"""Text functions as Column expressions: code tokens, query terms, transforms, routing, ids, scores in replies."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: word lists, patterns and wordings that results depend on ----
STOPWORDS = (
    "the and for with that this from are was were into over than then them their there has have had not but you your can all any each "
    "one two given find print output input example return returns number numbers first second line lines list must may should would could "
    "will also only such when what which where while about after before between per its it's set case cases"
).split()
INSTRUCTIONS = {
    "registry": "Retrieve the most relevant code snippet for the given query.",
    "contest": "Given a problem description from a programming contest, retrieve code examples that can assist in solving it.",
    "code_contest": "Given a code contest problem description, retrieve relevant code that can help solve the problem.",
    "solution": "Given a competitive programming problem statement, retrieve a Python solution that solves it.",
}
EXAMPLE_WORDS = r"examples?|sample\s+(?:input|output|tests?)|example\s+(?:input|output)|test\s+cases?|sample\s+cases?"
SPEC_WORDS = r"input(?:\s+format)?|output(?:\s+format)?|constraints?|subtasks?|" + EXAMPLE_WORDS
QUERY_HINTS = {
    "dynamic_programming": ["dp", "memo", "subsequence", "knapsack", "optimal", "maximum sum", "minimum cost"],
    "graph_search": ["graph", "bfs", "dfs", "shortest path", "tree", "node", "edge", "visited"],
    "sorting": ["sort", "sorted", "order", "rank", "ascending", "descending"],
    "string_processing": ["string", "substring", "palindrome", "character", "word", "prefix", "suffix", "anagram"],
    "math_number_theory": ["prime", "gcd", "divisor", "modulo", "factorial", "fibonacci", "digit"],
    "matrix_grid": ["matrix", "grid", "row", "column", "cell", "board"],
    "heap_priority": ["heap", "priority", "kth largest", "kth smallest"],
    "hashing_lookup": ["count", "frequency", "duplicate", "unique", "lookup", "dictionary"],
    "recursion": ["recursive", "recursion", "backtrack", "permutation", "combination"],
}
STRUCTURAL_PATTERNS = [
    (r"\bwho\s+(?:calls|call|uses|invokes)\b", "who_calls"),
    (r"\bwhat\s+does\s+\S+\s+call\b", "what_calls"),
    (r"\bcallers?\s+of\b", "who_calls"),
    (r"\bcalle+s?\s+of\b", "what_calls"),
    (r"\bwhere\s+is\s+.+\bimported\b", "where_imported"),
    (r"\bwho\s+imports\b|\bimports?\s+of\b", "where_imported"),
    (r"\bwhere\s+is\s+.+\b(?:used|referenced|defined)\b", "where_used"),
    (r"\bwhere\s+.+\b(?:used|referenced)\b", "where_used"),
    (r"\bwhich\s+files?\b.*\bcalls?\b.*\bbefore\b", "call_order"),
    (r"\bcalls?\b.*\bbefore\b.*", "call_order"),
    (r"\bwhere\s+is\s+.+\bdeclared\b", "where_used"),
]
SECTION = r"(?im)^\s*(input|output|constraints?|examples?|sample input|sample output|note|explanation)\s*[:\-]?\s*$"
SUBJECT_STOPWORDS = (
    "who what where which does do is are the a an call calls called caller callers callee callees uses used use import imports imported in of to "
    "from and before after file files function method class this that it defined referenced declared invokes constant string value code where's"
).split()
ROUTES = {"problem_statement": "dense", "nl_intent": "dense", "code_query": "dense_code", "structural": "structural"}
LONG_QUERY_CHARS = 400
DESCRIPTION_OPENINGS = ("This function ", "This code ", "The function ", "The code ", "It ")
JUDGE_PROMPT = (
    'Decide whether the Python code below is a correct solution to the problem. Reply with ONLY a JSON object {"score": <number from 0 to 1>, "reason": "<one short sentence>"}, '
    "where 1 means certainly correct and 0 means certainly wrong or unrelated.\n\n"
)
# ---- end of fixed values ----


def split_identifier(ident: Column) -> Column:
    """Lower-case parts of an identifier at underscores, case and digit boundaries."""
    spaced = F.regexp_replace(ident, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(spaced, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), F.lower)


SEVERAL_PARTS = "[A-Za-z0-9]_+[A-Za-z0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]"


def code_tokens(text: Column, keep_whole: bool = True, least: int = 1) -> Column:
    """A bag of code terms: the parts of every identifier and number, then the identifiers that have several parts.

    Parts are found in one pass over the text, as every letter and digit belongs to some identifier. Null gives null.
    """
    spaced = F.regexp_replace(text, "([A-Z])([A-Z][a-z])", "$1 $2")
    parts = F.regexp_extract_all(spaced, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))
    whole = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda i: i.rlike(SEVERAL_PARTS))
    bag = F.transform(F.concat(parts, whole) if keep_whole else parts, F.lower)
    return bag if least <= 1 else F.filter(bag, lambda t: F.length(t) >= least)


def query_terms(text: Column) -> Column:
    """Distinct content words in order of first appearance."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))


def name_set(text: Column) -> Column:
    """Distinct lower-case identifiers of three characters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def transform_query(text: Column, how: str = "full", least: int = 120) -> Column:
    """`full`, `no_examples` or `narrative`: the text before the first header line of that kind, unless too little remains."""
    if how == "full":
        return text
    words = {"no_examples": EXAMPLE_WORDS, "narrative": SPEC_WORDS}[how]
    head = F.regexp_replace(F.regexp_replace(text, rf"(?im)^[ \t#*\-]*(?:{words})\b[^\n]{{0,25}}$(?s:.*)", ""), r"\s+$", "")
    cut = text.rlike(rf"(?im)^[ \t#*\-]*(?:{words})\b[^\n]{{0,25}}$")
    return F.when(cut & (F.length(head) >= least), head).otherwise(text)


def format_query(text: Column, variant: str = "registry+full") -> Column:
    """The string that an encoder gets under instruction+transform."""
    instruction, how = variant.split("+")
    return F.concat(F.lit(f"Instruct: {INSTRUCTIONS[instruction]}\nQuery: "), transform_query(text, how))


def query_family(text: Column) -> Column:
    """The family with most keyword hints in the text, the first on ties; null without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [(family, sum((low.contains(h).cast("int") for h in hints), F.lit(0))) for family, hints in QUERY_HINTS.items()]
    most = F.greatest(*[c for _, c in counts])
    out = F.when(most == 0, F.lit(None).cast("string"))
    for family, c in counts:
        out = out.when(c == most, F.lit(family))
    return out


def subject_of(text: Column) -> Column:
    """What is asked about: a quoted string, else the first identifier that is no stop word."""
    quoted = F.regexp_extract(text, "[\"'`]([^\"'`]{2,})[\"'`]", 1)
    idents = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\b"), F.lit(1))
    return F.when(quoted != "", quoted).otherwise(F.get(F.filter(idents, lambda i: ~F.lower(i).isin(*SUBJECT_STOPWORDS)), F.lit(0)))


def structural_intent(text: Column) -> Column:
    """The first structural question whose pattern occurs, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, intent in STRUCTURAL_PATTERNS:
        out = out.when(text.rlike("(?i)" + pattern), F.lit(intent))
    return out


def route(text: Column, is_code: Column) -> Column:
    """Struct kind, route, intent, subject, confidence for a query; is_code tells whether it reads as source."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    intent, subject = structural_intent(raw), subject_of(raw)
    sections = F.size(F.regexp_extract_all(raw, F.lit(SECTION), F.lit(0)))
    is_long = F.length(raw) >= LONG_QUERY_CHARS
    kind = F.when(raw == "", "nl_intent").when(intent.isNotNull(), "structural").when(is_code, "code_query").when((sections >= 2) | is_long, "problem_statement").otherwise("nl_intent")
    confidence = (
        F.when(raw == "", "low")
        .when(intent.isNotNull(), F.when(subject.isNull(), "low").otherwise("high"))
        .when(is_code, "high")
        .when((sections >= 2) | (is_long & (sections >= 1)), "high")
        .otherwise("medium")
    )
    way = F.element_at(F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair]), kind)
    return F.struct(kind.alias("kind"), way.alias("route"), F.when(raw != "", intent).alias("intent"), F.when(kind == "structural", subject).alias("subject"), confidence.alias("confidence"))


def reply_score(reply: Column) -> Column:
    """The score in [0, 1] of a judge's reply: of its first JSON object, else after `score`, else a lone 0..1; null without."""
    json = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*?\}", 0), "$.score")
    number = F.when(json.rlike(r"^-?[0-9.]+(?:[eE][-+]?[0-9]+)?$"), json)
    named = F.regexp_extract(reply, r"(?i)score\"?\s*[:=]\s*([0-9]*\.?[0-9]+)", 1)
    lone = F.regexp_extract(reply, r"\b([01](?:\.[0-9]+)?)\b", 1)
    value = F.coalesce(number, F.when(named != "", named), F.when(lone != "", lone)).try_cast("double")
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def mock_judge(problem: Column, code: Column) -> Column:
    """A deterministic judge: twice the Jaccard of lower-case words of three letters or more, at most 1, 3 digits."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.round(F.least(F.lit(1.0), 2 * jaccard(found(problem), found(code))), 3)


def doc_id_parts(doc_id: Column) -> Column:
    """Struct snippet_id and version of `snippet@vN`, read from the right."""
    return F.struct(F.nullif(F.regexp_extract(doc_id, r"^(?s:(.+))@v(\d+)$", 1), F.lit("")).alias("snippet_id"), F.regexp_extract(doc_id, r"@v(\d+)$", 1).try_cast("int").alias("version"))


def chunk_id_parts(chunk_id: Column) -> Column:
    """Struct file, start_line and end_line of `file:first-last`, read from the right; null where it is none."""
    at = lambda i: F.regexp_extract(chunk_id, r"^(?s:(.+)):(\d+)-(\d+)$", i)
    return F.when(at(1) != "", F.struct(at(1).alias("file"), at(2).try_cast("int").alias("start_line"), at(3).try_cast("int").alias("end_line")))


def lineage_parts(key: Column) -> Column:
    """Struct file and qualname of `file::qualname`, parted at the first `::`; null where it is none."""
    at = lambda i: F.regexp_extract(key, r"^(?s:(.*?))::(?s:(.+))$", i)
    return F.when(at(2) != "", F.struct(at(1).alias("file"), at(2).alias("qualname")))


def readable_phrase(qualname: Column, file: Column) -> Column:
    """A spoken form of a function: words of its qualname and its file."""
    spaced = F.regexp_replace(F.regexp_replace(qualname, r"[_.]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.concat(F.lower(spaced), F.lit(" in "), file)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def truncate_words(text: Column, most: int, suffix: str = "...") -> Column:
    """The first words, and the suffix where any were cut."""
    found = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(found) > most, F.concat(F.array_join(F.slice(found, 1, most), " "), F.lit(suffix))).otherwise(F.array_join(found, " "))


def split_sentences(text: Column) -> Column:
    """Sentences: cut at white space after . ! or ?"""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def normalize_whitespace(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Text without diacritics (compatibility decomposition, combining marks dropped)."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return text.map(plain, na_action="ignore")


def highlight(text: Column, query: Column, marker: str = "**") -> Column:
    """The words of a text, parted by blanks, with those between markers that are words of the query."""
    terms = F.transform(F.regexp_extract_all(query, F.lit(r"\w+"), F.lit(0)), F.lower)
    found = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(found, lambda w: F.when(F.array_contains(terms, F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]", "")), F.concat(F.lit(marker), w, F.lit(marker))).otherwise(w)), " ")


def clean_description(line: Column) -> Column:
    """The first line of a description, without backquotes around it and one opening phrase, at most 220 characters."""
    first = F.trim(F.regexp_extract(F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+", ""), r"^[^\n]*", 0))
    bare = F.trim(F.regexp_replace(first, "^`+|`+$", ""))
    openings = "|".join(w.strip() for w in DESCRIPTION_OPENINGS)
    return F.trim(F.substring(F.regexp_replace(bare, f"^(?:{openings}) ", ""), 1, 220))


def judge_prompt(problem: Column, code: Column, most: int = 4000) -> Column:
    """The prompt that asks a judge for a score of a solution, each part cut at `most` characters."""
    part = lambda c: F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, most), r"^\s+|\s+$", "")
    return F.concat(F.lit(JUDGE_PROMPT + "PROBLEM:\n"), part(problem), F.lit("\nCODE:\n"), part(code))


def reranker_pair(instruction: str, query: Column, document: Column) -> Column:
    """The text that a pair reranker reads."""
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), query, F.lit("\n<Document>: "), document)


def subject_pair(text: Column) -> Column:
    """Struct first and second of a question about the order of two calls: the names around the word before."""
    name = "[\"'`]?([A-Za-z_][A-Za-z0-9_.]*)[\"'`]?(?:\\(\\))?"
    pattern = rf"(?i)\b{name}\s+before\s+(?:calling\s+|it\s+calls\s+)?{name}"
    first, second = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(first != "", F.struct(first.alias("first"), second.alias("second")))
