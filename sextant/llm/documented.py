"""Functions and methods of source files paired with their documentation."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.grammars import LANGUAGES, definitions
from sextant.runtime import busy

WORD = re.compile(r"[^\W_]+")
#: First words that mark a note instead of a description, and words that say nothing beside the name (fixed values).
NOTES = frozenset({"todo", "fixme", "xxx", "tbd"})
FILLERS = frozenset({"the", "a", "an", "of", "for", "to"})


def name_words(name: str) -> set[str]:
    """Words of an identifier: parted at underscores and where a small letter or digit precedes a capital."""
    return {w.lower() for w in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).split("_") if w}


def is_trivial(documentation: str, name: str, least: int = 4) -> bool:
    """Too few words, a note, or nothing but the words of the name."""
    found = [w.lower() for w in WORD.findall(documentation)]
    return len(found) < least or found[0] in NOTES or set(found) <= name_words(name) | FILLERS


#: Frames that a parse may take: brackets of a script may nest some ten thousand deep (valid Python nests 200 at most).
FRAMES = 200_000


def _sources(files: DataFrame, file: str, text: str) -> DataFrame:
    """Distinct (file, text) of the files whose language has a grammar."""
    known = F.lower(F.regexp_extract(F.col(file), r"\.\w+$", 0)).isin(*LANGUAGES)
    return busy(files.where(F.col(text).isNotNull() & known).select(F.col(file).alias("file"), F.col(text).alias("text")), "file", "text").distinct()


def documented_functions(files: DataFrame, file: str = "file", text: str = "text", least_words: int = 4, trivial: bool = False) -> DataFrame:
    """Functions and methods at any depth with their documentation.

    Returns file, qualname, name, start_line, end_line (1-based, of `def` or `async def` and of the last line of the
    body), code, documentation. Without `trivial`, those whose documentation is missing or trivial are left out. Null
    and empty texts and files of unknown suffix give no rows; those of texts that cannot be read are in unread_files. A
    file that is delivered twice with the same text counts once.
    """

    def walk(found: list, above: tuple):
        for d in found:
            names = (*above, d.name)
            if d.kind == "function":
                yield names, d
            yield from walk(d.inner, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(FRAMES)
        for batch in batches:
            out = []
            for name, t in zip(batch["file"], batch["text"]):
                source, found, _ = definitions(t, os.path.splitext(name)[1].lower())
                starts = [m.end() for m in re.finditer("\n", source)]
                for names, d in walk(found, ()):
                    if not trivial and (d.documentation is None or is_trivial(d.documentation, d.name, least_words)):
                        continue
                    code = source[d.start : d.stop].rstrip()
                    line = _line(starts, d.start)
                    out.append((name, ".".join(names), d.name, line, line + code.count("\n"), code, d.documentation))
            yield pd.DataFrame(out, columns=["file", "qualname", "name", "start_line", "end_line", "code", "documentation"])

    schema = "file string, qualname string, name string, start_line int, end_line int, code string, documentation string"
    return _sources(files, file, text).mapInPandas(run, schema).withColumnRenamed("file", file)


def unread_files(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, reason) of every text that gives no functions because it is not valid in its language or nests too deep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(FRAMES)
        for batch in batches:
            read = [(name, definitions(t, os.path.splitext(name)[1].lower())[2]) for name, t in zip(batch["file"], batch["text"])]
            yield pd.DataFrame([r for r in read if r[1]], columns=["file", "reason"])

    return _sources(files, file, text).mapInPandas(run, "file string, reason string").withColumnRenamed("file", file)


def _line(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at) + 1
