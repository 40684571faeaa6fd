"""Cut oversized texts into pieces under a limit, at natural boundaries, with an overlap between consecutive pieces.

Boundaries are kept by level (blank line, line, white space, anywhere), finer ones only where the coarser leave too long
a stretch. A dynamic programme over the boundary positions minimises the cut penalties, then the imbalance of sizes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.runtime import busy

LEVELS = ("blank", "line", "space", "none")
#: Penalty of one cut by level; the imbalance of one piece is below 1.
PENALTIES = np.array([2.0, 20.0, 200.0, 2000.0])
#: Steps of candidates inside a run without any white space, as a part of the greatest step.
GRID = 32
_LINE = re.compile(r"([^\n]*?)(\r?\n|\Z)")
_RUN = re.compile(r"\S+")


def lines_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end without line end, start of the next line) of every line."""
    out, at, n = [], 0, len(text)
    while at < n:
        stop = text.find("\n", at)
        after = n if stop < 0 else stop + 1
        end = n if stop < 0 else stop
        if stop > at and text[stop - 1] == "\r":
            end = stop - 1
        out.append((at, end, after))
        at = after
    return out


def structure(text: str):
    """Starts of paragraphs and lines, and the length of the longest paragraph, line and run without white space."""
    paragraphs, lines, longest_p, longest_l, first = [], [], 0, 0, -1
    for start, end, _ in lines_of(text):
        if text[start:end].strip() == "":
            first = -1
            continue
        if first < 0:
            first = start
            paragraphs.append(start)
        else:
            lines.append(start)
        longest_p, longest_l = max(longest_p, end - first), max(longest_l, end - start)
    longest_r = max((m.end() - m.start() for m in _RUN.finditer(text)), default=0) if longest_l else 0
    return paragraphs, lines, (longest_p, longest_l, longest_r)


def boundary_of(longest: tuple[int, int, int], limit: int) -> str:
    """The coarsest level at which no unit is above the limit."""
    return next((LEVELS[i] for i, x in enumerate(longest) if x <= limit), LEVELS[3])


def candidates(text: str, paragraphs: list[int], lines: list[int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and levels at which a cut may fall; two neighbours are never further apart than step."""
    n = len(text)
    level = {p: 0 for p in paragraphs if 0 < p < n}

    def gaps():
        at = [0, *sorted(level), n]
        return [(a, b) for a, b in zip(at, at[1:]) if b - a > step]

    inside = np.array(lines, dtype=np.int64)
    for a, b in gaps():
        for p in inside[np.searchsorted(inside, a, "right") : np.searchsorted(inside, b)]:
            level[int(p)] = 1
    for a, b in gaps():
        for m in re.finditer(r"\s+", text[a:b]):
            if 0 < a + m.end() < b:
                level[a + m.end()] = 2
    for a, b in gaps():
        for p in range(a + max(1, step // GRID), b, max(1, step // GRID)):
            level[p] = 3
    at = np.array(sorted(level), dtype=np.int64)
    return np.concatenate([[0], at, [n]]), np.array([0, *(level[int(p)] for p in at), 0])


def cuts(positions: np.ndarray, levels: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Indexes of the positions at which the best pieces begin and end."""
    m, step = len(positions), limit - overlap
    cost, back = np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    cost[0] = 0
    low = np.searchsorted(positions, positions - step)
    for j in range(1, m):
        i = low[j]
        size = positions[j] - positions[i:j]
        total = cost[i:j] + ((step - size) / step) ** 2
        if i == 0:  # the first piece has no overlap, so it may be longer
            total[0] = ((limit - size[0]) / limit) ** 2
        k = int(total.argmin())
        best, at = total[k], i + k
        if i > 0 and positions[j] <= limit and (first := ((limit - positions[j]) / limit) ** 2) < best:
            best, at = first, 0
        cost[j], back[j] = best + (PENALTIES[levels[j]] if j < m - 1 else 0), at
    out = [m - 1]
    while out[-1]:
        out.append(int(back[out[-1]]))
    return out[::-1]


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> tuple[str, list[tuple[int, int, str]]]:
    """The boundary level of the text and its pieces: (start without overlap, end, level of the cut at the end)."""
    paragraphs, lines, longest = structure(text)
    boundary = boundary_of(longest, limit)
    if len(text) <= limit:
        return boundary, [(0, len(text), "end")]
    positions, levels = candidates(text, paragraphs, lines, limit - overlap)
    at = cuts(positions, levels, limit, overlap)
    return boundary, [(int(positions[a]), int(positions[b]), LEVELS[levels[b]] if b < len(positions) - 1 else "end") for a, b in zip(at, at[1:])]


def split_oversized(rows: DataFrame, id: str = "row", text: str = "text", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Numbered pieces of every text above `limit` characters (code points).

    Returns id, boundary (coarsest level at which every unit of the text is within the limit), piece (from 1), pieces,
    start and stop (characters of the text that are new in this piece), cut (level of the cut after it, `end` for the
    last) and piece_text, which has at most `limit` characters and after the first begins with the last `overlap`
    characters of the piece before it. The new parts joined give the text again. Null, empty and shorter texts give no
    rows; texts of white space alone are cut like others. Rows with the same id are cut each for itself. Other columns
    are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["text"]):
                boundary, pieces = split_text(t, limit, overlap)
                for k, (a, b, how) in enumerate(pieces):
                    out.append((i, boundary, k + 1, len(pieces), a, b, how, t[max(0, a - overlap) if k else 0 : b]))
            yield pd.DataFrame(out, columns=["id", "boundary", "piece", "pieces", "start", "stop", "cut", "piece_text"])

    long = rows.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    kind = long.schema["id"].dataType.simpleString()
    cutup = busy(long).mapInPandas(run, f"id {kind}, boundary string, piece int, pieces int, start long, stop long, cut string, piece_text string")
    return cutup.withColumnRenamed("id", id)
