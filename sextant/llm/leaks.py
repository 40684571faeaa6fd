"""Documents that contain passages of evaluation texts.

The n-grams of the (few) evaluation texts are held as a sorted array of hashes that goes to every task; documents are
scanned in batches of token windows, where they lie. Hits are verified word by word and grown to whole passages, which can
then be cut out. More evaluation texts than one array may hold are taken in slices, with one scan each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.runtime import busy, cut

WORD = re.compile(r"[^\W_]+")
#: Characters of evaluation text that are broadcast at once, about (50 MB of text make at most about 400 MB of arrays).
BROADCAST_CHARS = 50_000_000
#: Documents with passages whose spans are broadcast to cut them out, at most; beyond that the join shuffles.
BROADCAST_SPANS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Passages:
    """The n-grams of the evaluation texts, and the search for them in other texts."""

    def __init__(self, ids: list, texts: list, n: int):
        self.n, self.vocabulary = n, {}
        sequences = []
        for t in texts:
            sequences.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall((t or "").lower())], dtype=np.int64))
        self.sequences, self.ids = sequences, ids
        grams, items, places = [], [], []
        for k, s in enumerate(sequences):
            if len(s) >= n:
                h = self.hashes(s)
                grams.append(h)
                items.append(np.full(len(h), k))
                places.append(np.arange(len(h)))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        grams, items, places = join(grams, np.uint64), join(items, np.int64), join(places, np.int64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.items, self.places = grams[order], items[order], places[order]

    def hashes(self, s: np.ndarray) -> np.ndarray:
        """Hash of every window of n words."""
        m = len(s) - self.n + 1
        out = np.zeros(max(m, 0), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.n if m > 0 else 0):
                x = (s[j : j + m].astype(np.uint64) + np.uint64(1)) * _BASE
                out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(j)
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first character, end, first word, words) of every maximal run of at least n common words."""
        get, spans, flat, starts = self.vocabulary.get, [], [], [0]
        for t in texts:
            low = t.lower()
            found = WORD.findall(low)
            flat.extend([get(w, -1) for w in found])
            starts.append(len(flat))
            spans.append(len(low) == len(t))
        s, starts = np.array(flat, dtype=np.int64), np.array(starts)
        if len(s) < self.n or not len(self.grams):
            return []
        known = np.concatenate([[0], np.cumsum(s >= 0)])
        whole = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        owner = np.searchsorted(starts, whole, "right") - 1
        whole = whole[whole + self.n <= starts[owner + 1]]
        h = self.hashes(s)[whole]
        low, high = np.searchsorted(self.grams, h), np.searchsorted(self.grams, h, "right")
        hit = high > low
        out, done = [], {}
        for w, a, b in zip(whole[hit], low[hit], high[hit]):
            k = int(np.searchsorted(starts, w, "right") - 1)
            for item, place in zip(self.items[a:b], self.places[a:b]):
                q = self.sequences[item]
                diagonal = (k, int(item), int(w - place))
                if done.get(diagonal, -1) >= w or not np.array_equal(s[w : w + self.n], q[place : place + self.n]):
                    continue
                i, j, end = int(w), int(place), int(starts[k + 1])
                first = i
                while first > starts[k] and j - (i - first) > 0 and s[first - 1] == q[j - (i - first) - 1]:
                    first -= 1
                stop = i + self.n
                while stop < end and j + stop - i < len(q) and s[stop] == q[j + stop - i]:
                    stop += 1
                done[diagonal] = stop - self.n
                at = list(WORD.finditer(texts[k] if not spans[k] else texts[k].lower()))
                out.append((k, int(item), at[first - starts[k]].start(), at[stop - 1 - starts[k]].end(), first - int(starts[k]), stop - first))
        return out


def leaked_passages(documents: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = 20) -> DataFrame:
    """Passages of evaluation texts in documents: every maximal run of at least `words` common words.

    Returns id, item, start and stop (characters of the document), first_word and n_words of the passage. Words are
    longest runs of letters and digits, letter case ignored. Null and empty texts have none; evaluation texts of fewer
    than `words` words cannot leak. Repeated rows give repeated passages. Other columns are ignored.
    """
    slim = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    probe = items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    id_type, item_type = slim.schema["id"].dataType.simpleString(), probe.schema["item"].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, start long, stop long, first_word int, n_words int"
    size = probe.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    slices = max(1, min(size["n"], -(-(size["chars"] or 0) // max(1, BROADCAST_CHARS))))
    spread = busy(slim)

    def scanned(part: int) -> DataFrame:
        own = probe if slices == 1 else probe.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == part)
        rows = own.orderBy("item", "text").collect()  # about BROADCAST_CHARS characters
        shared = documents.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], [r["text"] for r in rows]))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages = Passages(*shared.value, words)
            for batch in batches:
                for at in range(0, len(batch), 500):
                    some = batch.iloc[at : at + 500]
                    names = some["id"].to_numpy()
                    found = passages.search(some["text"].tolist())
                    yield pd.DataFrame([(names[k], passages.ids[i], a, b, f, n) for k, i, a, b, f, n in found], columns=["id", "item", "start", "stop", "first_word", "n_words"])

        return spread.mapInPandas(scan, schema)

    found = scanned(0)
    for part in range(1, slices):
        found = found.unionByName(scanned(part))
    return found.withColumnsRenamed({"id": id, "item": item})


def without_passages(documents: DataFrame, passages: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every passage cut out: all columns, text replaced, and removed_chars.

    Overlapping passages are merged first. Documents without passages stay as they are (removed_chars 0); the id must be
    unique.
    """
    spans = passages.groupBy(id).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.when(s["start"] > acc["at"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).otherwise("")).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text)))
    cleaned = F.when(F.col("spans").isNotNull() & F.col(text).isNotNull(), F.aggregate("spans", start, step, rest)).otherwise(F.col(text))
    before = [c for c in documents.columns if c != text]
    spans = cut(spans)
    joined = documents.join(F.broadcast(spans) if spans.count() <= BROADCAST_SPANS else spans, id, "left").withColumn("cleaned", cleaned)
    return joined.select(*before, F.col("cleaned").alias(text), F.coalesce(F.length(F.col(text)) - F.length("cleaned"), F.lit(0)).alias("removed_chars"))
