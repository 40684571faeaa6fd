"""Subjects of documents by weak supervision.

Labelling functions vote for (document, subject): words of a learned lexicon, counted in sentences; words in headings;
words in addresses (web, mail and file names); and the document's source. How far each can be trusted is learned by
expectation maximisation over the counts of their joint votes in all documents; documents get the subjects whose
posterior passes a half. The lexicon comes from the labelled documents and is widened over all documents by what stands
in one sentence with words already known.

Every distinct text is cut into sentences, headings and addresses once; the result, hashes of words, is written. Learning
and voting then read it, with whole batches of sentences scored at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.formatting import hot_join
from sextant.runtime import busy, cut

WORD = re.compile(r"[^\W\d_]{3,}")
SENTENCE = re.compile(r"(?<=[.!?])[\s*_#/>]+|\n[ \t\r]*\n")
HEADING = re.compile(r"(?m)^\s*#+ +(.+)$|\A\s*([^\n.]{3,80})\n")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+|[\w/]+\.\w{2,4}\b(?!\s)")
#: What every address holds; only runs of text around it are searched for one.
_SIGN = re.compile(r"(?<=[\w/])\.\w{2,4}\b(?!\s)|@|https?://|www\.")
#: Words of the model that speak for one subject, at most; 14 bytes each go to every task. More raise an error.
LEXICON = 2_000_000
#: Subjects, at most. More raise an error.
SUBJECTS = 1000
#: Documents in which a word must occur, and part of them (by subject) that must agree; SEED_SUPPORT among labelled ones.
SUPPORT, PURITY = 4, 0.7
SEED_SUPPORT = 3
#: Sentences that make a subject.
SENTENCES = 4
_SENTENCE, _HEADING, _ADDRESS = range(3)
_UNITS = "digest binary, n long, words array<long>, sizes array<int>, kinds array<tinyint>"


def addresses(text: str) -> list[str]:
    """Web, mail and file names in a text."""
    out, done = [], 0
    for m in _SIGN.finditer(text):
        if m.start() < done:
            continue
        a, e = m.start(), m.end()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        out += [x[0] for x in ADDRESS.finditer(text, a, min(e + 1, len(text)))]
        done = e
    return out


def units(text: str) -> list[tuple[int, set[str]]]:
    """(kind, words) of every sentence, heading and address that has words."""
    parts = [(_SENTENCE, x) for x in SENTENCE.split(text.lower())] + [(_HEADING, m[0].lower()) for m in HEADING.finditer(text)] + [(_ADDRESS, x.lower()) for x in addresses(text)]
    return [(kind, found) for kind, found in ((kind, set(WORD.findall(x))) for kind, x in parts) if found]


def hashed(words) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return pd.util.hash_array(np.array(list(words), dtype=object), categorize=False).view(np.int64) if len(words) else np.zeros(0, np.int64)


class Lexicon:
    """Words (by hash) that speak for one subject, with weights; lexicon[word] gives (subject number, weight)."""

    def __init__(self, words: np.ndarray, subjects: np.ndarray, weights: np.ndarray):
        by = np.argsort(words)
        self.words, self.subjects, self.weights = words[by].astype(np.int64), subjects[by].astype(np.int16), weights[by].astype(np.float32)

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, word: str) -> tuple[int, float]:
        at, known = self.find(hashed([word]))
        if not known[0]:
            raise KeyError(word)
        return int(self.subjects[at[0]]), float(self.weights[at[0]])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and whether it is known."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self) - 1, 0))
        return at, self.words[at] == words if len(self) else np.zeros(len(words), bool)


class Batch:
    """Units of a batch of texts as flat arrays: text and kind of every unit, unit and hash of every word."""

    def __init__(self, batch: pa.RecordBatch):
        lists = {c: batch.column(c) for c in ("words", "sizes", "kinds")}
        flat = {c: x.flatten().to_numpy() for c, x in lists.items()}
        self.texts, self.words, self.kinds = batch.num_rows, flat["words"], flat["kinds"]
        self.text = np.repeat(np.arange(self.texts), np.diff(lists["sizes"].offsets.to_numpy()))
        self.unit = np.repeat(np.arange(len(self.kinds)), flat["sizes"])

    def votes(self, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        """Subject of every unit by its known words, and of every word by the other words of its unit; -1 if undecided.

        A subject wins alone or with more than 1.2 times the weight of the next.
        """
        n, at = len(self.kinds), lexicon.find(self.words)
        place = np.flatnonzero(at[1])
        unit, subject, weight = self.unit[place], lexicon.subjects[at[0][place]].astype(np.int64), lexicon.weights[at[0][place]].astype(np.float64)
        span = int(subject.max(initial=0)) + 1
        pair, back = np.unique(unit * span + subject, return_inverse=True)
        score, count = np.bincount(back, weight, len(pair)), np.bincount(back, minlength=len(pair))
        best = np.full((3, n), -1), np.full((3, n), -np.inf)  # the three best subjects of each unit, and their scores
        by = np.lexsort((-score, pair // span))
        owner = pair[by] // span
        nth = np.arange(len(by)) - np.searchsorted(owner, owner)
        for k in range(3):
            here = by[nth == k]
            best[0][k, pair[here] // span], best[1][k, pair[here] // span] = pair[here] % span, score[here]

        def decide(s1, v1, s2, v2):
            return np.where((s1 >= 0) & ((s2 < 0) | (v1 > 1.2 * v2)), s1, -1)

        of_unit = decide(best[0][0], best[1][0], best[0][1], best[1][1])
        of_word = of_unit[self.unit]
        (s1, s2, s3), (v1, v2, v3) = best[0][:, unit], best[1][:, unit]
        own = np.where(count[back] > 1, score[back] - weight, -np.inf)  # of the word's subject without the word
        o1, w1 = np.where(s1 == subject, s2, s1), np.where(s1 == subject, v2, v1)
        two = (s1 == subject) | (s2 == subject)
        o2, w2 = np.where(two, s3, s2), np.where(two, v3, v2)
        there = np.isfinite(own)
        leads = there & ((o1 < 0) | (own > w1))
        next_w = np.where(leads, w1, np.maximum(own, w2))
        next_s = np.where(leads, o1, np.where(there | (o2 >= 0), 0, -1))
        of_word[place] = decide(np.where(leads, subject, o1), np.where(leads, own, w1), next_s, next_w)
        return of_unit, of_word


def text_units(texts: DataFrame) -> DataFrame:
    """(digest, n, words, sizes, kinds) of texts (digest, n, text): hashes of the words of all units, one unit after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: dict[str, int] = {}
            words, sizes, kinds, word_ends, unit_ends = [], [], [], [0], [0]
            for text in batch.column("text").to_pylist():
                for kind, found in units(text):
                    words += [number.setdefault(w, len(number)) for w in found]
                    sizes.append(len(found))
                    kinds.append(kind)
                word_ends.append(len(words))
                unit_ends.append(len(sizes))
            flat = hashed(list(number))[np.array(words, dtype=np.int64)] if words else np.zeros(0, np.int64)
            lists = [(word_ends, pa.array(flat)), (unit_ends, pa.array(sizes, pa.int32())), (unit_ends, pa.array(kinds, pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), *[pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values) for ends, values in lists]], names=["digest", "n", "words", "sizes", "kinds"])

    return texts.mapInArrow(run, _UNITS)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _counted(cells: np.ndarray, words: np.ndarray, span: int) -> pa.RecordBatch:
    """Rows (word, subject, n) of a batch from distinct cells (text, word number, subject): by subject, and -1 for any."""
    per, n = np.unique(cells % (len(words) * span), return_counts=True)
    whole, all_n = np.unique(_distinct(cells // span) % len(words), return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([words[per // span], words[whole]])), pa.array(np.concatenate([per % span, np.full(len(whole), -1)]).astype(np.int32)), pa.array(np.concatenate([n, all_n]))],
        names=["word", "subject", "n"],
    )


def _count_pairs(texts: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """(word, subject, n): distinct texts in which a word stands where the subject holds.

    Without lexicon the subject holds in a whole labelled text (column subjects); with it, in the sentence, by the other
    words of it. Subject -1 counts all texts in which any subject held for the word.
    """
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            if not record.num_rows:
                continue
            b = Batch(record)
            inside = np.flatnonzero(b.kinds[b.unit] == _SENTENCE)
            words, number = np.unique(b.words[inside], return_inverse=True)
            text = b.text[b.unit[inside]]
            if shared.value is None:
                column = record.column("subjects")
                subjects, many = column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy())
                first = np.cumsum(many) - many
                times = many[text]
                each = np.repeat(np.arange(len(text)), times)
                subject = subjects[first[text[each]] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)] if len(each) else np.zeros(0, np.int64)
            else:
                subject = b.votes(shared.value)[1][inside].astype(np.int64)
                each = np.flatnonzero(subject >= 0)
                subject = subject[each]
            if len(each):
                span = int(subject.max()) + 1
                yield _counted(_distinct((text[each] * len(words) + number[each]) * span + subject), words, span)

    return texts.mapInArrow(run, "word long, subject int, n long").groupBy("word", "subject").agg(F.sum("n").alias("n"))


def _lexicon(counts: DataFrame, prior: dict[int, float], support: int, purity: float, size: int) -> Lexicon:
    """Words that speak for one subject; more than `size` raise ValueError."""
    per = counts.groupBy("word").agg(F.max(F.when(F.col("subject") == -1, F.col("n"))).alias("all"), F.collect_list(F.when(F.col("subject") >= 0, F.struct("subject", "n"))).alias("by"))  # at most one entry a subject
    good = per.where(F.col("all") >= support).select("word", "all", F.explode("by").alias("x")).select("word", "all", "x.*").where(F.col("n") >= purity * F.col("all"))
    share = F.element_at(F.create_map(*[F.lit(x) for s, p in prior.items() for x in (int(s), float(p))]), F.col("subject"))
    kept = good.where(F.col("subject").isin(*prior)).where(F.col("n") / F.col("all") > 1.5 * share)
    rows = kept.limit(size + 1).toPandas()  # one more than are allowed shows that there are too many
    if len(rows) > size:
        raise ValueError(f"more than {size} words speak for one subject; ask for more support or a greater size")
    weight = np.log((rows["n"] / rows["all"]).to_numpy(float) / np.maximum(rows["subject"].map(prior).to_numpy(float), 1e-3))
    return Lexicon(rows["word"].to_numpy(np.int64), rows["subject"].to_numpy(), weight)


def _digest(text: str = "text"):
    return F.unhex(F.md5(text)).alias("digest")


def distinct_units(documents: DataFrame) -> DataFrame:
    """text_units of the distinct texts of documents (id, text), n documents each; written once."""
    keyed = busy(documents.where("text is not null").select(_digest(), "text"), "digest")
    return cut(text_units(keyed.groupBy("digest").agg(F.count("*").alias("n"), F.first("text").alias("text"))))


def learn_lexicon(documents: DataFrame, labels: DataFrame, names: list[str], rounds: int = 2, support: int = SUPPORT, purity: float = PURITY, size: int = LEXICON, known: DataFrame | None = None) -> Lexicon:
    """The lexicon from columns id, text of documents and id, subject of labels; `known` is distinct_units(documents), if there."""
    number = {n: i for i, n in enumerate(names)}
    mapping = F.create_map(*[x for n, i in number.items() for x in (F.lit(n), F.lit(i))])
    marks = labels.select("id", F.element_at(mapping, F.lower(F.trim("subject"))).alias("s")).where("s is not null and id is not null").groupBy("id").agg(F.collect_set("s").alias("subjects"))
    marked = documents.where("text is not null").select("id", _digest()).join(marks, "id").groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_set("subjects"))).alias("subjects"))
    texts = distinct_units(documents) if known is None else known
    labelled = cut(texts.join(marked, "digest"))
    per = {r["s"]: r["n"] for r in labelled.select(F.explode("subjects").alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}  # one row per subject
    count = max(1, labelled.count())
    prior = {s: n / count for s, n in per.items()}
    if not prior:
        return Lexicon(*(np.zeros(0) for _ in range(3)))
    lexicon = _lexicon(_count_pairs(labelled, None), prior, min(SEED_SUPPORT, support), 0.55, size)
    for _ in range(rounds):
        wider = _lexicon(_count_pairs(texts, lexicon), {s: max(prior.get(s, 0), 0.02) for s in range(len(names))}, support, purity, size)
        lexicon = wider if len(wider) else lexicon
    return lexicon


def learn_accuracies(patterns: np.ndarray, counts: np.ndarray, levels: list[int], rounds: int = 40) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Latent binary class behind independent votes: prior, P(vote | class) of each function, posterior per pattern.

    patterns: one row per joint vote, a column per labelling function with values below its number of levels. The first
    function is the count of sentences, from which the class starts.
    """
    weight = counts.astype(float)
    post = np.where(patterns[:, 0] >= SENTENCES, 0.95, np.where(patterns[:, 0] == SENTENCES - 1, 0.3, 0.02))
    tables, prior = [], 0.1
    for _ in range(rounds):
        prior = float(np.clip((weight * post).sum() / weight.sum(), 1e-4, 0.9))
        tables = []
        for j, n in enumerate(levels):
            table = np.empty((2, n))
            for y, p in enumerate((1 - post, post)):
                table[y] = np.bincount(patterns[:, j], weights=weight * p, minlength=n) + 0.1
                table[y] /= table[y].sum()
            tables.append(table)
        odds = np.log(prior / (1 - prior)) + sum(np.log(t[1][patterns[:, j]] / t[0][patterns[:, j]]) for j, t in enumerate(tables))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return prior, tables, post


def text_votes(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(digest, n, subject number, in_sentences 0..6, in_heading 0..1, in_address 0..1) of units where any function votes."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            b = Batch(record)
            of_unit, _ = b.votes(shared.value)
            there = np.flatnonzero(of_unit >= 0)
            span = int(of_unit.max(initial=0)) + 1
            pair, back = np.unique(b.text[there] * span + of_unit[there], return_inverse=True)
            seen = [np.bincount(back[b.kinds[there] == kind], minlength=len(pair)) for kind in (_SENTENCE, _HEADING, _ADDRESS)]
            columns = [record.column("digest").take(pa.array(pair // span)), record.column("n").take(pa.array(pair // span)), *[pa.array(x.astype(np.int32)) for x in (pair % span, *(np.minimum(x, top) for x, top in zip(seen, (6, 1, 1))))]]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "subject", "in_sentences", "in_heading", "in_address"])

    return texts.mapInArrow(run, "digest binary, n long, subject int, in_sentences int, in_heading int, in_address int")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """Subjects of every document that has a text: (id, subject, probability).

    labels(id, subject) mark a small share of the documents, some wrongly; subjects(subject) lists all (a fixed, small
    table). Null and blank texts and documents about none of the subjects give no rows; null ids keep theirs. Labels of
    other spelling (case, outer blanks) count, unknown ones do not. Equal texts get equal lexicon votes. Without usable
    labels the result is empty.
    """
    listed = subjects.select(F.lower(F.trim("subject")).alias("s"), "subject").where("s is not null").groupBy("s").agg(F.max("subject").alias("subject")).orderBy("s").limit(SUBJECTS + 1).collect()
    if len(listed) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    names = [r["s"] for r in listed]
    written = {r["s"]: r["subject"] for r in listed}
    slim = documents.select(F.col(id).alias("id"), F.col(text).alias("text"), F.lower(F.trim(F.col(source))).alias("source")).where(F.col("text").rlike(r"\S"))
    texts = distinct_units(slim)
    lexicon = learn_lexicon(slim, labels.select(F.col(id).alias("id"), "subject"), names, known=texts)
    kind = slim.schema["id"].dataType.simpleString()
    if not len(lexicon):
        return documents.sparkSession.createDataFrame([], f"id {kind}, subject string, probability double").withColumnRenamed("id", id)
    of_text = text_votes(texts, lexicon).groupBy("digest", "n").agg(F.collect_list(F.struct("subject", "in_sentences", "in_heading", "in_address")).alias("votes"))  # a text has one row a subject
    total = texts.agg(F.sum("n")).first()[0] or 0
    voted = hot_join(slim.select("id", "source", _digest()), cut(of_text), "digest", "n", total)
    votes = cut(voted.select("id", "source", F.explode("votes").alias("x")).select("id", "source", "x.*"))
    # the source votes by how much of it the sentences give to a subject: 0 to 3
    spread = votes.groupBy("source", "subject").agg(F.avg((F.col("in_sentences") >= SENTENCES).cast("double")).alias("rate"), F.count("*").alias("n"))
    usual = votes.groupBy("subject").agg(F.avg((F.col("in_sentences") >= SENTENCES).cast("double")).alias("usual"))
    by_source = spread.join(F.broadcast(usual), "subject").select("source", "subject", F.when(F.col("n") < 20, 1).when(F.col("rate") > 1.3 * F.col("usual"), 2).when(F.col("rate") < 0.7 * F.col("usual"), 0).otherwise(1).alias("by_source"))
    full = votes.join(by_source, ["source", "subject"], "left").withColumn("by_source", F.coalesce("by_source", F.lit(1)))
    columns, levels = ["in_sentences", "in_heading", "in_address", "by_source"], [7, 2, 2, 3]
    joint = full.groupBy("subject", *columns).agg(F.count("*").alias("n")).toPandas()  # at most 84 rows a subject
    known = []
    for s, group in joint.groupby("subject"):
        _, _, post = learn_accuracies(group[columns].to_numpy(), group["n"].to_numpy(), levels)
        known += [(int(s), *map(int, p), float(x), written[names[int(s)]]) for p, x in zip(group[columns].to_numpy(), post)]
    model = F.broadcast(documents.sparkSession.createDataFrame(known, "subject int, in_sentences int, in_heading int, in_address int, by_source int, probability double, name string"))
    return full.join(model, ["subject", *columns]).where(F.col("probability") >= threshold).select(F.col("id").alias(id), F.col("name").alias("subject"), F.round("probability", 6).alias("probability"))
