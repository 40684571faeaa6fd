"""The same or nearly the same records across splits, by winnowed word fingerprints.

Both splits are winnowed: of every window of neighbouring k-grams of words (rolling hashes) the minimum is selected. The
order behind "minimum" is the same in both splits: first the number of occurrences in the evaluation split, as a counting
sketch of bounded size has it, then the hash. So a stretch of k + w - 1 words that two texts share selects the same
fingerprint in both, and text that everything shares is selected only where there is nothing rarer.

With at most e edits, one of any e + 1 disjoint windows of a training text occurs unchanged in its partner. So a training
text probes with the minima of e + 1 + SPARE disjoint windows, chosen for the least sum of occurrences; an evaluation text
posts all its minima. Joined seeds are chained: a pair that is e edits apart keeps a collinear chain of all but e of
the windows, near the diagonal. Chains that are long enough are extended by an exact alignment of all words. No pair
within the limit is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import busy, cut

#: Texts of at least so many words are fingerprinted by three words, shorter ones by two.
LONG = 20
#: Words of a fingerprint and fingerprints of a window, for long and for short texts.
LONG_GRAM, SHORT_GRAM, WINDOW = 3, 2, 2
#: Windows beyond e + 1 that a pair is probed by, so that it must keep a chain of 1 + SPARE of them.
SPARE = 4
#: Buckets (as a power of two) of the sketch of occurrences, 2 bytes each, and bits of the map of probed fingerprints.
SKETCH_BITS, MAP_BITS = 22, 24
#: Pairs of keys that are broadcast to fetch their texts, at most (16 bytes each); beyond that the join shuffles.
BROADCAST_PAIRS = 1_000_000
_CHUNK_BITS = 16
_SEGMENT = 1000
_FAR = 1 << 30
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def edits(n: Column | int, share: float):
    """Edits allowed for a pair whose longer text has n words (rounded as exact decimals are)."""
    if isinstance(n, Column):
        return F.floor(n * F.lit(share) + F.lit(1e-9)).cast("int")
    return int(np.floor(n * share + 1e-9))


def longest_partner(n, share: float):
    """The number of words that the longer partner of a text of n words can have."""
    if isinstance(n, Column):
        return F.floor(n / F.lit(1 - share) + F.lit(1e-9)).cast("int")
    return int(np.floor(n / (1 - share) + 1e-9))


# ---- fingerprints ----
def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (words parted by one blank), and where each text starts, with the end at last."""
    parts = pc.split_pattern(texts, " ")
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    starts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64), starts.astype(np.int64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every k neighbouring words; k itself takes part, so that lengths differ."""
    out = np.full(max(len(h) - k + 1, 0), np.uint64(k))
    with np.errstate(over="ignore"):
        for j in range(k if len(out) else 0):
            out = out * _BASE + h[j : j + len(out)]
        out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def winnow(grams: np.ndarray, counts: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """The place of the minimum of every w neighbouring grams, by (count, hash), the first on ties."""
    best = np.arange(max(len(grams) - w + 1, 0))
    for j in range(1, w):
        other = np.arange(len(best)) + j
        less = (counts[other] < counts[best]) | ((counts[other] == counts[best]) & (grams[other] < grams[best]))
        best = np.where(less, other, best)
    return best


def cheapest_windows(costs: list[np.ndarray], t: int, need: list[int]) -> list[np.ndarray]:
    """For each text `need` disjoint windows of t words with the least sum of costs; costs has one entry per window place.

    An exact dynamic programme over places, for all texts side by side.
    """
    count, places, most = len(costs), max(map(len, costs), default=0), max(need, default=0)
    cost = np.full((places, count), _FAR, np.int32)
    for b, c in enumerate(costs):
        cost[: len(c), b] = c
    best = np.full((places + t + 1, count, most + 1), _FAR, np.int32)  # [i, b, j]: j windows from place i on
    best[:, :, 0] = 0
    for i in range(places - 1, -1, -1):
        best[i, :, 1:] = np.minimum(np.minimum(best[i + 1, :, 1:], best[i + t, :, :-1] + np.minimum(cost[i], _FAR // 2)[:, None]), _FAR)
    at, left, every = np.zeros(count, np.int64), np.array(need, np.int64), np.arange(count)
    took = []
    for i in range(places):
        here = (at == i) & (left > 0)
        take = here & (best[i, every, left] != best[i + 1, every, left])
        took.append(take)
        left -= take
        at += np.where(take, t, here | (at == i))
    chosen = np.array(took).reshape(places, count)
    return [np.flatnonzero(chosen[:, b]) for b in range(count)]


def probes(costs: list[np.ndarray], t: int, need: list[int], budget: int = 1 << 23) -> list[np.ndarray]:
    """cheapest_windows in groups of bounded size; very long texts are cut into segments that get their part of the windows."""
    jobs = []  # (text, offset, costs, need)
    for b, (c, m) in enumerate(zip(costs, need)):
        n = len(c) + t - 1
        cuts = np.linspace(0, n, max(1, -(-n // _SEGMENT)) + 1).astype(int)
        share = np.floor(np.arange(len(cuts)) * m / (len(cuts) - 1)).astype(int)
        jobs += [(b, a, c[a : e - t + 1], int(k)) for a, e, k in zip(cuts[:-1], cuts[1:], np.diff(share)) if k]
    jobs.sort(key=lambda j: len(j[2]))
    out: list[list[np.ndarray]] = [[] for _ in costs]
    while jobs:
        size = max(1, budget // ((len(jobs[-1][2]) + t + 1) * (max(j[3] for j in jobs[-256:]) + 1)))
        part = jobs[-size:]
        del jobs[-size:]
        for (b, a, _, _), places in zip(part, cheapest_windows([j[2] for j in part], t, [j[3] for j in part])):
            out[b].append(places + a)
    return [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]


# ---- alignment ----
def edit_distance(a: list, b: list, limit: int) -> int:
    """Insertions, deletions and replacements that make b of a; limit + 1 if they are more than limit."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    goal, reach = m - n, {0: 0}
    while reach[0] < n and reach[0] < m and a[reach[0]] == b[reach[0]]:
        reach[0] += 1
    for d in range(limit + 1):
        if reach.get(goal, -1) >= n:
            return d
        after = {}
        for diagonal in range(-d - 1, d + 2):
            if abs(goal - diagonal) > limit - d - 1 + 1:
                continue
            i = max(reach.get(diagonal, -2) + 1, reach.get(diagonal - 1, -2), reach.get(diagonal + 1, -2) + 1)
            if i < 0 or i > n or i + diagonal > m or i + diagonal < 0:
                i = min(i, n, m - diagonal)
                if i < 0 or i + diagonal < 0:
                    continue
            while i < n and i + diagonal < m and a[i] == b[i + diagonal]:
                i += 1
            after[diagonal] = i
        reach = after
    return limit + 1


def chain(seeds: list[tuple[int, int]], drift: int) -> int:
    """Seeds of the longest collinear chain, strictly rising in both texts, within drift of the diagonal."""
    near = sorted({(i, j) for i, j in seeds if abs(i - j) <= drift}, key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    for _, j in near:
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
    return len(tails)


# ---- bounded tables over all texts ----
def _summed(parts: DataFrame, bits: int, reduce, kind) -> np.ndarray:
    """Sparse parts (chunk, at, n) of a table of 2 ** bits entries, reduced by chunk on the executors; the table comes back."""
    whole = 1 << min(bits, _CHUNK_BITS)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(whole, np.int64)
        for at, n in zip(group["at"], group["n"]):
            reduce(table, np.frombuffer(at, np.uint16), np.frombuffer(n, np.int32))
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "packed": [kind(table).tobytes()]})

    rows = parts.groupBy("chunk").applyInPandas(add, "chunk int, packed binary").toPandas()  # at most 2 ** (bits - 16) rows of fixed size
    empty = kind(np.zeros(whole, np.int64))
    out = np.zeros((1 << bits) // whole * len(empty), empty.dtype)
    for r in rows.itertuples():
        out[r.chunk * len(empty) : (r.chunk + 1) * len(empty)] = np.frombuffer(r.packed, empty.dtype)
    return out


def _sparse(table: np.ndarray) -> pa.RecordBatch:
    rows = []
    for chunk in range(max(1, len(table) >> _CHUNK_BITS)):
        part = table[chunk << _CHUNK_BITS : (chunk + 1) << _CHUNK_BITS]
        at = np.flatnonzero(part)
        if len(at):
            rows.append((chunk, at.astype(np.uint16).tobytes(), part[at].astype(np.int32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], names=["chunk", "at", "n"])


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def cross_split_overlaps(train: DataFrame, evaluation: DataFrame, id: str = "qid", text: str = "text", share: float = 0.15, spare: int = SPARE, sketch_bits: int = SKETCH_BITS, map_bits: int = MAP_BITS) -> DataFrame:
    """Pairs of a training and an evaluation record whose word sequences are equal or at most `share` edits apart.

    Returns train_id, eval_id, words (of the longer), distance (in words) and coverage (part of the longer text that
    the alignment matches) and seed_words (words in the chain of seeds; all of them for equal texts). Words are longest
    runs of letters and digits, letter case ignored. Null and wordless texts and null ids are left out; repeated rows
    count once. Equal texts are worked on once; every member of either split gets its pairs. Other columns are ignored.
    Texts may be of any length. The sketch and the map of fingerprints have a fixed size; where they fill up, more
    fingerprints are joined, but the result stays.
    """
    spark = train.sparkSession
    shortest_long = int(np.ceil(LONG * (1 - share) - 1e-9))  # words of the shortest partner of a long text
    longest_short = longest_partner(LONG - 1, share)
    plain = F.trim(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]+", " "))  # the words, parted by one blank
    wordy = F.col("id").isNotNull() & F.col("t").rlike(r"[\p{L}\p{N}]")
    side = lambda rows, held: busy(rows.select(F.col(id).alias("id"), F.col(text).alias("t")).where(wordy)).select("id", F.lit(held).alias("held"), plain.alias("s"))
    base = cut(side(train, False).unionByName(side(evaluation, True)).withColumn("digest", F.unhex(F.md5("s"))))
    grouped = base.groupBy("digest").agg(F.first("s").alias("s"), F.bool_or("held").alias("held"), F.bool_or(~F.col("held")).alias("trained"))
    texts = cut(grouped.withColumn("key", F.monotonically_increasing_id()))  # the cut fixes the keys

    def fingerprints(batch: pa.RecordBatch):
        """(row, words, k, hashes) of every text, by each length of fingerprint that it can be met by."""
        flat, starts = word_hashes(batch.column("s"))
        every = {k: rolling(flat, k) for k in (SHORT_GRAM, LONG_GRAM)}
        for i, (a, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            for k, grams in every.items():
                yield i, e - a, k, grams[a : max(a, e - k + 1)]

    def posts(n: int, k: int) -> bool:
        return n >= shortest_long if k == LONG_GRAM else n <= longest_short

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << sketch_bits, np.int64)
        for batch in batches:
            parts = [_bucket(g, sketch_bits) for _, n, k, g in fingerprints(batch) if posts(n, k)]
            if parts:
                table += np.bincount(np.concatenate(parts), minlength=len(table))
        yield _sparse(np.minimum(table, 1 << 30))

    held, trained = texts.where("held").select("key", "s"), texts.where("trained").select("key", "s")
    sketch = _summed(held.mapInArrow(count, "chunk int, at binary, n binary"), sketch_bits, lambda t, at, n: np.add.at(t, at, n), lambda t: np.minimum(t, 65_535).astype(np.uint16))
    counts = spark.sparkContext.broadcast(sketch)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, jobs = batch.column("key").to_numpy(), [], {SHORT_GRAM: [], LONG_GRAM: []}
            for i, n, k, g in fingerprints(batch):
                if (k == LONG_GRAM) != (n >= LONG) or len(g) < WINDOW:
                    continue
                c = counts.value[_bucket(g, sketch_bits)].astype(np.int64)
                minima, worst = winnow(g, c), edits(longest_partner(n, share), share) + 1
                need = min(worst + spare, n // (k + WINDOW - 1))
                if need >= worst:
                    jobs[k].append((i, n, g, c, minima, need))
                else:  # so many disjoint windows do not fit: every minimum counts
                    places = np.unique(minima)
                    places = places[c[places] > 0]
                    out.append((np.full(len(places), i), g[places], places, np.full(len(places), n), np.zeros(len(places), int), np.full(len(places), -1)))
            for k, found in jobs.items():
                for (i, n, g, c, minima, need), picked in zip(found, probes([c[m] for _, _, _, c, m, _ in found], k + WINDOW - 1, [x[-1] for x in found])):
                    places = minima[picked]
                    places = places[np.argsort(c[places], kind="stable")]  # numbered from the rarest; those that do not occur come first
                    number = np.arange(len(places))
                    there = c[places] > 0
                    places, number = places[there], number[there]
                    out.append((np.full(len(places), i), g[places], places, np.full(len(places), n), np.full(len(places), need), number))
            if out:
                row, gram, place, n, need, number = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(keys[row]), *[pa.array(x.astype(np.int32)) for x in (place, n, need, number)]], names=["gram", "t_key", "t_place", "t_n", "need", "number"])

    chosen = cut(trained.mapInArrow(probe, "gram long, t_key long, t_place int, t_n int, need int, number int"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << map_bits, np.int8)
        for batch in batches:
            table[_bucket(batch.column("gram").to_numpy().view(np.uint64), map_bits)] = 1
        yield _sparse(table)

    probed = _summed(chosen.select("gram").mapInArrow(mark, "chunk int, at binary, n binary"), map_bits, lambda t, at, n: t.__setitem__(at, 1), lambda t: np.packbits(t.astype(bool)))
    wanted = spark.sparkContext.broadcast(probed)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column("key").to_numpy(), []
            for i, n, k, g in fingerprints(batch):
                if posts(n, k) and len(g) >= WINDOW:
                    places = np.unique(winnow(g, counts.value[_bucket(g, sketch_bits)]))
                    b = _bucket(g[places], map_bits)
                    places = places[(wanted.value[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1]
                    out.append((np.full(len(places), i), g[places], places, np.full(len(places), n)))
            if out:
                row, gram, place, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(keys[row]), *[pa.array(x.astype(np.int32)) for x in (place, n)]], names=["gram", "e_key", "e_place", "e_n"])

    posted = held.mapInArrow(post, "gram long, e_key long, e_place int, e_n int")
    limit = edits(F.greatest("t_n", "e_n"), share)
    # a partner no longer than the text needs fewer windows than were selected: the rarest e + 1 + spare of them
    used = F.least("need", limit + 1 + spare)
    near = (F.abs(F.col("t_place") - F.col("e_place")) <= limit) & (F.abs(F.col("t_n") - F.col("e_n")) <= limit) & (F.col("number") < F.greatest(used, F.lit(0)) + (F.col("need") == 0).cast("int"))
    met = chosen.join(posted, "gram").where(near & (F.col("t_key") != F.col("e_key")))
    pairs = met.groupBy("t_key", "e_key", limit.alias("drift"), F.greatest(F.lit(1), used - limit).alias("least"), F.when(F.col("t_n") >= LONG, LONG_GRAM).otherwise(SHORT_GRAM).alias("k")).agg(F.collect_list(F.shiftleft(F.col("t_place").cast("long"), 32).bitwiseOR(F.col("e_place").cast("long"))).alias("seeds"))
    seeded = pairs.where(F.size(F.array_distinct(F.transform("seeds", lambda x: F.shiftright(x, 32)))) >= F.col("least"))

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            long = np.array([chain([(x >> 32, x & 0xFFFFFFFF) for x in s.tolist()], d) for s, d in zip(b["seeds"], b["drift"])], dtype=np.int64)
            keep = long >= b["least"].to_numpy()
            yield pd.DataFrame({"t_key": b["t_key"][keep], "e_key": b["e_key"][keep], "seed_words": (long * b["k"].to_numpy())[keep].astype(np.int32)})

    candidates = cut(seeded.select("t_key", "e_key", "drift", "least", "k", "seeds").mapInPandas(chained, "t_key long, e_key long, seed_words int"))
    few = F.broadcast if candidates.count() <= BROADCAST_PAIRS else (lambda df: df)
    left = trained.select(F.col("key").alias("t_key"), F.col("s").alias("a")).join(few(candidates), "t_key")
    right = held.select(F.col("key").alias("e_key"), F.col("s").alias("b")).join(few(candidates.select("t_key", "e_key")), "e_key")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tk, ek, s, x, y in zip(batch["t_key"], batch["e_key"], batch["seed_words"], batch["a"], batch["b"]):
                a, b = x.split(" "), y.split(" ")
                longer = max(len(a), len(b))
                most = edits(longer, share)
                d = edit_distance(a, b, most)
                if d <= most:
                    out.append((tk, ek, longer, d, min(s, longer)))
            yield pd.DataFrame(out, columns=["t_key", "e_key", "words", "distance", "seed_words"])

    with_texts = left.join(right, ["t_key", "e_key"]).select("t_key", "e_key", "seed_words", "a", "b")
    aligned = with_texts.mapInPandas(align, "t_key long, e_key long, words int, distance int, seed_words int")
    n = F.size(F.split("s", " "))
    equal = texts.where("held and trained").select(F.col("key").alias("t_key"), F.col("key").alias("e_key"), n.alias("words"), F.lit(0).alias("distance"), n.alias("seed_words"))
    keyed = lambda key, digest: texts.select(F.col("key").alias(key), F.col("digest").alias(digest))
    found = aligned.unionByName(equal).join(keyed("t_key", "t_digest"), "t_key").join(keyed("e_key", "e_digest"), "e_key")
    members = lambda held, name, digest: base.where(F.col("held") == held).select(F.col("id").alias(name), F.col("digest").alias(digest)).distinct()
    full = found.join(members(False, "train_id", "t_digest"), "t_digest").join(members(True, "eval_id", "e_digest"), "e_digest")
    return full.select("train_id", "eval_id", "words", "distance", (1 - F.col("distance") / F.col("words")).alias("coverage"), "seed_words")


def overlap_report(overlaps: DataFrame, evaluation: DataFrame, id: str = "qid", split: str = "split", source: str = "source") -> DataFrame:
    """Per evaluation split and source: records, those with an overlap, pairs, and the mean best coverage of the latter.

    evaluation has one row or more per record; its rows are made distinct by id, split and source first.
    """
    best = overlaps.groupBy(F.col("eval_id").alias(id)).agg(F.max("coverage").alias("best"), F.count("*").alias("pairs"))
    records = evaluation.select(id, split, source).distinct().join(best, id, "left")
    return records.groupBy(split, source).agg(F.count("*").alias("records"), F.count("best").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("best"), 6).alias("mean_coverage"))
