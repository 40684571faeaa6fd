"""The k most similar vectors of every vector, by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of its POSTS nearest
pivots; a query looks into the files of its own nearest pivots and compares what is posted there by exact cosine. How many
files a query visits is calibrated: a few hundred vectors are compared with all rows, and the least visits are taken that
would find the wanted part of their true neighbours. Nothing that is met is left out: ranking it by footrule first takes
some fifteen times as long as the cosine of 64 values, and could only lose neighbours.

Pivots are centres of a bounded sample; everything else covers all rows. Equal vectors are worked on once and carry the
least k + 1 of their ids, which is all that k neighbours can need. Files of pivots that lie together share a shard, so that
a row or query that meets several of them travels once, with those of its pivots that the shard has. Shards and the queries
that visit them are split into blocks of bounded size, so no pivot can overload a task; the rows of a block are held, the
queries stream past.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.formatting import hot_join
from sextant.runtime import busy, cut, xxhash64

#: Vectors to which pivots are fitted (about; drawn by hash): this many, or FITTED a pivot if that is more.
SAMPLE, FITTED = 20_000, 4
#: Pivots of a shard, on average, as long as that makes no more than SHARDS; beyond, vectors of a shard.
SHARD, SHARDS, SHARD_ROWS = 16, 48, 150_000
#: Rows of one block of a shard, which a task holds at once, and queries that meet it in one task.
BLOCK, QUERIES = 250_000, 1_000_000
#: Files that a row is posted in.
POSTS = 3
#: Vectors by which the search is calibrated, and the part of their true neighbours that it has to find.
ASKERS, WANTED = 256, 0.97
#: Queries that are compared at once, and rows, so that their cosines stay in the processor's cache.
_BATCH, _ROWS = 256, 1024
#: Bits of a key below the number of its cell; the highest of them tells queries from rows, the others bring like queries together.
_BITS = 32
_FOUND = np.dtype([("near", "<i8"), ("copies", "?"), ("cosine", "<f4")])


def pivot_count(vectors: int) -> int:
    """Pivots for so many vectors: the square root, 16 at least; so files grow as the root, and so does a query's work."""
    return max(16, round(vectors**0.5))


def visit_steps(pivots: int) -> list[int]:
    """Numbers of files that a query may visit: 2, 3, 4, 6, 8, 12 and so on; all at last."""
    steps = [x for e in range(1, 40) for x in (2**e, 3 * 2 ** (e - 1)) if x < pivots]
    return [*sorted(steps), pivots]


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Unit centres of the sample, deterministic: started from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres).astype(np.float32)
    return centres


def pack(vectors: np.ndarray) -> list[bytes]:
    """Rows as bytes: half precision where that loses nothing, else single."""
    with np.errstate(over="ignore"):
        half = vectors.astype(np.float16)
    exact = (half.astype(np.float32) == vectors).all(axis=1)
    return [h.tobytes() if e else v.tobytes() for e, h, v in zip(exact, half, vectors)]


def unpack(rows: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors from packed rows."""
    out = np.empty((len(rows), dim), np.float32)
    sizes = rows.map(len).to_numpy()
    for size, kind in ((2 * dim, np.float16), (4 * dim, np.float32)):
        at = np.flatnonzero(sizes == size)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows.iloc[at]), dtype=kind).reshape(-1, dim)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def usable(embedding: Column, dim: int) -> Column:
    """Arrays of dim values without null, NaN or infinity, not all zero."""
    return (F.size(embedding) == dim) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)


def orders(unit: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` nearest pivots of every vector, nearest first, ties by number."""
    depth = min(depth, len(pivots))
    similar = unit @ pivots.T
    if depth < len(pivots):
        part = np.sort(np.argpartition(-similar, depth - 1, axis=1)[:, :depth], axis=1)
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(similar, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-similar, axis=1, kind="stable")


def ranks_of(order: np.ndarray, pivots: int, depth: int) -> np.ndarray:
    """For every query the place of each pivot in its order, `depth` for those beyond."""
    ranks = np.full((len(order), pivots), depth, np.int16 if depth < 32_000 else np.int32)
    np.put_along_axis(ranks, order[:, :depth].astype(np.int64), np.arange(min(depth, order.shape[1]), dtype=ranks.dtype)[None, :], 1)
    return ranks


def footrule(ranks: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """Footrule distance of every query (by its ranks) to every row (by its prefix): how far each pivot is from its place."""
    out = np.zeros((len(ranks), len(prefixes)), np.int16)
    for place in range(prefixes.shape[1]):
        out += np.abs(ranks.take(prefixes[:, place], axis=1) - np.int16(place))
    return out


def spread(order: np.ndarray, shard_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shards of every order: (line, shard, start, pivots); the pivots of an entry are those from its start to the next."""
    by = np.argsort(shard_of[order], axis=1, kind="stable")
    pivots = np.take_along_axis(order, by, 1)
    shards = shard_of[pivots]
    new = np.ones(shards.shape, bool)
    new[:, 1:] = shards[:, 1:] != shards[:, :-1]
    start = np.flatnonzero(new.ravel())
    return start // max(1, order.shape[1]), shards.ravel()[start], start, pivots.ravel()


class Block:
    """Rows of a shard, posted in the inverted files of their pivots."""

    def __init__(self, vids: np.ndarray, copies: np.ndarray, unit: np.ndarray, posts: Sequence[bytes], code: type, pivots: int):
        self.vids, self.copies, self.unit = vids, copies, unit
        lengths = np.fromiter(map(len, posts), np.int64, len(posts)) // np.dtype(code).itemsize
        pivot = np.frombuffer(b"".join(posts), code)
        by = np.argsort(pivot, kind="stable")
        self.posted = np.repeat(np.arange(len(posts)), lengths)[by]
        self.starts = np.searchsorted(pivot[by], np.arange(pivots + 1))

    def search(self, queries: np.ndarray, visited: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows for each query among all that the visited files of any of them hold: places (-1 where there are fewer) and cosines."""
        place, score = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
        met = np.zeros(len(self.vids), bool)
        for p in visited:
            met[self.posted[self.starts[p] : self.starts[p + 1]]] = True
        at = np.flatnonzero(met)
        if not len(at):
            return place, score
        run = 16 if len(at) < 1 << 15 else 32  # rows of which the greatest cosine is kept first
        padded = np.concatenate([at, np.full(-len(at) % run, at[-1])])
        best = np.empty((len(queries), len(padded) // run), np.float32)
        for a in range(0, len(padded), _ROWS):
            cosines = self.unit[padded[a : a + _ROWS]] @ queries.T
            best[:, a // run : (a + _ROWS) // run] = cosines.reshape(-1, run, len(queries)).max(axis=1).T
        runs = best.shape[1]
        top = np.argpartition(-best, k - 1, axis=1)[:, :k] if runs > k else np.broadcast_to(np.arange(runs), best.shape)  # the k best rows lie in the k best runs
        cand = (top[:, :, None] * run + np.arange(run)).reshape(len(queries), -1)
        value = np.matmul(self.unit[padded[cand]], queries[:, :, None])[:, :, 0]
        value[cand >= len(at)] = -np.inf
        m = min(k, value.shape[1])
        pick = np.argpartition(-value, m - 1, axis=1)[:, :m]
        score[:, :m] = np.take_along_axis(value, pick, 1)
        place[:, :m] = np.where(np.isneginf(score[:, :m]), -1, padded[np.take_along_axis(cand, pick, 1)])
        return place, score


def calibrate(classes: DataFrame, asked: pd.DataFrame, shared, dim: int, k: int, wanted: float) -> tuple[int, int, float]:
    """(visits, pairs, estimated recall): the least visits that find `wanted` of the true neighbours of the askers, and how many those are.

    Every row is compared with the askers. The k true neighbours of each come back with the place of the first visited file
    that has them.
    """
    pivots = shared.value
    steps = visit_steps(len(pivots))
    ids, q = asked["vid"].to_numpy(), unpack(asked["v"], dim)
    whole = orders(q, pivots, len(pivots))
    place_of = np.searchsorted(steps, ranks_of(whole, len(pivots), len(pivots)), "right").astype(np.int8)
    given = classes.sparkSession.sparkContext.broadcast((ids, q, place_of))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, place_of = given.value
        line = np.arange(len(ids))[:, None]
        best, vids, places = np.full((len(ids), k), -2, np.float32), np.full((len(ids), k), -1, np.int64), np.zeros((len(ids), k), np.int8)
        for b in batches:
            for a in range(0, len(b), 2048):
                part = b.iloc[a : a + 2048]
                unit, vid = unpack(part["v"], dim), part["vid"].to_numpy()
                cosine = q @ unit.T
                cosine[vid[None, :] == ids[:, None]] = -2
                m = min(k, cosine.shape[1])
                top = np.argpartition(-cosine, m - 1, axis=1)[:, :m]
                posts = orders(unit, shared.value, POSTS)[top]
                first = place_of[line[:, :, None], posts].min(axis=2)
                best, vids, places = (np.concatenate(x, axis=1) for x in ((best, cosine[line, top]), (vids, vid[top]), (places, first)))
                keep = np.lexsort((vids, -best), axis=1)[:, :k]
                best, vids, places = (np.take_along_axis(x, keep, 1) for x in (best, vids, places))
        real = best > -1.5
        yield pd.DataFrame({"asker": np.broadcast_to(line, best.shape)[real], "cosine": best[real].astype(float), "vid": vids[real], "place": places[real].astype(np.int32)})

    least = Window.partitionBy("asker").orderBy(F.desc("cosine"), "vid")
    near = classes.select("vid", "v").mapInPandas(compare, "asker int, cosine double, vid long, place int")
    true = near.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= k).select("place").toPandas()["place"].to_numpy()  # k rows an asker
    if not len(true):
        return steps[0], 0, 1.0
    for step, visits in enumerate(steps):
        met = (true <= step).mean()
        if met >= wanted or visits == len(pivots):
            return visits, len(true), float(met)
    raise AssertionError("the last step visits every file")


def nearest_vectors(rows: DataFrame, id: str = "row", embedding: str = "embedding", dim: int = 64, k: int = 10, pivots: int | None = None, sample: int = SAMPLE, wanted: float = WANTED) -> DataFrame:
    """For every row with a usable vector the k other rows of greatest cosine: (id, neighbour, cosine, rank).

    Usable are arrays of `dim` values without null, NaN or infinity that are not all zero; other rows neither ask nor
    answer. Ties rank by id. With k or fewer usable rows there are fewer neighbours. Rows with the same id count as one
    (their vectors all answer for it). Only a bounded, hash-drawn sample fits the pivots. About `wanted` of the true
    neighbours come out (estimated on ASKERS vectors against all rows); an equal vector is never missed.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(id).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("e")).where(F.col("id").isNotNull() & usable(F.col("e"), dim))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": pack(np.stack(b["e"].to_numpy()).astype(np.float32) + np.float32(0))})

    one = slim.mapInPandas(packed, "id long, v binary")
    keep = k + 1
    classes = cut(one.groupBy("v").agg(F.min("id").alias("vid"), F.count("*").alias("n")))
    total = classes.count()
    if total == 0:
        return spark.createDataFrame([], "id long, neighbour long, cosine double, rank int").withColumnRenamed("id", id)

    def drawn(most: int, seed: int) -> pd.DataFrame:
        """At most so many classes, by hash."""
        share = F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(1_000_000)) < int(np.ceil(min(1.0, 1.1 * most / total) * 1_000_000))
        return classes.where(share).orderBy(F.xxhash64("vid", F.lit(seed))).limit(most).select("vid", "v").toPandas()

    wanted_pivots = pivots or pivot_count(total)
    fitted = unpack(drawn(max(sample, FITTED * wanted_pivots), 1)["v"], dim)
    centres = fit_pivots(fitted, wanted_pivots)
    number = len(centres)
    shards = max(-(-total // SHARD_ROWS), min(-(-number // SHARD), SHARDS))
    shard_of = (fit_pivots(centres, shards) @ centres.T).argmax(0).astype(np.int32)
    shared = spark.sparkContext.broadcast(centres)
    visits, _, _ = calibrate(classes, drawn(ASKERS, 2), shared, dim, k, wanted)

    several = classes.where("n > 1")
    members = cut(hot_join(one, several, "v", "n", total).select("id", "vid", "n").distinct())
    in_class = Window.partitionBy("vid").orderBy("id")
    answers = members.withColumn("place", F.row_number().over(in_class)).where(F.col("place") <= keep).groupBy("vid").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most keep ids
    code = np.uint16 if number < 1 << 16 else np.int32
    order = np.concatenate([orders(fitted[a : a + 2048], centres, max(visits, POSTS)) for a in range(0, len(fitted), 2048)])
    part = lambda depth, size: np.maximum(1, np.ceil(np.bincount(spread(order[:, :depth], shard_of)[1], minlength=shards) * (total / len(fitted)) / size)).astype(np.int64)
    blocks, turns = part(POSTS, BLOCK), part(visits, QUERIES)  # of every shard, as the sample has them
    base = np.cumsum(blocks * turns) - blocks * turns
    keep_of = {True: (POSTS, blocks, turns), False: (visits, turns, blocks)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                own = xxhash64(part.column("vid").to_numpy())
                order = orders(unpack(part.column("v").to_pandas(), dim), shared.value, max(visits, POSTS))
                for held, (depth, mine, every) in keep_of.items():  # a row is in one block, for every turn; a query has one turn, in every block
                    line, shard, start, pivots = spread(order[:, :depth], shard_of)
                    times = every[shard]
                    entry = np.repeat(np.arange(len(line)), times)
                    other = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
                    one = np.mod(own[line], mine[shard])[entry]
                    cell = base[shard][entry] + (one * turns[shard][entry] + other if held else other * turns[shard][entry] + one)
                    count = np.diff(start, append=len(pivots))
                    second = np.where(count > 1, pivots[np.minimum(start + 1, len(pivots) - 1)], 0)
                    alike = (1 << 31) | (pivots[start].astype(np.int64) & 0x7FFF) << 16 | np.minimum(count, 63) << 10 | (second & 0x3FF)  # queries that visit the same files follow each other
                    low = 0 if held else alike[entry]
                    bounds = (np.append(start, len(pivots)) * np.dtype(code).itemsize).astype(np.int32)
                    files = pa.BinaryArray.from_buffers(pa.binary(), len(line), [None, pa.py_buffer(bounds), pa.py_buffer(pivots.astype(code))])
                    rows = part.take(pa.array(line[entry]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell << _BITS | low), rows.column("vid"), pa.array(rows.column("n").to_numpy() > 1), rows.column("v"), files.take(pa.array(entry))], ["key", "vid", "copies", "v", "o"])

    routed = busy(classes.select("vid", "n", "v")).mapInArrow(route, "key long, vid long, copies boolean, v binary, o binary")
    gathered = routed.repartition(F.shiftright("key", _BITS)).sortWithinPartitions("key")  # cell by cell, rows before queries

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, block = -1, [], None
        for b in batches:
            cells, asks = b["key"].to_numpy() >> _BITS, (b["key"].to_numpy() >> (_BITS - 1) & 1) > 0
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks) != 0)) + 1
            for a, e in zip([0, *edges], [*edges, len(b)]):
                if a == e:
                    continue
                part = b.iloc[a:e]
                if cells[a] != now:
                    now, rows, block = cells[a], [], None
                unit = unpack(part["v"], dim)
                if not asks[a]:
                    rows.append((part["vid"].to_numpy(), part["copies"].to_numpy(), unit, list(part["o"])))
                    continue
                if block is None and rows:
                    vids, copies, units, posts = zip(*rows)
                    block = Block(np.concatenate(vids), np.concatenate(copies), np.concatenate(units), [x for p in posts for x in p], code, number)
                    rows = []
                if block is None:
                    continue
                found = []
                for q in range(0, len(part), _BATCH):
                    visited = np.unique(np.frombuffer(b"".join(part["o"].iloc[q : q + _BATCH]), code))
                    at, cos = block.search(unit[q : q + _BATCH], visited, keep)
                    record = np.zeros(at.shape, _FOUND)
                    record["near"], record["copies"], record["cosine"] = block.vids[np.maximum(at, 0)], block.copies[np.maximum(at, 0)], cos
                    found += [r[x >= 0].tobytes() for r, x in zip(record, at)]
                yield pd.DataFrame({"vid": part["vid"].to_numpy(), "found": found})

    met = gathered.mapInPandas(meet, "vid long, found binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("found")
            blobs = lists.flatten().to_pylist()
            f = np.frombuffer(b"".join(blobs), _FOUND)
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // _FOUND.itemsize
            line = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), sizes)
            c = f["cosine"].astype(float).round(6)
            by = np.lexsort((-c, f["near"], line))  # a row can be met in several shards
            by = by[np.append(True, (np.diff(f["near"][by]) != 0) | (np.diff(line[by]) != 0))[: len(by)]]
            by = by[np.lexsort((f["near"][by], -c[by], line[by]))]
            place = np.arange(len(by)) - np.searchsorted(line[by], line[by])
            by = by[place < keep]
            offsets = np.searchsorted(line[by], np.arange(b.num_rows + 1)).astype(np.int32)
            best = pa.StructArray.from_arrays([pa.array(-c[by]), pa.array(f["near"][by]), pa.array(f["copies"][by])], ["c", "near", "copies"])
            yield pa.RecordBatch.from_arrays([b.column("vid"), pa.ListArray.from_arrays(pa.array(offsets), best)], ["vid", "top"])

    merged = met.groupBy("vid").agg(F.collect_list("found").alias("found")).mapInArrow(merge, "vid long, top array<struct<c double, near long, copies boolean>>")
    merged = cut(merged)
    mixed = F.exists("top", lambda x: x["copies"])
    plain = merged.where(~mixed).select("vid", F.transform("top", lambda x: F.struct(x["c"].alias("c"), x["near"].alias("neighbour"))).alias("near"))
    opened = merged.where(mixed).select("vid", F.explode("top").alias("x")).select("vid", "x.*")
    resolved = opened.where("copies").join(answers.withColumnRenamed("vid", "near"), "near").select("vid", "c", F.explode("ids").alias("neighbour")).unionByName(opened.where("not copies").select("vid", "c", F.col("near").alias("neighbour")))
    lists = plain.unionByName(resolved.groupBy("vid").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "neighbour"))), 1, keep).alias("near")))  # at most keep * keep entries
    sizes = members.groupBy("vid").agg(F.count("*").alias("n"))
    counted = lists.join(sizes, "vid", "left")
    alone = counted.where("n is null").select(F.col("vid").alias("id"), "near")
    shared_lists = counted.where("n is not null").select("vid", "n", "near")
    asking = alone.unionByName(hot_join(members.select("id", "vid"), shared_lists, "vid", "n", total).select("id", "near"))
    out = asking.select("id", F.posexplode(F.filter("near", lambda x: x["neighbour"] != F.col("id"))).alias("rank", "x")).where(F.col("rank") < k)
    return out.select(F.col("id").alias(id), F.col("x.neighbour").alias("neighbour"), (-F.col("x.c")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
