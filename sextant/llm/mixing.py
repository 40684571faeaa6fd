"""Mix records of several sources to target shares of the total size, repeating small sources up to a cap.

Sizes are exact token counts. A source takes part in whole copies plus a part of its documents whose lengths sum to what
is left of its budget: an even share of every length first, then a bounded-knapsack programme over the histogram of
lengths for the small rest. Documents of each length are drawn by a seeded hash, through counts per hash bucket, so that
no source or length, however large, is ordered in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.runtime import busy, cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens that the knapsack programme settles, about; the even share leaves more only if lengths are longer.
WINDOW = 16_384
#: Targets that are broadcast, at most; beyond that the joins shuffle.
BROADCAST_TARGETS = 100_000
#: Hash buckets by which documents of one length are drawn.
BUCKETS = 1024
#: Pattern by which a byte-level tokenizer of this kind cuts text into words (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens): source in lower case without outer blanks, tokens 0 for null texts.

    The vocabulary file is read by the driver and sent to the tasks (a few MB); executors need not have it.
    """
    name = F.lower(F.regexp_replace(F.col(source), r"^\s+|\s+$", ""))
    slim = documents.select(F.col(id).alias("id"), name.alias("source"), F.col(text).alias("text"))
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _encoding(vocabulary.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "tokens": [len(count(t)) if t else 0 for t in b["text"]]})

    kind = slim.schema["id"].dataType.simpleString()
    return busy(slim).mapInPandas(run, f"id {kind}, source string, tokens long")


def budgets(sized: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share", repeats: str = "max_repeats", budget: int | None = None) -> DataFrame:
    """Per target: target (as written), source, share, repeats, size, total, wanted (tokens) and short (whether the cap keeps it below)."""
    listed = targets.select(F.col(source).alias("target"), F.lower(F.regexp_replace(F.col(source), r"^\s+|\s+$", "")).alias("source"), F.col(share).alias("share"), F.col(repeats).alias("repeats")).where("target is not null").distinct()
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("size"))
    known = listed.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    total = known.select("source", "size").distinct().agg(F.sum("size").alias("total") if budget is None else F.lit(budget).cast("long").alias("total"))  # one row
    wanted = known.crossJoin(F.broadcast(total)).withColumn("wanted", F.col("share") * F.col("total"))
    return wanted.withColumn("short", F.col("wanted") > F.col("repeats") * F.col("size"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to the budget as can be found.

    An even share of every length first; the rest, once within the window, is settled exactly over all lengths that are
    left (bounded knapsack on bit sets).
    """
    take = np.zeros(len(lengths), np.int64)
    size = int((lengths * counts).sum())
    if budget <= 0 or size == 0:
        return take
    if budget >= size:
        return counts.copy()
    take = np.floor(counts * (budget / size)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # one more of the longest, while the rest is above the window
        if rest <= window:
            break
        if take[i] < counts[i] and 0 < lengths[i] <= rest:
            take[i] += 1
            rest -= int(lengths[i])
    left = counts - take
    usable = [i for i in np.flatnonzero((left > 0) & (lengths > 0)) if lengths[i] <= 2 * max(rest, 1) + 1]
    capacity = 2 * max(rest, 0) + 1
    mask, reach, stages = (1 << (capacity + 1)) - 1, 1, []
    for i in usable:
        stages.append(reach)
        n, c, step = int(lengths[i]), int(min(left[i], capacity // int(lengths[i]))), 1
        while c > 0:
            step = min(step, c)
            reach |= (reach << (n * step)) & mask
            c -= step
            step *= 2
        if reach >> max(rest, 0) & 1:  # the budget itself is reached
            stages = stages[: len(stages)]
            usable = usable[: len(stages)]
            break
    goal = next((s for d in range(capacity + 1) for s in (rest - d, rest + d) if 0 <= s <= capacity and reach >> s & 1), 0)
    for i, before in zip(reversed(usable[: len(stages)]), reversed(stages)):
        n, used = int(lengths[i]), 0
        while not before >> goal & 1:
            goal -= n
            used += 1
        take[i] += used
    return take


def mix(documents: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: int = 7, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A mix of documents by target shares, and the shares that came out.

    The budget of the mix is the size of all target sources together, or `budget` tokens. First result: target, id,
    tokens, copies (at least 1, at most the target's cap). Second: target, target_share, size, wanted, got (tokens), share
    (of the mix's tokens; null for an empty mix), deviation (share less target_share: where caps keep some sources short,
    the others get the tokens they were to have, which is more than their share of the smaller mix) and short (whether the
    cap kept the source below its share). Sources are compared ignoring
    letter case and outer blanks; null sources and sources without target take no part; targets without documents get
    nothing; null texts count no tokens and come only with whole copies. Nulls in share or cap give that target nothing.
    """
    sized = cut(token_counts(documents, id, text, source, tokenizer))
    plan = budgets(sized, targets, budget=budget).withColumn("aim", F.when(F.col("size") > 0, F.least(F.floor("wanted"), F.col("repeats") * F.col("size"))).otherwise(0)).withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("aim") / F.greatest("size", F.lit(1)))).otherwise(0))
    plan = cut(plan.withColumn("rest", F.col("aim") - F.col("whole") * F.col("size")).where("aim is not null"))  # one row per target
    few = F.broadcast if plan.count() <= BROADCAST_TARGETS else (lambda df: df)
    lengths = sized.groupBy("source", "tokens").agg(F.count("*").alias("n"))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tokens")
        got = fit(group["tokens"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["rest"].iloc[0]))
        return pd.DataFrame({"target": group["target"], "tokens": group["tokens"], "take": got})

    taken = lengths.join(few(plan.select("target", "source", "rest")), "source").groupBy("target").applyInPandas(settle, "target string, tokens long, take long").where("take > 0")  # a group is a histogram of lengths
    bucket = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(BUCKETS))
    ours = sized.join(few(plan.select("target", "source", "whole")), "source").withColumn("bucket", bucket)
    counts = ours.groupBy("target", "tokens", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("target", "tokens").orderBy("bucket")  # at most BUCKETS rows a group
    quota = counts.join(taken, ["target", "tokens"]).withColumn("before", F.sum("n").over(upto) - F.col("n")).where("before < take").select("target", "tokens", "bucket", F.least("n", F.col("take") - F.col("before")).alias("quota"), "n")
    drawn = ours.join(quota, ["target", "tokens", "bucket"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    order = Window.partitionBy("target", "tokens", "bucket").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id")
    ruled = drawn.where(split).withColumn("extra", (F.row_number().over(order) <= F.col("quota")).cast("int"))
    plain = drawn.where(~F.coalesce(split, F.lit(False))).withColumn("extra", (F.col("quota") > 0).cast("int"))
    chosen = plain.unionByName(ruled).select("target", F.col("id").alias(id), "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")
    got = chosen.groupBy("target").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"))
    shares = plan.join(got, "target", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    whole = shares.agg(F.sum("got").alias("all"))  # one row
    shares = shares.crossJoin(F.broadcast(whole)).select("target", F.col("share").alias("target_share"), "size", "wanted", "got", F.when(F.col("all") > 0, F.col("got") / F.col("all")).alias("share"), "short").withColumn("deviation", F.col("share") - F.col("target_share"))
    return chosen, shares
