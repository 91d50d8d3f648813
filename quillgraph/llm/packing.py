"""Best-fit packing of tokenised documents by minimum bin slack.

A plan depends on how many pieces there are of each length, and on nothing else. So the driver sees a
histogram of at most `capacity` rows. It repeats: take the longest length left, find by a bitset
subset-sum over the lengths that remain the fullest combination that goes with it, and use that
combination as often as the counts allow. Pieces find their place by their rank within their length;
ranks come from counts by task, so no window runs over all pieces of one (maybe hot) length.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import arrow_pass, read, stored

#: Plans and task counts are sent to the executors up to this many rows; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: The pattern tables of the two tokenizer libraries are known to agree below this code point (tested).
SAME_BELOW = 0x250


def encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """text -> ids of tokenizers' `name`.json with add_special_tokens=False.

    tiktoken reads the same vocabulary and is four times faster, so it takes the texts of Latin letters
    without a special token's string; tokenizers itself takes all others.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def encode(text: str) -> list[int]:
        if not text:
            return []
        if ord(max(text)) < SAME_BELOW and "<|" not in text:
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces of it in each bin), ...]), ...] that together use up `counts`."""
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        order = sorted(left, reverse=True)
        first = order[0]
        room = capacity - first
        reach, full = 1, (1 << (room + 1)) - 1
        steps = []
        for n in order:
            if n > room:
                continue
            c = min(left[n] - (n == first), room // n)
            take = 1
            while c > 0 and not reach >> room & 1:
                k = min(take, c)
                steps.append((n, k, reach))
                reach |= (reach << (n * k)) & full
                c -= k
                take *= 2
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        used = {first: 1}
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                used[n] = used.get(n, 0) + k
                at -= n * k
        bins = min(left[n] // k for n, k in used.items())
        plan.append((bins, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """Runs of ranks: pieces of `length` ranked from `rank` on go `each` to a sequence, from `sequence` on, at `offset`."""
    rows, next_rank, sequence = [], {}, 0
    for bins, used in plan:
        offset = 0
        for n, k in used:
            rows.append((n, next_rank.get(n, 0), sequence, k, offset))
            next_rank[n] = next_rank.get(n, 0) + bins * k
            offset += n * k
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """One row per piece, with the task that made it and its rank among that task's pieces of its length."""

    def make():
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "tokens": pa.binary(), "local": pa.int64()}
            out: dict[str, list] = {c: [] for c in kinds}
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                at, piece, size = 0, 0, len(ids) % capacity or capacity
                while at < len(ids):
                    for c, v in zip(out, (doc, piece, at, size, ids[at : at + size].tobytes(), seen.get(size, 0)), strict=True):
                        out[c].append(v)
                    seen[size] = seen.get(size, 0) + 1
                    at, piece, size = at + size, piece + 1, capacity
            out["part"] = [part] * len(out["piece"])
            return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

        return work

    return arrow_pass(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, tokens binary, local long, part long")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Packs documents into sequences of at most `capacity` tokens.

    A document is its ids and `end_id`; a null or empty text is `end_id` alone. Longer ones are cut: all pieces but the
    first have `capacity` tokens. Returns doc_id, piece, start, length, tokens (ids as little-endian unsigned 32-bit numbers;
    ids_of() makes arrays of them), sequence_id, offset. A null doc_id stays
    null; repeated rows are packed as often as they come; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, end_id, tokenizer), "pieces")
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places(bin_plan(counts, capacity))
    starts = {n: tuple(g[c].to_numpy() for c in ("rank", "sequence", "each", "offset")) for n, g in runs.groupby("length")}
    told = spark.sparkContext.broadcast(starts)  # at most a few runs for each of `capacity` lengths

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for size in np.unique(n):
            here = np.flatnonzero(n == size)
            first, start, each, at = told.value[int(size)]
            run = np.searchsorted(first, r[here], "right") - 1
            past = r[here] - first[run]
            sequence[here] = start[run] + past // each[run]
            offset[here] = at[run] + past % each[run] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    small = by_task.count() <= BROADCAST_ROWS
    ranked = cut.join(F.broadcast(base) if small else base, ["part", "length"])
    ranked = ranked.withColumn("at", place("length", F.col("base") + F.col("local")))
    return ranked.select("doc_id", "piece", "start", "length", "tokens", "at.sequence_id", "at.offset")


def ids_of(tokens: str = "tokens") -> Column:
    """Arrays of the ids in a binary column."""
    ids = F.pandas_udf(lambda b: b.map(lambda x: np.frombuffer(x, "<u4").astype(np.int32)), ArrayType(IntegerType()))
    return ids(tokens)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")
