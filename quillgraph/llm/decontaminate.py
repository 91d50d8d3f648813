"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `least` words that a document shares with an item. For each pair with a seed, the longest
common runs of words that don't overlap runs marked before are marked, again and again, until none of `least`
words is left (running Karp-Rabin: lengths to look for fall, runs are found by rolling hashes and checked word
by word). The share of the item's words in marked runs, wherever they stand in the document, decides; so
passages in another order count like those in the old one.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, grams, read

WORD = re.compile(r"[^\W_]+")

#: Letters of scripts without blanks between words: Thai and Lao, Tibetan, Myanmar, Khmer, kana and Han.
UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
ANY_UNSPACED, LETTER_OR_WORD = re.compile(f"[{UNSPACED}]"), re.compile(f"(?=[{UNSPACED}])[^\\W_]|[^\\W_{UNSPACED}]+")

#: Words of the shortest run that counts, and the share of an item's words that makes a document contaminated.
LEAST, COVER = 4, 0.5

#: Words of the items that are matched in one pass over the documents. A larger benchmark is taken block by block.
BLOCK_WORDS = 2_000_000

SCHEMA = "doc_id long, item_id long, covered long, item_words long, coverage double, tiles array<struct<doc_start:long,item_start:long,length:long>>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; letters of unspaced scripts each count as a word."""
    text = (text or "").lower()
    return (WORD if text.isascii() or not ANY_UNSPACED.search(text) else LETTER_OR_WORD).findall(text)


def _open(free: np.ndarray, n: int) -> np.ndarray:
    """Places from which n words are unmarked."""
    total = np.concatenate([[0], np.cumsum(free)])
    return total[n:] - total[:-n] == n


def _shared(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes of a's runs of n words, and the unmarked places in a and in b whose hash the other has unmarked too."""
    if n > min(len(a), len(b)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ha, hb = grams(a.astype(np.uint64), n), grams(b.astype(np.uint64), n)
    at_a, at_b = np.flatnonzero(_open(free_a, n)), np.flatnonzero(_open(free_b, n))
    at_a = at_a[np.isin(ha[at_a], hb[at_b])]
    return ha, at_a, at_b[np.isin(hb[at_b], ha[at_a])]


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word numbers: (place in a, place in b, length), longest first.

    Each round finds the length of the longest runs that both have unmarked (by halving, as what has a run of n words has
    one of n - 1) and marks such runs from the first place in a on, each with the first place left in b. Lengths fall from
    round to round, so there are no more rounds than lengths that fit into the shorter sequence together. A round looks at
    places, not at pairs of places: words that repeat many times cost no more than others.
    """
    free_a, free_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    tiles = []
    most = min(len(a), len(b))
    while True:
        low, high = least - 1, most
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(_shared(a, b, free_a, free_b, n)[1]) else (low, n - 1)
        if low < least:
            return tiles
        n = low
        ha, at_a, at_b = _shared(a, b, free_a, free_b, n)
        hb = grams(b.astype(np.uint64), n)
        queues: dict[int, deque[int]] = defaultdict(deque)
        for j in at_b.tolist():
            queues[int(hb[j])].append(j)
        done = 0
        for i in at_a.tolist():
            if i < done:
                continue
            queue = queues[int(ha[i])]
            while queue and not free_b[queue[0] : queue[0] + n].all():
                queue.popleft()
            if queue and np.array_equal(a[i : i + n], b[queue[0] : queue[0] + n]):
                j = queue.popleft()
                free_a[i : i + n] = free_b[j : j + n] = 0
                tiles.append((i, j, n))
                done = i + n
        most = n - 1


class Items:
    """A block of items: their words as numbers from 1 on, and which items hold each seed."""

    def __init__(self, items: list[tuple[int, str | None]], least: int) -> None:
        self.least, self.numbers = least, {}
        self.ids, self.words = [], []
        seeds = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            own = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
            if len(own) < least:
                continue
            for h in grams(own.astype(np.uint64), least).tolist():
                seeds[h].add(len(self.ids))
            self.ids.append(item)
            self.words.append(own)
        self.seeds = dict(seeds)
        self.keys = np.sort(np.fromiter(seeds, np.uint64, len(seeds)))

    def scan(self, text: str | None, cover: float) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(item, words covered, words, tiles) of the items that the text covers enough."""
        words = words_of(text)
        if len(words) < self.least or not len(self.keys):
            return
        get = self.numbers.get
        own = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        h = grams(own.astype(np.uint64), self.least)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == h)
        places = defaultdict(list)
        for p in hits.tolist():
            for item in self.seeds[int(h[p])]:
                places[item].append(p)
        for item, starts in places.items():
            words_b = self.words[item]
            if len(starts) + (self.least - 1) * len(starts) < cover * len(words_b):
                continue  # even apart, the seeds can't cover enough
            # only words in seeds can be in tiles: keep these, with a gap (-1) between stretches
            inside = np.unique((np.array(starts)[:, None] + np.arange(self.least)).ravel())
            cuts = np.flatnonzero(np.diff(inside) > 1) + 1
            parts = np.split(inside, cuts)
            back = np.concatenate([x for p in parts for x in (p, [-1])])
            a = np.where(back >= 0, own[back], -1)
            tiles = tile(a, words_b, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= cover * len(words_b):
                yield item, covered, len(words_b), [(int(back[i]), j, n) for i, j, n in sorted(tiles)]


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about `block_words` words, as the driver reads them one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(words_of(row[1]))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item that it covers to at least `cover`: the words covered and the tiles.

    Words are runs of letters and digits, in lower case, and single letters of scripts without blanks. Items of fewer than
    `least` words, null and empty texts match nothing. Null ids stay. Repeated rows each get their rows, of documents and of
    items; an empty table on either side gives no rows. The benchmark is the query set: it goes to the executors in blocks
    of bounded size, and each block is one narrow pass over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in blocks(benchmark, block_words):
        told = spark.sparkContext.broadcast(block)

        def make(told=told):
            items = Items(told.value, least)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                found = []
                for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    for item, covered, n, tiles in items.scan(text, cover):
                        spans = [{"doc_start": i, "item_start": j, "length": k} for i, j, k in tiles]
                        found.append({"doc_id": doc, "item_id": items.ids[item], "covered": covered, "item_words": n, "coverage": covered / n, "tiles": spans})
                if not found:
                    return None
                span = pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())])
                kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(span))]
                return pa.RecordBatch.from_pylist(found, pa.schema(kinds))

            return work

        part = arrow_pass(rows, make, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, that cover no item enough: a pass over the documents for each block of items.

    Null and empty texts stay, as do all rows if there is no item; repeated rows stay or go together; ids take no part.
    """
    spark = docs.sparkSession
    for block in blocks(benchmark, block_words):
        told = spark.sparkContext.broadcast(block)

        def make(told=told):
            items = Items(told.value, least)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch[batch.schema.get_field_index("text")].to_pylist()
                return batch.filter(pa.array([next(items.scan(t, cover), None) is None for t in texts], pa.bool_()))

            return work

        docs = arrow_pass(docs, make, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items and the tiles that show it."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
