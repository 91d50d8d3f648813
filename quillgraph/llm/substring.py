"""Substring deduplication by a relative Lempel-Ziv parse.

The reference of a place is the text before it (documents by id, words in order), in which every window of `least` words
counts once, at its earliest place. It is indexed in blocks: a window has an anchor, the smallest hash among the
`least` // 2-grams in it, and a block holds all windows whose anchors fall in its range. Equal windows have equal anchors,
so a window's earlier place is in its block. Each block matches a document's windows with earlier ones.

Matches on one diagonal (at one distance between document and reference) whose words touch are one stretch, as all its
words are equal; so stretches grow across blocks. A document is then parsed greedily: from the first place that a stretch
reaches with `least` words or more, the factor follows the longest stretch to its end, and the parse goes on behind it.
Windows across a factor's end, which are in none, are checked on their own: the stretch that reaches farthest from before
the end gives a boundary factor. Words in factors are duplicates; together these are all words in a recurring window.

The reference keeps one place of each window (a task that sees equal windows itself takes the earliest it sees), so a
factor may be shorter than the longest match at any earlier place: all places would grow with the square of a group of copies.

Only anchors that occur twice matter. A first pass over the texts counts anchors by hash range and leaves a bit map of
those that recur (a bit may be set wrongly, which costs traffic and no result). The second pass gives out the windows at
recurring anchors; of equal windows each task sends on the earliest, as the others have that one in front of them. Windows at
a hot anchor (in a line that a third of the documents may hold) are dealt out by their own hashes instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, dealt, grams, mix, read, tasks_for

#: Bits of the map of recurring anchors for one scan task's share of the input, and at most.
BITS_A_TASK, MOST_BITS = 1 << 23, 1 << 29

#: Windows that a task holds before it gives out what it has.
HELD = 600_000

#: Anchors this common are hot; at most so many of them, the commonest, are known to the tasks.
HOT, MOST_HOT = 512, 65_536

FACTOR = np.dtype([("start", "<i8"), ("words", "<i8"), ("ref_doc", "<i8"), ("ref_start", "<i8")])

#: A factor as it is told: boundary factors reach over the end of a greedy one.
TOLD = "struct<start:long,words:long,ref_doc_id:long,ref_start:long,boundary:boolean>"


def anchors(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all short n-grams, and for each window of `least` words the place of its anchor (the first with the smallest hash).

    The smallest of some hashes is small, so keys are mixed anew; their high bits deal anchors out evenly.
    """
    short = least // 2
    g = grams(words, short, seed=3)
    view = sliding_window_view(g, least - short + 1)
    return mix(g + np.uint64(0x9E3779B97F4A7C15)), view.argmin(axis=1) + np.arange(len(view))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket, of rows sorted by it; one bucket is held at a time."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if rows:
                    yield now, rows
                now, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield now, rows


def hashed(text: str | None, hashes: WordHash) -> np.ndarray:
    return hashes.of(text.encode("utf-8", "surrogatepass").split()) if text else np.zeros(0, np.uint64)


def _bits(docs: DataFrame) -> tuple[int, int]:
    """Bits of the blocks' numbers (several blocks for each scan task, so that they deal out evenly) and of the map."""
    tasks = (tasks_for(docs) - 1).bit_length()
    return max(8, tasks + 3), min(MOST_BITS, BITS_A_TASK << tasks).bit_length() - 1


def recurring(texts: DataFrame, least: int, bucket_bits: int, map_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit map over the top `map_bits` bits of anchor hashes, set where an anchor occurs more than once; and the hot anchors."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHash(), [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(h >> np.uint64(64 - bucket_bits), np.arange((1 << bucket_bits) + 1))
            full = np.flatnonzero(np.diff(cuts))
            blobs, often = [], []
            for b in full.tolist():
                part, count = h[cuts[b] : cuts[b + 1]], n[cuts[b] : cuts[b + 1]]
                blobs.append(np.concatenate([part, part[count > 1]]).tobytes())  # each anchor once, or twice if it recurs here
                many = count >= 16
                often.append(np.stack([part[many], count[many].astype(np.uint64)]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), pa.array(often, pa.binary())], ["bucket", "blob", "often"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch[0].slice(at, 256).to_pylist():
                    words = hashed(text, hashes)
                    if len(words) < least:
                        continue
                    g, place = anchors(words, least)
                    held.append(g[np.unique(place)])
                    size += len(held[-1])
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            h = np.sort(np.concatenate([np.frombuffer(r["blob"], np.uint64) for r in rows]))
            h = h[1:][h[1:] == h[:-1]]
            bits = np.zeros(1 << (map_bits - bucket_bits), bool)
            bits[(h >> np.uint64(64 - map_bits) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            many = np.concatenate([np.frombuffer(r["often"], np.uint64).reshape(2, -1) for r in rows], axis=1)
            keys, at = np.unique(many[0], return_inverse=True)
            count = np.bincount(at, many[1].astype(np.float64), len(keys)).astype(np.int64)
            best = np.argsort(-count, kind="stable")[:MOST_HOT]
            hot = np.stack([keys[best].view(np.int64), count[best]])[:, count[best] >= HOT]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([hot.tobytes()], pa.binary())], ["bucket", "blob", "often"])

    schema = "bucket int, blob binary, often binary"
    whole = np.zeros((1 << bucket_bits, 1 << (map_bits - bucket_bits - 3)), np.uint8)
    hot = np.zeros((2, 0), np.int64)
    counted = dealt(texts.select("text").mapInArrow(send, schema), texts, "bucket").sortWithinPartitions("bucket")
    for r in counted.mapInArrow(mark, schema).toLocalIterator():  # at most MOST_BITS together, and MOST_HOT anchors at a time
        whole[r["bucket"]] = np.frombuffer(r["blob"], np.uint8)
        hot = np.concatenate([hot, np.frombuffer(r["often"], np.int64).reshape(2, -1)], axis=1)
        hot = hot[:, np.lexsort((hot[0], -hot[1]))[:MOST_HOT]]
    return whole.ravel(), np.sort(hot[0].view(np.uint64))


def _runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, least: int) -> pa.RecordBatch:
    """Later windows with the earlier place of each, as stretches; one row per document."""
    order = np.lexsort((start, key, doc))
    doc, key, start, ref_doc, ref_start = (x[order] for x in (doc, key, start, ref_doc, ref_start))
    new_doc = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])[: len(doc)]
    new = new_doc | np.concatenate([[True], (start[1:] != start[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_start[1:] != ref_start[:-1] + 1)])[: len(doc)]
    at = np.flatnonzero(new)
    factors = np.zeros(len(at), FACTOR)
    factors["start"], factors["words"] = start[at], np.diff(np.concatenate([at, [len(doc)]])) + least - 1
    factors["ref_doc"], factors["ref_start"] = ref_doc[at], ref_start[at]
    first = np.flatnonzero(new_doc[at])
    blobs = [x.tobytes() for x in np.split(factors, first[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), -1), pa.int32()), pa.array(doc[at[first]], pa.int64()), pa.array(key[at[first]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "doc_id", "text_key", "blob"]
    )


def _later(anchor: np.ndarray, window: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the index of the earliest equal one, and which ones have it truly before them."""
    order = np.lexsort((start, doc, window, anchor))
    a, w = anchor[order], window[order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])[: len(a)]
    earliest = np.empty(len(order), np.int64)
    earliest[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return earliest, (doc[earliest] != doc) | (start[earliest] != start)


def stretches(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), stretches: binary rows of FACTOR, not yet joined across blocks.

    Each row has some of a document's matches of at least `least` words and the earlier place each copies.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"))
    bucket_bits, map_bits = _bits(texts)
    told = docs.sparkSession.sparkContext.broadcast(recurring(texts, least, bucket_bits, map_bits))
    schema = "bucket int, doc_id long, text_key long, blob binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (known, hot) = WordHash(), told.value
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            anchor, window, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            earliest, later = _later(anchor, window, doc, start)
            if later.any():
                src = earliest[later]
                yield _runs(doc[later], key[later], start[later], doc[src], start[src], least)
            # the earliest ones go on, by their anchors' block
            keep = np.flatnonzero(earliest == np.arange(len(doc)))
            same = np.flatnonzero(~later & (earliest != np.arange(len(doc))))  # rows that repeat a doc_id and a place
            keep = np.concatenate([keep, same])
            by = np.where(np.isin(anchor[keep], hot), window[keep], anchor[keep]) if len(hot) else anchor[keep]
            bucket = (by >> np.uint64(64 - bucket_bits)).astype(np.int64)
            order = np.lexsort((start[keep], key[keep], doc[keep], bucket))
            keep, bucket = keep[order], bucket[order]
            head = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (doc[keep][1:] != doc[keep][:-1]) | (key[keep][1:] != key[keep][:-1]) | (anchor[keep][1:] != anchor[keep][:-1]) | (start[keep][1:] != start[keep][:-1] + 1)])
            at = np.flatnonzero(head)
            count = np.diff(np.concatenate([at, [len(keep)]]))
            cuts = np.searchsorted(bucket[at], np.arange((1 << bucket_bits) + 1))
            ends = np.concatenate([at, [len(keep)]])
            full = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = []
            for b in full:
                runs = at[cuts[b] : cuts[b + 1]]
                rows = keep[runs]
                parts = (anchor[rows].view(np.int64), doc[rows], key[rows], start[rows], count[cuts[b] : cuts[b + 1]], window[keep[ends[cuts[b]] : ends[cuts[b + 1]]]].view(np.int64))
                blobs.append(np.concatenate([[len(runs)], *parts]).astype("<i8").tobytes())
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), none, none, pa.array(blobs, pa.binary())], ["bucket", "doc_id", "text_key", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, doc, key in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = hashed(text, hashes)
                    if len(words) < least:
                        continue
                    g, place = anchors(words, least)
                    bit = (g >> np.uint64(64 - map_bits)).astype(np.int64)
                    start = np.flatnonzero((known[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)[place])
                    if len(start):
                        held.append((g[place[start]], grams(words, least, seed=5)[start], np.full(len(start), doc), np.full(len(start), key), start))
                        size += len(start)
                    if size >= HELD:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
        x = np.frombuffer(blob, "<i8")
        n = int(x[0])
        anchor, doc, key, start, count = (x[1 + i * n : 1 + (i + 1) * n] for i in range(5))
        past = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(anchor, count), x[1 + 5 * n :], np.repeat(doc, count), np.repeat(key, count), np.repeat(start, count) + past

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = pa.compute.less(batch[0], 0)
                if (ready := batch.filter(done)).num_rows:
                    settled.append(ready)
                yield batch.filter(pa.compute.invert(done))

        settled: list[pa.RecordBatch] = []
        for _, rows in by_bucket(blocks()):
            while settled:
                yield settled.pop()
            anchor, window, doc, key, start = (np.concatenate(x) for x in zip(*(unpacked(r["blob"]) for r in rows), strict=True))
            earliest, later = _later(anchor, window, doc, start)
            if later.any():
                src = earliest[later]
                yield _runs(doc[later], key[later], start[later], doc[src], start[src], least)
        yield from settled

    sent = texts.mapInArrow(send, schema)
    # what is settled already is dealt out by document, the rest by block
    to = F.when(F.col("bucket") < 0, F.xxhash64("doc_id")).otherwise(F.col("bucket").cast("long"))
    found = dealt(sent.withColumn("to", to), texts, "to").sortWithinPartitions("bucket").select("bucket", "doc_id", "text_key", "blob").mapInArrow(look_up, schema)
    return found.select("doc_id", "text_key", F.col("blob").alias("stretches"))


def joined(blobs: list[bytes] | None) -> np.ndarray:
    """A document's stretches by start; those on one diagonal whose words overlap or touch are one."""
    if not blobs:
        return np.zeros(0, FACTOR)
    f = np.concatenate([np.frombuffer(b, FACTOR) for b in blobs])
    shift = f["start"] - f["ref_start"]
    order = np.lexsort((f["start"], shift, f["ref_doc"]))
    f, shift = f[order], shift[order]
    end = f["start"] + f["words"]
    new = np.concatenate([[True], (f["ref_doc"][1:] != f["ref_doc"][:-1]) | (shift[1:] != shift[:-1])])
    for i in np.flatnonzero(~new).tolist():
        if f["start"][i] > end[i - 1]:
            new[i] = True
        else:
            end[i] = max(end[i], end[i - 1])
    head = np.flatnonzero(new)
    out = f[head].copy()
    out["words"] = end[np.concatenate([head[1:] - 1, [len(f) - 1]])] - out["start"]
    return np.sort(out, order=("start", "words", "ref_doc", "ref_start"))


def parse(stretches: np.ndarray, least: int) -> list[tuple[int, int, int, int, bool]]:
    """The greedy parse along the stretches: (start, words, ref_doc, ref_start, boundary) of each factor, in order.

    From a place, the stretch that reaches farthest is followed (of equal ones that of the smaller document and place).
    Behind a factor's end the next begins where a stretch reaches `least` words on; if words before that are still in a
    window across the end, a boundary factor from the first such window on covers them.
    """
    rows = stretches.tolist()
    out: list[tuple[int, int, int, int, bool]] = []
    open_: list[tuple[int, int, int, int]] = []  # heap: -end, ref_doc, ref_start - start, start
    at = done = 0
    while done < len(rows) or open_:
        while done < len(rows) and rows[done][0] <= at:
            start, words, doc, ref = rows[done]
            heapq.heappush(open_, (-start - words, doc, ref - start, start))
            done += 1
        if open_ and -open_[0][0] >= at + least:
            end, doc, shift, _ = open_[0]
            out.append((at, -end - at, doc, at + shift, False))
            at = -end
            continue
        if open_ and out and -open_[0][0] > at:
            end, doc, shift, start = open_[0]
            first = max(start, at - least + 1)
            out.append((first, -end - first, doc, first + shift, True))
        open_ = []
        if done < len(rows):
            at = rows[done][0]
    return out


def remove_repeats(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, factors (TOLD: the parse's, and whether at a boundary).

    A word goes if it is in a window of `least` words whose sequence also starts earlier: in a document with a smaller id,
    or before in the same one. Words are runs without ASCII blanks, unchanged. Null texts have no words. Rows with a null
    doc_id have no place in the order: they are kept whole and shadow nothing. Rows that repeat a doc_id start at the same
    places, so neither is before the other. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    found = stretches(docs, least).groupBy("doc_id", "text_key").agg(F.collect_list("stretches").alias("stretches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, counts, gone, spans = [], [], [], []
                for text, blobs in zip(part[1].to_pylist(), part[2].to_pylist(), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split() if text else []
                    own = parse(joined(blobs), least)
                    kept, end = [], 0
                    for start, n, *_ in own:
                        kept += words[end:start]
                        end = max(end, start + n)
                    kept += words[end:]
                    texts.append(b" ".join(kept))
                    counts.append(len(words))
                    gone.append(len(words) - len(kept))
                    spans.append([dict(zip(("start", "words", "ref_doc_id", "ref_start", "boundary"), f, strict=True)) for f in own])
                kind = pa.list_(pa.struct([*((k, pa.int64()) for k in ("start", "words", "ref_doc_id", "ref_start")), ("boundary", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [part[0], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)],
                    ["doc_id", "text", "n_words", "n_removed", "factors"],
                )

    both = rows.join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "stretches")
    return both.mapInArrow(run, f"doc_id long, text string, n_words long, n_removed long, factors array<{TOLD}>")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), least=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
