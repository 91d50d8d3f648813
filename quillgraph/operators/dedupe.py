"""Near-duplicate notes within a document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import band_pairs, overlap, scored, similar_pairs


def note_tokens() -> Column:
    """Words of the quote (two characters or more), topics and names, in lower case, distinct."""
    words = F.filter(F.split(F.lower("quote"), "[^a-z0-9_]+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(words, F.transform("topics", F.lower), F.transform("entities", F.lower)))


def plain_tokens(note: dict) -> frozenset[str]:
    """The same of one note, plainly."""
    words = {w for w in re.split("[^a-z0-9_]+", note["quote"].lower()) if len(w) > 1}
    return frozenset(words | {t.lower() for t in note["topics"]} | {e.lower() for e in note["entities"]})


def similar_notes(notes: DataFrame, threshold: float = 0.9, full: int | None = None) -> DataFrame:
    """doc_id, a, b, score: pairs of notes whose tokens have a Jaccard similarity of `threshold` or more.

    All such pairs, unless `full` is given: then documents of more notes get theirs from MinHash bands, which miss some.
    """
    sets = notes.select("doc_id", "seq", note_tokens().alias("tokens"))

    def score(a: str, b: str) -> Column:
        return overlap("tokens", a, b)

    if full is None:
        return similar_pairs(sets, score, threshold, tokens=threshold)
    sets = sets.withColumn("small", F.count("*").over(Window.partitionBy("doc_id")) <= full)
    found = scored(band_pairs(sets.where("NOT small").select("doc_id", "seq", "tokens")), sets, score, threshold, "tokens")
    return similar_pairs(sets.where("small"), score, threshold, tokens=threshold).unionByName(found)


def components(pairs: DataFrame) -> DataFrame:
    """doc_id, seq, root: the least number that pairs (doc_id, a, b) reach; streamed by document with one entry per note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, up = None, {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def out() -> pa.RecordBatch:
            rows = [(x, root(x)) for x in sorted(up)]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(rows), pa.int64()), pa.array([x for x, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.int32())], ["doc_id", "seq", "root"])

        for batch in batches:
            for doc, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != now:
                    if up:
                        yield out()
                    now, up = doc, {}
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        if up:
            yield out()

    dealt = pairs.select("doc_id", F.col("a").cast("int"), F.col("b").cast("int")).repartition("doc_id").sortWithinPartitions("doc_id", "a", "b")
    return dealt.mapInArrow(run, "doc_id long, seq int, root int")


def merge_duplicates(notes: DataFrame, threshold: float = 0.9, weight: str = "raw_weight", full: int | None = None) -> DataFrame:
    """One note for each group of near-duplicates: the heaviest (the first of equals), with what the others say.

    Its weight is the heaviest's; names are united and sorted; topics, emotions and flags follow in note order after its own.
    full: see similar_notes.
    """
    found = components(similar_notes(notes, threshold, full))
    grouped = notes.join(found, ["doc_id", "seq"], "left").withColumn("root", F.coalesce("root", "seq"))
    lead = Window.partitionBy("doc_id", "root")
    best = F.max_by("seq", F.struct(F.col(weight), -F.col("seq"))).over(lead)
    grouped = grouped.withColumn("rep", best)
    parts = F.array_sort(F.collect_list(F.struct((F.col("seq") != F.col("rep")).alias("other"), "seq", "entities", "topics", "emotions", "flags")))
    said = grouped.groupBy("doc_id", "rep").agg(parts.alias("p"))

    def united(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("p", lambda x: x[name])))

    said = said.select("doc_id", F.col("rep").alias("seq"), F.array_sort(united("entities")).alias("entities"), *[united(n).alias(n) for n in ("topics", "emotions", "flags")])
    own = notes.drop("entities", "topics", "emotions", "flags")
    return own.join(said, ["doc_id", "seq"]).select(*notes.columns)
