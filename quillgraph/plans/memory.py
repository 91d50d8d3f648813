"""From corpora to memories: the whole pipeline, merging, and memories from text."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildOptions, InjectOptions, RecallOptions
from ..functions import annotate
from ..functions.text import newlines, note_id, trimmed
from ..operators import conflicts as conflict_ops
from ..operators import context, dedupe, links, search, segment, weights
from ..sources import codec

#: Texts shorter than this make no meaningful memory.
SHORT = 40

NOTE = ["doc_id", "seq", "id", "entities", "topics", "quote", "weight", "emotions", "flags", "source_start", "source_end", "resolved_date"]


#: What a note says, and what that is.
KINDS = {f.split(" ")[0]: f.split(" ")[1] for f in segment.NOTE_FIELDS.split(", ") if f.split(" ")[0] in annotate.PARTS and f != "body string"}
PARTS = tuple(KINDS)


@dataclass(frozen=True)
class Memory:
    """A corpus's memories as tables keyed by doc_id; all lazy. A context manager: close() lets go of rows that build holds.

    notes: NOTE; links: from_id, to_id, label, score; codes: name, code; meta: input_length, chunk_count, date, title,
    warnings, source; conflicts: earlier, later, shared_topic, signal, summary.
    """

    notes: DataFrame
    links: DataFrame
    codes: DataFrame
    meta: DataFrame
    conflicts: DataFrame | None = None
    held: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        for rows in self.held:
            rows.unpersist()

    def __enter__(self) -> Memory:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def sources(self) -> DataFrame:
        return self.meta.where("source IS NOT NULL").select("doc_id", F.col("source").alias("text"))

    def recall(self, questions: DataFrame, options: RecallOptions = RecallOptions()) -> DataFrame:
        return search.recall(self.notes, questions, self.links, options, self.sources)

    def recall_context(self, questions: DataFrame, options: RecallOptions = RecallOptions(), max_tokens: int | None = None, sources: DataFrame | None = None) -> DataFrame:
        """`sources` changes what is shown, not what is found."""
        shown = self.sources if sources is None else sources
        return context.recall_context(self.recall(questions, options), self.notes, shown, max_tokens)

    def inject(self, options: InjectOptions = InjectOptions()) -> DataFrame:
        return context.inject(self.notes, self.links, self.codes, self.meta, options)

    def wake_up(self, share: float = 0.15) -> DataFrame:
        return context.wake_up(self.notes, share)

    def top_notes(self, n: int) -> DataFrame:
        return context.top_notes(self.notes, n)

    def encode(self) -> DataFrame:
        return codec.encode(self.notes, self.links, self.codes, self.meta)


def build(corpus: DataFrame, options: BuildOptions = BuildOptions(), hold: bool = True, parts: tuple[str, ...] = PARTS) -> Memory:
    """corpus: doc_id, text and, if there, date and title. One memory per document.

    Notes come from one narrow pass; codes, links and weights are shuffled by doc_id. hold keeps the pass's rows, the links
    and the notes, which several tables read, until the memory is closed. parts: what notes shall say; what is not asked for is
    null and not made, and tables made of it are of no use.
    """
    for name in ("date", "title"):
        if name not in corpus.columns:
            corpus = corpus.withColumn(name, F.lit(None).cast("string"))
    raw = segment.with_ids(segment.annotate_notes(corpus, options.notes, parts))
    raw = raw.withColumns({c: F.lit(None).cast(kind) for c, kind in KINDS.items() if c not in parts})
    held: list[DataFrame] = []

    def kept(rows: DataFrame) -> DataFrame:
        if not hold:
            return rows
        held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    raw = kept(raw)
    codes = segment.entity_codes(raw)
    counts = raw.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    if options.dedupe:
        raw = dedupe.merge_duplicates(raw, options.dedupe_threshold, full=options.full)
    tied = kept(links.build_links(raw, codes, options.link_threshold, options.link_top_k, options.verbose_labels, options.full))
    notes = kept(weights.normalize_weights(weights.blend_centrality(raw, tied, "raw_weight"), options.temperature).select(*NOTE))
    short = F.length(trimmed("text"))
    warning = F.when((short < SHORT) & (F.coalesce("chunk_count", F.lit(0)) > 0), F.array(F.concat(F.lit("input is "), short, F.lit(" chars: too short for a meaningful memory"))))
    source = newlines("text") if options.keep_source else F.lit(None).cast("string")
    meta = corpus.join(counts, "doc_id", "left").select("doc_id", F.length("text").alias("input_length"), F.coalesce("chunk_count", F.lit(0)).cast("int").alias("chunk_count"), "date", "title", warning.alias("warnings"), source.alias("source"))
    found = conflict_ops.conflicts(notes, meta.where("source IS NOT NULL").select("doc_id", F.col("source").alias("text")) if options.keep_source else None)
    return Memory(notes, tied, codes, meta, found, tuple(held))


def merge(memory: Memory, groups: DataFrame) -> Memory:
    """Memories united: groups has doc_id, group_id and, in the order to be kept, position.

    Notes are numbered anew, names coded anew, links and weights made anew by the defaults; places in sources are dropped,
    as are dates, titles, warnings and conflicts. The result's doc_id is the group_id.
    """
    rows = memory.notes.join(groups.select("doc_id", "group_id", "position"), "doc_id")
    seq = F.row_number().over(Window.partitionBy("group_id").orderBy("position", "doc_id", "seq"))
    rows = rows.withColumn("seq", seq).withColumn("doc_id", F.col("group_id")).withColumn("id", note_id("seq"))
    rows = rows.select("doc_id", "seq", "id", "entities", "topics", "quote", "weight", "emotions", "flags", "resolved_date")
    names = memory.codes.join(groups.select("doc_id", "group_id"), "doc_id").select(F.col("group_id").alias("doc_id"), F.array("name").alias("entities"))
    codes = segment.entity_codes(names)
    tied = links.build_links(rows, codes)
    notes = weights.normalize_weights(weights.blend_centrality(rows, tied))
    none = F.lit(None).cast("int")
    notes = notes.withColumn("source_start", none).withColumn("source_end", none).select(*NOTE)
    lengths = memory.meta.join(groups, "doc_id").groupBy(F.col("group_id").alias("doc_id")).agg(F.sum("input_length").alias("input_length"))
    counts = notes.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    text = F.lit(None).cast("string")
    meta = lengths.join(counts, "doc_id", "left").select("doc_id", "input_length", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), text.alias("date"), text.alias("title"), F.lit(None).cast("array<string>").alias("warnings"), text.alias("source"))
    return Memory(notes, tied, codes, meta)


def decode(texts: DataFrame, strict: bool = False) -> Memory:
    """Memories from their text form (doc_id, text)."""
    rows = codec.decode_rows(texts, strict)
    notes = rows.select("doc_id", F.inline("notes")).withColumn("resolved_date", F.lit(None).cast("string")).select(*NOTE)
    # a text's links keep their order
    tied = rows.select("doc_id", F.posexplode("links").alias("at", "tie")).select("doc_id", "tie.*", (-F.col("at")).cast("double").alias("score"))
    codes = rows.select("doc_id", F.inline("codes"))
    meta = rows.select("doc_id", "input_length", F.size("notes").alias("chunk_count"), "date", "title", F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"), F.lit(None).cast("string").alias("source"))
    return Memory(notes, tied, codes, meta)


def with_notes(memory: Memory, notes: DataFrame) -> Memory:
    return replace(memory, notes=notes)


__all__ = ["Memory", "build", "decode", "merge", "with_notes"]
