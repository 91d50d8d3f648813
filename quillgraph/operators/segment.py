"""Passages, notes and names from texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import annotate
from ..functions.annotate import Options
from ..functions.text import name_code, note_id
from .passes import each

NOTE_FIELDS = (
    "seq int, entities array<string>, topics array<string>, quote string, raw_weight double, emotions array<string>, "
    "flags array<string>, source_start int, source_end int, resolved_date string, body string"
)

#: Bytes for each core below which a corpus is dealt out anew, and of a task where every corpus is.
SMALL = 4 << 20


def _lines(text: str | None) -> str:
    return re.sub(r"\r\n?", "\n", text or "")


def paragraphs(corpus: DataFrame) -> DataFrame:
    """doc_id, idx, para_start, para_end, text: paragraphs parted by blank lines, without white space at their ends."""

    def of(text: str | None) -> list[tuple]:
        text = _lines(text)
        return [(i, s, e, text[s:e]) for i, (s, e) in enumerate(annotate.paragraphs(text))]

    return each(corpus.select("doc_id", "text"), ["doc_id"], of, "idx int, para_start int, para_end int, text string")


def chunks(corpus: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """doc_id, idx, char_start, char_end, text: whole paragraphs gathered up to `size` characters."""

    def of(text: str | None) -> list[tuple]:
        text = _lines(text)
        return [(i, s, e, text[s:e]) for i, (s, e) in enumerate(annotate.passages(text, size, overlap))]

    return each(spread(corpus.select("doc_id", "text")), ["doc_id"], of, "idx int, char_start int, char_end int, text string")


def spread(corpus: DataFrame, always: bool = False) -> DataFrame:
    """A corpus that is small by the optimiser's estimate is dealt out over the cores; others stay as they lie. Nothing is run.

    always: larger ones are dealt out too, in tasks of about SMALL bytes, as work that takes seconds a megabyte should not
    depend on how many row groups the corpus lies in.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    size = int(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < SMALL * cores:
        return corpus.repartition(4 * cores)
    return corpus.repartition(max(4 * cores, min(size // SMALL, 4096))) if always else corpus


def annotate_notes(corpus: DataFrame, options: Options = Options(), wanted: tuple[str, ...] = annotate.PARTS) -> DataFrame:
    """The notes of each text with names, topics, quote, signals, dates and raw weight, in one narrow Arrow pass.

    corpus: doc_id, text and, if there, date. A null or blank text has no notes. wanted: the columns of annotate.PARTS to
    make; others are not there.
    """
    fields = [f for f in NOTE_FIELDS.split(", ") if (name := f.split(" ")[0]) in wanted or name not in annotate.PARTS]
    when = F.col("date").cast("string") if "date" in corpus.columns else F.lit(None).cast("string")

    def of(text: str | None, day: str | None) -> list[tuple]:
        return [tuple(n.values()) for n in annotate.notes(text, day, options, wanted)] if text else []

    return each(spread(corpus.select(F.col("doc_id").cast("long"), "text", when.alias("date")), always=True), ["doc_id"], of, ", ".join(fields))


def entity_codes(notes: DataFrame) -> DataFrame:
    """doc_id, name, code. Names in order take the code of their letters; later ones its first two and a number."""
    names = notes.select("doc_id", F.explode("entities").alias("name")).distinct().withColumn("base", name_code("name"))
    first = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("name")) == 1
    names = names.withColumn("first", first).withColumn("two", F.substring("base", 1, 2))
    number = F.row_number().over(Window.partitionBy("doc_id", "two", "first").orderBy("name"))
    return names.select("doc_id", "name", F.when(F.col("first"), F.col("base")).otherwise(F.concat("two", number)).alias("code"))


def speaker_names(corpus: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, name, n: names that stand before a colon `least` times or more, in lower case."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,15}):"), 1))
    counted = corpus.select("doc_id", found.alias("name")).groupBy("doc_id", F.lower("name").alias("name")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def with_ids(notes: DataFrame) -> DataFrame:
    return notes.withColumn("id", note_id("seq"))
