"""Corpora (doc_id, text, date, title) from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import newlines


def from_documents(documents: DataFrame, line_breaks_part: bool = True) -> DataFrame:
    """One text per document. Line breaks become blank lines if paragraphs are parted by single ones."""
    text = newlines("text")
    return documents.select(F.col("doc_id").cast("long"), (F.replace(text, F.lit("\n"), F.lit("\n\n")) if line_breaks_part else text).alias("text"))


def from_conversations(turns: DataFrame) -> DataFrame:
    """One text per conversation: `role: text` in turn order, parted by blank lines."""
    line = F.concat("role", F.lit(": "), "text")
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))


def from_sessions(turns: DataFrame) -> DataFrame:
    """One text per sample of dated chat sessions: `(date) speaker: text [shares a photo: caption]`.

    turns: sample_id, session, session_date, pos, speaker, text, caption.
    """
    photo = F.when(F.col("caption").isNotNull(), F.concat(F.lit("[shares a photo: "), "caption", F.lit("]")))
    line = F.concat(F.lit("("), "session_date", F.lit(") "), "speaker", F.lit(": "), F.concat_ws(" ", "text", photo))
    lines = F.array_sort(F.collect_list(F.struct("session", "pos", line.alias("line"))))
    return turns.groupBy("sample_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))
