"""Topics of passages (doc_id, idx, text and, if there, speakers): the scores of words and phrases, and the best of both.

Passes over the functions that notes are made with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import annotate
from .passes import each

KEYS = ["doc_id", "idx"]


def _passages(chunks: DataFrame) -> DataFrame:
    return chunks.select(*KEYS, "text", F.col("speakers") if "speakers" in chunks.columns else F.array().cast("array<string>").alias("speakers"))


def word_scores(chunks: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, idx, word, freq, score, first (its place among the words, from 0)."""

    def of(text: str, who: list[str]) -> list[tuple]:
        words = annotate.word_scores(annotate.topic_tokens(text, stop, frozenset(who or ())))
        return [(w, k, v, i) for i, (w, (k, v)) in enumerate(words.items())]

    return each(_passages(chunks), KEYS, of, "word string, freq int, score double, first int")


def phrase_scores(chunks: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, idx, phrase, freq, score, rank (from 1): phrases of two or three words."""

    def of(text: str, who: list[str]) -> list[tuple]:
        tokens = annotate.topic_tokens(text, stop, frozenset(who or ()))
        found = annotate.phrase_scores(tokens, annotate.word_scores(tokens))
        return [(" ".join(p), k, v, i + 1) for i, (p, k, v) in enumerate(found)]

    return each(_passages(chunks), KEYS, of, "phrase string, freq int, score double, rank int")


def top_topics(chunks: DataFrame, least: int = 1, stop: tuple[str, ...] = (), most: int = 8) -> DataFrame:
    """doc_id, idx, topic, rank (from 1): the best phrases, then words that they don't absorb, `most` together."""

    def of(text: str, who: list[str]) -> list[tuple]:
        return [(t, i + 1) for i, t in enumerate(annotate.topics(text, least, stop, most, frozenset(who or ())))]

    return each(_passages(chunks), KEYS, of, "topic string, rank int")
