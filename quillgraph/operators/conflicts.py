"""Decisions that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.text import BLANK, LEFT, RIGHT, jaccard, trimmed

#: Unions of antonyms of a word, in the order of the list.
OPPOSITES = {w: tuple(dict.fromkeys([b for a, b in lex.ANTONYMS if a == w] + [a for a, b in lex.ANTONYMS if b == w])) for p in lex.ANTONYMS for w in p}


def says_no(text: Column) -> Column:
    """Whether a cue stands in the text, as a substring, without a word that ends its reach in the 60 characters from it."""
    low = F.lower(text)
    ends = f"{LEFT}(?:{'|'.join(lex.NEGATION_ENDS)}){RIGHT}"

    def cue(c: str) -> Column:
        at = F.instr(low, c)
        return (at > 0) & ~F.substring(low, at, F.lit(60)).rlike(ends)

    found = F.lit(False)
    for c in dict.fromkeys(lex.NEGATION_CUES):
        found = found | cue(c)
    return found


def decided_value(text: Column) -> Column:
    """What follows the first verb of decision, up to a mark or conjunction: at most 60 characters, in lower case."""
    verb = f"(?is){LEFT}(?:{'|'.join(lex.VALUE_VERBS)}){RIGHT}(.*)$"
    after = trimmed(F.regexp_extract(text, verb, 1))
    cut = F.regexp_extract(after, rf"(?s)^(.*?)(?:[,;.!?\n]|{LEFT}(?:and|or|but|because|so|if){RIGHT}|$)", 1)
    return F.substring(F.lower(trimmed(cut)), 1, 60)


def values_differ(a: Column, b: Column) -> Column:
    def parts(x: Column) -> Column:
        return F.array_distinct(F.split(x, f"[{BLANK}]+"))

    return (a != "") & (b != "") & (a != b) & (jaccard(parts(a), parts(b)) < 0.8)


def opposite(a: Column, b: Column) -> Column:
    """The first word of a with an antonym in b, as word/antonym; else null."""
    wa, wb = (F.filter(F.split(F.lower(x), "[^a-z0-9_]+"), lambda w: w != "") for x in (a, b))
    told = F.map_from_arrays(F.array(*map(F.lit, OPPOSITES)), F.array(*[F.array(*map(F.lit, o)) for o in OPPOSITES.values()]))

    def hits(w: Column) -> Column:
        others = F.filter(F.coalesce(F.try_element_at(told, w), F.array().cast("array<string>")), lambda o: F.array_contains(wb, o))
        return F.transform(others, lambda o: F.concat(w, F.lit("/"), o))

    return F.get(F.flatten(F.transform(wa, hits)), F.lit(0))


def decision_pairs(notes: DataFrame) -> DataFrame:
    """doc_id, seq_a, seq_b, shared_topic: notes (doc_id, seq, entities, topics) with a name or a topic of more than three characters in common.

    The first shared name of the earlier note, else its first shared topic. Notes meet on what they share.
    """
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("entities").alias("keys")), F.struct(F.lit(1).alias("kind"), F.filter("topics", lambda t: F.length(t) > 3).alias("keys")))
    rows = notes.select("doc_id", "seq", F.inline(kinds)).select("doc_id", "seq", "kind", F.posexplode("keys").alias("place", "key"))
    a = rows.select("doc_id", "kind", "key", F.col("seq").alias("seq_a"), "place")
    b = rows.select("doc_id", "kind", "key", F.col("seq").alias("seq_b")).distinct()
    both = a.join(b, ["doc_id", "kind", "key"]).where("seq_a < seq_b")
    return both.groupBy("doc_id", "seq_a", "seq_b").agg(F.min(F.struct("kind", "place", "key")).alias("first")).select("doc_id", "seq_a", "seq_b", F.col("first.key").alias("shared_topic"))


def own_text(notes: DataFrame, sources: DataFrame | None, wanted: Column | None = None) -> DataFrame:
    """The `wanted` notes (all, if not said) with `said`: a note's text after the note before it (by number), its whole text if that is short, else its quote."""
    before = notes.select("doc_id", (F.col("seq") + 1).alias("seq"), F.col("source_end").alias("from_"))
    rows = (notes if wanted is None else notes.where(wanted)).join(before, ["doc_id", "seq"], "left")
    if sources is None:
        return rows.withColumn("said", F.col("quote")).drop("from_")
    rows = rows.join(sources.select("doc_id", F.col("text").alias("whole_")), "doc_id", "left")
    from_ = F.coalesce("from_", F.lit(0))
    tail = trimmed(F.substring("whole_", from_ + 1, F.greatest(F.col("source_end") - from_, F.lit(0))))
    start = F.coalesce("source_start", F.lit(0))
    full = trimmed(F.substring("whole_", start + 1, F.col("source_end") - start))
    said = F.when(F.length(tail) >= 20, tail).when(full != "", full).otherwise(F.col("quote"))
    return rows.withColumn("said", F.when(F.col("whole_").isNotNull() & F.col("source_end").isNotNull(), said).otherwise(F.col("quote"))).drop("from_", "whole_")


def conflicts(notes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """doc_id, earlier, later, shared_topic, signal, summary: pairs of decisions on one thing that say different things.

    notes: doc_id, seq, id, entities, topics, flags, quote, resolved_date and, with sources (doc_id, text), the note's place.
    """
    rows = own_text(notes, sources, F.array_contains("flags", "DECISION"))
    rows = rows.select("doc_id", "seq", "id", "entities", "topics", "said", "resolved_date", says_no(F.col("said")).alias("no"), decided_value(F.col("said")).alias("value"))
    side = {x: rows.select("doc_id", *[F.col(c).alias(f"{c}_{x}") for c in ("seq", "id", "said", "resolved_date", "no", "value")]) for x in "ab"}
    both = decision_pairs(notes.where(F.array_contains("flags", "DECISION"))).join(side["a"], ["doc_id", "seq_a"]).join(side["b"], ["doc_id", "seq_b"])
    signal = (
        F.when(F.col("no_a") != F.col("no_b"), "negation-flip")
        .when(values_differ(F.col("value_a"), F.col("value_b")), "value-change")
        .when(opposite(F.col("said_a"), F.col("said_b")).isNotNull(), "antonym")
    )

    def shown(x: str) -> Column:
        text = F.regexp_replace(F.substring(f"said_{x}", 1, 60), f"[{BLANK}]+", " ")
        day = F.when(F.col(f"resolved_date_{x}").isNotNull(), F.concat(F.lit(" ("), f"resolved_date_{x}", F.lit(")"))).otherwise("")
        return F.concat(F.lit('"'), text, F.lit('"'), day)

    both = both.withColumn("signal", signal).where("signal IS NOT NULL")
    summary = F.concat(F.lit("["), "shared_topic", F.lit("] "), shown("a"), F.lit(" → "), shown("b"), F.lit(" ("), "signal", F.lit(")"))
    return both.select("doc_id", F.col("id_a").alias("earlier"), F.col("id_b").alias("later"), "shared_topic", "signal", summary.alias("summary"))
