"""Questions to memories: BM25, expansions, dates, links. Many questions are answered in one job.

notes: doc_id, seq, id, entities, topics, quote, resolved_date and, with sources, source_start and source_end.
questions: query_id, doc_id, text. A question is put to the memory of its doc_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RecallOptions
from ..functions import lexicon as lex
from ..functions.text import BLANK, LEFT, RIGHT, exploded, folded, tokens
from .passes import each

# Names of months in questions, and the constants of BM25.
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
K1, B = 1.2, 0.75

#: Places of scores that decide an order, as sums come in no fixed order.
PLACES = 9


def date_range(notes: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Dated notes in the range; a bound compares as many characters as it has."""
    day = F.col("resolved_date")
    if after is not None:
        notes = notes.where(F.substring(day, 1, len(after)) >= after)
    if before is not None:
        notes = notes.where(F.substring(day, 1, len(before)) <= before)
    return notes


def note_text(notes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Adds `body`: the passage a note stands for, else its quote."""
    if sources is None:
        return notes.withColumn("body", F.col("body") if "body" in notes.columns else F.col("quote"))
    whole = sources.select("doc_id", F.col("text").alias("whole_"))
    part = F.substring("whole_", F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    return notes.join(whole, "doc_id", "left").withColumn("body", F.coalesce(part, "quote")).drop("whole_")


def note_words() -> Column:
    """Search tokens of passage, topics and names."""
    return tokens(F.concat_ws(" ", "body", F.array_join("topics", " "), F.array_join("entities", " ")))


def postings(notes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, id, token, tf, idf, norm: what BM25 needs of each note and token. Notes have `body`.

    idf and norm come from the notes given, so filters that should change them go before. asked: doc_id, token; only these
    tokens' postings are made.
    """
    rows = notes.select("doc_id", "seq", "id", note_words().alias("words")).withColumn("len", F.size("words"))
    whole = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    held = exploded(rows, "doc_id", "seq", "id", "len", of="words", name="token")
    if asked is not None:
        held = held.join(asked.select("doc_id", "token"), ["doc_id", "token"], "left_semi")
    tf = held.groupBy("doc_id", "token", "seq", "id", "len").agg(F.count("*").alias("tf"))
    df = F.count("*").over(Window.partitionBy("doc_id", "token"))
    both = tf.withColumn("df", df).join(whole, "doc_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * ((1 - B) + B * F.col("len") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0))
    return both.select("doc_id", "seq", "id", "token", "tf", idf.alias("idf"), norm.alias("norm"))


def synonym_pairs() -> list[tuple[str, str]]:
    """(token, its mates): words of one cluster."""
    return [(a, b) for group in lex.SYNONYMS for a in group for b in group if a != b]


def synonyms() -> Column:
    """A map from tokens to their mates, after the same folding that texts get: a dictionary of fixed size."""
    mates: dict[str, list[str]] = {}
    for a, b in synonym_pairs():
        a, b = folded(a), folded(b)
        if a != b and b not in mates.setdefault(a, []):
            mates[a].append(b)
    return F.create_map(*[x for a, bs in mates.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])


def co_occurrences(notes: DataFrame) -> DataFrame:
    """doc_id, a, b, cnt: how often two folded words of topics and names stand in one note, with repeats."""
    rows = notes.select("doc_id", tokens(F.concat_ws(" ", F.array_join("topics", " "), F.array_join("entities", " "))).alias("ws"))
    pairs = F.flatten(F.transform("ws", lambda a: F.transform(F.filter("ws", lambda b: a != b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select("doc_id", F.inline(pairs)).groupBy("doc_id", "a", "b").agg(F.count("*").alias("cnt"))


def question_words(questions: DataFrame, notes: DataFrame | None = None, expand: bool = False) -> DataFrame:
    """query_id, doc_id, token, weight, times: a question's tokens and their synonyms and, if asked for, companions.

    With any such word, tokens count once; without, as often as they are asked.
    """
    none = F.array().cast("array<string>")
    rows = questions.select("query_id", "doc_id", tokens("text").alias("words")).withColumn("own", F.array_distinct("words"))
    mates = F.flatten(F.transform("own", lambda w: F.coalesce(F.try_element_at(synonyms(), w), none)))
    rows = rows.withColumn("mates", F.array_except(mates, F.col("own"))).withColumn("more", none)
    if expand and notes is not None:
        asked = rows.select("query_id", "doc_id", F.explode("own").alias("a"))
        order = Window.partitionBy("doc_id", "a").orderBy(F.desc("cnt"), "b")
        near = co_occurrences(notes).join(asked.select("doc_id", "a"), ["doc_id", "a"], "left_semi").withColumn("rank", F.row_number().over(order)).where("rank <= 3")
        told = asked.join(near, ["doc_id", "a"]).groupBy("query_id", "doc_id").agg(F.collect_set("b").alias("found"))
        rows = rows.join(told, ["query_id", "doc_id"], "left").withColumn("more", F.array_except(F.array_except(F.coalesce("found", none), "own"), "mates"))
    alone = F.size("mates") + F.size("more") == 0

    def said(words: str, weight: float) -> Column:
        times = F.lit(1) if weight < 1 else None
        return F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight"), (times if times is not None else F.when(alone, F.size(F.filter("words", lambda x: x == w))).otherwise(1)).alias("times")))

    return rows.select("query_id", "doc_id", F.inline(F.concat(said("own", 1.0), said("mates", 0.6), said("more", 0.5))))


def bm25(words: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, doc_id, seq, id, score: Okapi BM25 over an inverted index, one row for each word that a note holds."""
    part = F.col("weight") * F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
    return words.join(index, ["doc_id", "token"]).select("query_id", "doc_id", "seq", "id", part.alias("score"))


def question_dates(text: Column | str = "text") -> Column:
    """The dates a question asks for, as prefixes: months with years, else years."""
    text = F.col(text) if isinstance(text, str) else text

    def months(pattern: str, month: int, year: int) -> Column:
        names, years = (F.regexp_extract_all(text, F.lit(pattern), g) for g in (month, year))
        number = F.map_from_arrays(F.array(*[F.lit(m[:3]) for m in lex.MONTHS]), F.array(*[F.lit(f"{i + 1:02d}") for i in range(12)]))
        return F.zip_with(years, names, lambda y, m: F.concat(y, F.lit("-"), F.try_element_at(number, F.lower(F.substring(m, 1, 3)))))

    both = F.array_distinct(F.concat(months(rf"(?i){LEFT}{MONTH}{RIGHT}[{BLANK},]*(\d{{4}}){RIGHT}", 1, 2), months(rf"(?i){LEFT}(\d{{4}}){RIGHT}[{BLANK},]*{MONTH}{RIGHT}", 2, 1)))
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{LEFT}((?:20|19)\d{{2}}){RIGHT}"), 1))
    return F.when(F.size(both) > 0, both).otherwise(years)


def date_bonus(day: Column | str, asked: Column | str) -> Column:
    """0.25 for a note whose date and the first asked date that speaks to it agree as far as both go, 0.1 for the month beside."""
    day, asked = (F.col(c) if isinstance(c, str) else c for c in (day, asked))

    def number(x: Column) -> Column:
        return F.substring(x, 1, 4).cast("int") * 12 + F.substring(x, 6, 2).cast("int")

    def one(q: Column) -> Column:
        beside = (F.length(q) == 7) & (F.length(day) >= 7) & (F.abs(number(day) - number(q)) == 1)
        return F.when(day.startswith(q) | q.startswith(day), 0.25).when(beside, 0.1).otherwise(0.0)

    hits = F.filter(F.transform(asked, one), lambda x: x > 0)
    return F.when(day.isNull(), 0.0).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(0.0)))


def date_hits(notes: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, doc_id, seq, id, bonus: dated notes that a question's dates speak for. They meet on years."""
    dates = questions.select("query_id", "doc_id", question_dates().alias("asked")).where(F.size("asked") > 0)

    def years(q: Column) -> Column:
        year = F.substring(q, 1, 4).cast("int")
        return F.array(year, F.when(q.endswith("-01"), year - 1).when(q.endswith("-12"), year + 1).otherwise(year))

    dates = dates.withColumn("year", F.explode(F.array_distinct(F.flatten(F.transform("asked", years)))))
    dated = notes.where("resolved_date IS NOT NULL").select("doc_id", "seq", "id", "resolved_date", F.substring("resolved_date", 1, 4).try_cast("int").alias("year"))
    rows = dates.join(dated, ["doc_id", "year"]).select("query_id", "doc_id", "seq", "id", date_bonus("resolved_date", "asked").alias("bonus"))
    return rows.where("bonus > 0")


#: Questions of one document whose walks are worked out together.
WALKS = 64


def walked(scored: DataFrame, links: DataFrame, notes: DataFrame, steps: int = 20, alpha: float = 0.85) -> DataFrame:
    """query_id, doc_id, seq, id, score: scores blended with walks over the links that start and restart at notes by their score.

    scored: query_id, doc_id, id, score (> 0). Each question gets 0.6 of its notes' scores and 0.4 of their share in the
    walks, the largest being 1; notes that have neither have no row. Documents without links keep their scores. Links to
    others than `notes` are not walked. A document's notes and links go once to each WALKS of its questions.
    """
    asked = scored.groupBy("query_id", "doc_id").agg(F.collect_list(F.struct("id", "score")).alias("seeds"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("doc_id")) / WALKS)
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), parts)).groupBy("doc_id", "part").agg(F.collect_list(F.struct("query_id", "seeds")).alias("asked"))
    edges = links.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from_id", "to_id"))).alias("edges"))
    held = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "seq"))).alias("notes"))
    rows = dealt.join(held, "doc_id").join(edges, "doc_id", "left").select("doc_id", "asked", "notes", "edges")

    def of(asked: list[dict], notes: list[dict], edges: list[dict] | None) -> list[tuple]:
        at = {x["id"]: i for i, x in enumerate(notes)}
        ends = [(at[e["from_id"]], at[e["to_id"]]) for e in edges or [] if e["from_id"] in at and e["to_id"] in at]
        a = np.array([x for e in ends for x in e], np.int64)
        b = np.array([x for e in ends for x in e[::-1]], np.int64)
        degree = np.bincount(a, minlength=len(at))
        idle = degree == 0
        out = []
        for q in asked:
            own = np.zeros(len(at))
            for x in sorted(q["seeds"], key=lambda x: x["id"]):
                own[at[x["id"]]] = x["score"]
            if edges:
                start = rank = own / own.sum()
                for _ in range(steps):
                    rank = (1 - alpha + alpha * rank[idle].sum()) * start + np.bincount(b, (alpha * rank / np.maximum(degree, 1))[a], len(at))
                own = 0.6 * own + 0.4 * rank / rank.max()
            out += [(q["query_id"], notes[i]["seq"], notes[i]["id"], float(own[i])) for i in np.flatnonzero(own).tolist()]
        return out

    kind = scored.schema["query_id"].dataType.simpleString()
    return each(rows, ["doc_id"], of, f"query_id {kind}, seq int, id string, score double")


def recall(notes: DataFrame, questions: DataFrame, links: DataFrame | None = None, options: RecallOptions = RecallOptions(), sources: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, id, seq, score, rank (from 1): the notes that answer each question best.

    Without words to ask, notes, or a match, a question has no answer. Scores that differ by less than PLACES are equal;
    ties go by id, by the root collation. Rows are made only of notes that hold an asked word or have an asked date, and
    texts take part only in making the postings of asked words.
    """
    keys, note = ["query_id", "doc_id"], ["seq", "id"]
    whole = Window.partitionBy(*keys)
    found = date_range(notes, options.after, options.before)
    words = question_words(questions, notes, options.expand)
    parts = bm25(words, postings(note_text(found, sources), words)).withColumn("bonus", F.lit(0.0))
    both = parts.unionByName(date_hits(found, questions).withColumn("score", F.lit(0.0)))
    rows = both.groupBy(*keys, *note).agg(F.sum("score").alias("score"), F.max("bonus").alias("bonus")).withColumn("most", F.max("score").over(whole)).where("most > 0")
    rows = rows.select(*keys, *note, (F.col("score") / F.col("most") + F.col("bonus")).alias("score")).where("score > 0")
    if options.hops and links is not None:
        rows = walked(rows, links, found)
    order = whole.orderBy(F.desc(F.round("score", PLACES)), F.collate("id", "UNICODE"))
    return rows.select(*keys, "id", "seq", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top_k)
