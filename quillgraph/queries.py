"""Registered queries of the engine and the SQL that checks them, where SQL can express them.

The tables' texts are pseudo-words without signals, so some queries put fixed sentences into the whole texts, chosen and
placed by the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as sql
from .config import BuildOptions, InjectOptions, RecallOptions, StreamOptions
from .functions import hashing, text
from .functions import lexicon as lex
from .operators import conflicts, context, dedupe, evaluate, links, search, segment, topics, weights
from .plans import memory
from .sources import codec, corpora
from .streaming import live

QUERIES: dict = {}

ORACLE_SQL: dict[str, str] = {}


def query(check: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if check:
            ORACLE_SQL[f.__name__] = check
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def conv_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.from_conversations(read(spark, sf, "conversations"))


def doc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.from_documents(read(spark, sf, "documents"))


def rounded(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


def texts_of(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def base_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes made from turns by plain rules; the same as oracle.NOTES."""
    t = read(spark, sf, "conversations")
    turn, mixed = F.col("turn"), F.col("conv_id") + F.col("turn")
    names = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), 0))), 1, 4)
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w).between(4, 9))
    month = F.concat(F.lit("2023-0"), (turn % 9 + 1).cast("string"))
    flags = F.when(mixed % 6 == 0, texts_of("DECISION", "TECHNICAL")).when(mixed % 6 == 1, texts_of("ORIGIN")).when(mixed % 6 == 2, texts_of("CORE")).when(mixed % 6 == 3, texts_of("PIVOT")).otherwise(texts_of())
    return t.select(
        F.col("conv_id").alias("doc_id"),
        (turn + 1).cast("int").alias("seq"),
        text.note_id(turn + 1).alias("id"),
        names.alias("entities"),
        F.slice(F.array_sort(F.array_distinct(words)), 1, 8).alias("topics"),
        F.col("text").alias("quote"),
        ((F.col("conv_id") * 31 + turn * 17) % 101 / 100.0).alias("weight"),
        flags.alias("flags"),
        texts_of().alias("emotions"),
        F.when(mixed % 5 == 0, F.concat(month, F.lit("-1"), (turn % 9).cast("string"))).when(mixed % 5 == 1, month).when(mixed % 5 == 2, "2022").alias("resolved_date"),
    )


def base_links(notes: DataFrame) -> DataFrame:
    """Links between notes that share a topic word; the same as oracle.LINKS."""
    rows = notes.select("doc_id", "seq", F.explode("topics").alias("token"), "id")
    a, b = (rows.select("doc_id", "token", F.col("seq").alias(f"seq_{x}"), F.col("id").alias(n)) for x, n in (("a", "from_id"), ("b", "to_id")))
    return a.join(b, ["doc_id", "token"]).where("seq_a < seq_b").select("doc_id", "from_id", "to_id").distinct()


def turn_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation is asked its first turn."""
    return read(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("doc_id"), "text")


def spans_of(turns: DataFrame) -> DataFrame:
    """doc_id, seq, start, end: where each turn's line (`role: text`) stands in its conversation's text."""
    size = F.length(F.concat("role", F.lit(": "), "text"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + 2).over(before), F.lit(0)).cast("int")
    return turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("seq"), start.alias("start"), (start + size).cast("int").alias("end"))


# ---- sources and segments


@query(f"WITH {sql.CONV} SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM conv")
def conversation_corpus(spark, sf):
    return conv_corpus(spark, sf).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(text) AS digest FROM documents")
def normalize_newlines(spark, sf):
    docs = read(spark, sf, "documents")
    cr = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    return docs.select("doc_id", F.replace("text", F.lit("\n"), cr).alias("text")).select("doc_id", F.md5(text.newlines("text").cast("binary")).alias("digest"))


PARAS = r"""pieces AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT doc_id, string_split(text, E'\n') AS p FROM documents)),
placed AS (SELECT doc_id, i, piece, coalesce(sum(length(piece) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pl FROM pieces),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, CAST(pl + length(piece) - length(ltrim(piece, E' \t')) AS INT) AS s,
         CAST(pl + length(rtrim(piece, E' \t')) AS INT) AS e, trim(piece, E' \t') AS text FROM placed WHERE trim(piece, E' \t') <> '')"""


@query(f"WITH {PARAS} SELECT doc_id, CAST(idx AS INT) AS idx, s AS para_start, e AS para_end, md5(text) AS digest FROM paras")
def paragraphs(spark, sf):
    return segment.paragraphs(doc_corpus(spark, sf)).select("doc_id", "idx", "para_start", "para_end", F.md5(F.col("text").cast("binary")).alias("digest"))


CHUNKS = """walk AS (
  SELECT doc_id, idx, s AS cs, e AS ce, NULL::INT AS os, NULL::INT AS oe FROM paras WHERE idx = 0
  UNION ALL
  SELECT p.doc_id, p.idx, CASE WHEN p.e - w.cs > 800 THEN {next} ELSE w.cs END, p.e,
         CASE WHEN p.e - w.cs > 800 THEN w.cs END, CASE WHEN p.e - w.cs > 800 THEN w.ce END
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.idx = w.idx + 1 JOIN whole d ON d.doc_id = p.doc_id),
spans AS (
  SELECT doc_id, os AS s, oe AS e FROM walk WHERE os IS NOT NULL
  UNION ALL SELECT doc_id, arg_max(cs, idx), arg_max(ce, idx) FROM walk GROUP BY doc_id)
SELECT s.doc_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY s.s, s.e) - 1 AS INT) AS idx, s.s AS char_start, s.e AS char_end, md5(substring(d.text, s.s + 1, s.e - s.s)) AS digest
FROM spans s JOIN whole d USING (doc_id)"""
WHOLE = r"whole AS (SELECT doc_id, replace(text, E'\n', E'\n\n') AS text FROM documents)"
SKIP = r"""(CASE WHEN greatest(w.cs, w.ce - 100) = w.cs THEN w.cs ELSE (
  SELECT CASE WHEN x < w.ce THEN x ELSE p.s END FROM (SELECT CAST(w.ce - 100 + length(regexp_extract(substring(d.text, w.ce - 99, 100),
    CASE WHEN regexp_matches(substring(d.text, w.ce - 100, 1), '\S') THEN '^\S*\s*' ELSE '^\s*' END)) AS INT) AS x)) END)"""


@query(f"WITH RECURSIVE {PARAS}, {WHOLE}, {CHUNKS.replace('{next}', 'p.s')}")
def chunks_no_overlap(spark, sf):
    return segment.chunks(doc_corpus(spark, sf), 800, 0).select("doc_id", "idx", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH RECURSIVE {PARAS}, {WHOLE}, {CHUNKS.replace('{next}', SKIP)}")
def chunks_overlap(spark, sf):
    return segment.chunks(doc_corpus(spark, sf), 800, 100).select("doc_id", "idx", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest({sql.tokens('text')}) AS token FROM conversations) GROUP BY ALL")
def tokens_fold(spark, sf):
    t = read(spark, sf, "conversations")
    return text.exploded(t.withColumn("ws", text.tokens("text")), "conv_id", "turn", of="ws", name="token").groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {sql.estimate('text')} AS tokens, CASE WHEN length(text) < 1000 THEN 150 WHEN length(text) < 3000 THEN 300 WHEN length(text) < 8000 THEN 500 ELSE 800 END AS chunk_size FROM documents")
def token_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.token_estimate("text").alias("tokens"), text.chunk_size_for("text").alias("chunk_size"))


# ---- topics

TURNS = r"turns AS (SELECT conv_id AS doc_id, turn AS idx, regexp_replace(regexp_replace(text, '\([^)]{3,60}\)', ' ', 'g'), '(?m)^[A-Z][a-zA-Z]{1,20}:\s*', ' ', 'g') AS text FROM conversations)"


def turns(spark, sf):
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")


@query(f"WITH {TURNS}, {sql.topic_words('turns')} SELECT doc_id, idx, low AS word, CAST(freq AS INT) AS freq, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY doc_id, idx ORDER BY first) - 1 AS INT) AS first FROM unigrams")
def topic_unigrams(spark, sf):
    return topics.word_scores(turns(spark, sf)).withColumn("score", F.round("score", 9))


@query(f"WITH {TURNS}, {sql.topic_words('turns')} SELECT doc_id, idx, phrase, CAST(freq AS INT) AS freq, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY doc_id, idx ORDER BY score DESC, first) AS INT) AS rank FROM phrases")
def topic_phrases(spark, sf):
    return topics.phrase_scores(turns(spark, sf)).withColumn("score", F.round("score", 9))


@query(f"WITH {TURNS}, {sql.topic_words('turns')}, {sql.TOPICS} SELECT doc_id, idx, topic, rank FROM topics")
def topics_top8(spark, sf):
    return topics.top_topics(turns(spark, sf))


NAMED = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Alice' WHEN 'assistant' THEN 'Bob' ELSE 'Carol' END || ': ' || text AS text FROM conversations"


@query(f"""WITH conv AS (SELECT conv_id AS doc_id, string_agg(text, E'\\n\\n' ORDER BY turn) AS text FROM ({NAMED}) GROUP BY conv_id),
found AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\\b([A-Z][a-z]{{2,15}}):', 1))) AS name FROM conv)
SELECT doc_id, name, count(*) AS n FROM found GROUP BY ALL HAVING count(*) >= 3""")
def speaker_names(spark, sf):
    name = F.when(F.col("role") == "user", "Alice").when(F.col("role") == "assistant", "Bob").otherwise("Carol")
    turns = read(spark, sf, "conversations").withColumn("role", name)
    return segment.speaker_names(corpora.from_conversations(turns))


# ---- notes of whole documents with planted sentences

#: Two sentences for a document, by its id: signals, negations, dates of each form, relative dates, names, pronouns, speakers.
SENTENCES = (
    ("We decided to use Redis for the cache.", "We never decided on a queue."),
    ("This was a turning point and everyone was thrilled.", "Ann is worried about the database schema."),
    ("The key principle led to a great outcome.", "It was founded there; no one was angry."),
    ("She failed to say what was decided.", "They are not, as one might have thought, really proud."),
    ("We met Maria and Peter on 8 May 2023 in Oslo.", "Then she wrote yesterday that he was late."),
    ("On March 7th, 2021 Laura came.", "They left last month with their things."),
    ("The plan from June 2022 holds.", "It came 3 weeks ago by post."),
    ("It has run since 2019 or so.", "It ships next friday at noon."),
    ("The log of 2020-02-29 is lost.", "It was tomorrow that he chose."),
    ("(1:56 pm on 8 May, 2023) Alice: we will do it.", "Bob: she said it was last week."),
    ("In 2018 we began; by 4 June 2020 it was done.", "It will be ready in 2 months."),
    ("Nothing is dated here.", "He left last year for good."),
    ("Clara: yes. Clara: no. Clara: perhaps Clara knows.", "We saw Clara and the GraphStore module of the APIS team with real-time limiting."),
    ("Running tests. Window panes shine, and the window opens.", "We like Tess's house and GraphQL."),
    ("It was today that Sofia agreed to it.", "This month her team is relieved."),
    ("That was in December 2019.", "So next month they meet."),
    ("It is due on 31 January 2022.", "That was 14 months ago."),
    ("We go on 1 March 2020.", "It was 1 day ago, or so he said."),
    ("We met on 5 May 2020.", "It rained the sunday before."),
    ("We met on 5 May 2020 again.", "It snowed the week after."),
    ("See what came in 2021.", "And 5 days later we met."),
    ("No one had said no more.", "I refuse to push back, and avoided what I love."),
    ("It was last tuesday that Omar rested.", "So this friday he must go."),
    ("Nothing to report.", "At last we are at peace with it; the basis is non-negotiable."),
)


def planted_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, paragraphs parted by blank lines, with a pair of sentences as paragraphs of their own, and session dates; as oracle.planted."""
    said = F.element_at(F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("two")) for a, b in SENTENCES]), (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))
    rows = read(spark, sf, "documents").select(F.col("doc_id").cast("long"), F.split("text", "\n").alias("ls"), said.alias("said"))
    n = F.size("ls")
    rows = rows.withColumn("a", (F.col("doc_id") * 7 % (n + 1)).cast("int")).withColumn("b", (F.col("a") + F.col("doc_id") * 5 % (n - F.col("a") + 1)).cast("int"))
    parts = F.concat(F.slice("ls", F.lit(1), F.col("a")), F.array("said.one"), F.slice("ls", F.col("a") + 1, F.col("b") - F.col("a")), F.array("said.two"), F.slice("ls", F.col("b") + 1, n - F.col("b")))
    date = F.when(F.col("doc_id") % 3 == 0, "2023-03-31").when(F.col("doc_id") % 3 == 1, "8 May, 2023")
    return rows.select("doc_id", F.array_join(parts, "\n\n").alias("text"), date.alias("date"))


def noted(*parts: str) -> str:
    return f"WITH RECURSIVE {sql.note_parts(SENTENCES, SKIP, *parts)}"


@query(f"{noted('signals')} SELECT doc_id, seq, array_to_string(flags, ',') AS flags, array_to_string(emotions, ',') AS emotions, raw_weight FROM signals")
def note_signals(spark, sf):
    """Flags, emotions and raw weight of every note."""
    return segment.annotate_notes(planted_corpus(spark, sf), wanted=("flags", "emotions", "raw_weight")).select("doc_id", "seq", F.array_join("flags", ",").alias("flags"), F.array_join("emotions", ",").alias("emotions"), "raw_weight")


@query(f"{noted('dates')} SELECT doc_id, seq, resolved_date FROM dated")
def note_dates(spark, sf):
    """The date of every note: its own best one, one told from the nearest date before it or the session's, or the session's."""
    return segment.annotate_notes(planted_corpus(spark, sf), wanted=("resolved_date",)).select("doc_id", "seq", "resolved_date")


@query(f"{noted('names')} SELECT doc_id, seq, array_to_string(entities, ',') AS names FROM entity")
def note_names(spark, sf):
    """Names of every note, those that its pronouns stand for included."""
    return segment.annotate_notes(planted_corpus(spark, sf), wanted=("entities",)).select("doc_id", "seq", F.array_join("entities", ",").alias("names"))


@query(f"{noted('topics')} SELECT doc_id, CAST(idx AS INT) AS seq, string_agg(topic, ',' ORDER BY rank) AS topics FROM topics GROUP BY ALL")
def note_topics(spark, sf):
    """Topics of every note, without the document's speakers, in order."""
    return segment.annotate_notes(planted_corpus(spark, sf), wanted=("topics",)).where(F.size("topics") > 0).select("doc_id", "seq", F.array_join("topics", ",").alias("topics"))


ASKED = ("What happened in March 2022?", "And in 2021 or 2019?", "Was it 2023, Jan or later?", "Nothing dated", "From May 2023 to june 2023 in 2020")


@query(rf"""WITH own AS (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents), q(k, said) AS (VALUES {", ".join(f"({i}, '{a}')" for i, a in enumerate(ASKED))}),
questions AS (SELECT doc_id, doc_id AS query_id, array_to_string(list_concat(list_concat(ls[1:doc_id * 7 % (len(ls) + 1)], [said]), ls[doc_id * 7 % (len(ls) + 1) + 1:]), E'\n') AS text FROM own JOIN q ON k = doc_id % 5),
notes AS (SELECT 0 AS doc_id, 0 AS seq, '' AS id, '' AS resolved_date WHERE false), scored AS (SELECT 0 AS query_id, 0 AS doc_id, 0 AS seq, 0.0 AS score WHERE false), {sql.recalled()}
SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS dates FROM (SELECT doc_id, list_filter(qs, lambda x, i: list_position(qs, x) = i) AS list_distinct_in_order FROM spoken2)""")
def query_dates(spark, sf):
    """The dates that whole texts ask for, with a dated question put between their lines."""
    docs = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"), picked(ASKED, F.col("doc_id") % 5).alias("said"))
    at = (F.col("doc_id") * 7 % (F.size("ls") + 1)).cast("int")
    text_ = F.array_join(F.concat(F.slice("ls", F.lit(1), at), F.array("said"), F.slice("ls", at + 1, F.size("ls") - at)), "\n")
    return docs.select("doc_id", text_.alias("text")).select("doc_id", F.array_join(search.question_dates("text"), ",").alias("dates"))


def picked(values, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key + 1).cast("int"))


@query(f"""WITH {sql.NOTES}, asked AS (SELECT unnest(['2023-03', '2022', '2023-05-14']) AS q),
parts AS (SELECT doc_id, seq, q, resolved_date AS d FROM notes, asked)
SELECT doc_id, seq, q, CAST(CASE WHEN d IS NULL THEN 0.0 WHEN starts_with(d, q) OR starts_with(q, d) THEN 0.25
  WHEN length(q) = 7 AND length(d) >= 7 AND abs((CAST(left(d, 4) AS INT) - CAST(left(q, 4) AS INT)) * 12 + CAST(substring(d, 6, 2) AS INT) - CAST(substring(q, 6, 2) AS INT)) = 1 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS bonus FROM parts""")
def date_bonus(spark, sf):
    asked = F.explode(texts_of("2023-03", "2022", "2023-05-14")).alias("q")
    rows = base_notes(spark, sf).select("doc_id", "seq", "resolved_date", asked)
    return rows.select("doc_id", "seq", "q", search.date_bonus("resolved_date", F.array("q")).alias("bonus"))


@query(f"WITH {sql.NOTES} SELECT doc_id, id, resolved_date FROM notes WHERE left(resolved_date, 7) >= '2023-02' AND left(resolved_date, 10) <= '2023-04-12'")
def date_filter(spark, sf):
    return search.date_range(base_notes(spark, sf), "2023-02", "2023-04-12").select("doc_id", "id", "resolved_date")


# ---- names

CODES = """names AS (SELECT doc_id, unnest(entities) AS name FROM notes),
letters AS (SELECT DISTINCT doc_id, name, upper(regexp_replace(name, '[^a-zA-Z]', '', 'g')) AS l FROM names),
base AS (
  SELECT doc_id, name, CASE WHEN l = '' THEN 'UNK' WHEN length(c) >= 2 THEN l[1] || left(c, 2) WHEN length(c) = 1 THEN l[1] || c || l[-1] ELSE rpad(left(l, 3), 3, 'X') END AS base
  FROM (SELECT *, regexp_replace(substring(l, 2), '[AEIOU]', '', 'g') AS c FROM letters)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY name) = 1 AS f FROM base),
codes AS (SELECT doc_id, name, CASE WHEN f THEN base ELSE left(base, 2) || row_number() OVER (PARTITION BY doc_id, left(base, 2), f ORDER BY name) END AS code FROM firsts)"""


@query(f"WITH {sql.NOTES}, {CODES} SELECT * FROM codes")
def entity_codes(spark, sf):
    return segment.entity_codes(base_notes(spark, sf))


# ---- links and weights

PAIRS = f"""{sql.NOTES},
sets AS (SELECT doc_id, seq, list_distinct(entities) AS es, list_distinct(list_filter(topics, lambda w: length(w) >= 2)) AS ws FROM notes),
pairs AS (
  SELECT a.doc_id, a.seq AS a, b.seq AS b, len(list_intersect(a.es, b.es)) AS e, len(list_intersect(a.ws, b.ws)) AS w, len(a.es) AS ea, len(b.es) AS eb, len(a.ws) AS wa, len(b.ws) AS wb
  FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.seq < b.seq),
cand AS (
  SELECT doc_id, a, b, greatest(CASE WHEN e > 0 THEN e / (ea + eb - e) * 1.2 ELSE 0 END, CASE WHEN w > 0 THEN w / (wa + wb - w) ELSE 0 END) AS score FROM pairs)"""


@query(f"WITH {PAIRS} SELECT doc_id, a, b, round(score, 6) AS score FROM cand WHERE score >= 0.1")
def link_candidates(spark, sf):
    return links.link_candidates(base_notes(spark, sf), 0.1).select("doc_id", "a", "b", rounded("score", "score"))


PHRASED = "notes AS (SELECT * REPLACE (CASE WHEN len(topics) > 1 THEN list_concat([topics[1] || ' ' || topics[2]], topics[3:]) ELSE topics END AS topics) FROM plain_notes)"


def phrased_notes(spark, sf):
    """Notes whose first two topics are one phrase; as PHRASED."""
    first = F.array(F.concat_ws(" ", F.col("topics")[0], F.get("topics", F.lit(1))))
    both = F.when(F.size("topics") > 1, F.concat(first, F.slice("topics", F.lit(3), F.size("topics")))).otherwise(F.col("topics"))
    return base_notes(spark, sf).withColumn("topics", both)


@query(f"""WITH RECURSIVE {sql.NOTES.replace('notes AS', 'plain_notes AS', 1)}, {PHRASED}, {CODES}, {sql.links('notes', 0.1)},
ends AS (SELECT t.doc_id, t.a, t.b, t.score, x.id AS from_id, y.id AS to_id, list_filter(x.entities, lambda n: list_contains(y.entities, n)) AS names, list_filter(x.topics, lambda n: list_contains(y.topics, n)) AS phrases,
  list_filter(list_distinct_words(x.topics), lambda n: list_contains(y.ws, n))[1:2] AS words FROM tied t JOIN sets x ON x.doc_id = t.doc_id AND x.seq = t.a JOIN sets y ON y.doc_id = t.doc_id AND y.seq = t.b),
called AS (SELECT doc_id, a, b, string_agg(code, '+' ORDER BY i) AS called FROM (SELECT doc_id, a, b, unnest(names[1:3]) AS name, generate_subscripts(names[1:3], 1) AS i FROM ends) JOIN codes USING (doc_id, name) GROUP BY ALL)
SELECT doc_id, from_id, to_id, round(score, 6) AS score, CASE WHEN len(names) >= 2 THEN called WHEN len(phrases) > 0 AND len(names) = 1 THEN names[1] || '_' || array_to_string(phrases[1:2], '_') WHEN len(phrases) > 0 THEN array_to_string(phrases[1:2], '_')
  WHEN len(words) > 0 THEN array_to_string(words, '_') ELSE coalesce(names[1], '') END AS label FROM ends LEFT JOIN called USING (doc_id, a, b)""".replace("list_distinct_words(x.topics)", "list_filter(flatten(list_transform(x.topics, lambda t: string_split(t, ' '))), lambda w: length(w) >= 2)"))
def note_links(spark, sf):
    """Links with labels, three for a note at most."""
    notes = phrased_notes(spark, sf)
    return links.build_links(notes, segment.entity_codes(notes), threshold=0.1).withColumn("score", F.round("score", 6))


BLEND = f"""{sql.NOTES}, {sql.LINKS},
deg AS (SELECT doc_id, id, count(*) AS d FROM (SELECT doc_id, from_id AS id FROM links UNION ALL SELECT doc_id, to_id FROM links) GROUP BY ALL),
blend AS (SELECT n.doc_id, n.id, 0.8 * weight + 0.2 * CASE WHEN max(d) OVER (PARTITION BY n.doc_id) > 0 THEN coalesce(d, 0) / max(d) OVER (PARTITION BY n.doc_id) ELSE 0 END AS weight FROM notes n LEFT JOIN deg USING (doc_id, id))"""


@query(f"WITH {BLEND} SELECT doc_id, id, round(weight, 6) AS weight FROM blend")
def degree_centrality(spark, sf):
    notes = base_notes(spark, sf)
    return weights.blend_centrality(notes, base_links(notes)).select("doc_id", "id", rounded("weight", "weight"))


@query(f"""WITH {sql.NOTES},
mid AS (SELECT doc_id, id, weight, rank() OVER (PARTITION BY doc_id ORDER BY weight) - 1 + (count(*) OVER (PARTITION BY doc_id, weight) - 1) / 2 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM notes),
ex AS (SELECT *, exp(r / greatest(n - 1, 1) / 0.5 - 2) AS e FROM mid),
lim AS (SELECT *, min(e) OVER (PARTITION BY doc_id) AS lo, max(e) OVER (PARTITION BY doc_id) AS hi FROM ex)
SELECT doc_id, id, CASE WHEN n <= 1 THEN weight WHEN hi > lo THEN floor((e - lo) / (hi - lo) * 100 + 0.5) / 100 ELSE 1.0 END AS weight FROM lim""")
def midrank_weights(spark, sf):
    return weights.normalize_weights(base_notes(spark, sf)).select("doc_id", "id", "weight")


@query(f"WITH {sql.NOTES} SELECT doc_id, id, round(weight * pow(0.5, (max(seq) OVER (PARTITION BY doc_id) - seq) / 50.0), 6) AS weight FROM notes")
def decay_rank(spark, sf):
    age = F.max("seq").over(Window.partitionBy("doc_id")) - F.col("seq")
    return base_notes(spark, sf).select("doc_id", "id", rounded(weights.decayed(F.col("weight"), age, 50.0), "weight"))


# ---- search

SYNONYMS = ", ".join(f"('{a}', '{b}')" for a, b in search.synonym_pairs())
CO_ROWS = f"""ws AS (SELECT doc_id, seq, {sql.tokens("concat_ws(' ', array_to_string(topics, ' '), array_to_string(entities, ' '))")} AS w FROM notes),
rows AS (SELECT doc_id, seq, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM ws),
co AS (SELECT x.doc_id, x.w AS a, y.w AS b, count(*) AS cnt FROM rows x JOIN rows y ON x.doc_id = y.doc_id AND x.seq = y.seq AND x.i <> y.i AND x.w <> y.w GROUP BY ALL)"""


def wanted(expand: bool = False) -> str:
    """`wanted` (query_id, doc_id, token, w, times): the words asked, their synonyms and, to expand, three companions of each."""
    more = f"""{CO_ROWS}, beside AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, a ORDER BY cnt DESC, b) AS k FROM co) WHERE k <= 3),
more AS (SELECT DISTINCT o.query_id, o.doc_id, b AS token, 0.5::DOUBLE AS w FROM own o JOIN beside c ON c.doc_id = o.doc_id AND c.a = o.token WHERE NOT EXISTS (SELECT 1 FROM own p WHERE p.query_id = o.query_id AND p.token = b) AND NOT EXISTS (SELECT 1 FROM mates m WHERE m.query_id = o.query_id AND m.token = b)),"""
    return f"""{sql.OWN}, dict AS (SELECT DISTINCT {sql.fold('x')} AS token, {sql.fold('y')} AS mate FROM (VALUES {SYNONYMS}) t(x, y)),
mates AS (SELECT DISTINCT o.query_id, o.doc_id, mate AS token, 0.6::DOUBLE AS w FROM own o JOIN dict d ON d.token = o.token WHERE d.token <> mate AND NOT EXISTS (SELECT 1 FROM own p WHERE p.query_id = o.query_id AND p.token = mate)),
{more if expand else ""} every_word AS (SELECT * FROM mates {"UNION ALL SELECT * FROM more" if expand else ""}),
wanted AS (SELECT query_id, doc_id, token, 1.0::DOUBLE AS w, CASE WHEN query_id IN (SELECT query_id FROM every_word) THEN 1 ELSE times END AS times FROM own UNION ALL SELECT query_id, doc_id, token, w, 1 FROM every_word)"""


def answered(notes: str, questions: str = sql.QUESTIONS, top: int = 5, hops: str = "", expand: bool = False) -> str:
    """Down to `answers`, of `notes` and `questions`; hops: the links to walk."""
    return f"WITH {notes}, {questions}, {wanted(expand)}, {sql.bm25('SELECT * FROM wanted')}, {hops + ',' if hops else ''}{sql.recalled(top, bool(hops))}"


ANSWERS = "SELECT query_id, doc_id, id, rank, round(score, 6) AS score FROM answers"


def hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "doc_id", "id", "rank", rounded("score", "score"))


PLAIN = RecallOptions(hops=False)


@query(f"{answered(sql.NOTES)} {ANSWERS}")
def bm25_top5(spark, sf):
    """The flagship: each conversation's first turn asked of its turns, over an inverted index."""
    return hits(search.recall(base_notes(spark, sf), turn_questions(spark, sf), options=PLAIN))


SAID = "CASE turn % 4 WHEN 0 THEN 'we moved house' WHEN 1 THEN 'she migrated data' WHEN 2 THEN 'a wedding' ELSE 'they married' END"


@query(answered(
    sql.NOTES.replace("text AS quote", f"text || ' ' || {SAID} AS quote"),
    "questions AS (SELECT DISTINCT conv_id AS query_id, conv_id AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 'who will move or wed' ELSE 'was there a partner engaged engaged' END AS text FROM conversations)",
) + ANSWERS)
def bm25_synonyms(spark, sf):
    said = picked(("we moved house", "she migrated data", "a wedding", "they married"), (F.col("seq") - 1) % 4)
    notes = base_notes(spark, sf).withColumn("quote", F.concat("quote", F.lit(" "), said))
    asked = F.when(F.col("conv_id") % 2 == 0, "who will move or wed").otherwise("was there a partner engaged engaged")
    questions = read(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("doc_id"), asked.alias("text")).distinct()
    return hits(search.recall(notes, questions, options=PLAIN))


DATED_ASK = "questions AS (SELECT conv_id AS query_id, conv_id AS doc_id, text || CASE conv_id % 3 WHEN 0 THEN ' in March 2023' WHEN 1 THEN ' (2022, or 2023 dec)' ELSE '' END AS text FROM conversations WHERE turn = 0)"


def dated_questions(spark, sf):
    more = F.when(F.col("doc_id") % 3 == 0, " in March 2023").when(F.col("doc_id") % 3 == 1, " (2022, or 2023 dec)").otherwise("")
    return turn_questions(spark, sf).withColumn("text", F.concat("text", more))


@query(f"{answered(sql.NOTES, DATED_ASK)} {ANSWERS}")
def recall_dates(spark, sf):
    """Recall that asks for dates."""
    return hits(search.recall(base_notes(spark, sf), dated_questions(spark, sf), options=PLAIN))


IN_SOURCE = sql.NOTES.replace("text AS quote", "role || ': ' || text AS quote")


@query(f"{answered(IN_SOURCE)} {ANSWERS}")
def recall_sources(spark, sf):
    """Recall over passages of the sources: quotes hold only the first characters."""
    t = read(spark, sf, "conversations")
    places = spans_of(t).select("doc_id", "seq", F.col("start").alias("source_start"), F.col("end").alias("source_end"))
    notes = base_notes(spark, sf).withColumn("quote", F.substring("quote", 1, 12)).join(places, ["doc_id", "seq"])
    return hits(search.recall(notes, turn_questions(spark, sf), options=PLAIN, sources=corpora.from_conversations(t)))


@query(f"""{answered(IN_SOURCE, top=3)}, {sql.CONV}, place AS (
  SELECT conv_id AS doc_id, lpad((turn + 1)::VARCHAR, 3, '0') AS id, turn, coalesce(sum(length(role) + 4 + length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(role) + 2 + length(text) AS n FROM conversations),
hit AS (SELECT query_id, a.doc_id, s, s + n AS e, turn - row_number() OVER (PARTITION BY query_id ORDER BY turn) AS isle FROM answers a JOIN place p ON p.doc_id = a.doc_id AND p.id = a.id),
span AS (SELECT query_id, doc_id, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e FROM hit GROUP BY query_id, doc_id, isle)
SELECT query_id, s.doc_id, string_agg(substring(text, s.s + 1, s.e - s.s), E'\n\n' ORDER BY s.s) AS text FROM span s JOIN conv c ON c.doc_id = s.doc_id GROUP BY ALL""")
def recall_passages(spark, sf):
    """The passages that the three best notes of each question stand for, united where they touch."""
    t = read(spark, sf, "conversations")
    sources = corpora.from_conversations(t)
    places = spans_of(t).select("doc_id", "seq", F.col("start").alias("source_start"), F.col("end").alias("source_end"))
    notes = base_notes(spark, sf).withColumn("quote", F.substring("quote", 1, 12)).join(places, ["doc_id", "seq"])
    found = search.recall(notes, turn_questions(spark, sf), options=RecallOptions(top_k=3, hops=False), sources=sources)
    return context.recall_context(found, notes, sources)


@query(f"WITH {sql.NOTES}, {CO_ROWS} SELECT * FROM co")
def co_occurrence(spark, sf):
    return search.co_occurrences(base_notes(spark, sf))


SECOND = "questions AS (SELECT conv_id AS query_id, conv_id AS doc_id, text || ' in March 2023' AS text FROM conversations WHERE turn = 1)"


@query(f"{answered(sql.NOTES, SECOND, hops=sql.LINKS, expand=True)} {ANSWERS}")
def recall_expanded(spark, sf):
    """Recall with companions of the asked words, walks over the links, and dates."""
    notes = base_notes(spark, sf)
    asked = read(spark, sf, "conversations").where("turn = 1").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("doc_id"), F.concat("text", F.lit(" in March 2023")).alias("text"))
    return hits(search.recall(notes, asked, base_links(notes), RecallOptions(expand=True)))


@query(f"{answered(sql.NOTES.replace('notes AS', 'every_note AS', 1) + ", notes AS (SELECT * FROM every_note WHERE left(resolved_date, 7) >= '2023-02' AND left(resolved_date, 10) <= '2023-07-15')")} {ANSWERS}")
def recall_date_filter(spark, sf):
    """The range goes before the statistics, so these are of the notes in it."""
    return hits(search.recall(base_notes(spark, sf), turn_questions(spark, sf), options=RecallOptions(hops=False, after="2023-02", before="2023-07-15")))


SPANS = """spans AS (SELECT conv_id AS doc_id, turn * 37 % 211 AS s, turn * 37 % 211 + 25 AS e FROM conversations),
reach AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
isle AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM reach)"""


@query(f'WITH {SPANS} SELECT doc_id, min(s) AS start, max(e) AS "end" FROM isle GROUP BY doc_id, k')
def span_merge(spark, sf):
    at = F.col("turn") * 37 % 211
    spans = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), at.alias("start"), (at + 25).alias("end"))
    return context.merge_spans(spans, ["doc_id"])


# ---- prompts

SCORE = "0.7 * weight + 0.3 * CASE WHEN list_has_any(flags, ['DECISION', 'ORIGIN', 'CORE']) THEN 1 ELSE 0 END"


@query(f"WITH {sql.NOTES} SELECT doc_id, id, rank FROM (SELECT doc_id, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {SCORE} DESC, id) AS INT) AS rank FROM notes WHERE weight >= 0.2) WHERE rank <= 3")
def inject_top(spark, sf):
    return context.select_notes(base_notes(spark, sf).where("weight >= 0.2"), 3).select("doc_id", "id", "rank")


@query(f"""WITH {sql.NOTES}, lines AS (SELECT doc_id, seq, '**[' || id || ']** ' || CASE WHEN resolved_date IS NULL AND len(flags) = 0 THEN '' ELSE '*(' || concat_ws(' · ', resolved_date, CASE WHEN len(flags) > 0 THEN array_to_string(flags, ', ') END) || ')* ' END || quote AS line
FROM notes WHERE list_has_any(flags, ['DECISION', 'CORE'])) SELECT n.doc_id, coalesce(string_agg(line, E'\\n\\n' ORDER BY n.seq), '') AS text FROM notes n LEFT JOIN lines l ON l.doc_id = n.doc_id AND l.seq = n.seq GROUP BY n.doc_id""")
def inject_markdown(spark, sf):
    notes = base_notes(spark, sf)
    return context.inject(notes, base_links(notes), segment.entity_codes(notes), options=InjectOptions(format="markdown", flags=("DECISION", "CORE")))


TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.FLAG_TITLES.items())


@query(f"""WITH {sql.NOTES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seq) AS p, least(5, greatest(1, ceil(count(*) OVER (PARTITION BY doc_id) * 0.15))) AS lim FROM notes),
cut AS (SELECT *, max(CASE WHEN p = lim THEN weight END) OVER (PARTITION BY doc_id) AS c FROM ranked),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seq) AS k FROM cut WHERE weight >= c OR list_has_any(flags, ['ORIGIN', 'CORE', 'GENESIS']))
SELECT doc_id, replace(string_agg(CASE flags[1] {TITLES} ELSE '' END || quote, '. ' ORDER BY k), '..', '.') AS text FROM kept WHERE k <= 5 GROUP BY doc_id""")
def wake_up(spark, sf):
    return context.wake_up(base_notes(spark, sf))


@query(f"WITH {sql.NOTES} SELECT doc_id, id, rank FROM (SELECT doc_id, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seq) AS INT) AS rank FROM notes) WHERE rank <= 4")
def top_notes(spark, sf):
    return context.top_notes(base_notes(spark, sf), 4).select("doc_id", "id", "rank")


def tied_notes(spark, sf):
    """Notes with their codes and scored links, as TIED."""
    notes = phrased_notes(spark, sf)
    codes = segment.entity_codes(notes)
    return notes, links.build_links(notes, codes, threshold=0.1).withColumn("label", F.lit("x")), codes


@query()
def inject_budget(spark, sf):
    """Text blocks of at most 400 tokens, guaranteed flags first; greedy, the rules are tested against brute force."""
    return context.inject(*tied_notes(spark, sf), options=InjectOptions(max_tokens=400, guarantee_flags=("ORIGIN",)))


@query()
def inject_json(spark, sf):
    """JSON of at most 900 tokens; greedy, the rules are tested against brute force."""
    return context.inject(*tied_notes(spark, sf), options=InjectOptions(format="json", max_tokens=900))


@query()
def mmr_select(spark, sf):
    """Markdown of three notes, relevant and unlike each other; greedy, the rules are tested against brute force."""
    return context.inject(*tied_notes(spark, sf), options=InjectOptions(max_notes=3, selection="mmr", format="markdown"))


@query("SELECT DISTINCT conv_id AS doc_id, 'FILE:000||||v2' AS text FROM conversations")
def inject_nothing(spark, sf):
    """Filters that leave no note leave the header."""
    return context.inject(*tied_notes(spark, sf), options=InjectOptions(min_weight=2.0))


@query(f"""WITH {sql.NOTES}, {CODES}, coded AS (SELECT n.doc_id, n.seq, string_agg(c.code, '+' ORDER BY c.name) AS codes FROM (SELECT doc_id, seq, unnest(entities) AS name FROM notes) n JOIN codes c USING (doc_id, name) GROUP BY ALL)
SELECT n.doc_id, n.seq, n.id || ':' || coalesce(codes, '') || '|' || array_to_string(topics, ',') || '|"' || replace(replace(replace(replace(quote, '\\', '\\\\'), '"', '\\"'), E'\\r', '\\r'), E'\\n', '\\n') || '"|' || printf('%.2f', weight) || '||' || array_to_string(flags, '+') AS line
FROM notes n LEFT JOIN coded USING (doc_id, seq)""")
def note_lines(spark, sf):
    notes = base_notes(spark, sf)
    rows = codec.with_book(notes, segment.entity_codes(notes))
    return rows.select("doc_id", "seq", codec.note_line(rows).alias("line"))


LINES = """coded AS (SELECT n.doc_id, n.seq, string_agg(c.code, '+' ORDER BY c.name) AS codes FROM (SELECT doc_id, seq, unnest(entities) AS name FROM notes) n JOIN codes c USING (doc_id, name) GROUP BY ALL),
lines AS (SELECT n.doc_id, n.seq, n.id || ':' || coalesce(codes, '') || '|' || array_to_string(list_transform(topics, lambda t: replace(t, ' ', '\\_')), ',') || '|"' || replace(replace(replace(replace(quote, '\\', '\\\\'), '"', '\\"'), E'\\r', '\\r'), E'\\n', '\\n') || '"|' || printf('%.2f', weight) || '||' || array_to_string(flags, '+') AS line
FROM notes n LEFT JOIN coded USING (doc_id, seq))"""


@query(f"""WITH RECURSIVE {sql.NOTES.replace('notes AS', 'plain_notes AS', 1)}, {PHRASED}, {CODES}, {sql.links('notes', 0.1)}, {LINES},
met AS (SELECT doc_id, code, min(seq * 100 + i) AS first FROM (SELECT doc_id, seq, unnest(entities) AS name, generate_subscripts(entities, 1) AS i FROM notes) JOIN codes USING (doc_id, name) GROUP BY ALL),
tops AS (SELECT doc_id, string_agg(code, '+' ORDER BY first) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS k FROM met) WHERE k <= 3 GROUP BY doc_id),
parts AS (
  SELECT doc_id, 0 AS part, 0::DOUBLE AS x, 0::DOUBLE AS y, 0 AS z, 'FILE:' || lpad(count(*)::VARCHAR, 3, '0') || '|' || coalesce(any_value(tops), '') || '|||v2' AS line FROM notes LEFT JOIN tops USING (doc_id) GROUP BY doc_id
  UNION ALL SELECT doc_id, 1, 0, 0, 0, 'E:' || string_agg(code || '=' || name, ';' ORDER BY code) FROM codes GROUP BY doc_id
  UNION ALL SELECT doc_id, 2, seq, 0, 0, line FROM lines
  UNION ALL SELECT doc_id, 3, a, -score, b, 'T:' || lpad(a::VARCHAR, 3, '0') || '<->' || lpad(b::VARCHAR, 3, '0') || '|x' FROM tied)
SELECT doc_id, string_agg(line, E'\\n' ORDER BY part, x, y, z) AS text FROM parts GROUP BY doc_id""")
def text_form(spark, sf):
    """Memories as text: header, names, notes, links by where they start and how strong they are."""
    return codec.encode(*tied_notes(spark, sf))


@query(f"WITH {sql.NOTES} SELECT doc_id, id, true AS same_quote, true AS same_entities, true AS same_topics, true AS same_flags, true AS same_weight FROM notes")
def codec_roundtrip(spark, sf):
    """Memories to text and back; the columns say whether both are equal."""
    notes = base_notes(spark, sf)
    ties = base_links(notes).withColumn("label", F.lit("x"))
    back = memory.decode(codec.encode(notes, ties, segment.entity_codes(notes)))
    b = back.notes.select("doc_id", "id", *[F.col(c).alias(f"{c}_2") for c in ("quote", "entities", "topics", "flags", "weight")])
    rows = notes.join(b, ["doc_id", "id"], "left")
    same = [(F.col(c).eqNullSafe(F.col(f"{c}_2"))).alias(f"same_{c}") for c in ("quote", "entities", "topics", "flags")]
    return rows.select("doc_id", "id", *same, (F.abs(F.col("weight") - F.col("weight_2")) < 0.006).alias("same_weight"))


OLD_NAMES = "list_transform(entities, lambda e: upper(left(e, 3)))"


def old_texts(spark, sf):
    """Memories in the older text form: no escapes, topics by _, names as codes; a wrong count, a line of no kind, an unknown flag."""
    notes = base_notes(spark, sf)
    names = F.array_join(F.transform("entities", lambda e: F.upper(F.substring(e, 1, 3))), "+")
    line = F.concat("id", F.lit(":"), names, F.lit("|"), F.array_join("topics", "_"), F.lit('|"'), F.replace("quote", F.lit("\n"), F.lit(" ")), F.lit('"|'), F.format_string("%.2f", "weight"), F.lit("||"), F.array_join(F.concat("flags", texts_of("ODD")), "+"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")
    return notes.groupBy("doc_id").agg(F.concat(F.lit("FILE:000|||old\nno note at all\n"), lines).alias("text"))


@query(f"""WITH {sql.NOTES} SELECT doc_id, seq, id, array_to_string({OLD_NAMES}, '+') AS entities, array_to_string(topics, ',') AS topics, md5(replace(quote, E'\\n', ' ')) AS digest, weight, array_to_string(flags, ',') AS flags,
CAST(count(*) OVER (PARTITION BY doc_id) + 2 AS INT) AS warnings FROM notes""")
def decode_old(spark, sf):
    """Memories from the older text form, with what was amiss in them counted."""
    m = memory.decode(old_texts(spark, sf))
    rows = m.notes.join(m.meta.select("doc_id", F.size("warnings").alias("warnings")), "doc_id")
    return rows.select("doc_id", "seq", "id", F.array_join("entities", "+").alias("entities"), F.array_join("topics", ",").alias("topics"), F.md5(F.col("quote").cast("binary")).alias("digest"), "weight", F.array_join("flags", ",").alias("flags"), "warnings")


# ---- conflicts and duplicates

DECISIONS = (
    "We decided to use Redis here.", "We decided against Redis here.", "We will ship it on friday then, or so.", "We will ship it on monday then.", "They agreed to approve the plan.",
    "They agreed to reject the plan.", "We chose Rust, but never saw why.", "Yes.",
)
SENTENCE = "list_extract([" + ", ".join(f"'{d}'" for d in DECISIONS) + "], CAST((conv_id * 3 + turn * 5) % 8 + 1 AS INT))"
TURN_TEXT = f"CASE WHEN turn % 7 = 6 THEN {SENTENCE} ELSE text || ' ' || {SENTENCE} END"
CUES = " OR ".join(f"(contains(low, {sql.quoted(c)}) AND NOT regexp_matches(substring(low, CAST(strpos(low, {sql.quoted(c)}) AS INT), 60), '\\b({'|'.join(lex.NEGATION_ENDS)})\\b'))" for c in dict.fromkeys(lex.NEGATION_CUES))
OPPOSED = " OR ".join(f"(list_contains(x.ws, {sql.quoted(a)}) AND list_contains(y.ws, {sql.quoted(b)}))" for p in lex.ANTONYMS for a, b in (p, p[::-1]))


@query(f"""WITH {sql.NOTES.replace('text AS quote', f"{TURN_TEXT} AS quote")},
line AS (SELECT conv_id AS doc_id, turn + 1 AS seq, {TURN_TEXT} AS t FROM conversations),
place AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM line),
text AS (SELECT doc_id, string_agg(t, E'\\n\\n' ORDER BY seq) AS whole FROM line GROUP BY doc_id),
tail AS (SELECT p.doc_id, p.seq, trim(substring(whole, CAST(coalesce(b.s + length(b.t), 0) + 1 AS INT), CAST(p.s + length(p.t) - coalesce(b.s + length(b.t), 0) AS INT)), E' \\n') AS tail,
  trim(substring(whole, CAST(greatest(p.s - 15, 0) + 1 AS INT), CAST(p.s + length(p.t) - greatest(p.s - 15, 0) AS INT)), E' \\n') AS full_text FROM place p JOIN text USING (doc_id) LEFT JOIN place b ON b.doc_id = p.doc_id AND b.seq = p.seq - 1),
said AS (SELECT n.* REPLACE (CASE WHEN n.seq % 3 = 0 THEN list_concat(entities, ['Redis']) ELSE entities END AS entities, list_concat(topics, CASE WHEN (n.doc_id + n.seq) % 2 = 0 THEN ['app', 'the plan'] ELSE ['app'] END) AS topics), CASE WHEN length(tail) >= 20 THEN tail ELSE full_text END AS said FROM notes n JOIN tail USING (doc_id, seq) WHERE (n.doc_id + n.seq) % 3 < 2),
told AS (SELECT *, lower(said) AS low, trim(regexp_extract(said, '(?is)\\b(?:{'|'.join(lex.VALUE_VERBS)})\\b(.*)$', 1), E' \\n') AS after FROM said),
judged AS (SELECT *, ({CUES}) AS no, left(lower(trim(regexp_extract(after, '(?s)^(.*?)(?:[,;.!?\\n]|\\b(?:and|or|but|because|so|if)\\b|$)', 1), E' \\n')), 60) AS value, list_filter(regexp_split_to_array(low, '[^a-z0-9_]+'), lambda w: w <> '') AS ws FROM told),
pair AS (SELECT x.doc_id, x.id AS earlier, y.id AS later, coalesce(list_filter(x.entities, lambda e: list_contains(y.entities, e))[1], list_filter(x.topics, lambda e: list_contains(y.topics, e) AND length(e) > 3)[1]) AS shared_topic,
  x.said AS said_x, y.said AS said_y, x.resolved_date AS day_x, y.resolved_date AS day_y,
  CASE WHEN x.no <> y.no THEN 'negation-flip'
    WHEN x.value <> '' AND y.value <> '' AND x.value <> y.value AND len(list_intersect(string_split(x.value, ' '), string_split(y.value, ' '))) / len(list_distinct(list_concat(string_split(x.value, ' '), string_split(y.value, ' ')))) < 0.8 THEN 'value-change'
    WHEN {OPPOSED} THEN 'antonym' END AS signal FROM judged x JOIN judged y ON x.doc_id = y.doc_id AND x.seq < y.seq)
SELECT doc_id, earlier, later, shared_topic, signal, '[' || shared_topic || '] "' || regexp_replace(left(said_x, 60), '\\s+', ' ', 'g') || '"' || coalesce(' (' || day_x || ')', '') || ' → "' || regexp_replace(left(said_y, 60), '\\s+', ' ', 'g') || '"' || coalesce(' (' || day_y || ')', '') || ' (' || signal || ')' AS summary
FROM pair WHERE shared_topic IS NOT NULL AND signal IS NOT NULL""")
def decision_conflicts(spark, sf):
    """Decisions put behind the turns of conversations, told from each other by the text that is their own."""
    t = read(spark, sf, "conversations")
    said = picked(DECISIONS, (F.col("conv_id") * 3 + F.col("turn") * 5) % 8)
    line = F.when(F.col("turn") % 7 == 6, said).otherwise(F.concat("text", F.lit(" "), said))
    rows = t.withColumn("line", line)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 2).over(before), F.lit(0)).cast("int")
    places = rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("seq"), "line", F.greatest(start - 15, F.lit(0)).alias("source_start"), (start + F.length("line")).alias("source_end"))
    lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
    sources = places.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))
    flags = F.when((F.col("doc_id") + F.col("seq")) % 3 < 2, texts_of("DECISION")).otherwise(texts_of())
    notes = base_notes(spark, sf).drop("quote").join(places.withColumnRenamed("line", "quote"), ["doc_id", "seq"]).withColumn("flags", flags)
    named = F.when(F.col("seq") % 3 == 0, F.concat("entities", texts_of("Redis"))).otherwise(F.col("entities"))
    on = F.concat("topics", F.when((F.col("doc_id") + F.col("seq")) % 2 == 0, texts_of("app", "the plan")).otherwise(texts_of("app")))
    notes = notes.withColumns({"entities": named, "topics": on})
    return conflicts.conflicts(notes, sources)


TOKENS = "list_distinct(list_concat(list_filter(regexp_split_to_array(lower(quote), '[^a-z0-9_]+'), lambda w: length(w) >= 2), list_concat(topics, list_transform(entities, lambda e: lower(e)))))"
DUP = f"""{sql.NOTES}, sets AS (SELECT doc_id, seq, {TOKENS} AS t FROM notes),
prs AS (SELECT a.doc_id, a.seq AS a, b.seq AS b, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS na, len(b.t) AS nb FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.seq < b.seq),
dup AS (SELECT doc_id, a, b, k / (na + nb - k) AS score FROM prs WHERE k > 0)"""


@query(f"WITH {DUP} SELECT doc_id, a, b, round(score, 6) AS score FROM dup WHERE score >= 0.15")
def near_duplicates(spark, sf):
    return dedupe.similar_notes(base_notes(spark, sf), 0.15).select("doc_id", "a", "b", rounded("score", "score"))


@query(f"""WITH RECURSIVE {DUP}, e AS (SELECT doc_id, a, b FROM dup WHERE score >= 0.15 UNION ALL SELECT doc_id, b, a FROM dup WHERE score >= 0.15),
r AS (SELECT DISTINCT doc_id, a AS seq, a AS root FROM e UNION SELECT e.doc_id, e.b, r.root FROM r JOIN e ON e.doc_id = r.doc_id AND e.a = r.seq)
SELECT doc_id, seq, min(root) AS root FROM r GROUP BY doc_id, seq""")
def dup_components(spark, sf):
    return dedupe.components(dedupe.similar_notes(base_notes(spark, sf), 0.15))


HASH = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(regexp_split_to_array(w, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296)"
#: The constants of the hashes by the generator's own steps (32-bit numbers).
DRAWN = """state AS (SELECT i, (930589345 + (i + 1) * 1831565813::HUGEINT) % 4294967296 AS s FROM range(64) t(i)),
turn1 AS (SELECT i, CAST((xor(s::BIGINT, s::BIGINT >> 15)::HUGEINT * (s::BIGINT | 1)) % 4294967296 AS BIGINT) AS t FROM state),
turn2 AS (SELECT i, xor(t, CAST((t + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296) % 4294967296 AS BIGINT)) AS t FROM turn1),
drawn AS (SELECT i, CAST(floor(xor(t, t >> 14) / 4294967296 * 4294967295) AS BIGINT) AS v FROM turn2),
constants AS (SELECT a.i // 2 AS j, a.v | 1 AS a, b.v AS b FROM drawn a JOIN drawn b ON b.i = a.i + 1 WHERE a.i % 2 = 0)"""
MINHASH = f"""{DRAWN}, {sql.NOTES}, hashed AS (SELECT doc_id, seq, unnest(list_transform(list_filter(topics, lambda w: w <> ''), lambda w: {HASH})) AS h FROM notes WHERE len(topics) > 0),
least AS (SELECT doc_id, seq, j, min(CAST((a::HUGEINT * h + b) % 4294967296 AS BIGINT)) AS v FROM hashed, constants GROUP BY ALL),
sig AS (SELECT doc_id, seq, list(v ORDER BY j) AS sig FROM least GROUP BY ALL)"""


def topic_sets(spark, sf):
    return base_notes(spark, sf).where(F.size("topics") > 0)


@query(f"WITH {MINHASH} SELECT doc_id, seq, array_to_string(sig, ',') AS signature FROM sig")
def minhash_signature(spark, sf):
    return links.signatures(topic_sets(spark, sf), "topics").select("doc_id", "seq", F.array_join(F.col("sig").cast("array<string>"), ",").alias("signature"))


BANDS = "[" + ", ".join(f"'{b}:' || sig[{2 * b + 1}] || ':' || sig[{2 * b + 2}]" for b in range(hashing.BANDS)) + "]"


@query(f"""WITH {MINHASH}, keys AS (SELECT doc_id, seq, unnest({BANDS}) AS k FROM sig),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY seq) AS n FROM keys) WHERE n <= 64)
SELECT DISTINCT x.doc_id, x.seq AS a, y.seq AS b FROM first x JOIN first y ON x.doc_id = y.doc_id AND x.k = y.k AND x.seq < y.seq""")
def lsh_pairs(spark, sf):
    return links.band_pairs(topic_sets(spark, sf), "topics")


GROUPED = "notes AS (SELECT doc_id % 10 AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 10 ORDER BY -doc_id, seq) AS INT) AS seq, * EXCLUDE (doc_id, seq) FROM plain_notes)"


@query(f"""WITH RECURSIVE {sql.NOTES.replace('notes AS', 'plain_notes AS', 1)}, {GROUPED}, {sql.links('notes')}, {sql.weighted('notes', 'weight')},
tie AS (SELECT doc_id, a AS seq, count(*) AS n FROM tied GROUP BY ALL)
SELECT doc_id, lpad(seq::VARCHAR, CAST(greatest(3, length(seq::VARCHAR)) AS INT), '0') AS id, md5(quote) AS digest, f.weight, NULL::INT AS source_start, n.resolved_date, coalesce(tie.n, 0) AS n_links FROM notes n JOIN final f USING (doc_id, seq) LEFT JOIN tie USING (doc_id, seq)""")
def merge_renumber(spark, sf):
    """Memories united by tens, the last conversation first: numbers, links and weights made anew, places dropped."""
    notes = base_notes(spark, sf).withColumn("source_start", F.lit(1)).withColumn("source_end", F.lit(2))
    meta = notes.groupBy("doc_id").agg(F.count("*").alias("input_length"))
    groups = meta.select("doc_id", (F.col("doc_id") % 10).alias("group_id"), (-F.col("doc_id")).alias("position"))
    m = memory.merge(memory.Memory(notes, base_links(notes), segment.entity_codes(notes), meta), groups)
    ties = m.links.groupBy("doc_id", F.col("from_id").alias("id")).agg(F.count("*").alias("n_links"))
    rows = m.notes.join(ties, ["doc_id", "id"], "left")
    return rows.select("doc_id", "id", F.md5(F.col("quote").cast("binary")).alias("digest"), "weight", "source_start", "resolved_date", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(f"WITH {sql.NOTES}, {CODES.replace('FROM notes', 'FROM (SELECT * REPLACE (doc_id % 10 AS doc_id) FROM notes)', 1)} SELECT * FROM codes")
def merge_codes(spark, sf):
    """Names of united memories are coded anew."""
    notes = base_notes(spark, sf)
    meta = notes.groupBy("doc_id").agg(F.count("*").alias("input_length"))
    groups = meta.select("doc_id", (F.col("doc_id") % 10).alias("group_id"), F.col("doc_id").alias("position"))
    return memory.merge(memory.Memory(notes, base_links(notes), segment.entity_codes(notes), meta), groups).codes


# ---- measures and vectors

WORDS_OF = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"


@query(f"""WITH pairs AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, {WORDS_OF.format('a.text')} AS p, {WORDS_OF.format('b.text')} AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT pair_id, w, count(*) AS a FROM (SELECT pair_id, unnest(p) AS w FROM pairs) GROUP BY ALL), y AS (SELECT pair_id, w, count(*) AS b FROM (SELECT pair_id, unnest(g) AS w FROM pairs) GROUP BY ALL),
o AS (SELECT pair_id, sum(least(a, b)) AS k FROM x JOIN y USING (pair_id, w) GROUP BY pair_id)
SELECT pair_id, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0 ELSE 0.0 END ELSE 2.0 * coalesce(k, 0) / (len(p) + len(g)) END, 6) AS f1,
contains(array_to_string(p, ' '), array_to_string(g, ' ')) AS held FROM pairs LEFT JOIN o USING (pair_id)""")
def token_f1(spark, sf):
    t = read(spark, sf, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    pairs = t.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("said"), "gold")
    return evaluate.token_f1(pairs).select("pair_id", rounded("f1", "f1"), "held")


@query(f"""{answered(sql.NOTES)},
best AS (SELECT q.query_id, min(rank) AS rank FROM questions q LEFT JOIN answers t ON t.query_id = q.query_id AND t.id = lpad((1 + q.query_id % 3)::VARCHAR, 3, '0') GROUP BY ALL)
SELECT round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS found_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS found_at_5, count(*) AS n FROM best""")
def mean_reciprocal_rank(spark, sf):
    expected = turn_questions(spark, sf).select("query_id", text.note_id(1 + F.col("query_id") % 3).alias("id"))
    out = evaluate.reciprocal_ranks(bm25_top5(spark, sf), expected)
    return out.select(rounded("mrr", "mrr"), rounded("found_at_1", "found_at_1"), rounded("found_at_5", "found_at_5"), "n")


@query("""SELECT label, round(avg(quality), 6) AS mean_quality, count(*) AS n FROM (SELECT doc_id % 7 AS label, quality FROM labels) GROUP BY label""")
def mean_by_category(spark, sf):
    rows = read(spark, sf, "labels").select((F.col("doc_id") % 7).alias("label"), "quality")
    return evaluate.mean_by(rows, "label", "quality").select("label", rounded("mean_quality", "mean_quality"), "n")


@query("SELECT event_type, value AS middle FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = n // 2 + 1")
def median_value(spark, sf):
    return evaluate.middle(read(spark, sf, "events"), "event_type", "value")


@query("""WITH m AS (SELECT label, list_transform(range(1, 65), lambda i: i) AS ix, list(embedding) AS es FROM embeddings GROUP BY label),
v AS (SELECT label, list_transform(ix, lambda i: list_sum(list_transform(es, lambda e: e[i]::DOUBLE))) AS v FROM m),
u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS mean FROM v),
c AS (SELECT e.vec_id, e.label AS query_id, ((e.vec_id * 13) % 97) / 10.0 AS bm25, list_sum(list_transform(list_zip(e.embedding, u.mean), lambda p: p[1]::DOUBLE * p[2])) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS cosine FROM embeddings e JOIN u ON u.label = e.label)
SELECT vec_id, round(0.7 * CASE WHEN max(bm25) OVER w > 0 THEN bm25 / max(bm25) OVER w ELSE 0 END + 0.3 * CASE WHEN max(cosine) OVER w > 0 THEN cosine / max(cosine) OVER w ELSE 0 END, 5) AS blended FROM c WINDOW w AS (PARTITION BY query_id)""")
def embedding_blend(spark, sf):
    e = read(spark, sf, "embeddings")
    means = evaluate.mean_vector(e, "label", "embedding", 64)
    rows = e.join(means, "label").select("vec_id", F.col("label").alias("query_id"), (F.col("vec_id") * 13 % 97 / 10.0).alias("bm25"), evaluate.cosine("embedding", "mean").alias("cosine"))
    return evaluate.blend(rows, 0.3).select("vec_id", F.round("blended", 5).alias("blended"))


FACTS = ("The access word is zebra.", "Ann keeps the spare key.", "The train leaves at nine.")


@query(r"""WITH f AS (SELECT unnest([0, 1, 2]) AS fact_id, unnest(['The access word is zebra.', 'Ann keeps the spare key.', 'The train leaves at nine.']) AS sentence),
p AS (SELECT doc_id, CAST(doc_id % 5 AS INT) AS fact_id, string_split(replace(text, E'\n', E'\n\n'), E'\n\n') AS ps FROM documents),
j AS (SELECT p.*, sentence, (doc_id * 7 + p.fact_id * 3) % (len(ps) + 1) AS pl FROM p JOIN f ON f.fact_id = p.fact_id)
SELECT doc_id, fact_id, md5(array_to_string(list_concat(list_concat(list_slice(ps, 1, pl), [sentence]), list_slice(ps, pl + 1, len(ps))), E'\n\n')) AS digest FROM j""")
def fact_planting(spark, sf):
    facts = spark.createDataFrame(list(enumerate(FACTS)), "fact_id int, sentence string")
    return evaluate.plant(doc_corpus(spark, sf), facts, 5).select("doc_id", "fact_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"""SELECT conv_id, turn, md5(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(?i)\b(?:and|the)[a-z]*', '<mark>\0</mark>', 'g')) AS digest FROM conversations""")
def highlight(spark, sf):
    t = read(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.md5(text.highlight("text", "The and of").cast("binary")).alias("digest"))


# ---- whole memories


@query(f"""{noted('signals', 'names', 'dates', 'topics')}, words AS (SELECT doc_id, idx AS seq, list(topic ORDER BY rank) AS topics FROM topics GROUP BY ALL),
notes AS MATERIALIZED (SELECT c.doc_id, c.seq, c.s, c.e, lpad(c.seq::VARCHAR, 3, '0') AS id, entities, coalesce(topics, []) AS topics, raw_weight, flags, emotions, resolved_date
  FROM chunk c JOIN entity USING (doc_id, seq) JOIN signals USING (doc_id, seq) JOIN dated USING (doc_id, seq) LEFT JOIN words USING (doc_id, seq)),
{sql.links('notes')}, {sql.weighted('notes', 'raw_weight')}
SELECT doc_id, n.id, n.s AS source_start, n.e AS source_end, array_to_string(entities, ',') AS entities, array_to_string(topics, ',') AS topics, array_to_string(flags, ',') AS flags, array_to_string(emotions, ',') AS emotions, f.weight, resolved_date FROM notes n JOIN final f USING (doc_id, seq)""")
def build_memory(spark, sf):
    """All notes of whole documents with planted sentences, weighted by their links; everything but their quotes."""
    notes = memory.build(planted_corpus(spark, sf), parts=tuple(p for p in memory.PARTS if p != "quote")).notes
    return notes.select("doc_id", "id", "source_start", "source_end", *[F.array_join(c, ",").alias(c) for c in ("entities", "topics", "flags", "emotions")], "weight", "resolved_date")


@query(f"""{noted('names', 'topics')}, words AS (SELECT doc_id, idx AS seq, list(topic ORDER BY rank) AS topics FROM topics GROUP BY ALL),
notes AS MATERIALIZED (SELECT c.doc_id, c.seq, lpad(c.seq::VARCHAR, 3, '0') AS id, entities, coalesce(topics, []) AS topics FROM chunk c JOIN entity USING (doc_id, seq) LEFT JOIN words USING (doc_id, seq)), {sql.links('notes')}
SELECT doc_id, lpad(a::VARCHAR, 3, '0') AS from_id, lpad(b::VARCHAR, 3, '0') AS to_id, round(score, 6) AS score FROM tied""")
def build_memory_links(spark, sf):
    """The links of the same memories."""
    return memory.build(planted_corpus(spark, sf), parts=("entities", "topics")).links.select("doc_id", "from_id", "to_id", rounded("score", "score"))


@query()
def memory_text(spark, sf):
    """Memories of the conversations as text."""
    return memory.build(conv_corpus(spark, sf)).encode()


@query()
def recall_context(spark, sf):
    """Passages for each conversation's first turn, over links."""
    m = memory.build(conv_corpus(spark, sf), BuildOptions(chunk_size=400, chunk_overlap=0))
    return m.recall_context(turn_questions(spark, sf), RecallOptions(top_k=3))


@query()
def stream_replay(spark, sf):
    """The state of each conversation after its last message, with decay, absorption and eviction."""
    options = StreamOptions(BuildOptions(dedupe=True, dedupe_threshold=0.8), half_life_turns=50, max_notes=200)
    states = live.replay(read(spark, sf, "conversations"), options)
    return states.select("conv_id", "turn", "pushed", F.size("notes").alias("n_notes"), F.size("codes").alias("n_codes"))


# ---- more of the parts

@query(f"WITH {sql.NOTES}, {sql.LINKS} SELECT doc_id, 'T:' || from_id || '<->' || to_id || '|x' AS line FROM links")
def link_lines(spark, sf):
    return base_links(base_notes(spark, sf)).withColumn("label", F.lit("x")).select("doc_id", codec.link_line().alias("line"))


@query(f"""WITH {MINHASH} SELECT a.doc_id, a.seq, round(list_sum(list_transform(list_zip(a.sig, b.sig), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) / 32, 6) AS estimate
FROM sig a JOIN sig b ON a.doc_id = b.doc_id AND b.seq = a.seq + 1""")
def jaccard_estimate(spark, sf):
    notes = links.signatures(topic_sets(spark, sf), "topics")
    after = notes.select("doc_id", (F.col("seq") - 1).alias("seq"), F.col("sig").alias("next"))
    return notes.join(after, ["doc_id", "seq"]).select("doc_id", "seq", F.round(hashing.estimate("sig", "next"), 6).alias("estimate"))


@query("SELECT conv_id AS doc_id, md5(string_agg(text, E'\\n\\n' ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def stream_source_log(spark, sf):
    return live.source_log(read(spark, sf, "conversations")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def stream_snapshot(spark, sf):
    """Memories of the streams as they stand after their last messages, asked nothing yet."""
    options = StreamOptions(BuildOptions(dedupe=True), half_life_turns=10, max_notes=4)
    return live.snapshot(live.replay(read(spark, sf, "conversations"), options), options).notes.drop("entities", "topics")


@query()
def merged_memories(spark, sf):
    """Memories of conversations united by tens."""
    m = memory.build(conv_corpus(spark, sf), BuildOptions(chunk_size=400, chunk_overlap=0))
    groups = m.meta.select("doc_id", (F.col("doc_id") % 10).alias("group_id"), F.col("doc_id").alias("position"))
    return memory.merge(m, groups).notes.select("doc_id", "id", "quote", "weight")


@query()
def key_quotes(spark, sf):
    """The key quote of each turn; by sentence centrality, checked by tests."""
    t = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return segment.annotate_notes(t, wanted=("quote",)).select("doc_id", "seq", "quote")
