"""The similarity graph of notes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import BLANK
from .passes import each

#: Members of a band's bucket that make pairs: the first so many. Only for MinHash bands, which may miss pairs.
BUCKET = 64


#: Notes of a document up to which all are compared with all.
DIRECT = 64


def phrase_words(topics: Column | str) -> Column:
    """Distinct words of two characters or more, in order."""
    topics = F.col(topics) if isinstance(topics, str) else topics
    return F.array_distinct(F.filter(F.flatten(F.transform(topics, lambda t: F.split(t, f"[{BLANK}]+"))), lambda w: F.length(w) >= 2))


def signatures(sets: DataFrame, tokens: str = "tokens") -> DataFrame:
    """doc_id, seq, sig: the MinHash signature of each set (doc_id, seq, tokens)."""
    return each(sets.select("doc_id", "seq", tokens), ["doc_id", "seq"], lambda words: [(hashing.signature(words),)], "sig array<long>")


def band_pairs(sets: DataFrame, tokens: str = "tokens") -> DataFrame:
    """doc_id, a, b: sets (doc_id, seq, tokens) that share a MinHash band, each pair once."""
    keys = signatures(sets, tokens).select("doc_id", "seq", F.explode(hashing.bands("sig")).alias("key"))
    first = keys.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("seq"))).where(F.col("n") <= BUCKET)
    members = first.groupBy("doc_id", "key").agg(F.collect_list("seq").alias("own")).where(F.size("own") > 1)
    pairs = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return members.select("doc_id", F.inline(pairs)).distinct()


def similar_pairs(sets: DataFrame, score: Callable[[str, str], Column], threshold: float, **least: float) -> DataFrame:
    """doc_id, a, b, score: pairs of rows (doc_id, seq, arrays of distinct tokens) with a score of `threshold` or more, each once.

    least: for each array to compare, the least Jaccard similarity that such a pair has in one of them. score is made of the
    two rows' arrays (`{array}_a` and `{array}_b`; tokens are 64-bit hashes there). No pair is missed: documents of at most
    DIRECT rows compare all; in larger ones, of an array's n tokens, the rarest first, all but the last ceil(least * n) - 1
    are joined, as two that share that many share one of these. Rows bring their arrays along and a pair is judged where it
    meets first, so nothing is shuffled for pairs that are not similar.
    """
    names = list(least)

    def hashed(kind: int) -> Callable[[Column], Column]:
        return lambda t: F.xxhash64(F.lit(kind), t)

    def of_kind(kind: int) -> Callable[[Column], Column]:
        return lambda t: t["kind"] == kind

    rows = sets.select("doc_id", "seq", *[F.transform(c, hashed(k)).alias(c) for k, c in enumerate(names)])
    rows = rows.withColumn("rows_", F.count("*").over(Window.partitionBy("doc_id")))

    def side(of: DataFrame, x: str, *keys: str) -> DataFrame:
        return of.select("doc_id", *keys, F.col("seq").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in of.columns if c not in ("doc_id", "seq", "rows_", *keys)])

    def judged(both: DataFrame) -> DataFrame:
        return both.select("doc_id", "a", "b", score("a", "b").alias("score")).where(F.col("score") >= threshold)

    few = rows.where(F.col("rows_") <= DIRECT)
    direct = judged(side(few, "a").join(side(few, "b"), "doc_id").where("a < b"))

    arrays = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("tokens")) for k, c in enumerate(names)])
    many = rows.where(F.col("rows_") > DIRECT).select("doc_id", "seq", F.inline(arrays)).select("doc_id", "seq", "kind", F.explode("tokens").alias("token"))
    many = many.withColumn("held", F.count("*").over(Window.partitionBy("doc_id", "token")))
    many = many.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("kind", "held", "token"))).alias("all"))

    def front(tokens: Column, c: str) -> Column:
        n = F.size(tokens)
        return F.slice(tokens, F.lit(1), F.greatest(n - F.ceil(n * F.lit(float(least[c])) - 1e-9).cast("int") + F.when(n > 0, 1).otherwise(0), F.lit(0)))

    def keys(x: str) -> Column:
        return F.concat(*[front(F.col(f"{c}_{x}"), c) for c in names])

    many = many.select("doc_id", "seq", *[F.filter("all", of_kind(k)).alias(c) for k, c in enumerate(names)])
    joined = F.filter(F.concat(*[front(F.col(c), c) for c in names]), lambda t: t["held"] > 1)
    many = many.select("doc_id", "seq", *[F.transform(c, lambda t: t["token"]).alias(c) for c in names], F.explode(F.transform(joined, lambda t: t["token"])).alias("token"))
    both = side(many, "a", "token").join(side(many, "b", "token"), ["doc_id", "token"]).where("a < b")
    # judged where they meet first: at the first of a's keys that is one of b's
    return direct.unionByName(judged(both.where(F.get(F.array_intersect(keys("a"), keys("b")), F.lit(0)) == F.col("token"))))


def overlap(name: str, a: str = "a", b: str = "b") -> Column:
    """The Jaccard similarity of two arrays of distinct tokens."""
    shared = F.size(F.array_intersect(f"{name}_{a}", f"{name}_{b}"))
    return F.when(shared > 0, shared / (F.size(f"{name}_{a}") + F.size(f"{name}_{b}") - shared)).otherwise(0.0)


def scored(pairs: DataFrame, sets: DataFrame, score: Callable[[str, str], Column], threshold: float, *names: str) -> DataFrame:
    """doc_id, a, b, score of pairs (doc_id, a, b) that are similar enough."""
    side = {x: sets.select("doc_id", F.col("seq").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab"}
    both = pairs.join(side["a"], ["doc_id", "a"]).join(side["b"], ["doc_id", "b"])
    return both.select("doc_id", "a", "b", score("a", "b").alias("score")).where(F.col("score") >= threshold)


def link_candidates(notes: DataFrame, threshold: float = 0.3, full: int | None = None) -> DataFrame:
    """doc_id, a, b (sequence numbers, a < b), score: pairs of notes similar enough in names or topic words.

    All such pairs, unless `full` is given: then documents of more notes get theirs from MinHash bands, which miss some.
    """
    sets = notes.select("doc_id", "seq", F.array_distinct("entities").alias("names"), phrase_words("topics").alias("words"))

    def score(a: str, b: str) -> Column:
        return F.greatest(overlap("names", a, b) * 1.2, overlap("words", a, b))

    if full is None:
        return similar_pairs(sets, score, threshold, names=threshold / 1.2, words=threshold)
    sets = sets.withColumn("small", F.count("*").over(Window.partitionBy("doc_id")) <= full)
    plain = sets.where("NOT small").select("doc_id", "seq", F.array_distinct(F.concat("words", "names")).alias("tokens"))
    found = scored(band_pairs(plain), sets, score, threshold, "names", "words")
    return similar_pairs(sets.where("small"), score, threshold, names=threshold / 1.2, words=threshold).unionByName(found)


def cap_degree(pairs: DataFrame, top_k: int = 3) -> DataFrame:
    """Of (doc_id, a, b, score) by falling score, those whose ends both have fewer than `top_k` so far.

    Streams each document's pairs in order and keeps a counter for each of its notes; ties go by a, then b.
    """
    schema = pairs.select("doc_id", "a", "b", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, defaultdict(int)
        for batch in batches:
            keep = []
            for doc, a, b in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                if doc != now:
                    now, used = doc, defaultdict(int)
                ok = used[a] < top_k and used[b] < top_k
                if ok:
                    used[a] += 1
                    used[b] += 1
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = schema.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("score"), "a", "b")
    return dealt.mapInArrow(run, schema.schema)


def kept(a: str, b: str) -> Column:
    """The values of array a that are in b, repeats included, in a's order."""
    return F.filter(F.col(a), lambda x: F.array_contains(F.col(b), x))


def link_labels(pairs: DataFrame, notes: DataFrame, codes: DataFrame, verbose: bool = False) -> DataFrame:
    """doc_id, from_id, to_id, label, score: why two notes are linked."""
    told = F.map_from_entries(F.collect_list(F.struct("name", F.col("name") if verbose else F.col("code"))))
    books = codes.groupBy("doc_id").agg(told.alias("book"))
    side = {x: notes.select("doc_id", F.col("seq").alias(x), F.col("id").alias(f"id_{x}"), F.col("entities").alias(f"names_{x}"), F.col("topics").alias(f"topics_{x}")) for x in "ab"}
    both = pairs.join(side["a"], ["doc_id", "a"]).join(side["b"], ["doc_id", "b"]).join(books, "doc_id", "left")
    both = both.withColumn("names", kept("names_a", "names_b")).withColumn("phrases", kept("topics_a", "topics_b"))
    both = both.withColumn("words_a", phrase_words("topics_a")).withColumn("words_b", phrase_words("topics_b"))
    shown = F.transform(F.slice("names", 1, 3), lambda n: n if verbose else F.coalesce(F.try_element_at("book", n), F.upper(F.substring(n, 1, 3))))
    phrase = F.array_join(F.slice("phrases", 1, 2), "_")
    word = F.array_join(F.slice(kept("words_a", "words_b"), 1, 2), "_")
    label = (
        F.when(F.size("names") >= 2, F.array_join(shown, "+"))
        .when((F.size("phrases") > 0) & (F.size("names") == 1), F.regexp_replace(F.concat_ws("_", F.col("names")[0], phrase), "^_+|_+$", ""))
        .when(F.size("phrases") > 0, phrase)
        .when(word != "", word)
        .otherwise(F.coalesce(F.get("names", F.lit(0)), F.lit("")))
    )
    return both.select("doc_id", F.col("id_a").alias("from_id"), F.col("id_b").alias("to_id"), label.alias("label"), "score")


def build_links(notes: DataFrame, codes: DataFrame, threshold: float = 0.3, top_k: int = 3, verbose: bool = False, full: int | None = None) -> DataFrame:
    """doc_id, from_id, to_id, label, score: at most `top_k` links for each note. notes: doc_id, seq, id, entities, topics.

    full: see link_candidates.
    """
    return link_labels(cap_degree(link_candidates(notes, threshold, full), top_k), notes, codes, verbose)


def in_order(links: DataFrame) -> DataFrame:
    """Adds `at`: each document's links by where they start, then by falling score, then by where they end."""
    score = [F.desc("score")] if "score" in links.columns else []
    order = Window.partitionBy("doc_id").orderBy(F.collate("from_id", "UNICODE"), *score, F.col("to_id").try_cast("long"), "to_id")
    return links.withColumn("at", F.row_number().over(order))


def links_among(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links with both ends among the chosen notes (doc_id, id)."""
    ids = chosen.select("doc_id", "id")
    for end in ("from_id", "to_id"):
        links = links.join(ids.withColumnRenamed("id", end), ["doc_id", end], "left_semi")
    return links
