"""Measures of answers, and vectors beside words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answer_words(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: (t != "") & ~t.isin("a", "an", "the"))


def token_f1(pairs: DataFrame, key: str = "pair_id", said: str = "said", gold: str = "gold") -> DataFrame:
    """key, f1, held: overlap of two answers' words with repeats, and whether the gold words stand in the said ones in a row."""
    rows = pairs.select(key, answer_words(said).alias("p"), answer_words(gold).alias("g"))
    p = rows.select(key, F.explode("p").alias("w")).groupBy(key, "w").agg(F.count("*").alias("a"))
    g = rows.select(key, F.explode("g").alias("w")).groupBy(key, "w").agg(F.count("*").alias("b"))
    both = p.join(g, [key, "w"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("both"))
    np_, ng = F.size("p"), F.size("g")
    both_n = F.coalesce("both", F.lit(0))
    f1 = F.when((np_ == 0) | (ng == 0), F.when(np_ == ng, 1.0).otherwise(0.0)).when(both_n == 0, 0.0).otherwise(2.0 * both_n / (np_ + ng))
    return rows.join(both, key, "left").select(key, f1.alias("f1"), F.contains(F.array_join("p", " "), F.array_join("g", " ")).alias("held"))


def reciprocal_ranks(hits: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: mean reciprocal rank of the expected ids (query_id, id) among the hits (query_id, id, rank), and shares found by rank k."""
    best = hits.join(expected, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = expected.select("query_id").distinct().join(best, "query_id", "left")
    found = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"found_at_{k}") for k in ks]
    return rows.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), *found, F.count("*").alias("n"))


def mean_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n"))


def middle(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The upper middle value of each key's rows."""
    order = Window.partitionBy(key).orderBy(value)
    placed = rows.select(key, F.col(value).alias("middle"), F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return placed.where("i = floor(n / 2) + 1").select(key, "middle")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def mean_vector(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """key, mean: the mean of each key's vectors, of length one."""
    sums = [F.sum(F.col(vector)[i].cast("double")).alias(f"v{i}") for i in range(width)]
    total = rows.groupBy(key).agg(*sums).select(key, F.array(*[F.col(f"v{i}") for i in range(width)]).alias("v"))
    size = F.sqrt(dot(F.col("v"), F.col("v")))
    return total.select(key, F.transform("v", lambda x: x / F.when(size > 0, size).otherwise(1.0)).alias("mean"))


def blend(rows: DataFrame, share: float, words: str = "bm25", vectors: str = "cosine", key: str = "query_id") -> DataFrame:
    """Adds `blended`: scores of words and of vectors, each by its largest for the question."""
    whole = Window.partitionBy(key)

    def part(c: str) -> Column:
        most = F.max(c).over(whole)
        return F.when(most > 0, F.col(c) / most).otherwise(0.0)

    return rows.withColumn("blended", (1 - share) * part(words) + share * part(vectors))


#: Rows of facts that may be broadcast.
FACTS = 10_000


def plant(texts: DataFrame, facts: DataFrame, every: int) -> DataFrame:
    """doc_id, fact_id, text: a fact's sentence put as a paragraph of its own, at a place that the ids decide.

    facts: fact_id, sentence; document d gets fact (d mod every), if there is one. Up to FACTS of them go out whole, as a
    join by number would bring all texts of a fact into one task.
    """
    if facts.limit(FACTS + 1).count() <= FACTS:
        facts = F.broadcast(facts)
    rows = texts.withColumn("fact_id", F.pmod("doc_id", F.lit(every)).cast("int")).join(facts, "fact_id")
    paras = F.split("text", "\n\n")
    at = F.pmod(F.col("doc_id") * 7 + F.col("fact_id") * 3, F.size("p") + 1).cast("int")
    placed = F.concat(F.slice("p", F.lit(1), F.col("at")), F.array("sentence"), F.slice("p", F.col("at") + 1, F.size("p")))
    return rows.withColumn("p", paras).withColumn("at", at).select("doc_id", "fact_id", F.array_join(placed, "\n\n").alias("text"))
