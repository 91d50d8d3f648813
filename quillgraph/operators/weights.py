"""Importance of notes: degree in the link graph, midranks, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round2


def degrees(links: DataFrame) -> DataFrame:
    """doc_id, id, degree."""
    ends = links.select("doc_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.groupBy("doc_id", "id").agg(F.count("*").alias("degree"))


def blend_centrality(notes: DataFrame, links: DataFrame, weight: str = "weight", share: float = 0.2) -> DataFrame:
    """Weights with a share of each note's degree, relative to the largest of its document."""
    most = F.max("degree").over(Window.partitionBy("doc_id"))
    both = notes.join(degrees(links), ["doc_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    central = F.when(most > 0, F.col("degree") / most).otherwise(0.0)
    return both.withColumn("weight", (1 - share) * F.col(weight) + share * central).drop("degree")


def midrank(weight: str = "weight", key: str = "doc_id") -> Column:
    """Rank from 0 by weight; equal weights share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(key).orderBy(weight)) - 1 + (F.count("*").over(Window.partitionBy(key, weight)) - 1) / 2


def normalize_weights(notes: DataFrame, temperature: float = 0.5) -> DataFrame:
    """Weights from 0 to 1 by the exponential of their midrank; one note alone keeps its weight."""
    whole = Window.partitionBy("doc_id")
    ranked = notes.withColumn("n_", F.count("*").over(whole)).withColumn("e_", F.exp((midrank() / F.greatest(F.col("n_") - 1, F.lit(1)) / temperature) - 1 / temperature))
    low, high = F.min("e_").over(whole), F.max("e_").over(whole)
    value = F.when(high > low, round2((F.col("e_") - low) / F.when(high > low, high - low))).otherwise(1.0)
    return ranked.withColumn("weight", F.when(F.col("n_") > 1, value).otherwise(F.col("weight"))).drop("n_", "e_")


def decayed(weight: Column, age: Column, half_life: float | None) -> Column:
    """A weight after `age` turns."""
    return weight if not half_life or half_life <= 0 else weight * F.pow(F.lit(0.5), age / half_life)
