"""Language identification by rank-order profiles.

A profile is the list of the most frequent 1- to 3-grams of letters, words being set off by blanks. A text
goes to the language whose profile has the smallest out-of-place distance: the sum, over the text's own most
frequent n-grams, of how far their rank lies from their rank in the profile (the most for those not in it).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_pass, bucket_of, read

#: N-grams in a profile, and of a text that are compared.
SIZE = 300

#: About so many documents of each language are learned from: a hash of the id picks them.
SAMPLE = 3_000


@functools.cache
def _symbols() -> np.ndarray:
    """Code point -> its number among all letters, from 1 on (below 2^20), else 0: a blank."""
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    return np.where(letter, np.cumsum(letter), 0).astype(np.uint64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams; none if it has no letter. A code holds n and three symbols of 20 bits."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[points]
    if not s.any():
        return np.array([], np.uint64), np.array([], np.int64)
    s = np.concatenate([[np.uint64(0)], s, [np.uint64(0)]])
    s = s[np.flatnonzero((s[1:] != 0) | (s[:-1] != 0))[0] :]
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one blank between words
    a, b, c = s, s[1:], s[2:]
    one = a[a != 0] | np.uint64(1 << 60)
    two = a[:-1] << np.uint64(20) | b | np.uint64(2 << 60)
    three = (a[:-2] << np.uint64(40) | b[:-1] << np.uint64(20) | c | np.uint64(3 << 60))[b[:-1] != 0]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:size]] if len(codes) > size else codes[np.lexsort((codes, -counts))]


@dataclass
class Profiles:
    """For each language its n-grams by code, and their ranks."""

    langs: list[str]
    codes: list[np.ndarray]
    ranks: list[np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, counts)
        place = np.arange(len(own))
        far = []
        for known, rank in zip(self.codes, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            far.append(int(np.where(known[at] == own, np.minimum(np.abs(rank[at] - place), SIZE), SIZE).sum()))
        best = int(np.argmin(far))
        rest = min((f for i, f in enumerate(far) if i != best), default=SIZE * len(own))
        return self.langs[best], 0.5 + 0.5 * (rest - far[best]) / max(rest, 1) if rest else 0.5


def fit_profiles(docs: DataFrame, keep: Column, sample: int = SAMPLE) -> Profiles:
    """Learns a profile for each non-null `lang` from about `sample` documents of it (fewer if it has fewer) where `keep` holds."""
    rows = docs.where(keep & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string").alias("lang"))
    shares = rows.groupBy("lang").agg((sample / F.count("*")).alias("share"))  # one row per language
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(ngrams(text))
            for lang, found in by_lang.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([n for _, n in found]), len(codes))
                out += [(lang, int(c), int(n)) for c, n in zip(codes, sums, strict=True)]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["lang", "code", "n"])

        return work

    counted = arrow_pass(drawn.select("lang", "text"), make, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    top = counted.withColumn("rank", rank).where(F.col("rank") < SIZE).select("lang", "code", "rank").orderBy("lang", "code").collect()
    langs = sorted({r["lang"] for r in top})
    of = {x: [(r["code"], r["rank"]) for r in top if r["lang"] == x] for x in langs}
    return Profiles(langs, [np.array([c for c, _ in of[x]], np.uint64) for x in langs], [np.array([k for _, k in of[x]], np.int64) for x in langs])


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for every row.

    A text that is null or has no letter is `und` with score 0 (as is every text when no language was learned). The score
    is 0.5 when two languages are equally near and grows to 1 as the nearest one's lead grows. Ties go to the first name.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = zip(*map(profiles.predict, batch[1].to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch[0], pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

        return work

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id") % 3 == 1
    profiles = fit_profiles(docs, ~held_out)
    return identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
