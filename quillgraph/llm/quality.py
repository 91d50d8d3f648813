"""Quality scores by Bradley-Terry ranking.

From all pairs of a better and a worse document, logistic loss on the difference of their features gives the
weights of a score. The score at the quantile that parts the training rows as their labels do becomes 0.3,
and a logistic curve takes scores to 0..1.

No pair is made for that. A pair's loss is a smooth function of the difference of two scores, so what the pairs of a
row add up to depends on its score alone, and is found from the other class's sums on a grid of scores. Rows
between grid points go to the eight around them (Lagrange polynomials), which errs by less than 1e-9 of a loss.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, bucket_of, read, scratch, stored
from .linear import fit_logistic, sigmoid
from .toxicity import sample_labels

#: Weight of the penalty beside the mean loss of a pair; Newton steps at most; digits of a weight that do not hang on the order of sums.
RIDGE, STEPS, DIGITS = 1e-3, 50, 6

#: Distance of grid points; grid points on either side of a score that share its row.
GRID, REACH = 0.125, 4

#: Parts into which a pass cuts a span of scores.
PARTS = 1024

#: A score of CUT or more counts as quality 1.
CUT = 0.3

UPPER, DIGIT, SYMBOL, PUNCT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d"), re.compile(r"[#$%&*|<>{}\[\]=+~^\\_/@]"), re.compile(r"[.,;:!?\"'()-]")


def features(text: str | None) -> list[float]:
    """Shape of a text: sizes, shares of character classes, repetition of words, pairs of words and lines."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * 20
    counts = Counter(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = counts.most_common(1)[0][1]
    bare = sum(map(str.isalpha, words))
    return [
        math.log1p(n), len("".join(words)) / n,
        len(UPPER.findall(text)) / chars, len(DIGIT.findall(text)) / chars, len(SYMBOL.findall(text)) / chars, len(PUNCT.findall(text)) / chars,
        text.count("!") / n, text.count("|") / n, text.count(".") / n, text.count(",") / n,
        len(counts) / n, len(counts) / n**0.8, top / n, 1 - pairs / max(1, n - 1), twice / n,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), bare / n,
        sum(w.isupper() for w in words) / n, sum(w[0].isupper() for w in words) / n,
    ]


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.sums(x) - self.cut) * self.slope + math.log(CUT / (1 - CUT)))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Weighted sums, added in one order whatever rows lie beside a row, so that equal features have equal sums."""
        out = np.zeros(len(x))
        for column, weight in zip(self.wide(x).T, self.weights, strict=True):
            out += column * weight
        return out

    def wide(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, and how far each lies beyond one deviation on either side."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])

    def span(self) -> tuple[float, float]:
        """Bounds of the sums of any features."""
        z = np.array([-8.0, -1.0, 1.0, 8.0])  # a feature's part is linear between these
        own, over, under = self.weights.reshape(3, -1, 1)
        part = own * z + over * np.maximum(z - 1, 0) + under * np.maximum(-z - 1, 0)
        return float(part.min(1).sum()), float(part.max(1).sum())


def shapes(docs: DataFrame) -> DataFrame:
    """doc_id and the features x of every row. Null texts count as empty ones."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pa.array(list(map(features, batch[1].to_pylist())), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch[0], x], ["doc_id", "x"])

        return work

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, x array<double>")


def numbers(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def total(rows: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows (y, x) of what add(sum, x, y) adds. Each task sends its rows of the sum that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                add(own, numbers(part[1]), part[0].to_numpy(zero_copy_only=False))
        held = np.flatnonzero(own.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(list(own[held]), pa.list_(pa.float64()))], ["at", "v"])

    out = np.zeros(shape)
    found = rows.select("y", "x").mapInArrow(run, "at long, v array<double>").toArrow()
    for batch in found.to_batches():
        np.add.at(out, batch[0].to_numpy(), numbers(batch[1]))
    return out


def near(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the 2 * REACH grid points around each score, and the share of each of them in it."""
    below = np.floor(s / GRID)
    u = s / GRID - below + REACH - 1
    share = np.ones((2 * REACH, len(s)))
    for j in range(2 * REACH):
        for i in range(2 * REACH):
            if i != j:
                share[j] *= (u - i) / (j - i)
    return below.astype(np.int64) - (REACH - 1), share


class Pairs:
    """Mean loss of all pairs of a good and a bad row, with the ridge, at the weights of `rank`; its slope and its curvature."""

    def __init__(self, rows: DataFrame, rank: Ranking, counts: Sequence[int]):
        self.rows, self.rank, self.counts = rows, rank, counts
        least, most = rank.span()
        self.low = low = math.floor(least / GRID) - REACH
        self.size = size = math.floor(most / GRID) + REACH + 2 - low

        def tally(out: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            first, share = near(rank.sums(x))
            place = y * size + first - low
            order = np.argsort(place, kind="stable")
            places, starts = np.unique(place[order], return_index=True)
            z = np.column_stack([np.ones(len(x)), rank.wide(x)])[order]
            for j in range(2 * REACH):
                out[places + j] += np.add.reduceat(share[j][order, None] * z, starts, axis=0)

        sums = total(rows, (2 * size, len(rank.weights) + 1), tally).reshape(2, size, -1)
        self.bad, self.good = (np.flatnonzero(sums[y].any(axis=1)) for y in (0, 1))
        bad, good = sums[0, self.bad] / counts[0], sums[1, self.good] / counts[1]
        gap = (self.good[:, None] - self.bad) * GRID
        wrong = sigmoid(-gap)
        w = rank.weights
        self.loss = float(good[:, 0] @ np.logaddexp(0, -gap) @ bad[:, 0] + RIDGE / 2 * w @ w)
        self.slope = good[:, 0] @ wrong @ bad[:, 1:] - wrong @ bad[:, 0] @ good[:, 1:] + RIDGE * w
        unsure = wrong * (1 - wrong)
        self.cross = good[:, 1:].T @ unsure @ bad[:, 1:]
        self.each = np.zeros((2, size))
        self.each[0, self.bad], self.each[1, self.good] = good[:, 0] @ unsure / counts[0], unsure @ bad[:, 0] / counts[1]

    def curvature(self) -> np.ndarray:
        rank, low, size, each = self.rank, self.low, self.size, self.each.ravel()

        def squares(out: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            first, share = near(rank.sums(x))
            place = y * size + first - low
            z = rank.wide(x)
            out += (z * sum(share[j] * each[place + j] for j in range(2 * REACH))[:, None]).T @ z

        width = len(rank.weights)
        return total(self.rows, (width, width), squares) - self.cross - self.cross.T + RIDGE * np.eye(width)


def all_pairs(rows: DataFrame, rank: Ranking, counts: Sequence[int]) -> np.ndarray:
    """The weights with the least loss over all pairs, by Newton steps that are halved while the loss grows."""
    here = Pairs(rows, rank, counts)
    for _ in range(STEPS):
        step = np.linalg.solve(here.curvature(), -here.slope)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
        while True:
            there = Pairs(rows, Ranking(rank.mean, rank.scale, here.rank.weights + step, 0.0, 1.0), counts)
            if there.loss <= here.loss + 1e-9 or np.abs(step).max() < 1e-6:
                break
            step /= 2
        here = there
        if np.abs(step).max() < 1e-6:
            break
    return np.round(here.rank.weights, DIGITS)


def drawn_pairs(rows: DataFrame, rank: Ranking, pairs: int) -> np.ndarray:
    """The weights by `pairs` drawn pairs of at most so many rows of each class."""
    order = F.xxhash64("doc_id"), "doc_id", "x"
    bad, good = (rank.wide(np.array([r["x"] for r in rows.where(F.col("y") == y).orderBy(*order).limit(pairs).collect()])) for y in (0, 1))
    draw = np.random.default_rng(7)
    better, worse = draw.choice(len(good), pairs), draw.choice(len(bad), pairs)
    sign = np.where(np.arange(pairs) % 2, 1.0, -1.0)
    return fit_logistic((good[better] - bad[worse]) * sign[:, None], (sign + 1) / 2, ridge=1000 * RIDGE, intercept=False)


def at_ranks(values: DataFrame, ranks: Sequence[int]) -> list[float]:
    """The values of column s at these places (from 0) of their order: each pass counts the parts of the spans they lie in."""
    least, most = values.agg(F.min("s"), F.max("s")).first()
    spans = {k: (least, most, 0) for k in ranks}  # its ends are values; how many lie before it
    while wide := sorted({span for span in spans.values() if span[0] < span[1]}):
        part = [
            F.when(F.col("s").between(a, b), F.struct(F.lit(i).alias("i"), F.floor((F.col("s") - a) / (b - a) * PARTS).alias("part"), "s"))
            for i, (a, b, _) in enumerate(wide)
        ]
        held = values.select(F.explode(F.array_compact(F.array(*part))).alias("p")).select("p.*").groupBy("i", "part")
        found = sorted(held.agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).collect())
        for k, span in spans.items():
            if span in wide:
                before = span[2]
                for r in found:
                    if r["i"] == wide.index(span):
                        if before + r["n"] > k:
                            spans[k] = (r["a"], r["b"], before)
                            break
                        before += r["n"]
    return [spans[k][0] for k in ranks]


def quantiles(values: DataFrame, n: int, shares: Sequence[float]) -> list[float]:
    """Quantiles of the n values in column s, linear between neighbours."""
    places = [q * (n - 1) for q in shares]
    ends = [min(n - 1, math.floor(p) + i) for p in places for i in (0, 1)]
    found = at_ranks(values, ends)
    return [a + (b - a) * (p - math.floor(p)) for p, a, b in zip(places, found[::2], found[1::2], strict=True)]


def fit_ranking(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, sample: int | None = None, pairs: int | None = None) -> Ranking:
    """Learns from all labelled rows (those of `labels` where `keep` holds) and all pairs of a good and a bad one.

    With `sample`, only from so many labelled rows of each class; with `pairs`, only from so many drawn pairs.
    Without labelled rows of both classes every document scores CUT.
    """
    return fit_shapes(shapes(docs), labels, label, keep, sample, pairs)


def fit_shapes(shaped: DataFrame, labels: DataFrame, label: str = "quality", keep=None, sample: int | None = None, pairs: int | None = None) -> Ranking:
    """fit_ranking() on the rows of shapes()."""
    chosen = labelled(labels, label, keep) if sample is None else sample_labels(labels, label, sample, keep)
    width = len(features(""))
    with scratch(shaped.sparkSession):
        rows = stored(shaped.join(chosen.hint("merge"), "doc_id").select("doc_id", "y", "x"), "labelled")
        each = [f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(width)]
        n, n1, *found = rows.agg(F.count("*"), F.sum("y"), *each).first()
        counts = n - (n1 or 0), n1 or 0
        if not all(counts):
            return Ranking(np.zeros(width), np.ones(width), np.zeros(3 * width), 0.0, 1.0)
        mean, scale = np.round(np.array(found).reshape(2, width), 9)
        rank = Ranking(mean, np.maximum(scale, 1e-6), np.zeros(3 * width), 0.0, 1.0)
        rank.weights = all_pairs(rows, rank, counts) if pairs is None else drawn_pairs(rows, rank, pairs)
        s = stored(summed(rows, rank), "sums")
        bad, good = s.where("y = 0"), s.where("y = 1")
        (low, mid0), (high, mid1) = quantiles(bad, counts[0], (0.97, 0.5)), quantiles(good, counts[1], (0.01, 0.5))
        # the quantile that parts the rows as their labels do; where a gap lies between the classes, its middle
        rank.cut = (low + high) / 2 if low < high else quantiles(s, n, [counts[0] / n])[0]
        rank.slope = 4.0 / max(mid1 - mid0, 1e-6)
    return rank


def labelled(labels: DataFrame, label: str, keep=None) -> DataFrame:
    """doc_id and y (the label) of every labelled document; of rows that repeat a doc_id the largest label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return (rows.where(keep) if keep is not None else rows).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def summed(rows: DataFrame, rank: Ranking) -> DataFrame:
    """y and the weighted sum s of every row (doc_id, y, x)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch[0], pa.array(rank.sums(numbers(batch[1])))], ["y", "s"])

        return work

    return arrow_pass(rows.select("y", "x"), make, "y int, s double")


def score_quality(docs: DataFrame, rank: Ranking) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from CUT on) for every row. Null texts score as empty ones."""
    return scored(docs.select(F.col("doc_id").cast("long"), "text"), rank, lambda text: np.array(list(map(features, text.to_pylist()))))


def score_shapes(shaped: DataFrame, rank: Ranking) -> DataFrame:
    """score_quality() on the rows of shapes()."""
    return scored(shaped.select("doc_id", "x"), rank, numbers)


def scored(rows: DataFrame, rank: Ranking, read_x: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = rank.scores(read_x(batch[1]))
            return pa.RecordBatch.from_arrays([batch[0], pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

        return work

    return arrow_pass(rows, make, "doc_id long, score double, predicted int")


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    shaped = stored(shapes(docs), "shapes", keep=True)
    held_out = bucket_of("doc_id") % 5 == 0
    rank = fit_shapes(shaped, read(spark, sf_dir, "labels"), keep=~held_out)
    return score_shapes(shaped, rank).select("doc_id", held_out.alias("held_out"), "score", "predicted")
