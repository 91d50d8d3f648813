"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over words and their beginnings (so that inflected and
compound forms count); each model also gets the probabilities of the categories before it. In training these are
out-of-fold predictions, so a later model sees earlier probabilities as good as it will meet. The last category decides.

The categories are columns of the labels. Labels that know only toxic and not have none, so kinds of toxicity are found
in the data: the toxic training texts are clustered by the words that tell them from the others (spherical k-means), and
each cluster is a category of the chain.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, read
from .linear import best_cut, fit_logistic, sigmoid

#: Bounds of the fit: labelled rows of each class, words and beginnings that become features, folds, kinds of toxicity.
SAMPLE, WORDS, FOLDS, KINDS = 3_000, 256, 3, 3

WORD = re.compile(r"[^\W\d_]{2,}")
BEGIN = (4, 5, 6)


def words_of(text: str | None) -> set[str]:
    """The words of a text, and as `begin-` the first four to six letters of longer ones."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*({f"{w[:n]}-" for w in words if len(w) >= n} for n in BEGIN))


@dataclass
class Chain:
    """words: feature columns; models: (category, weights over words, earlier categories and intercept); cut: least probability of the last."""

    words: list[str]
    models: list[tuple[str, np.ndarray]]
    cut: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for _, w in self.models:
            out = np.column_stack([out, sigmoid(np.column_stack([x, out, np.ones(len(x))]) @ w)])
        return out


def sample_labels(labels: DataFrame, label: str, size: int, keep=None, more: Sequence[str] = ()) -> DataFrame:
    """The `size` labelled doc_ids of each class that come first by a hash of the id; bounded, the same in every run.

    Columns: doc_id, y (the label) and those of `more`, null as 0. Of rows that repeat a doc_id each label is the largest.
    """
    ones = [F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in more]
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = (rows.where(keep) if keep is not None else rows).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"), *ones)
    first = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    return first[0].unionByName(first[1])


def matrix(texts, words: list[str]) -> np.ndarray:
    """One row per text: which of the feature words it holds."""
    at = {w: i for i, w in enumerate(words)}
    begins = [(n, {w[:-1] for w in words if len(w) == n + 1 and w[-1] == "-"}) for n in BEGIN]
    x = np.zeros((len(texts), len(words)))
    for i, t in enumerate(texts):
        if t:
            own = set(WORD.findall(t.lower()))
            held = own & at.keys()
            for n, some in begins:
                held |= {f"{b}-" for b in {w[:n] for w in own} & some}
            x[i, [at[w] for w in held]] = 1
    return x


def kinds_of(x: np.ndarray, kinds: int, steps: int = 20) -> np.ndarray:
    """The cluster of each row, the largest being 0; -1 for rows of zeros. Spherical k-means from rows far from each other."""
    size = np.sqrt((x * x).sum(1))
    out = np.full(len(x), -1)
    at = np.flatnonzero(size > 0)
    if not len(at):
        return out
    unit = x[at] / size[at, None]
    near = unit @ unit.sum(0)
    centres = [unit[int(np.argmax(near))]]
    while len(centres) < min(kinds, len(at)):
        centres.append(unit[int(np.argmin(np.max(unit @ np.array(centres).T, axis=1)))])
    middle = np.array(centres)
    for _ in range(steps):
        own = np.argmax(unit @ middle.T, axis=1)
        sums = np.array([unit[own == k].sum(0) if (own == k).any() else middle[k] for k in range(len(middle))])
        middle = sums / np.sqrt((sums * sums).sum(1, keepdims=True))
    order = np.argsort(-np.bincount(own, minlength=len(middle)), kind="stable")
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    out[at] = rank[own]
    return out


def chain_of(x: np.ndarray, targets: list[tuple[str, np.ndarray]], words: list[str]) -> Chain:
    """Fits the models one after the other; each gets the out-of-fold probabilities of those before it."""
    fold = np.arange(len(x)) % FOLDS
    models, ahead = [], np.zeros((len(x), 0))
    for name, t in targets:
        xs = np.column_stack([x, ahead])
        apart = np.zeros(len(x))
        for f in range(FOLDS):
            w = fit_logistic(xs[fold != f], t[fold != f])
            apart[fold == f] = sigmoid(np.column_stack([xs[fold == f], np.ones((fold == f).sum())]) @ w)
        models.append((name, fit_logistic(xs, t)))
        ahead = np.column_stack([ahead, apart])
    return Chain(words, models, max(0.5, best_cut(ahead[:, -1], targets[-1][1])))


def fit_chain(docs: DataFrame, labels: DataFrame, label: str = "toxic", categories: Sequence[str] = (), kinds: int = KINDS, sample: int = SAMPLE, keep=None) -> Chain:
    """Fits the chain on at most 2 * `sample` labelled documents (rows of `labels` where `keep` holds).

    Its categories are the columns `categories` of `labels`, in this order, or without any `kinds` clusters of the toxic
    texts; then comes `label`. Without labelled documents of both classes, empty tables included, the chain finds nothing.
    """
    drawn = sample_labels(labels, label, sample, keep, categories)
    held = docs.select(F.col("doc_id").cast("long")).join(F.broadcast(drawn), "doc_id")
    sizes = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        names = (*(categories or (f"kind{k + 1}" for k in range(kinds))), label)
        return Chain([], [(c, np.array([*([0.0] * i), -35.0])) for i, c in enumerate(names)], 0.5)
    # at most 2 * sample rows of a few numbers
    text = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y", *categories)

    def tally():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[str, list[int]] = {}
            for at in range(0, batch.num_rows, 32):
                for t, y in zip(batch[1].slice(at, 32).to_pylist(), batch[2].slice(at, 32).to_pylist(), strict=True):
                    for w in words_of(t):
                        c = found.setdefault(w, [0, 0])
                        c[0] += y
                        c[1] += 1
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in (0, 1))], ["w", "p", "n"])

        return work

    by_word = arrow_pass(text, tally, "w string, p long, n long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (n0 + 1))
    chosen = by_word.where("n >= 3").select("w", "n", odds.alias("odds")).orderBy((F.abs("odds") * F.sqrt("n")).desc(), "w").limit(WORDS).collect()
    words = [r["w"] for r in chosen]
    wanted = set(words)

    def hold():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = [sorted(words_of(t) & wanted) for t in batch[1].to_pylist()]
            return pa.RecordBatch.from_arrays([batch[0], *batch.columns[2:], pa.array(held, pa.list_(pa.string()))], ["doc_id", "y", *categories, "words"])

        return work

    rows = arrow_pass(text, hold, ", ".join(["doc_id long", *(f"`{c}` int" for c in ("y", *categories)), "words array<string>"])).orderBy("doc_id", "words").collect()
    at = {w: i for i, w in enumerate(words)}
    x, y = np.zeros((len(rows), len(words))), np.array([r["y"] for r in rows], float)
    for i, r in enumerate(rows):
        x[i, [at[w] for w in r["words"]]] = 1
    if categories:
        targets = [(c, np.array([r[c] for r in rows], float)) for c in categories]
    else:
        telling = np.maximum([r["odds"] for r in chosen], 0.0)
        kind = np.full(len(rows), -1)
        kind[y == 1] = kinds_of(x[y == 1] * telling, kinds)
        targets = [(f"kind{k + 1}", (kind == k).astype(float)) for k in range(kinds)]
    return chain_of(x, [*targets, (label, y)], words)


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, one probability column p_<category> each, and `toxic` (1 if the last reaches the cut), for every row.

    Null and empty texts hold no word, so they get the probabilities of a text without any feature word. A null doc_id
    stays, repeated rows get a row each, an empty table gives no rows; texts count whole, however long.
    """
    names = [f"p_{c}" for c, _ in chain.models]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = chain.probabilities(matrix(batch[1].to_pylist(), chain.words))
            toxic = pa.array((p[:, -1] >= chain.cut).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch[0], *(pa.array(c) for c in p.T), toxic], ["doc_id", *names, "toxic"])

        return work

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), make, ", ".join(["doc_id long", *(f"{n} double" for n in names), "toxic int"]))


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of `docs`, all columns, without those that the chain rejects.

    Null and empty texts are judged as a text without any feature word (kept, unless most such texts are toxic). Repeated
    rows are kept or go together; ids take no part; an empty table gives no rows; other columns are left as they are.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = chain.probabilities(matrix(batch[batch.schema.get_field_index("text")].to_pylist(), chain.words))
            return batch.filter(pa.array(p[:, -1] < chain.cut))

        return work

    return arrow_pass(docs, make, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, the probabilities, and toxic, 1 for those that the chain rejects."""
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_chain(docs, read(spark, sf_dir, "labels")))
