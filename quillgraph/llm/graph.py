"""Connected components of a link table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links that a task holds at a time while it turns them into a forest.
HELD = 500_000


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, with the components of `links`; each task leaves out links that close a circle among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (p := up.get(top, top)) != top:
                top = p
            while (p := up.get(x, x)) != top:
                up[x], x = top, p
            return top

        def out() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(up)]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) >= HELD:
                yield out()
        if up:
            yield out()

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach, for every node in a link.

    Links are gathered into as few tasks as can hold them, and each makes a forest of its own. If that is one task, its
    trees are the components. Otherwise each round hooks every node to its smallest neighbour, follows these hooks to
    their ends by doubling, and goes on with the links between the ends; every round at least halves what is left.
    """
    links = checkpoint(links.select("a", "b").where("a != b"))
    tasks = -(-links.count() // HELD)
    left = checkpoint(forest(links.coalesce(max(1, tasks))).where("a != b"))
    if tasks <= 1:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(left.select("b", "b").distinct())
    left = left.distinct()
    labels = None
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")))
        while True:
            ends = hook.where("a = p").select("a")
            inner = hook.where("a != p")
            nxt = inner.select("a", F.col("p").alias("q")).join(inner.select(F.col("a").alias("q"), "p"), "q")
            if nxt.isEmpty():
                break
            jumped = inner.alias("x").join(inner.select(F.col("a").alias("q"), F.col("p").alias("r")), F.col("p") == F.col("q"), "left")
            hook = checkpoint(jumped.select("a", F.coalesce("r", "p").alias("p")).unionAll(ends.select("a", F.col("a").alias("p"))))
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(hook, labels["label"] == hook["a"], "left").select("node", F.coalesce("p", "label").alias("label"))
        labels = checkpoint(labels)
        one = left.join(hook, "a").select(F.col("p").alias("x"), "b")
        two = one.join(hook.select(F.col("a").alias("b"), F.col("p").alias("y")), "b").where("x != y")
        left = checkpoint(forest(two.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct())
    return labels
