"""What the operators of this subpackage share: reading, checkpoints, word hashing and Arrow passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that are worked on together; it bounds memory, not results.
CHUNK = 256

#: Tables stored inside the innermost scratch(), if any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only in local mode, where all tasks see it, one of our own if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgraph-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows are in the shared folder, so a lost executor takes none with it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Like checkpoint(), as a compressed Parquet table, so that later reads prune columns.

    The table goes at the end of the scratch() around it, unless it is to be kept; else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = _made.get()
    if made is not None and not keep:
        made.append(path)
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were stored inside. What is read later must be stored with keep=True."""
    before = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(before)
        for path in made or ():
            remove(spark, path)


#: Estimates beyond this are no sizes: the optimiser has none for rows that come from no file.
UNKNOWN = 1 << 52


def tasks_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many tasks a table's size asks for, by the optimiser's estimate; without one, the cores. Nothing is run for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > UNKNOWN:
        return df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(1 << 16, -(-size // bytes_each)))


def dealt(df: DataFrame, like: DataFrame, *keys: str) -> DataFrame:
    """`df` by its keys, in as many parts as the size of `like` asks for, and no fewer than the session's shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, tasks_for(like)), *keys)


def arrow_pass(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow in slices of CHUNK rows. make() runs once in each task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                if (out := work(batch.slice(at, CHUNK))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


class WordHash(dict):
    """word (bytes) -> 64-bit hash, kept for the words seen; emptied when large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of the n consecutive values from each place (len(h) - n + 1 of them; n <= len(h))."""
    m = len(h) - n + 1
    key = np.uint64((0x9E3779B97F4A7C15 * seed | 1) & 0xFFFFFFFFFFFFFFFF)
    out = h[:m].copy()
    for i in range(1, n):
        out *= key
        out += h[i : i + m]
    return mix(out)


def bucket_of(col: str):
    """crc32 of an id as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
