"""One Arrow pass that makes rows of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are worked on together; it bounds memory, not results.
SLICE = 64


def each(rows: DataFrame, keys: list[str], of: Callable[..., Iterable[tuple]], fields: str) -> DataFrame:
    """For each row its keys, once with each tuple of `fields` that `of` gives for the row's other columns."""
    told = StructType.fromDDL(fields)
    schema = StructType([*(rows.schema[k] for k in keys), *told.fields])
    kinds, names = to_arrow_schema(told).types, schema.names
    rest = [c for c in rows.columns if c not in keys]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                take: list[int] = []
                out: list[tuple] = []
                for i, values in enumerate(zip(*(c.to_pylist() for c in part.columns[n:]), strict=True)):
                    out += of(*values)
                    take += [i] * (len(out) - len(take))
                if out:
                    held = [c.take(pa.array(take, pa.int64())) for c in part.columns[:n]]
                    yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return rows.select(*keys, *rest).mapInArrow(run, schema)
