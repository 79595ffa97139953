"""Sequential work within small groups, without a pandas frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

Rows = list[tuple]


def by_runs(rows: DataFrame, keys: list[str], order: list, fn: Callable[[Rows], Rows], schema: str) -> DataFrame:
    """Calls fn with each key's rows, as tuples in `order`, and returns its tuples.

    Rows are hashed by key and sorted by Spark, then streamed: a task holds one key's rows and
    one batch at a time. Use it only where a key's rows are few by the data's nature.
    """
    places = [rows.columns.index(k) for k in keys]
    key = itemgetter(*places)
    sample = rows.sparkSession.createDataFrame([], schema)
    names = sample.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows = []

        def emit(done: Rows) -> pa.RecordBatch:
            cols = zip(*done) if done else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

        for batch in batches:
            out: Rows = []
            for _, run_ in groupby(zip(*(c.to_pylist() for c in batch.columns)), key):
                now = list(run_)
                if held and key(held[0]) == key(now[0]):
                    held += now
                    continue
                if held:
                    out += fn(held)
                held = now
            yield emit(out)
        if held:
            yield emit(fn(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
