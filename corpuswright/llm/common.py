"""Shared plumbing: scratch tables on shared storage and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators.storage import new_path, shared_root

#: Python-side work is cut into slices of about this many text bytes.
SLICE_BYTES = 4 << 20

#: Bytes of an Arrow batch on its way to Python, where the session still has Spark's default of
#: 64 MB: each side of each running task holds a batch or two.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


#: Scratch made within each open `scratch` block, innermost last.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the application's own on shared storage."""
    path = new_path(spark, tag)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """What operators store within the block is deleted at its end, except the paths that the
    caller adds to the yielded set; these go with the block around it, if there is one."""
    kept: set[str] = set()
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield kept
    finally:
        _OPEN.pop()
        remove(spark, *[p for p in made if p not in kept])
        if _OPEN:
            _OPEN[-1].extend(kept)


def paths_read(df: DataFrame) -> set[str]:
    """The folders whose files a plan reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(i).toString() for i in range(roots.size())}
    return out


def tidy(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (of a session and more) that deletes all scratch which its result does not read. What the
    result reads stays until an enclosing `scratch` block ends, or `clear`."""

    @wraps(query)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        with scratch(spark) as kept:
            df = query(spark, *args, **options)
            plain = {p.split(":", 1)[-1].lstrip("/"): p for p in _OPEN[-1]}
            kept |= {plain[q] for p in paths_read(df) if (q := p.split(":", 1)[-1].lstrip("/")) in plain}
            kept |= {p for p in _OPEN[-1] if "/lasting-" in p}
        return df

    return run


def clear(spark: SparkSession) -> None:
    """Deletes all scratch of this application; results that read it can no longer be computed."""
    remove(spark, f"{shared_root(spark)}/corpuswright/{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to shared storage and reads it back: lineage ends there, and
    a lost executor costs a re-read. Returns the table and its path."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def join_by_count(big: DataFrame, small: DataFrame, key: str, count: str, how: str = "left", hot: int = 1_000_000, most: int | None = None) -> DataFrame:
    """Joins big with a `small` that has one row for each key and the `count` of big's rows with it,
    where a third of big may share a key. Keys of over `hot` rows, so at most rows / hot of them, are
    broadcast; the rest meet by a shuffle in which no key is hot. Null keys meet nothing. Where `most`, a
    known bound of the counts, says that no key is hot, the shuffle is all."""
    if most is not None and most <= hot:
        return big.join(small, key, how)
    often = small.filter(F.col(count) > hot)
    inside = big.join(F.broadcast(often), key)
    rest = big.join(F.broadcast(often.select(key)), key, "left_anti").join(small.filter(F.col(count) <= hot), key, how)
    return inside.unionByName(rest)


def join_one(big: DataFrame, small: DataFrame, key: str, few: int = 100_000, hot: int = 1_000_000) -> DataFrame:
    """Left join of big with a stored `small` that has one row for each key. At most `few` rows of
    small are broadcast; with more, big's rows are counted by key for `join_by_count`."""
    if small.count() <= few:
        return big.join(F.broadcast(small), key, "left")
    (n,) = fresh([*big.columns, *small.columns], "__n")
    counted, _ = materialise(small.join(big.groupBy(key).agg(F.count("*").alias(n)), key), "counted")
    return join_by_count(big, counted, key, n, hot=hot).drop(n)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded in bytes unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if str(conf.get(BATCH_SETTING)).rstrip("bB") == str(BATCH_DEFAULT):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def release() -> None:
    """Gives memory that Python and Arrow no longer use back to the system, as Python workers
    outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about SLICE_BYTES of column `text` (a single
    longer value stays whole), so that a task's memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        wide = pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(col.cast(wide)), 0).cast(pa.int64())).to_numpy()
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(ends.searchsorted(base + SLICE_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def map_slices(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over slices; `fn` gets a slice of df's columns."""
    at = df.columns.index(text)

    def run(batches):
        for part in slices(batches, at):
            yield fn(part)

    return small_batches(df).mapInArrow(run, schema)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two needed columns, so that the scan is pruned and no other name clashes."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names of working columns that no column of `taken` has, upper and lower case alike."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out
