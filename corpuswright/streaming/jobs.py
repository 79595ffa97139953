"""Structured Streaming forms of the curation jobs.

Sources are file streams with a declared schema; jobs run to the end of what is there
(`availableNow`) with a checkpoint on shared storage, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corpuswright.operators.ordering import draw, prefix


def file_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def check_arguments(val_size: float = 0, max_samples: int | None = None, mask_history: bool = False, train_on_prompt: bool = False, probabilities: list[float] | None = None, sources: int = 1) -> None:
    """Rules for streamed datasets: counts, not shares, and no sample limit."""
    if 0 < val_size < 1:
        raise ValueError("a stream's validation size is a count")
    if max_samples is not None:
        raise ValueError("a stream has no sample limit")
    if mask_history and train_on_prompt:
        raise ValueError("history is masked or the prompt is trained on, not both")
    if probabilities is not None and len(probabilities) != sources:
        raise ValueError("one probability for each source")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling event-time windows with a watermark."""
    t = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    out = t.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    t = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    out = t.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), key, "n")


def hash_split(rows: DataFrame, key: str, test_percent: int) -> DataFrame:
    """A split that needs no look at other rows: a stream has no take and skip."""
    return rows.withColumn("split", F.when(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")), F.lit(100)) < test_percent, "test").otherwise("train"))


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q: StreamingQuery = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders name=N below a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = (f.getPath() for f in fs.listStatus(p))
    return sorted(int(f.getName().split("=")[1]) for f in found if f.getName().startswith(f"{name}=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run_to_snapshot(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation to its end. Each batch's whole result is written on shared storage under its
    number and replaces the one before; nothing passes through the driver."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/result={number}")
        for old in _folders(spark, path, "result"):
            if old < number:
                _delete(spark, f"{path}/result={old}")

    _run(stream, batch, checkpoint, "complete")
    return spark.read.schema(stream.schema).parquet(f"{path}/result={_folders(spark, path, 'result')[-1]}")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream to its end into Parquet files, exactly once by the sink's log."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str, order: str, merge_every: int = 16) -> DataFrame:
    """Keyed results, the latest row of a key wins (of equals that of the later batch): each batch is
    written under its number, so a repeated batch overwrites itself. Every `merge_every` batches they
    are merged into a base and deleted, so a reader never meets more than that many."""
    spark, names = stream.sparkSession, stream.columns

    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(*names, "__batch"), F.struct(order, "__batch")).alias("r")).select("r.*")

    def current() -> DataFrame | None:
        bases, deltas = _folders(spark, path, "base"), _folders(spark, path, "batch")
        at = [f"{path}/base={n}" for n in bases[-1:]] + [f"{path}/batch={n}" for n in deltas if not bases or n > bases[-1]]
        return last(spark.read.parquet(*at)) if at else None

    def batch(rows: DataFrame, number: int) -> None:
        last(rows.withColumn("__batch", F.lit(number).cast("long"))).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % merge_every == merge_every - 1:
            current().write.mode("overwrite").parquet(f"{path}/base={number}")
            for name in ("base", "batch"):
                for old in _folders(spark, path, name):
                    if old < number or name == "batch":
                        _delete(spark, f"{path}/{name}={old}")

    _run(stream, batch, checkpoint)
    got = current()
    return got.select(*names) if got is not None else spark.createDataFrame([], stream.schema)


def number_batches(stream: DataFrame, order: Sequence[str], by: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Adds turn, the number from 0 of a row within its `by`: batches in the order they come, rows of a
    batch by `order`. Each batch is written under its number with its counts beside it, which is
    all that later batches read."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        earlier = [n for n in _folders(spark, path, "count") if n < number]
        numbered = prefix(rows, order, by, before="turn", total="__total")
        if earlier:
            sums = spark.read.parquet(*[f"{path}/count={n}" for n in earlier]).groupBy(*by).agg(F.sum("n").alias("__earlier"))
            numbered = numbered.join(F.broadcast(sums), list(by), "left") if by else numbered.crossJoin(F.broadcast(sums))
            numbered = numbered.withColumn("turn", F.col("turn") + F.coalesce("__earlier", F.lit(0))).drop("__earlier")
        numbered.drop("__total").write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/count={number}")

    _run(stream, batch, checkpoint)
    done = _folders(spark, path, "batch")
    schema = StructType([*stream.schema.fields, StructField("turn", LongType())])
    return spark.read.schema(schema).parquet(*[f"{path}/batch={n}" for n in done]) if done else spark.createDataFrame([], schema)


def fair_interleave(streams: Sequence[DataFrame], probabilities: Sequence[float], order: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Streams of equal columns as one, with `source` and `place`: the k-th row of a source stands at k over
    its probability, so up to any place each source has its share, whatever comes later."""
    check_arguments(probabilities=list(probabilities), sources=len(streams))
    tagged = [s.withColumn("source", F.lit(k)) for k, s in enumerate(streams)]
    numbered = number_batches(reduce(DataFrame.union, tagged), order, ["source"], path, checkpoint)
    share = F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("source") + 1)
    return numbered.withColumn("place", (F.col("turn") + 1) / share)


def take_and_skip(stream: DataFrame, key: str, n: int, path: str, checkpoint: str, seed: int = 42) -> DataFrame:
    """A stream shuffled by hash within each batch: its first n rows are validation, the rest train."""
    hashed = stream.withColumn("__h", draw(key, seed=seed))
    numbered = number_batches(hashed, ["__h", key], [], path, checkpoint)
    return numbered.drop("__h").withColumn("split", F.when(F.col("turn") < n, "validation").otherwise("train"))


def batch_metrics(stream: DataFrame, metrics: dict[str, Column], path: str, checkpoint: str) -> DataFrame:
    """An append-only log of JSON lines, one for each batch with its number, rows and metrics; the state is
    empty again after each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        row = rows.agg(F.count("*").alias("rows"), *[c.alias(k) for k, c in metrics.items()]).select(F.lit(number).cast("long").alias("batch"), "*")
        row.coalesce(1).write.mode("overwrite").json(f"{path}/log={number}")

    _run(stream, batch, checkpoint)
    kinds = "batch long, rows long, " + ", ".join(f"{k} double" for k in metrics)
    return stream.sparkSession.read.schema(kinds).json(f"{path}/log=*")


def map_batches(stream: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A vectorised map over Arrow batches; the result's schema is declared."""
    return stream.mapInArrow(fn, schema)


def conversation_state(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each turn with what came before it in its conversation: the number of earlier turns and
    their length, kept as state by key across batches. Within a batch turns go by `order`."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}

    def step(keys, frames, state: GroupState):
        seen, chars = state.get if state.exists else (0, 0)
        for rows in frames:
            out = []
            for r in rows.sort_values(order).itertuples():
                out.append((keys[0], getattr(r, order), seen, chars))
                seen, chars = seen + 1, chars + len(getattr(r, text) or "")
            yield pd.DataFrame(out, columns=[key, order, "earlier", "earlier_chars"])
        state.update((seen, chars))

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, earlier long, earlier_chars long"
    return turns.groupBy(key).applyInPandasWithState(step, schema, "seen long, chars long", "append", GroupStateTimeout.NoTimeout)
