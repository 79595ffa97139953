"""Streaming queries, run to the end of the driver's files and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators.storage import new_path
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import table
from corpuswright.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's folder or file as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").format("parquet").load(f"{sf_dir}/{name}.parquet*")


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.windowed_counts(_stream(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    got = jobs.run_to_snapshot(out, new_path(spark, "windows"), new_path(spark, "stream"))
    return got.withColumn("total", F.round("total", 4))


@register("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
 SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_to_snapshot(jobs.sessions(_stream(spark, sf_dir, "events"), "ts", "user_id"), new_path(spark, "sessions"), new_path(spark, "stream"))


@register("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.struct("ts", "event_id").alias("o"))
    return jobs.upsert_batches(s, new_path(spark, "upsert"), "user_id", new_path(spark, "stream"), "o").select("user_id", "ts", "event_id")


@register("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_filter_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateless stream through the exactly-once file sink, then a batch count."""
    s = jobs.hash_split(_stream(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 10)
    return jobs.run_to_parquet(s, new_path(spark, "sink"), new_path(spark, "stream")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("SELECT conv_id, turn, row_number() OVER w - 1 AS earlier, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def stream_conversation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by conversation: what each turn has before it."""
    s = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return jobs.run_to_parquet(jobs.conversation_state(s, "conv_id", "turn", "text"), new_path(spark, "state"), new_path(spark, "stream"))


@register("""SELECT o_orderkey AS key, 0 AS source, row_number() OVER (ORDER BY o_orderkey) / 0.75::DOUBLE AS place FROM orders UNION ALL SELECT c_custkey, 1, row_number() OVER (ORDER BY c_custkey) / 0.25::DOUBLE FROM customer""")
def stream_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams as one, three rows of the first to one of the second."""
    a, b = _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), _stream(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return jobs.fair_interleave([a, b], [0.75, 0.25], ["key"], new_path(spark, "mix"), new_path(spark, "stream")).select("key", "source", "place")


@register("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || event_id), event_id) <= 100 THEN 'validation' ELSE 'train' END AS split FROM events")
def stream_take_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").select("event_id")
    return jobs.take_and_skip(s, "event_id", 100, new_path(spark, "split"), new_path(spark, "stream")).select("event_id", "split")


@register("SELECT 0::BIGINT AS batch, count(*) AS rows, round(avg(value), 8) AS mean, count_if(event_type = 'purchase') / CAST(count(*) AS DOUBLE) AS share FROM events")
def stream_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = {"mean": F.avg("value"), "share": F.avg((F.col("event_type") == "purchase").cast("double"))}
    return jobs.batch_metrics(_stream(spark, sf_dir, "events"), metrics, new_path(spark, "log"), new_path(spark, "stream")).withColumn("mean", F.round("mean", 8))
