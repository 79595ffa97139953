"""Frames derived from the driver's tables that many queries share, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scored multiple-choice rows made of labels and documents.
PRED = """pred AS (SELECT d.doc_id, d.source || ',' || d.lang AS category, d.source, d.lang, l.quality, l.toxic, d.n_chars,
  chr(CAST(65 + d.doc_id % 4 AS INTEGER)) AS answer, chr(CAST(65 + (d.doc_id * 7 + l.quality) % 4 AS INTEGER)) AS prediction,
  CASE WHEN d.doc_id % 4 = (d.doc_id * 7 + l.quality) % 4 THEN 1 ELSE 0 END AS hit
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    right, got = F.col("doc_id") % 4, (F.col("doc_id") * 7 + F.col("quality")) % 4
    return joined.select(
        "doc_id", F.concat_ws(",", "source", "lang").alias("category"), "source", "lang", "quality", "toxic", "n_chars",
        F.char(65 + right).alias("answer"), F.char(65 + got).alias("prediction"), F.when(right == got, 1).otherwise(0).alias("hit"),
    )


#: Boxes: one for each order line, numbered within its image.
BOXES = """boxes AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS det_id,
  CAST(l_partkey % 100 AS DOUBLE) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS y1, l_partkey % 100 + l_quantity AS x2, l_suppkey % 100 + l_quantity * 2 AS y2,
  l_discount * 10 AS score, l_returnflag AS label FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x, y, q = F.col("l_partkey") % 100, F.col("l_suppkey") % 100, F.col("l_quantity")
    # Renamed first: what then meets by image_id is not shuffled again.
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id").select(
        "image_id", F.row_number().over(order).alias("det_id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + q).alias("x2"), (y + q * 2).alias("y2"), (F.col("l_discount") * 10).alias("score"), F.col("l_returnflag").alias("label"),
    )


#: All conversations with some roles swapped, as the raw table alternates without a break.
BROKEN = "broken AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 <> 3 OR role = 'system' THEN role WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS role, text FROM conversations)"


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = F.when(((F.col("conv_id") + F.col("turn")) % 5 != 3) | (F.col("role") == "system"), F.col("role")).when(F.col("role") == "user", "assistant").otherwise("user")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", swapped.alias("role"), "text")


#: Intervals in epoch seconds made of events.
INTERVALS = "intervals AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS e FROM events)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("s"), (start + F.floor(F.col("value") * 60)).cast("long").alias("e"))
