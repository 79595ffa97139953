"""Datasets mixed with probabilities, by a draw that any engine repeats."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators.ordering import prefix
from corpuswright.operators.storage import stored


def pick(position: Column, probabilities: Sequence[float], seed: int = 42) -> Column:
    """Which source a position draws from: the first 28 bits of an md5 against the cumulative
    probabilities."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), position.cast("string"))), 1, 7), 16, 10).cast("long")
    total, at, out = sum(probabilities), 0.0, F.lit(len(probabilities) - 1)
    bounds = []
    for p in probabilities[:-1]:
        at += p / total
        bounds.append(math.floor(at * (1 << 28)))
    for k in reversed(range(len(bounds))):
        out = F.when(u < bounds[k], k).otherwise(out)
    return out


def positions(spark: SparkSession, sizes: Sequence[int], probabilities: Sequence[float], stop: str, seed: int) -> DataFrame:
    """position, source and turn (which row of the source, counting on beyond its end) up to the pick that
    uses the last row of the first source to end (`first`) or of the last one (`all`)."""
    choose = min if stop == "first" else max
    total = sum(probabilities)
    n = int(choose(s * total / p for s, p in zip(sizes, probabilities)) * 1.1) + 1000
    while True:
        drawn = spark.range(n).select(F.col("id").alias("position"), pick(F.col("id"), probabilities, seed).alias("source"))
        numbered = stored(prefix(drawn, ["position"], ["source"], before="turn"), "positions")
        size = reduce(lambda a, k: F.when(F.col("source") == k, F.lit(sizes[k] - 1)).otherwise(a), range(len(sizes)), F.lit(-1).cast("long"))
        ends = [r[0] for r in numbered.filter(F.col("turn") == size).select("position").collect()]  # one for each source
        if ends and (stop == "first" or len(ends) == len(sizes)):
            return numbered.filter(F.col("position") <= choose(ends))
        n *= 2


def interleave_by_probability(sources: Sequence[DataFrame], key: str, probabilities: Sequence[float], stop: str = "first", seed: int = 42) -> DataFrame:
    """Rows of several sources (equal columns), each position drawn from a source with its
    probability; a source gives its rows in the order of `key`. Adds source and position. `first` stops
    when a source ends, `all` begins ended sources again until each has ended once. An empty source
    gives an empty mix with `first` and is left out with `all`."""
    if len(sources) != len(probabilities) or min(probabilities) <= 0:
        raise ValueError("a positive probability for each source")
    sizes = [s.count() for s in sources]
    if stop == "first" and 0 in sizes or not any(sizes):
        return sources[0].limit(0).withColumns({"source": F.lit(0), "position": F.lit(0).cast("long")})
    live = [k for k, n in enumerate(sizes) if n]
    at = positions(sources[0].sparkSession, [sizes[k] for k in live], [probabilities[k] for k in live], stop, seed)
    rows = reduce(DataFrame.unionByName, [prefix(sources[k], [key], before="__row").withColumn("__source", F.lit(i)) for i, k in enumerate(live)])
    size = reduce(lambda a, i: F.when(F.col("source") == i, F.lit(sizes[live[i]])).otherwise(a), range(len(live)), F.lit(1).cast("long"))
    met = at.withColumn("__row", F.col("turn") % size).withColumnRenamed("source", "__source").join(rows, ["__source", "__row"])
    return met.select(*sources[0].columns, F.get(F.array(*map(F.lit, live)), F.col("__source")).alias("source"), "position")
