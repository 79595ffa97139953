"""URL filtering by hashed host-suffix and path-prefix expressions, in DataFrame operations.

A URL is expanded into the expressions (host suffix + path up to a slash) that some rule could
equal; expressions and rules meet by equality on a 4-byte hash prefix; then the full digest
and the rest of the rule's path are confirmed, and the longest rule wins.

Only shapes that rules have are expanded - pairs of (labels in the host, slashes in the
path) - which loses nothing, as an expression of another shape equals no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"
PREFIX = 8  # hex digits: 4 bytes


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def prepare(rules: DataFrame) -> DataFrame:
    """Rules with their shape, hash prefix and full digest. The hashed expression ends at the
    path's last slash; what follows is confirmed on the URL itself. Rules with no host or an unknown
    verdict are left out, a null path is empty, and of equal rules block is kept."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
    rules = rules.filter((F.length("r_host") > 0) & F.col("verdict").isin("allow", "block")).groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    slashes = _slashes(F.col("r_path"))
    directory = F.when(slashes > 0, F.concat(F.call_function("substring_index", F.col("r_path"), F.lit("/"), slashes), F.lit("/"))).otherwise(F.lit(""))
    digest = F.sha2(F.concat("r_host", F.lit("\n"), directory), 256)
    return rules.select("*", F.size(F.split("r_host", "\\.")).alias("labels"), slashes.alias("slashes"), digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = 200_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages.

    Null urls and urls without :// have empty host and path, no rule and the default
    verdict. Repeated rows and null ids are rows like others: rows are told apart by a row
    number, and a row's expressions stay in its task until they are merged again, so the one
    shuffle moves a row for each page. Rules of up to `broadcast_rules` rows (counted
    first) are broadcast; larger sets are joined by a shuffle on the hash prefix.
    """
    ready = prepare(rules)
    shapes = [(r[0], r[1]) for r in ready.select("labels", "slashes").distinct().collect()]  # one entry for each shape
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_rules = ready.count()
    labels, n_labels, n_slashes = F.split("host", "\\."), F.size(F.split("host", "\\.")), _slashes(F.col("path"))
    wanted = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("slashes")) for a, b in sorted(shapes)])
    fitting = F.filter(wanted, lambda s: (s["labels"] <= n_labels) & (s["slashes"] <= n_slashes))
    suffix = lambda s: F.array_join(F.slice(labels, n_labels - s["labels"] + 1, s["labels"]), ".")
    prefix = lambda s: F.when(s["slashes"] > 0, F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), s["slashes"]), F.lit("/"))).otherwise(F.lit(""))
    digests = F.transform(fitting, lambda s: F.sha2(F.concat(suffix(s), F.lit("\n"), prefix(s)), 256))
    asked = rows.withColumn("asked", F.explode_outer(digests)).withColumn("asked_prefix", F.substring("asked", 1, PREFIX))
    side = ready.select("prefix", "digest", "r_host", "r_path", F.col("verdict").alias("r_verdict"))
    met = asked.join(F.broadcast(side) if n_rules <= broadcast_rules else side, asked["asked_prefix"] == side["prefix"], "left")
    fits = (F.col("asked") == F.col("digest")) & F.startswith(F.col("path"), F.col("r_path"))
    text = F.concat("r_host", "r_path")
    best = F.max(F.when(fits, F.struct(F.length(text).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("verdict"), text.alias("rule"))))
    merged = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return merged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
