"""Findings assigned to boxes, with the rules for conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators import assign as A
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import BOXES, boxes
from corpuswright.plans.spatial_queries import _BOX, _IOU, _MEET, _lap

_BEST = f"""p AS (SELECT a.image_id, a.det_id, b.det_id AS other, {_IOU} AS iou FROM boxes a JOIN boxes b ON {_MEET} WHERE a.label = 'R' AND b.label <> 'R'),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, other) = 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    return b.filter("label = 'R'"), b.filter("label <> 'R'")


@register(f"""WITH {BOXES}, {_BEST} SELECT a.image_id, coalesce(CAST(k.other AS VARCHAR), 'unknown') AS target, a.label, round(max(a.score), 9) AS score FROM boxes a LEFT JOIN k USING (image_id, det_id) WHERE a.label = 'R' GROUP BY ALL""")
def best_score_per_tooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, teeth = _sides(spark, sf_dir)
    got = A.best_per_target(found, teeth, ["image_id"], "det_id", "det_id", "label", "score")
    return got.withColumn("score", F.round("score", 9))


@register(f"""WITH {BOXES}, {_BEST} SELECT a.image_id, a.det_id, CASE WHEN k.iou > 0.5 THEN k.other END AS best_det_id FROM boxes a LEFT JOIN k USING (image_id, det_id) WHERE a.label = 'R'""")
def unknown_reassignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, teeth = _sides(spark, sf_dir)
    return A.reassigned(found, teeth, ["image_id"], "det_id", "det_id").select("image_id", "det_id", "best_det_id")


@register(f"""WITH {BOXES} SELECT CASE label WHEN 'A' THEN 'missing' WHEN 'N' THEN 'jaw' ELSE 'tooth' END AS route, count(*) AS n, round(max(score), 9) AS top FROM boxes WHERE score > 0.2 GROUP BY ALL""")
def class_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings above a score, by the list their class goes to."""
    route = A.routed(F.col("label"), {"A": "missing", "N": "jaw"})
    return boxes(spark, sf_dir).filter("score > 0.2").groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.round(F.max("score"), 9).alias("top"))


_ORDER = f"o AS (SELECT image_id, list({_BOX} ORDER BY det_id) AS b FROM boxes GROUP BY image_id)"
_PLACES = "image_id, k.det_id, k.label, round(k.score, 9) AS score"


@register(f"""WITH RECURSIVE {BOXES}, {_ORDER}, w AS (SELECT image_id, 0::BIGINT AS i, b[1:0] AS kept, b FROM o UNION ALL
 SELECT image_id, i + 1, CASE WHEN hit IS NULL THEN list_append(kept, q) ELSE list_transform(kept, lambda k, j: CASE WHEN j = hit AND q.score > k.score THEN q ELSE k END) END, b
 FROM (SELECT *, list_min(list_filter(list_transform(kept, lambda k, j: CASE WHEN {_lap("k", "q")} > 0 THEN j END), lambda j: j IS NOT NULL)) AS hit FROM (SELECT *, b[i + 1] AS q FROM w WHERE i < len(b)))),
 x AS (SELECT image_id, unnest(arg_max(kept, i)) AS k FROM w GROUP BY image_id) SELECT {_PLACES} FROM x""")
def keep_higher_or_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.keep_higher(boxes(spark, sf_dir), ["image_id"], "det_id")
    return got.select("image_id", "det_id", "label", F.round("score", 9).alias("score"))


@register(f"""WITH RECURSIVE {BOXES}, {_ORDER}, w AS (SELECT image_id, 0::BIGINT AS i, b[1:0] AS kept, b FROM o UNION ALL
 SELECT image_id, i + 1, CASE WHEN q.label <> 'N' AND hit IS NOT NULL THEN list_transform(kept, lambda k, j: CASE WHEN j = hit AND q.label = 'R' AND q.score > k.score THEN struct_update(k, score := q.score) ELSE k END)
  WHEN q.label = 'R' THEN list_append(list_filter(kept, lambda k: k.label <> 'A' OR {_lap("k", "q")} <= 0), q) ELSE list_append(kept, q) END, b
 FROM (SELECT *, list_min(list_filter(list_transform(kept, lambda k, j: CASE WHEN k.label = 'R' AND {_lap("k", "q")} > 0 THEN j END), lambda j: j IS NOT NULL)) AS hit FROM (SELECT *, b[i + 1] AS q FROM w WHERE i < len(b)))),
 x AS (SELECT image_id, unnest(arg_max(kept, i)) AS k FROM w GROUP BY image_id) SELECT {_PLACES} FROM x""")
def strong_over_weak_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R findings replace A findings that they overlap; N findings take no part."""
    got = A.strong_over_weak(boxes(spark, sf_dir), ["image_id"], "det_id", F.col("label") == "R", F.col("label") == "A")
    return got.select("image_id", "det_id", "label", F.round("score", 9).alias("score"))


@register(f"""WITH {BOXES}, q AS (SELECT DISTINCT image_id, unnest([{{'n': 'upper right', 'x': 0.0, 'y': 0.0}}, {{'n': 'upper left', 'x': 60.0, 'y': 0.0}}, {{'n': 'lower right', 'x': 0.0, 'y': 60.0}}, {{'n': 'lower left', 'x': 60.0, 'y': 60.0}}]) AS q FROM boxes),
 r AS (SELECT image_id, q.n AS det_id, q.x AS x1, q.y AS y1, q.x + 50.0 AS x2, q.y + 50.0 AS y2 FROM q), p AS (SELECT a.image_id, a.det_id, b.det_id AS side, {_IOU} AS iou FROM boxes a JOIN r b ON {_MEET}),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, side) = 1)
 SELECT a.image_id, a.det_id, coalesce(k.side, CASE WHEN (y1 + y2) / 2 < 55 THEN CASE WHEN (x1 + x2) / 2 < 55 THEN 'upper right' ELSE 'upper left' END ELSE CASE WHEN (x1 + x2) / 2 > 55 THEN 'lower left' ELSE 'lower right' END END) AS side FROM boxes a LEFT JOIN k USING (image_id, det_id)""")
def quadrant_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    four = F.array(*[F.struct(F.lit(n).alias("quadrant"), F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(x + 50).alias("x2"), F.lit(y + 50).alias("y2")) for n, x, y in (("upper right", 0.0, 0.0), ("upper left", 60.0, 0.0), ("lower right", 0.0, 60.0), ("lower left", 60.0, 60.0))])
    quadrants = b.select("image_id").distinct().select("image_id", F.explode(four).alias("q")).select("image_id", "q.*")
    return A.quadrant(b, quadrants, ["image_id"], "det_id", "quadrant", F.lit(110.0), F.lit(110.0)).select("image_id", "det_id", "side")


_TWIN = "twins AS (SELECT image_id, det_id * 2 + t AS det_id, x1 + t * 0.1 AS x1, y1, x2 + t * 0.1 AS x2, y2, CASE WHEN t = 0 THEN score ELSE 1 - score END AS score, CASE WHEN t = 0 THEN label ELSE 'T' END AS label FROM boxes, range(2) r(t))"


@register(f"""WITH {BOXES}, {_TWIN}, p AS (SELECT a.image_id, a.det_id AS i, b.det_id AS j, a.score AS si, b.score AS sj, a.label AS li, b.label AS lj FROM twins a JOIN twins b ON a.image_id = b.image_id AND b.det_id = a.det_id + 1 AND a.det_id % 2 = 0 WHERE {_IOU} > 0.95)
 SELECT t.image_id, t.det_id, round(t.score, 9) AS score, CASE WHEN p.i IS NULL THEN t.label ELSE least(li, lj) || '+' || greatest(li, lj) END AS conditions FROM twins t LEFT JOIN p ON p.image_id = t.image_id AND t.det_id IN (p.i, p.j)
 WHERE p.i IS NULL OR (t.det_id = p.i AND si >= sj) OR (t.det_id = p.j AND si < sj)""")
def near_equal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box and a twin a tenth to the right: nearly equal ones become one with both conditions. A box
    and its twin are one group here, so that SQL can state the result; tests cover chains."""
    t = F.explode(F.array(F.lit(0), F.lit(1))).alias("t")
    b = boxes(spark, sf_dir).select("*", t)
    b = b.select("image_id", F.col("det_id").alias("base"), (F.col("det_id") * 2 + F.col("t")).alias("det_id"), (F.col("x1") + F.col("t") * 0.1).alias("x1"), "y1", (F.col("x2") + F.col("t") * 0.1).alias("x2"), "y2",
                 F.when(F.col("t") == 0, F.col("score")).otherwise(1 - F.col("score")).alias("score"), F.when(F.col("t") == 0, F.col("label")).otherwise("T").alias("label"))
    b = b.withColumn("conditions", F.create_map("label", "score")).drop("label")
    got = A.merge_near_equal(b, ["image_id", "base"], "det_id", "conditions")
    return got.select("image_id", "det_id", F.round("score", 9).alias("score"), F.array_join(F.array_sort(F.map_keys("conditions")), "+").alias("conditions"))
