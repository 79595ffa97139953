"""Queries over boxes and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions import geometry as G
from corpuswright.operators import spatial as S
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import BOXES, INTERVALS, boxes, intervals

_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_IOU = f"round({_INTER} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER}), 9)"
_MEET = "a.image_id = b.image_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"


@register(f"WITH {BOXES} SELECT a.image_id, a.det_id AS a, b.det_id AS b, {_IOU} AS iou FROM boxes a JOIN boxes b ON {_MEET} AND a.det_id < b.det_id")
def near_duplicate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    pairs = S.overlap_pairs(b, b, ["image_id"]).filter("l_det_id < r_det_id")
    return pairs.select(F.col("l_image_id").alias("image_id"), F.col("l_det_id").alias("a"), F.col("r_det_id").alias("b"), F.round("iou", 9).alias("iou"))


@register(f"""WITH {BOXES}, p AS (SELECT a.image_id, a.det_id, b.det_id AS other, {_IOU} AS iou FROM boxes a JOIN boxes b ON {_MEET} WHERE a.label = 'R' AND b.label <> 'R'),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, other) = 1)
 SELECT a.image_id, a.det_id, k.other AS best_det_id, coalesce(k.iou, 0) AS best_iou FROM boxes a LEFT JOIN k USING (image_id, det_id) WHERE a.label = 'R'""")
def best_iou_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions to the tooth box they overlap most; null where none does."""
    b = boxes(spark, sf_dir)
    got = S.best_match(b.filter("label = 'R'"), b.filter("label <> 'R'"), ["image_id"], "det_id", "det_id")
    return got.select("image_id", "det_id", "best_det_id", F.round(F.coalesce("best_iou", F.lit(0.0)), 9).alias("best_iou"))


@register(f"""WITH {BOXES}, n AS (SELECT image_id, det_id, score, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS k FROM boxes) SELECT image_id, det_id, round(score, 9) AS score FROM n WHERE k = 1""")
def best_box_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = boxes(spark, sf_dir).groupBy("image_id", "label").agg(F.min(F.struct((-F.col("score")).alias("s"), "det_id")).alias("b"))
    return best.select("image_id", F.col("b.det_id").alias("det_id"), F.round(-F.col("b.s"), 9).alias("score"))


@register(f"""WITH {BOXES} SELECT label, count_if((a.x1 + a.x2) / 2 BETWEEN 20 AND 80 AND (a.y1 + a.y2) / 2 BETWEEN 20 AND 80)::BIGINT AS inside,
 count_if(x2 - x1 > 30)::BIGINT AS wide, CAST(sum(CAST(floor(x1 / 100 * 640) AS INTEGER)) AS BIGINT) AS left_pixels, count(*) AS total FROM boxes a GROUP BY label""")
def centre_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box()
    target = tuple(F.lit(float(v)) for v in (20, 20, 80, 80))
    pixels = G.to_pixels(tuple(v / 100 for v in b), F.lit(640), F.lit(480))
    return boxes(spark, sf_dir).groupBy("label").agg(
        F.count_if(G.contains_point(target, *G.centre(b))).alias("inside"), F.count_if(b[2] - b[0] > 30).alias("wide"), F.sum(pixels[0]).alias("left_pixels"), F.count("*").alias("total")
    )


@register(f"""WITH {BOXES}, f AS (SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM boxes GROUP BY image_id)
 SELECT image_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, n FROM f""")
def polygon_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = boxes(spark, sf_dir).groupBy("image_id").agg(F.flatten(F.collect_list(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))).alias("p"), F.count("*").alias("n"))
    b = G.polygon_box(F.col("p"))
    cx, cy = G.centre(b)
    return pts.select("image_id", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(b[2] - b[0], 6).alias("w"), F.round(b[3] - b[1], 6).alias("h"), "n")


def _lap(a: str, b: str) -> str:
    """SQL of the IoU of two box structs."""
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    return f"({inter}) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"


_BOX = "{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score, 'label': label}"


@register(f"""WITH RECURSIVE {BOXES}, o AS (SELECT image_id, list({_BOX} ORDER BY score DESC, det_id) AS b FROM boxes GROUP BY image_id), w AS (SELECT image_id, 0::BIGINT AS i, b[1:0] AS kept, b FROM o UNION ALL
 SELECT image_id, i + 1, CASE WHEN len(list_filter(kept, lambda k: {_lap("k", "w.b[w.i + 1]")} > 0.5)) = 0 THEN list_append(kept, b[i + 1]) ELSE kept END, b FROM w WHERE i < len(b)),
 k AS (SELECT image_id, unnest(arg_max(kept, i)) AS k FROM w GROUP BY image_id) SELECT image_id, k.det_id, k.x1, k.y1, k.x2, k.y2, k.score, k.label FROM k""")
def nms_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suppress(boxes(spark, sf_dir), ["image_id"])


_SEED = "{'cx': (q.x1 + q.x2) / 2, 'cy': (q.y1 + q.y2) / 2, 'seed': q.det_id, 'x1': q.x1, 'y1': q.y1, 'x2': q.x2, 'y2': q.y2, 'members': 1::BIGINT}"


@register(f"""WITH RECURSIVE {BOXES}, o AS (SELECT image_id, list({_BOX} ORDER BY det_id) AS b FROM boxes GROUP BY image_id), w AS (SELECT image_id, 1::BIGINT AS i, [{_SEED}] AS seeds, b FROM (SELECT *, b[1] AS q FROM o) UNION ALL
 SELECT image_id, i + 1, CASE WHEN hit IS NULL THEN list_append(seeds, {_SEED}) ELSE list_transform(seeds, lambda s, j: CASE WHEN j = hit THEN {{'cx': s.cx, 'cy': s.cy, 'seed': s.seed, 'x1': least(s.x1, q.x1), 'y1': least(s.y1, q.y1), 'x2': greatest(s.x2, q.x2), 'y2': greatest(s.y2, q.y2), 'members': s.members + 1}} ELSE s END) END, b
 FROM (SELECT *, list_min(list_filter(list_transform(seeds, lambda s, j: CASE WHEN abs(s.cx - (q.x1 + q.x2) / 2) < 12.5 AND abs(s.cy - (q.y1 + q.y2) / 2) < 20 THEN j END), lambda j: j IS NOT NULL)) AS hit FROM (SELECT *, b[i + 1] AS q FROM w WHERE i < len(b)))),
 k AS (SELECT image_id, unnest(arg_max(seeds, i)) AS k FROM w GROUP BY image_id) SELECT image_id, k.seed, k.x1 - 3 AS x1, k.y1 - 3 AS y1, k.x2 + 3 AS x2, k.y2 + 3 AS y2, k.members FROM k""")
def proximity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_close(boxes(spark, sf_dir), ["image_id"])


_PAIRS = f"p AS (SELECT a.image_id AS l_image_id, a.det_id AS l_det_id, b.det_id AS r_det_id, {_IOU} AS iou FROM boxes a JOIN boxes b ON {_MEET} WHERE a.label = 'R' AND b.label <> 'R')"


@register(f"""WITH RECURSIVE {BOXES}, {_PAIRS}, o AS (SELECT l_image_id, list({{'l': l_det_id, 'r': r_det_id, 'iou': iou}} ORDER BY iou DESC, l_det_id, r_det_id) AS b FROM p GROUP BY l_image_id), w AS (SELECT l_image_id, 0::BIGINT AS i, b[1:0] AS kept, b FROM o UNION ALL
 SELECT l_image_id, i + 1, CASE WHEN len(list_filter(kept, lambda k: k.l = w.b[w.i + 1].l OR k.r = w.b[w.i + 1].r)) = 0 THEN list_append(kept, b[i + 1]) ELSE kept END, b FROM w WHERE i < len(b)),
 k AS (SELECT l_image_id, unnest(arg_max(kept, i)) AS k FROM w GROUP BY l_image_id) SELECT l_image_id, k.l AS l_det_id, k.r AS r_det_id, k.iou FROM k""")
def greedy_box_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    pairs = S.overlap_pairs(b.filter("label = 'R'"), b.filter("label <> 'R'"), ["image_id"]).select("l_image_id", "l_det_id", "r_det_id", "iou")
    return S.greedy_matches(pairs.withColumn("iou", F.round("iou", 9)), ["l_image_id"], "l_det_id", "r_det_id", "iou")


@register(f"""WITH RECURSIVE {BOXES}, {_PAIRS}, c AS (SELECT l_image_id AS im, l_det_id AS l, r_det_id AS r, round(1 - iou, 9) AS cost FROM p), l AS (SELECT im, l, row_number() OVER (PARTITION BY im ORDER BY l) AS i FROM (SELECT DISTINCT im, l FROM c)),
 e AS (SELECT im, i, l, r, cost FROM l JOIN c USING (im, l) UNION ALL SELECT im, i, l, NULL, 0 FROM l),
 w AS (SELECT DISTINCT im, 0::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS n, 0::DOUBLE AS total, []::STRUCT(l BIGINT, r BIGINT, cost DOUBLE)[] AS chosen FROM l UNION ALL
 SELECT w.im, e.i, CASE WHEN r IS NULL THEN used ELSE list_append(used, CAST(r AS BIGINT)) END, CASE WHEN r IS NULL THEN n ELSE n + 1 END, total + cost, CASE WHEN r IS NULL THEN chosen ELSE list_append(chosen, {{'l': CAST(l AS BIGINT), 'r': CAST(r AS BIGINT), 'cost': CAST(cost AS DOUBLE)}}) END
 FROM w JOIN e ON e.im = w.im AND e.i = w.i + 1 WHERE r IS NULL OR NOT list_contains(used, r)),
 b AS (SELECT im, chosen FROM w JOIN (SELECT im, max(i) AS m FROM l GROUP BY im) x USING (im) WHERE i = m QUALIFY row_number() OVER (PARTITION BY im ORDER BY n DESC, total) = 1),
 k AS (SELECT im, unnest(chosen) AS k FROM b) SELECT im AS l_image_id, count(*) AS matched, count(DISTINCT k.r) AS targets, CAST(sum(CAST(round(k.cost * 1e9) AS BIGINT)) AS BIGINT) AS cost FROM k GROUP BY im""")
def optimal_box_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and cost (in billionths) of the best matching of each image; which of equally good ones is open."""
    b = boxes(spark, sf_dir)
    pairs = S.overlap_pairs(b.filter("label = 'R'"), b.filter("label <> 'R'"), ["image_id"]).select("l_image_id", "l_det_id", "r_det_id", F.round(1 - F.round("iou", 9), 9).alias("cost"))
    got = S.optimal_matches(pairs, ["l_image_id"], "l_det_id", "r_det_id", "cost")
    return got.groupBy("l_image_id").agg(F.count("*").alias("matched"), F.countDistinct("r_det_id").alias("targets"), F.sum(F.round(F.col("cost") * 1e9).cast("long")).alias("cost"))


@register(f"""WITH {INTERVALS}, b AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM intervals),
 n AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
 SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS members FROM n GROUP BY user_id, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_intervals(intervals(spark, sf_dir), ["user_id"])


@register(f"""WITH {INTERVALS}, p AS (SELECT a.user_id, least(a.e, b.e) - greatest(a.s, b.s) AS o, greatest(a.e, b.e) - least(a.s, b.s) AS h, (a.e - a.s) + (b.e - b.s) AS t FROM intervals a JOIN intervals b
 ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e)
 SELECT user_id, count(*) AS pairs, CAST(sum(o) AS BIGINT) AS overlap, round(avg(CAST(o AS DOUBLE) / (t - o)), 9) AS mean_iou, round(avg(CAST(o AS DOUBLE) / h), 9) AS mean_hull_iou FROM p GROUP BY user_id""")
def interval_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = intervals(spark, sf_dir)
    pairs = S.interval_pairs(t, t, ["user_id"], 6 * 3600).filter("l_event_id < r_event_id")
    cols = [F.col(c) for c in ("l_s", "l_e", "r_s", "r_e")]
    return pairs.groupBy(F.col("l_user_id").alias("user_id")).agg(
        F.count("*").alias("pairs"), F.sum(F.least("l_e", "r_e") - F.greatest("l_s", "r_s")).alias("overlap"),
        F.round(F.avg(G.interval_iou(*cols)), 9).alias("mean_iou"), F.round(F.avg(G.interval_hull_iou(*cols)), 9).alias("mean_hull_iou"),
    )


@register(f"""WITH {BOXES} SELECT label, count_if(greatest(y2 / x2, x2 / y2) < 2)::BIGINT AS loose, count_if(greatest(y2 / x2, x2 / y2) < 1.5)::BIGINT AS strict FROM boxes WHERE x2 > 0 AND y2 > 0 GROUP BY label""")
def distance_ratio_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = lambda k: F.count_if(G.distance_ratio(F.col("y2"), F.col("x2"), k))
    return boxes(spark, sf_dir).filter("x2 > 0 AND y2 > 0").groupBy("label").agg(ok(2.0).alias("loose"), ok(1.5).alias("strict"))
