"""Conflict rules on chains of boxes, by hand."""

from pyspark.sql import functions as F

from corpuswright.operators import assign as A

SCHEMA = "img long, id long, x1 double, y1 double, x2 double, y2 double, score double, label string"


def box(i, x, score, label="a", img=1):
    return (img, i, float(x), 0.0, float(x) + 10, 10.0, score, label)


def test_keep_higher_in_order(spark):
    rows = spark.createDataFrame([box(1, 0, 0.5), box(2, 5, 0.4), box(3, 5, 0.6), box(4, 12, 0.9), box(5, 100, 0.1), box(1, 0, 0.1, img=2)], SCHEMA)
    got = sorted((r.img, r.id) for r in A.keep_higher(rows, ["img"], "id").collect())
    assert got == [(1, 4), (1, 5), (2, 1)]  # 3 takes 1's place, 4 that of 3
    assert A.keep_higher(rows.limit(0), ["img"], "id").collect() == []


def test_strong_over_weak(spark):
    rows = [box(1, 0, 0.9, "weak"), box(2, 20, 0.3, "weak"), box(3, 5, 0.5, "strong"), box(4, 8, 0.7, "strong"), box(5, 9, 0.9, "weak"), box(6, 3, 0.2, "other")]
    got = A.strong_over_weak(spark.createDataFrame(rows, SCHEMA), ["img"], "id", F.col("label") == "strong", F.col("label") == "weak")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r.id, r.score) for r in got.collect()) == [(2, 0.3), (3, 0.7), (6, 0.2)]


def test_near_equal_chain(spark):
    """1 and 2 merge into 2; 3 merges into it and brings its conditions; 9 stands alone."""
    rows = [(1, 1, 0.0, 0.0, 100.0, 100.0, 0.5, {"a": 0.1}), (1, 2, 1.0, 0.0, 101.0, 100.0, 0.7, {"b": 0.2}), (1, 3, 2.0, 0.0, 102.0, 100.0, 0.6, {"a": 0.9}), (1, 9, 500.0, 0.0, 600.0, 100.0, 0.1, None)]
    t = spark.createDataFrame(rows, "img long, id long, x1 double, y1 double, x2 double, y2 double, score double, c map<string, double>")
    got = {r.id: r.c for r in A.merge_near_equal(t, ["img"], "id", "c").collect()}
    assert got == {2: {"a": 0.9, "b": 0.2}, 9: None}


def quadrant_tables(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 45.0, 5.0, 70.0, 15.0), (1, 3, 52.0, 52.0, 54.0, 54.0), (1, 4, 40.0, 40.0, 70.0, 70.0), (1, 5, 9.0, 9.0, 2.0, 2.0), (1, 6, None, 1.0, 5.0, 5.0), (2, 1, 0.0, 0.0, 10.0, 10.0), (None, 1, 90.0, 90.0, 95.0, 95.0)]
    four = [(1, n, x, y, x + 50, y + 50) for n, x, y in (("upper right", 0.0, 0.0), ("upper left", 60.0, 0.0), ("lower right", 0.0, 60.0), ("lower left", 60.0, 60.0))]
    findings = spark.createDataFrame(rows, "img long, id long, x1 double, y1 double, x2 double, y2 double")
    return findings, spark.createDataFrame([*four, (1, "turned", 110.0, 110.0, 0.0, 0.0), (None, "upper right", 0.0, 0.0, 100.0, 100.0)], "img long, side_of string, x1 double, y1 double, x2 double, y2 double")


def test_quadrants(spark):
    findings, four = quadrant_tables(spark)
    got = A.quadrant(findings, four, ["img"], "id", "side_of", F.lit(110.0), F.lit(110.0))
    sides = {(r.img, r.id): (r.best_side_of, r.side) for r in got.collect()}
    assert sides == {
        (1, 1): ("upper right", "upper right"), (1, 2): ("upper left", "upper left"), (1, 3): (None, "upper right"), (1, 4): ("lower left", "lower left"),
        (1, 5): (None, "upper right"), (1, 6): (None, "upper left"), (2, 1): (None, "upper right"), (None, 1): (None, "lower left"),
    }
    by_cells = A.best_match(findings, four, ["img"], "id", "side_of").select("img", "id", "best_side_of", "best_iou")
    assert sorted(map(str, by_cells.collect())) == sorted(map(str, got.select("img", "id", "best_side_of", "best_iou").collect()))
    assert A.quadrant(findings.limit(0), four, ["img"], "id", "side_of", F.lit(110.0), F.lit(110.0)).collect() == []
    one = A.quadrant(findings.filter("img = 1"), four.filter("img = 1").drop("img"), [], "id", "side_of", F.lit(110.0), F.lit(110.0))
    assert {(r.img, r.id): (r.best_side_of, r.side) for r in one.collect()} == {k: v for k, v in sides.items() if k[0] == 1}


def test_quadrants_are_not_broadcast(spark):
    """There are four for each image, however small the files that they are made of seem."""
    findings, four = quadrant_tables(spark)
    got = A.quadrant(findings, four, ["img"], "id", "side_of", F.lit(110.0), F.lit(110.0))
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_routes(spark):
    rows = spark.createDataFrame([("canal",), ("sinus",), ("caries",), (None,)], "label string")
    got = [r.r for r in rows.select(A.routed(F.col("label"), {"canal": "jaw", "sinus": "jaw"}).alias("r")).collect()]
    assert got == ["jaw", "jaw", "tooth", "tooth"]
