"""Steps whose work or memory must not grow with all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tesselix.operators import index, knn, ranges


def test_lateral_neighbours_meet_few_parts(spark):
    """Suppliers lie far outside the parts; the lateral table is what the tree leaves, without a join of all with all."""
    from tesselix.plans import catalog

    plan = catalog.knn_lateral(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_groups_of_far_queries_are_small(spark):
    """Queries far apart and far from all points don't share a group, so few leaves are left to each."""
    from tesselix.plans.tree import build
    from tesselix.sources.storage import fresh_path

    rng = random.Random(2)
    points = spark.createDataFrame([(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(2_000)], "id bigint, x double, y double")
    tree = build(points, fresh_path(spark, "tree"), fanout=10)
    far = spark.createDataFrame([(i, rng.uniform(0, 10), rng.uniform(100, 5_000)) for i in range(400)], "qid bigint, q_x double, q_y double")
    _, groups = tree._grouped(far, "qid", {d: (F.col(f"q_{d}"), F.col(f"q_{d}")) for d in ("x", "y")})
    assert groups.agg(F.max(F.col("g_y_max") - F.col("g_y_min"))).first()[0] < 2


def test_subtree_of_many_nodes_by_bounds(spark):
    """More nodes than all points meet: the same choice, and no join of all with all. Many nodes without width tie at no growth."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 4), float(x := rng.randrange(40)), float(x + rng.choice((0, 0, 4))), float(y := rng.randrange(40)), y + rng.random() * 20) for i in range(1_200)]
    nodes = spark.createDataFrame(rows, "node bigint, entries bigint, x_min double, x_max double, y_min double, y_max double")
    points = spark.createDataFrame([(i, float(rng.randrange(-20, 60)), rng.uniform(-20, 60)) for i in range(80)], "id bigint, x double, y double")
    got = index.choose_subtree(points, nodes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.choose_subtree(points, nodes, block=600).collect()))


def test_many_pairs_are_many_tasks(spark, monkeypatch):
    """Few bytes on either side, but 3,000 boxes that hold many points: no task gives a large share of the pairs."""
    monkeypatch.setattr(ranges, "COMPARED", 200_000)
    points = spark.range(4_000).select("id", F.lit(0.0).alias("x"), (F.col("id") % 1000).cast("double").alias("y"))
    boxes = spark.range(3_000).select(F.col("id").alias("qid"), F.lit(-9.0).alias("q_x_min"), F.lit(9.0).alias("q_x_max"), (F.col("id") % 1000 - 25.5).alias("q_y_min"), (F.col("id") % 1000 + 25.5).alias("q_y_max"))
    got = ranges.range_join(points, boxes).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 12 * sum(min(y + 25, 999) - max(y - 25, 0) + 1 for y in range(1000))
    assert max(r["count"] for r in got) < sum(r["count"] for r in got) / 4


def test_grid_join_has_tasks_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranges, "COMPARED", 10_000)
    points = spark.range(500).select("id", F.lit(0.0).alias("x"), F.col("id").cast("double").alias("y"))
    boxes = points.select(F.col("id").alias("qid"), *(e for c in "xy" for e in ((F.col(c) - 50).alias(f"q_{c}_min"), (F.col(c) + 50).alias(f"q_{c}_max"))))
    got = ranges.range_join(points, boxes, method="grid", cell=(1000.0, 100.0))
    assert got.rdd.getNumPartitions() >= 8
    assert got.count() == sum(min(y + 50, 499) - max(y - 50, 0) + 1 for y in range(500))


def test_splits_write_only_what_overflows(spark, monkeypatch):
    """One node of 200 entries beside 30 that fit: rounds of splits write the 200 only."""
    written, write = [], index.materialise
    monkeypatch.setattr(index, "materialise", lambda df, what="table": (lambda made: (written.append((what, made.count())), made)[1])(write(df, what)))
    rng = random.Random(6)
    rows = [(i, 0 if i < 200 else 1 + i // 10, *(c for c in (rng.random(), rng.random()) for _ in (0, 1))) for i in range(500)]
    entries = spark.createDataFrame(rows, "id bigint, node bigint, x_min double, x_max double, y_min double, y_max double")
    got, lineage = index.divided(entries, 1_000, fanout=10)
    assert got.count() == got.select("id").distinct().count() == 500
    assert got.groupBy("node").count().agg(F.max("count")).first()[0] <= 10 and lineage.filter("origin <> 0").count() == 0
    assert max(n for what, n in written[1:] if what == "entries") <= 200


def test_pairs_are_thinned_in_bounded_memory(spark):
    """Of many pairs few reach the ranking; ties by id, rows without a proper distance stay."""
    rng = random.Random(4)
    rows = [(q, i, float(rng.randrange(9)) if i else None) for q in range(20) for i in range(300)]
    pairs = spark.createDataFrame(rows, "qid bigint, id bigint, dist double").coalesce(1)
    thin = knn.thinned(pairs, 5, held=1_000).collect()
    assert len(thin) < 1_000
    got = sorted((r["qid"], r["rank"], r["id"]) for r in knn.nearest(pairs.filter("id > 0"), 5).collect())
    assert got == [(q, n + 1, i) for q in range(20) for n, (_, i) in enumerate(sorted((d, i) for p, i, d in rows if p == q and i)[:5])]
    assert {r["qid"] for r in thin if r["dist"] is None} == set(range(20))
    assert knn.thinned(pairs, 5, held=50).count() < len(rows) and knn.nearest(knn.thinned(pairs.filter("id > 0"), 5, held=50), 5).count() == 100


def test_vectors_by_products_of_matrices(spark):
    """Copies, near ties by rounding, and vectors that have no proper distance: as by comparing all, but few rows reach the ranking."""
    from tesselix.functions import geometry as g

    rng = random.Random(7)
    base = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, [v + (i % 3) * 1e-7 for v in base[i % 60]]) for i in range(600)] + [(600, base[0][:5]), (601, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id bigint, e array<float>")
    queries = df.filter("id % 25 = 0 AND id < 600").select(F.col("id").alias("qid"), F.col("e").alias("q_e"))
    plain = knn.knn_join(df, queries, 10, distance=F.round(g.array_dist(F.col("e"), F.col("q_e")), 6)).select("qid", "id", "dist", "rank")
    said = lambda d: sorted((r["qid"], r["rank"], r["id"], r["dist"]) for r in d.filter("id < 600").collect())
    assert said(knn.knn_vectors(df, queries, 10)) == said(plain)


def test_boxes_of_a_full_cell_are_dealt_by_pairs(spark, monkeypatch):
    """One cell of few bytes and many pairs: its points are cut as finely as the pairs ask for, and its boxes are not copied into a broadcast."""
    monkeypatch.setattr(ranges, "COMPARED", 10_000)
    points = spark.range(4_000).select("id", F.lit(0.0).alias("x"), (F.col("id") % 100).cast("double").alias("y"))
    boxes = spark.range(300).select(F.col("id").alias("qid"), F.lit(1.0).alias("q_x_min"), F.lit(99.0).alias("q_x_max"), F.lit(1.0).alias("q_y_min"), F.lit(99.0).alias("q_y_max"))
    got = ranges.range_join(points.withColumn("x", F.lit(50.0)), boxes, method="grid", cell=(100.0, 100.0))
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    rows = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 300 * 40 * 99 and len(rows) > 64 and max(rows) <= 4 * 10_000


def test_boxes_wider_by_rounding_stay_in_their_grid(spark):
    """Sides of 100 that rounding makes a little longer: the points are compared in one grid, not two."""
    points = spark.range(50).select("id", F.lit(0.0).alias("x"), F.col("id").cast("double").alias("y"))
    boxes = spark.range(50).select(F.col("id").alias("qid"), F.lit(-50.0).alias("q_x_min"), F.when(F.col("id") % 2 == 0, 50.0).otherwise(50.0000000001).alias("q_x_max"), F.lit(0.0).alias("q_y_min"), F.lit(9.0).alias("q_y_max"))
    got = ranges.range_join(points, boxes, method="grid", cell=(100.0, 100.0))
    assert "explode([0])" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 500


def test_a_flooded_node_is_packed_at_once(spark, monkeypatch):
    """5,000 entries, some alike, come to one node, 15 to another: the first is cut in one go, so fewer rounds of halves are left than 500 nodes ask for."""
    rounds, cut = [], index.split
    monkeypatch.setattr(index, "split", lambda *a, **b: (rounds.append(1), cut(*a, **b))[1])
    rng = random.Random(8)
    rows = [(i, 3 if i < 5_000 else 4 + i % 2, *(c for v in ((0.5, 0.5) if i % 5 == 0 else (rng.random(), 100 * rng.random())) for c in (v, v))) for i in range(5_020)]
    entries = spark.createDataFrame(rows, "id bigint, node bigint, x_min double, x_max double, y_min double, y_max double")
    got, lineage = index.divided(entries.withColumn("node", F.when(F.col("id") >= 5_000, F.when(F.col("id") < 5_015, 4).otherwise(5)).otherwise(F.col("node")).cast("bigint")), 1_000, fanout=10)
    assert len(rounds) < 9
    nodes = {r["node"]: r["n"] for r in got.groupBy("node").agg(F.count("*").alias("n")).collect()}
    assert got.count() == got.select("id").distinct().count() == 5_020 and max(nodes.values()) <= 10 and min(n for k, n in nodes.items() if k != 5) >= 5
    origin = {r["node"]: r["origin"] for r in lineage.collect()}
    assert set(origin) == set(nodes) - {3, 4, 5} and min(origin) == 1_000 and {i: origin.get(n, n) for i, n in got.select("id", "node").collect()} == {i: 3 if i < 5_000 else 4 if i < 5_015 else 5 for i in range(5_020)}
