"""The stored tree: build, queries by level, batch joins, growth by versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesselix.plans import tree as trees
from tesselix.plans.tree import Tree, VersionTaken, build
from tesselix.sources.storage import fresh_path

POINT = "id bigint, name string, x double, y double"


def cloud(n, seed=0, same=0.0, first=0):
    """Points, a share of them at one place."""
    rng = random.Random(seed)
    return [(first + i, f"p{i}", *((5.0, 5.0) if rng.random() < same else (rng.gauss(0, 10), round(rng.uniform(-20, 20), 1)))) for i in range(n)]


def made(spark, rows, **how):
    return build(spark.createDataFrame(rows, POINT), fresh_path(spark, "tree"), **how)


def dist(a, b):
    return math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def nearest(rows, q, k):
    return [(i, d) for d, i in sorted((dist((x, y), q), i) for i, _, x, y in rows)[:k]]


def check_shape(tree):
    """Every node's box, counts and ids are its entries'; all points are in one leaf each; no node is too full."""
    leaves = {r["node"]: r for r in tree.nodes(0).collect()}
    points = tree.points().collect()
    assert len({r["id"] for r in points}) == len(points) == tree.meta["points"]
    below = {}
    for r in points:
        below.setdefault(r["node"], []).append((r["id"], r["id"], r["x"], r["x"], r["y"], r["y"], 1))
    for level in range(tree.height + 1):
        nodes = leaves if level == 0 else {r["node"]: r for r in tree.nodes(level).collect()}
        assert set(nodes) == set(below) and len(nodes) == tree.meta["levels"][level]
        above = {}
        for n, r in nodes.items():
            e = below[n]
            own = (min(x[0] for x in e), max(x[1] for x in e), min(x[2] for x in e), max(x[3] for x in e), min(x[4] for x in e), max(x[5] for x in e), sum(x[6] for x in e))
            assert (r["id_min"], r["id_max"], r["x_min"], r["x_max"], r["y_min"], r["y_max"], r["points"]) == own
            assert r["entries"] == len(e) <= tree.fanout
            above.setdefault(r["parent"], []).append(own)
            if level == 1:
                assert {leaves[k]["part"] for k in leaves if leaves[k]["parent"] == n} == {r["part"]}
        below = above
    assert len(below.get(None, below.get(0, [1]))) == 1 or tree.height == 0


@pytest.fixture(scope="module")
def rows():
    return cloud(6000, same=0.2)


@pytest.fixture(scope="module")
def tree(spark, rows):
    return made(spark, rows, fanout=10, points_per_part=500)


def test_shape(tree):
    assert tree.height >= 3 and len(tree.made) > 5
    check_shape(tree)


@pytest.mark.parametrize("held", [100_000, 0])
def test_single_queries(spark, tree, rows, held, monkeypatch):
    monkeypatch.setattr(trees, "MOST_HELD", held)
    t = Tree(spark, tree.store.path)
    rng = random.Random(1)
    for q in [(5.0, 5.0), (0.0, 0.0), (100.0, -3.0), *((rng.gauss(0, 10), rng.uniform(-20, 20)) for _ in range(2))]:
        for k in (1, 30):
            assert [(r["id"], r["dist"]) for r in t.knn(q, k).orderBy("rank").collect()] == nearest(rows, q, k)
        low, high = [q[0] - 3, q[1] - 2], [q[0] + 1, q[1] + 2]
        assert {r["id"] for r in t.range(low, high).collect()} == {i for i, _, x, y in rows if low[0] <= x <= high[0] and low[1] <= y <= high[1]}
    assert t.range([5, 5], [5, 5]).count() == sum((x, y) == (5.0, 5.0) for _, _, x, y in rows)
    assert t.range([3, 3], [2, 4]).count() == 0 and t.knn((0, 0), 0).count() == 0 and t.knn((0, 0), 10**6).count() == len(rows)


def test_a_query_reads_few_nodes(spark, tree, rows, monkeypatch):
    """Without anything held: only entries of the nodes that are left, and of a place that a fifth of all points share, by their ids."""
    monkeypatch.setattr(trees, "MOST_HELD", 0)
    for q in ((5.0, 5.0), (-7.0, 3.0)):
        t = Tree(spark, tree.store.path)
        assert not t.held
        plan = t.knn(q, 5)._jdf.queryExecution().toString()
        assert 0 < t.nodes_read < sum(t.meta["levels"]) / 2 and "PushedFilters: [IsNotNull(node), GreaterThanOrEqual(node" in plan
    t = Tree(spark, tree.store.path)
    some = t.range([-7, 3], [-6, 4])
    assert t.nodes_read < sum(t.meta["levels"]) / 2 and len(some.inputFiles()) < len(tree.made)


def test_wide_ranges_give_up_leaves(spark, tree, rows, monkeypatch):
    monkeypatch.setattr(trees, "MOST_FRONTIER", 20)
    assert tree.range([-1000, -1000], [1000, 1000]).count() == len(rows)
    assert [(r["id"], r["dist"]) for r in tree.knn((0, 0), 2000).orderBy("rank").collect()] == nearest(rows, (0, 0), 2000)


@pytest.mark.parametrize("most", [10_000, 0])
def test_batch_joins(spark, tree, rows, most, monkeypatch):
    """Also with nothing broadcast, where the queries' hot place is dealt out."""
    monkeypatch.setattr(trees, "BROADCAST_ROWS", most)
    asked = cloud(150, 3, same=0.4, first=900)
    queries = spark.createDataFrame([(i, x, y) for i, _, x, y in asked], "qid bigint, q_x double, q_y double")
    got = {}
    for r in tree.knn_join(queries, 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["dist"]))
    assert {i: [(n, d) for _, n, d in sorted(x)] for i, x in got.items()} == {i: nearest(rows, (x, y), 4) for i, _, x, y in asked}
    rng = random.Random(4)
    boxes = [(i, x, x + rng.choice([0, 0.5, 8]), y, y + rng.choice([-1, 0.5, 8])) for i, _, x, y in asked]
    met = tree.range_join(spark.createDataFrame(boxes, "qid bigint, q_x_min double, q_x_max double, q_y_min double, q_y_max double"))
    want = [(q, i) for q, x0, x1, y0, y1 in boxes for i, _, x, y in rows if x0 <= x <= x1 and y0 <= y <= y1]
    assert sorted((r["qid"], r["id"]) for r in met.collect()) == sorted(want)


def test_points_are_scanned_once_whatever_the_queries(spark, tree):
    def scans(n):
        q = spark.createDataFrame([(i, x, y) for i, _, x, y in cloud(n, 5)], "qid bigint, q_x double, q_y double")
        plan = tree.knn_join(q, 2)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("name#")

    assert scans(3) > 0 and scans(3) == scans(700)


def test_leaf_pairs_are_bounded(spark, tree):
    """A third of the points and all queries at one place: a pair still is of one leaf and one group."""
    queries = spark.createDataFrame([(i, 5.0, 5.0) for i in range(7000)], "qid bigint, q_x double, q_y double")
    grouped, groups = tree._grouped(queries, "qid", {"x": (F.col("q_x"), F.col("q_x")), "y": (F.col("q_y"), F.col("q_y"))})
    assert max(r["count"] for r in grouped.groupBy("group").count().collect()) <= tree.fanout
    assert max(r["entries"] for r in tree.nodes(0).collect()) <= tree.fanout
    assert tree.knn_join(queries, 2).count() == 14_000


def test_insert_rewrites_the_touched_parts_only(spark, tree, rows):
    rng = random.Random(2)
    new = [(100_000 + i, "new", 5.0 + rng.random() * 4, rng.uniform(-20, 20)) for i in range(100)]
    grown = tree.insert(spark.createDataFrame(new, POINT))
    check_shape(grown)
    changed = {p for p, m in grown.made.items() if tree.made.get(p) != m}
    assert grown.version == tree.version + 1 and 0 < len(changed) < len(tree.made) / 2
    assert len(grown.nodes(0).collect()) > tree.meta["levels"][0]
    # the old version is as it was
    assert Tree(spark, tree.store.path, tree.version).points().count() == len(rows) and Tree(spark, tree.store.path).version == grown.version
    for q in ((5.5, 5.0), (0.0, 0.0)):
        assert [(r["id"], r["dist"]) for r in grown.knn(q, 20).orderBy("rank").collect()] == nearest(rows + new, q, 20)
        assert [(r["id"], r["dist"]) for r in tree.knn(q, 20).orderBy("rank").collect()] == nearest(rows, q, 20)
    with pytest.raises(VersionTaken):
        tree.insert(spark.createDataFrame(new, POINT))


def test_grows_from_nothing_and_by_levels(spark, monkeypatch):
    monkeypatch.setattr(trees, "REBUILD", 1.0)
    t = made(spark, [], fanout=6, points_per_part=10)
    assert t.knn((0, 0), 3).count() == 0 and t.range([0, 0], [1, 1]).count() == 0
    assert t.knn_join(spark.createDataFrame([(1, 0.0, 0.0)], "qid bigint, q_x double, q_y double"), 2).count() == 0
    all_ = []
    for i, n in enumerate((1, 20, 20, 30)):
        new = cloud(n, seed=i, same=0.3, first=1000 * i)
        all_ += new
        t = t.insert(spark.createDataFrame(new, POINT), batch=i)
        assert t.insert(spark.createDataFrame(new, POINT), batch=i) is t  # a batch that is run again
        check_shape(t)
    assert t.height >= 2 and len(t.made) > 1
    assert [(r["id"], r["dist"]) for r in t.knn((1, 1), 9).orderBy("rank").collect()] == nearest(all_, (1, 1), 9)
    assert sorted(r["id"] for r in Tree(spark, t.store.path, 3).points().collect()) == sorted(r[0] for r in all_[:21])


def test_a_stream_of_documents(spark):
    """Documents arrive, batches go into the tree; a batch that is run again changes nothing."""
    from tesselix.sources import osm
    from tesselix.streaming import ingest

    points = [(i, n, x, y) for (i, _, x, y), n in zip(cloud(60, 8), ['a & "b"', "<c>", None, "d"] * 15, strict=True)]
    df = spark.createDataFrame(points, POINT)
    folder, path = fresh_path(spark, "documents"), fresh_path(spark, "tree")
    osm.write_osm(df.filter("id < 40"), folder + "/1", 20)
    check = fresh_path(spark, "stream")
    ingest.ingest_tree(osm.stream_osm(spark, folder), path, check, available_now=True, fanout=8).awaitTermination()
    osm.write_osm(df.filter("id >= 40"), folder + "/2", 20)
    ingest.ingest_tree(osm.stream_osm(spark, folder), path, check, available_now=True, fanout=8).awaitTermination()
    got = Tree(spark, path)
    assert got.version == 2
    said = {r["id"]: (r["name"], r["x"], r["y"]) for r in got.points().collect()}
    assert {i: v[1:] for i, v in said.items()} == {i: (x, y) for i, _, x, y in points}
    assert all(said[i][0] == n for i, n, _, _ in points if n) and all(len(said[i][0]) == 6 for i, n, _, _ in points if not n)
    again = ingest.insert_batch(spark, path, df.filter("id >= 40"), got.meta["batch"])
    assert (again.version, again.meta["points"]) == (2, 60)


def test_small_batches_gather(spark):
    """Batches wait beside the tree until they are half as many points: few versions; a batch that is run again changes nothing."""
    from tesselix.streaming import ingest

    df = spark.createDataFrame(cloud(200, 9), POINT)
    path = fresh_path(spark, "tree")
    for number in range(20):
        for _ in range(2 if number in (3, 12) else 1):
            ingest.gather_batch(spark, path, df.filter(f"id div 10 = {number}"), number, 0.5, fanout=8)
    assert Tree(spark, path).meta["points"] < 200
    ingest.settle(spark, path, fanout=8)
    ingest.gather_batch(spark, path, df.filter("id div 10 = 19"), 19, 0.5, fanout=8)
    ingest.settle(spark, path, fanout=8)
    got = Tree(spark, path)
    assert got.version < 10 and got.meta["batch"] == 19
    assert sorted(r["id"] for r in got.points().collect()) == sorted(r[0] for r in cloud(200, 9))
