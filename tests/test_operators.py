"""Edge cases and properties of the operators over points."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tesselix.functions import geometry as g
from tesselix.operators import heap, index, knn, points as pts, ranges, skyline as sky
from tesselix.plans import layout, ordering
from tesselix.sources import osm, report

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
COORD = st.integers(0, 6).map(float)
ROWS = st.lists(st.tuples(COORD, COORD), max_size=40)


def frame(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)] if not rows or len(rows[0]) == 2 else rows, "id bigint, x double, y double")


def cloud(n, seed=1):
    rng = random.Random(seed)
    return [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(n)]


def test_points_leave_out_what_has_no_place(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 1.0), (None, -0.0, 0.0)], "k bigint, a double, b double")
    got = pts.points_from(df, {"x": "a", "y": "b"}, "k").collect()
    assert sorted((r["id"] or 0, r["x"]) for r in got) == [(0, 0.0), (1, 1.0)]


def test_filters_reach_the_scan(spark):
    from tesselix.plans import catalog

    plan = catalog.range_box(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for part in ("GreaterThanOrEqual(p_size,10)", "LessThanOrEqual(p_size,30)", "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int,p_retailprice:double>"):
        assert part in plan, plan


def test_live_rules(spark):
    df = frame(spark, [(-1, 0.0, 0.0), (0, 0.0, 0.0), (1, 0.0, 0.0)])
    ids = lambda rule: sorted(r["id"] for r in pts.live(df, rule).collect())
    assert (ids("all"), ids("not_tombstone"), ids("positive")) == ([-1, 0, 1], [0, 1], [1])


@SLOW
@given(rows=ROWS, low=st.tuples(COORD, COORD), high=st.tuples(COORD, COORD))
def test_range_is_a_closed_box(spark, rows, low, high):
    got = sorted(r["id"] for r in ranges.range_query(frame(spark, rows), low, high).collect())
    assert got == [i for i, (x, y) in enumerate(rows) if low[0] <= x <= high[0] and low[1] <= y <= high[1]]


@SLOW
@given(rows=ROWS, r=st.sampled_from([0.0, 0.5, 1.0, 3.0]))
def test_range_join_by_grid_and_by_broadcast(spark, rows, r):
    df = frame(spark, rows)
    queries = df.filter("id % 3 = 0").select(F.col("id").alias("qid"), *(e for c in "xy" for e in ((F.col(c) - r).alias(f"q_{c}_min"), (F.col(c) + r).alias(f"q_{c}_max"))))
    want = sorted((q, i) for q, (a, b) in enumerate(rows) if q % 3 == 0 for i, (x, y) in enumerate(rows) if abs(a - x) <= r and abs(b - y) <= r)
    for how in ({"method": "broadcast"}, {"method": "grid", "cell": (1.0, 1.0)}, {"method": "grid", "cell": (0.3, 5.0)}, {"method": "grid"}):
        assert sorted(tuple(x) for x in ranges.range_join(df, queries, **how).select("qid", "id").collect()) == want


@SLOW
@given(rows=ROWS, k=st.integers(0, 50), at=st.tuples(COORD, COORD))
def test_knn_plain_and_pruned(spark, rows, k, at):
    df = frame(spark, rows)
    want = [(i, math.sqrt((x - at[0]) * (x - at[0]) + (y - at[1]) * (y - at[1]))) for i, (x, y) in enumerate(rows)]
    want = sorted(want, key=lambda r: (r[1], r[0]))[:k]
    plain = [(r["id"], r["dist"]) for r in knn.knn(df, at, k).orderBy("rank").collect()]
    placed, boxes = layout.leaf_table(df, fanout=4)
    pruned = [(r["id"], r["dist"]) for r in layout.knn_two_phase(placed, boxes, at, k).orderBy("rank").collect()]
    assert plain == want == pruned


def test_pruning_leaves_few(spark):
    df = frame(spark, cloud(2_000))
    _, boxes = layout.leaf_table(df)
    assert boxes.count() >= 40
    assert layout.pruned_leaves(boxes, (50.0, 50.0), 5).count() <= 10


def test_more_radius_more_hits_and_prefixes_of_neighbours(spark):
    df = frame(spark, cloud(500))
    counts = [ranges.range_query(df, *ranges.square((50.0, 50.0), r)).count() for r in (0.0, 1.0, 5.0, 20.0, 100.0)]
    assert counts == sorted(counts) and counts[-1] == 500
    far = [(r["id"], r["dist"]) for r in knn.knn(df, (50.0, 50.0), 30).orderBy("rank").collect()]
    assert [d for _, d in far] == sorted(d for _, d in far)
    assert [(r["id"], r["dist"]) for r in knn.knn(df, (50.0, 50.0), 7).orderBy("rank").collect()] == far[:7]


def test_sampler_is_repeatable_and_draws_known_rows(spark):
    df = frame(spark, cloud(20))
    draw = lambda: sorted((r["draw"], r["id"]) for r in pts.sampled(df, 50, 3).collect())
    assert draw() == draw() and len(draw()) == 50 and {i for _, i in draw()} <= set(range(20))
    assert pts.sampled(df.limit(0), 5).count() == 0


def test_nodes_are_stored_and_read(spark, tmp_path):
    index.write_nodes(index.levels(frame(spark, cloud(200)), fanout=5), str(tmp_path / "n"))
    nodes = spark.read.parquet(str(tmp_path / "n"))
    assert index.leaf_nodes(nodes).count() == 40
    assert index.read_node(nodes, 1, 0).count() == 5 and index.read_node(nodes, 0, 0).count() == 0


def test_knn_join_in_blocks(spark):
    df = frame(spark, cloud(200))
    queries = df.select(F.col("id").alias("qid"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    rows = lambda d: sorted(tuple(r) for r in d.select("qid", "id", "rank").collect())
    assert rows(knn.knn_join(df, queries, 3)) == rows(knn.knn_join(df, queries, 3, block=40))


def test_one_wide_box_takes_few_cells(spark):
    df = frame(spark, cloud(300))
    boxes = [(i, x - 0.1, x + 0.1, y - 0.1, y + 0.1) for i, (x, y) in enumerate(cloud(30, seed=5))] + [(99, -1e6, 1e6, -1e6, 1e6)]
    queries = spark.createDataFrame(boxes, "qid bigint, q_x_min double, q_x_max double, q_y_min double, q_y_max double")
    rows = lambda d: sorted(tuple(r) for r in d.select("qid", "id").collect())
    got = ranges.range_join(df, queries, method="grid", cell=(0.2, 0.2))
    assert rows(got) == rows(ranges.range_join(df, queries, method="broadcast"))


@SLOW
@given(rows=ROWS, k=st.integers(1, 12))
def test_knn_join_by_cells(spark, rows, k):
    df = frame(spark, [*rows, (1e4, -3.0)])  # one far away: cells grow for it
    queries = df.select(F.col("id").alias("qid"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    queries = queries.unionByName(spark.createDataFrame([(-1, -1e6, 7.0)], "qid bigint, q_x double, q_y double"))
    got = lambda d: sorted(tuple(r) for r in d.select("qid", "id", "dist", "rank").collect())
    assert got(knn.knn_join(df, queries, k, method="grid")) == got(knn.knn_join(df, queries, k, method="all"))
    assert got(knn.knn_join(df, queries, k, method="grid", block=4)) == got(knn.knn_join(df, queries, k, method="all"))


def test_cells_follow_the_long_sides():
    assert abs(knn.cell_width([100.0, 100.0], 10_000, 1) - 1) < 1e-9
    assert abs(knn.cell_width([1000.0, 10.0], 10_000, 4) - 2) < 1e-9
    assert abs(knn.cell_width([1e6, 1e-3], 1000, 5) - 5000) < 1e-6  # not the root of what the thin side leaves
    assert knn.cell_width([0.0, 0.0], 3, 1) == knn.cell_width([], 0, 1) == 1.0
    assert knn.cell_width([5.0, 7.0], 3, 10) > 0


def test_stored_index(spark, tmp_path, monkeypatch):
    df = frame(spark, cloud(3_000))
    layout.write_index(df, str(tmp_path / "i"), rows_per_file=1_000)
    stored = layout.Index(spark, str(tmp_path / "i"))
    assert stored.points.count() == 3_000 and stored.leaves.agg(F.max("entries")).first()[0] <= 50
    assert len(stored.near((50.0, 50.0), 5)) <= 10
    got = lambda d: [(r["id"], r["dist"]) for r in d.orderBy("rank").collect()]
    monkeypatch.setattr(layout, "MOST_HELD", 3)
    for at, k in (((50.0, 50.0), 5), ((-9.0, 200.0), 60), ((1.0, 1.0), 0), ((5.0, 5.0), 4_000)):
        want = got(knn.knn(df, at, k))
        assert got(stored.knn(at, k)) == want == got(layout.Index(spark, str(tmp_path / "i")).knn(at, k))
    plan = stored.knn((50.0, 50.0), 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(node," in plan


def brute_skyline(rows):
    return [i for i, p in enumerate(rows) if not any(all(b <= a for a, b in zip(p, q)) and q != p for q in rows)]


@SLOW
@given(rows=ROWS)
def test_skyline_keeps_all_or_the_first(spark, rows):
    df = frame(spark, rows)
    want = brute_skyline(rows)
    assert sorted(r["id"] for r in sky.skyline(df).collect()) == want
    firsts = {}
    for i in want:
        firsts.setdefault(rows[i], i)
    assert sorted(r["id"] for r in sky.skyline(df, duplicates="first").collect()) == sorted(firsts.values())


@SLOW
@given(rows=st.lists(st.tuples(COORD, COORD, COORD), max_size=30))
def test_skyline_in_three_dimensions(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, x double, y double, z double")
    assert sorted(r["id"] for r in sky.skyline(df, ("x", "y", "z")).collect()) == brute_skyline(rows)


def test_skyline_of_anticorrelated_points_compares_few(spark, monkeypatch):
    """Nearly all survive; they are compared leaf by leaf, far below survivors times survivors."""
    monkeypatch.setattr(sky, "CELL", 16)
    monkeypatch.setattr(sky, "FEW", 100)
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        x, y = rng.randint(0, 400), rng.randint(0, 400)
        rows.append((i, float(x), float(y), float(900 - x - y + rng.randint(0, 1))))
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double")
    got = {r["id"] for r in sky.skyline(df, ("x", "y", "z")).collect()}
    assert got == {a[0] for a in rows if not any(b[1] <= a[1] and b[2] <= a[2] and b[3] <= a[3] and b[1:] != a[1:] for b in rows)}
    packed = index.leaf_of(df, ("x", "y"), fanout=16, method="str").select("x", "y", "z", "node")
    compared = sky.meeting(packed, ("x", "y", "z")).agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0]
    assert len(got) > 1500 and compared < len(got) ** 2 / 5


def test_range_join_with_one_hot_cell(spark):
    """A third of all points at one place: they are dealt to several tasks, and no pair is lost or comes twice."""
    rng = random.Random(6)
    rows = [(i, 5.0, 5.0) if i % 3 == 0 else (i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(3000)]
    boxes = [(i, x - 1, x + 1, y - 1, y + 1) for i, x, y in rows[:40]]
    q = spark.createDataFrame(boxes, "qid bigint, q_x_min double, q_x_max double, q_y_min double, q_y_max double")
    got = ranges.range_join(spark.createDataFrame(rows, "id bigint, x double, y double"), q, method="grid")
    want = [(b[0], i) for b in boxes for i, x, y in rows if b[1] <= x <= b[2] and b[3] <= y <= b[4]]
    assert sorted((r["qid"], r["id"]) for r in got.collect()) == sorted(want)
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()


def test_preview_reads_once(spark):
    df = frame(spark, cloud(500)).repartition(7)
    got = ranges.preview(df.filter("x > 10"), 5)
    want = sorted(r["id"] for r in df.filter("x > 10").collect())
    assert [(r["id"], r["hits"]) for r in got.orderBy("id").collect()] == [(i, len(want)) for i in want[:5]]
    assert ranges.preview(df.filter("x < -1e9"), 5).count() == 0
    plan = ranges.preview(ranges.range_query(spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), [0, 0], [50, 2000]), 5)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_global_order_over_buckets_is_that_of_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(1000)) for _ in range(500)]
    df = frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(rows)])
    for per in (10**6, 50):
        got = {r["id"]: r["rn"] for r in ordering.numbered(df, ["x", "id"], rows_per_range=per).collect()}
        assert got == {i: n + 1 for n, (_, i) in enumerate(sorted((x, i) for i, (x, _) in enumerate(rows)))}
        low = {r["id"]: r["m"] for r in ordering.running_min_before(df, ["x", "id"], "y", "m", rows_per_range=per).collect()}
        best, want = None, {}
        for _, i in sorted((x, i) for i, (x, _) in enumerate(rows)):
            want[i] = best
            best = float(rows[i][1]) if best is None else min(best, float(rows[i][1]))
        assert low == want


@pytest.mark.parametrize("n", [0, 1, 50, 51, 2500, 2501])
def test_levels(spark, n):
    df = frame(spark, cloud(n))
    nodes = index.levels(df).collect()
    by_level = {}
    for r in nodes:
        by_level.setdefault(r["level"], []).append(r)
    assert sum(r["entries"] for r in by_level.get(0, [])) == n
    assert len(by_level) == (0 if not n else 1 + (n > 50) + (n > 2500))
    for level, rows in by_level.items():
        for r in rows:
            kids = [k for k in by_level.get(level - 1, []) if k["parent"] == r["node"]]
            if level:
                assert r["entries"] == len(kids) and r["x_min"] == min(k["x_min"] for k in kids) and r["y_max"] == max(k["y_max"] for k in kids)


def test_str_leaves_hold_their_points(spark):
    df = frame(spark, cloud(777))
    placed = index.leaf_of(df, method="str").join(index.leaves(df, method="str"), "node")
    assert placed.count() == 777
    assert placed.filter(~g.contained(g.point_box(pts.columns(("x", "y"))), g.box())).count() == 0
    assert placed.agg(F.max("entries")).first()[0] <= 50


def test_descent_against_a_walk(spark):
    df = frame(spark, cloud(300))
    nodes = index.levels(df, fanout=5)
    tree = {(r["level"], r["node"]): r for r in nodes.collect()}
    top = max(level for level, _ in tree)

    def cost(r, x, y):
        w, h = r["x_max"] - r["x_min"], r["y_max"] - r["y_min"]
        grown = (max(r["x_max"], x) - min(r["x_min"], x)) * (max(r["y_max"], y) - min(r["y_min"], y))
        return (grown - w * h, w * h, r["entries"], r["node"])

    new = cloud(40, seed=2)
    want = {}
    for i, (x, y) in enumerate(new):
        node = 0
        for level in range(top - 1, -1, -1):
            node = min((r for (lv, _), r in tree.items() if lv == level and r["parent"] == node), key=lambda r: cost(r, x, y))["node"]
        want[i] = node
    assert {r["id"]: r["node"] for r in index.descend(frame(spark, new), nodes).collect()} == want


def test_blocks_change_nothing(spark, monkeypatch):
    df, q = frame(spark, cloud(120)), frame(spark, cloud(15, seed=3))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    leaves = index.leaves(df, fanout=4)
    three = df.withColumn("z", F.col("x") * F.col("y") % 7)
    plain = rows(index.choose_subtree(q, leaves)), rows(sky.dominance_counts(df)), rows(sky.undominated(three, ("x", "y", "z")))
    monkeypatch.setattr(sky, "BLOCK", 20)
    assert plain == (rows(index.choose_subtree(q, leaves, block=7)), rows(sky.dominance_counts(df)), rows(sky.undominated(three, ("x", "y", "z"))))


def test_split_groups(spark):
    entries = frame(spark, cloud(51)).select("id", F.lit(0).alias("node"), F.col("x").alias("x_min"), F.col("x").alias("x_max"), F.col("y").alias("y_min"), F.col("y").alias("y_max"))
    got = index.split(entries).groupBy("group_no").count().collect()
    assert sorted(r["count"] for r in got) == [25, 26]
    assert len(index.reinsert_candidates(entries).collect()) == 15


def close_entries(spark, n=51, node=0, seed=7):
    """Entries in a box of a few ten-thousandths of a degree, where squares are far below 1e-6."""
    rng = random.Random(seed)
    at = [(i, node, 40.5979 + rng.random() * 5e-4, 22.9641 + rng.random() * 5e-4) for i in range(n)]
    return at, spark.createDataFrame([(i, m, x, x, y, y) for i, m, x, y in at], "id bigint, node bigint, x_min double, x_max double, y_min double, y_max double")


def test_farthest_entries_at_the_scale_of_degrees(spark):
    at, entries = close_entries(spark)
    other, more = close_entries(spark, node=3, seed=8)
    got = {}
    for r in index.reinsert_candidates(entries.unionByName(more)).collect():
        got.setdefault(r["node"], set()).add(r["id"])
    for node, own in ((0, at), (3, other)):
        mx, my = sum(p[2] for p in own) / 51, sum(p[3] for p in own) / 51
        want = sorted(own, key=lambda p: (-((p[2] - mx) ** 2 + (p[3] - my) ** 2), p[0]))[:15]
        assert got[node] == {p[0] for p in want} and got[node] != set(range(15))


def test_split_at_the_scale_of_degrees(spark):
    at, entries = close_entries(spark)
    chosen = index.choose_split(entries).first()
    sums = {}
    for o, dim in enumerate((2, 3)):
        order, total, best = sorted(at, key=lambda p: (p[dim], p[0])), 0.0, None
        for k in range(25, 51 - 25 + 1):
            margin = sum(2.0 * (max(p[c] for p in half) - min(p[c] for p in half)) for half in (order[:k], order[k:]) for c in (2, 3))
            total, best = total + margin, min(best or (margin, k), (margin, k))
        sums[o] = (total, best[1])
    o = min(sums, key=lambda o: (sums[o][0], o))
    assert (chosen["dim"], chosen["side"], chosen["k"]) == ("xy"[o], "min", sums[o][1])


@pytest.mark.parametrize("old, new, fanout", [(0, 30, 6), (1, 40, 6), (36, 1, 6), (100, 150, 6)])
def test_points_go_into_a_tree_that_stays(spark, old, new, fanout):
    rng = random.Random(old)
    first, more = frame(spark, cloud(old)), frame(spark, [(rng.choice([3.0, 90.0]) + rng.random(), rng.random()) for _ in range(new)]).withColumn("id", F.col("id") + 1000)
    nodes = index.levels(first, fanout=fanout)
    before = {r["id"]: r["node"] for r in index.leaf_of(first, fanout=fanout).collect()}
    placed, grown = index.grow(index.leaf_of(first, fanout=fanout), nodes, more, fanout=fanout)
    points, tree = placed.collect(), {(r["level"], r["node"]): r for r in grown.collect()}
    assert sorted(r["id"] for r in points) == sorted([*range(old), *range(1000, 1000 + new)])
    assert len(tree) == grown.count()
    roots = [k for k, r in tree.items() if r["parent"] is None]
    assert len(roots) == 1 and roots[0][0] == max(level for level, _ in tree)
    for (level, node), r in tree.items():
        kids = [(p["x"], p["x"], p["y"], p["y"]) for p in points if p["node"] == node] if not level else [(c["x_min"], c["x_max"], c["y_min"], c["y_max"]) for (lv, _), c in tree.items() if lv == level - 1 and c["parent"] == node]
        assert 0 < len(kids) == r["entries"] <= fanout
        assert (r["x_min"], r["x_max"], r["y_min"], r["y_max"]) == (min(k[0] for k in kids), max(k[1] for k in kids), min(k[2] for k in kids), max(k[3] for k in kids))
    assert all((0, p["node"]) in tree for p in points)
    if new == 1:  # what did not overflow stays where it was
        moved = [p for p in points if p["id"] < 1000 and before[p["id"]] != p["node"]]
        assert len({before[p["id"]] for p in moved}) <= 1


class Walk:
    """A tree in plain Python, to go down one entry at a time."""

    def __init__(self, placed, parents, fanout):
        self.fanout, self.leave, self.above = fanout, fanout * index.REINSERTED // index.FANOUT, [dict(placed), *map(dict, parents)]
        self.points = {}

    def members(self, level, node):
        """Boxes by key of the node's entries."""
        if level == 0:
            return {k: (p[0], p[0], p[1], p[1]) for k, p in self.points.items() if self.above[0].get(k) == node}
        return {k: self.box(level - 1, k) for k, n in self.above[level].items() if n == node}

    def box(self, level, node):
        e = list(self.members(level, node).values())
        return min(x[0] for x in e), max(x[1] for x in e), min(x[2] for x in e), max(x[3] for x in e)

    def down(self, entry, to):
        top = len(self.above) - 1
        (node,) = set(self.above[top].values())
        for level in range(top, to, -1):
            def growth(n, level=level):
                a, b, c, d = self.box(level - 1, n)
                grown = (max(b, entry[1]) - min(a, entry[0])) * (max(d, entry[3]) - min(c, entry[2]))
                return grown - (b - a) * (d - c), (b - a) * (d - c), len(self.members(level - 1, n)), n

            node = min((n for n, p in self.above[level].items() if p == node), key=growth)
        return node


def test_overflow_by_reinsertion_against_a_walk(spark):
    """A leaf gets one point too many: the farthest leave, boxes shrink, and the walk tells where each of them goes then."""
    rng = random.Random(9)
    rows, fanout = [(i, rng.randint(0, 40) / 2, rng.randint(0, 40) / 2) for i in range(60)], 10
    first = spark.createDataFrame(rows, "id bigint, x double, y double")
    placed, nodes = index.leaf_of(first, fanout=fanout).select("id", "x", "y", "node"), index.levels(first, fanout=fanout)
    gone = [r[0] for r in rows if r[0] % 5 == 0]
    entries = placed.filter(~F.col("id").isin(gone)).select("id", "node", F.col("x").alias("x_min"), F.col("x").alias("x_max"), F.col("y").alias("y_min"), F.col("y").alias("y_max"))
    parents = [{r["node"]: r["parent"] for r in nodes.filter(f"level = {i}").collect()} for i in range(nodes.agg(F.max("level")).first()[0])]
    held = {r["id"]: (r["x_min"], r["y_min"], r["node"]) for r in entries.collect()}
    moved = 0
    for t in range(6):
        x, y = rng.randint(0, 40) / 2, rng.randint(0, 40) / 2
        walk = Walk({i: n for i, (_, _, n) in held.items()}, parents, fanout)
        walk.points = {i: (a, b) for i, (a, b, _) in held.items()}
        leaf = walk.down((x, x, y, y), 0)
        crowd = 1 + fanout - sum(n == leaf for _, _, n in held.values())
        extra = {1000 + 100 * t + i: (x + i / 8, y) for i in range(crowd)}
        walk.points |= extra
        walk.above[0] |= dict.fromkeys(extra, leaf)
        more = spark.createDataFrame([(i, leaf, a, a, b, b) for i, (a, b) in extra.items()], entries.schema)
        got = {r["id"]: r["node"] for r in index.reinserted(entries.unionByName(more), nodes, 0, fanout=fanout).collect()}
        e = walk.members(0, leaf)
        mx, my = (sum(e[k][i] for k in sorted(e)) / len(e) for i in (0, 2))
        far = sorted(e, key=lambda k: (-((e[k][0] - mx) * (e[k][0] - mx) + (e[k][2] - my) * (e[k][2] - my)), k))[: walk.leave]
        for k in far:
            del walk.above[0][k]
        walk.above[0] |= {k: walk.down(e[k], 0) for k in far}
        assert got == walk.above[0] and len(far) == 3
        moved += sum(walk.above[0][k] != leaf for k in far)
    assert moved > 0


def test_growth_with_reinsertion_keeps_the_tree_whole(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(330)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    old, new = df.filter("id < 300"), df.filter("id >= 300")
    placed, nodes = index.grow(index.leaf_of(old, fanout=10), index.levels(old, fanout=10), new, fanout=10, reinsert=True)
    plain, _ = index.grow(index.leaf_of(old, fanout=10), index.levels(old, fanout=10), new, fanout=10)
    got = {r["id"]: (r["x"], r["y"], r["node"]) for r in placed.collect()}
    assert {i: v[:2] for i, v in got.items()} == {i: (x, y) for i, x, y in rows}
    assert {i: v[2] for i, v in got.items()} != {r["id"]: r["node"] for r in plain.collect()}
    tree = nodes.collect()
    for r in tree:
        if r["level"] == 0:
            e = [(x, x, y, y) for x, y, n in got.values() if n == r["node"]]
        else:
            e = [(c["x_min"], c["x_max"], c["y_min"], c["y_max"]) for c in tree if c["level"] == r["level"] - 1 and c["parent"] == r["node"]]
        assert r["entries"] == len(e) <= 10
        assert (r["x_min"], r["x_max"], r["y_min"], r["y_max"]) == (min(b[0] for b in e), max(b[1] for b in e), min(b[2] for b in e), max(b[3] for b in e))
    assert sum(r["parent"] is None for r in tree) == 1


def test_files_and_ranges_follow_the_rows(spark, tmp_path):
    df = frame(spark, cloud(1_000))
    assert ordering.ranged(df, ["x", "id"], 100).select("_range").distinct().count() > 5
    for per in (100, 10_000):
        layout.write_clustered(df, str(tmp_path / f"c{per}"), rows_per_file=per)
    assert len(list((tmp_path / "c100").glob("*.parquet"))) > 5 and len(list((tmp_path / "c10000").glob("*.parquet"))) == 1


def test_ranges_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MOST_RANGES", 7)
    df = frame(spark, cloud(300)).repartition(5)
    cut = ordering.ranged(df, ["x", "id"], 10)
    assert 1 < cut.select("_range").distinct().count() <= 7
    got = ordering.numbered(df, ["x", "id"], "rn", 10).orderBy("x", "id").collect()
    assert [r["rn"] for r in got] == list(range(1, 301))


def test_tables_in_between_are_removed(spark):
    import os

    from tesselix.sources import storage

    with storage.scratch(spark):
        inside = storage.materialise(frame(spark, cloud(20)))
        path = inside.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    kept = storage.materialise(frame(spark, cloud(20)))
    assert not os.path.exists(path) and kept.count() == 20


def test_records_are_appended(spark, tmp_path):
    df = frame(spark, cloud(20))
    heap.write(df, str(tmp_path / "h"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        heap.write(df, str(tmp_path / "h"))
    heap.write(df, str(tmp_path / "h"), append=True)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 40


@pytest.mark.parametrize("n", [117, 118, 234])
def test_addresses_are_unique(spark, n):
    got = heap.addressed(frame(spark, cloud(n))).collect()
    assert len({(r["block_id"], r["slot_id"]) for r in got}) == n
    assert max(r["slot_id"] for r in got) == 116 and max(r["block_id"] for r in got) == -(-n // 117)


def test_stored_name(spark):
    df = spark.createDataFrame([("a" + "α" * 200,), ("ab\0cd",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(heap.stored_name(F.col("s"))).collect()]
    assert got == ["a" + "α" * 127 + "�", "ab", "", None]


def test_osm(spark, tmp_path):
    (tmp_path / "m.osm").write_text(
        '<osm><node id="-5" lat="1.5" lon="2.5"/><node id="7" lat="3" lon="4"><tag k="name" v="a"/><tag k="name" v="b"/></node>'
        '<node id="9" lat="5" lon="6"><tag k="amenity" v="cafe"/><tag k="name" v=""/></node><way id="3"><tag k="name" v="w"/></way></osm>'
    )
    got = {r["id"]: r for r in osm.read_osm(spark, str(tmp_path / "m.osm")).collect()}
    assert set(got) == {-5, 7, 9} and got[7]["name"] == "b" and (got[-5]["x"], got[-5]["y"]) == (1.5, 2.5)
    assert all(len(got[i]["name"]) == 6 and got[i]["name"].islower() for i in (-5, 9))
    for bad in ('<osm><node id="x" lat="1" lon="2"/></osm>', '<osm><node id="1" lat="1" lon="2">'):
        (tmp_path / "bad.osm").write_text(bad)
        with pytest.raises(Exception, match="FAILED_READ_FILE|Malformed|MALFORMED"):
            osm.read_osm(spark, str(tmp_path / "bad.osm")).collect()


def test_clustered_layout_and_report(spark, tmp_path):
    df = frame(spark, cloud(5_000)).withColumn("name", F.lit("n"))
    layout.write_clustered(df, str(tmp_path / "c"))
    back = layout.read_clustered(spark, str(tmp_path / "c"))
    box = ([20.0, 30.0], [25.0, 40.0])
    ids = lambda d: sorted(r["id"] for r in ranges.range_query(d, *box).select("id").collect())
    assert ids(back) == ids(df)
    plan = ranges.range_query(back, *box)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(x,20.0)" in plan
    assert report.lines(df, 1).first()["line"].startswith("0, n, (")


def test_ingest_stores_each_batch_once(spark, tmp_path):
    from tesselix.streaming.ingest import ingest

    source = tmp_path / "in"
    frame(spark, cloud(100)).write.parquet(str(source))
    stream = spark.readStream.schema("id bigint, x double, y double").parquet(str(source))
    q = ingest(stream, str(tmp_path / "points"), str(tmp_path / "ck"), str(tmp_path / "clustered"), every=1)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "points")).count() == 100 == spark.read.parquet(str(tmp_path / "clustered")).count()
