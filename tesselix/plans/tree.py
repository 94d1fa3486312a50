"""A stored tree of points that is read in part, grows in part, and keeps its versions.

Leaves hold up to `fanout` points; the leaves under some nodes of level 1 are a part, with a folder for their points and
one for their boxes. All levels above the leaves (a row for 2,500 points) are one table, written anew with each version. A manifest has
a row a part: which folders hold it in this version. A version is there once its file in `versions` is, which is made last and
only if no one else has made it; readers of older versions keep theirs, for nothing is overwritten.

    points/<made>/part=<p>   leaves/<made>/part=<p>   top/<made>   manifests/<made>   versions/<n>

Queries go down from the root a level at a time, by the nodes' boxes, counts and ids, and read the leaves that are left. Ids must be
unique; rows with a null or NaN coordinate must be left out before (points_from does). The manifest and a number for each level are on
the driver: choose points_per_part so that there are at most some 100,000 parts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window
from pyspark.sql.types import LongType, StructField, StructType

from tesselix.functions import geometry as g
from tesselix.operators import index
from tesselix.operators.joins import BROADCAST_ROWS, dealt_join, hot_keys, tasks_for
from tesselix.operators.knn import cell_width, knn, nearest
from tesselix.operators.points import DIMS, columns
from tesselix.operators.ranges import range_query
from tesselix.plans.ordering import numbered
from tesselix.sources.storage import materialise, scratch

#: Nodes whose boxes the driver holds once a tree is open, from the root's level down; and nodes a single query goes on with: where
#: more are left, pruning by leaf is given up for the coordinates' own filter.
MOST_HELD = 100_000
MOST_FRONTIER = 10_000
POINTS_PER_PART = 1_000_000
#: Pairs of a query and a leaf that a task compares.
ASKED = 20_000
#: A batch of more than so many times the points there is packed with them.
REBUILD = 0.5


class VersionTaken(RuntimeError):
    """Someone else has written the next version meanwhile."""


def _sides(dims) -> list[str]:
    return [f"{d}_{s}" for d in dims for s in ("min", "max")]


def _node_columns(dims) -> list[str]:
    return ["level", "node", "parent", "entries", "points", "id_min", "id_max", *_sides(dims)]


def _node_schema(dims) -> str:
    return ", ".join(f"{c} {'double' if c in _sides(dims) else 'bigint'}" for c in _node_columns(dims))


def _summed(members: DataFrame, by: str, dims) -> DataFrame:
    """Nodes from their entries: entries, points, ids and box of each."""
    boxes = [e for d in dims for e in (F.min(f"{d}_min").alias(f"{d}_min"), F.max(f"{d}_max").alias(f"{d}_max"))]
    return members.groupBy(F.col(by).alias("node")).agg(F.count("*").alias("entries"), F.sum("points").alias("points"), F.min("id_min").alias("id_min"), F.max("id_max").alias("id_max"), *boxes)


def _as_entries(points: DataFrame, dims, id: str) -> DataFrame:
    """Points as nodes of one point."""
    return points.select(F.col(id).alias("_key"), "node", F.lit(1).cast("bigint").alias("points"), F.col(id).alias("id_min"), F.col(id).alias("id_max"), *(F.col(d).alias(f"{d}_{s}") for d in dims for s in ("min", "max")))


def _long(name: str) -> StructField:
    return StructField(name, LongType())


class Store:
    """The files of a tree."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def newest(self) -> int:
        """0 if there is none."""
        at = self._at("versions")
        found = [(int(f.getPath().getName()), f.getLen()) for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return max((n for n, size in found if size), default=0)  # an empty one is just being made

    def meta(self, version: int) -> dict:
        stream = self.fs.open(self._at(f"versions/{version}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, meta: dict) -> None:
        try:
            stream = self.fs.create(self._at(f"versions/{version}"), False)
        except Exception as error:
            raise VersionTaken(f"version {version} of {self.path} is there already") from error
        stream.writeBytes(json.dumps(meta))
        stream.close()

    def write_parts(self, df: DataFrame, kind: str, made: str) -> DataFrame:
        """Writes df by its column part, and reads it back."""
        path = f"{self.path}/{kind}/{made}"
        df.repartition("part").sortWithinPartitions("part", "node").write.partitionBy("part").option("parquet.block.size", 1 << 18).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read_parts(self, kind: str, folders: list[tuple[int, str]], schema) -> DataFrame:
        paths = [f"{self.path}/{kind}/{made}/part={part}" for part, made in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def build(points: DataFrame, path: str, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = index.FANOUT, points_per_part: int = POINTS_PER_PART, batch: int = -1, version: int | None = None) -> Tree:
    """Packs points (id, dims and any other columns) into leaves that are about square, and stores them as a new version."""
    with scratch(points.sparkSession):
        return _build(points, path, dims, id, fanout, points_per_part, batch, version)


def _build(points: DataFrame, path: str, dims: tuple[str, ...], id: str, fanout: int, points_per_part: int, batch: int, version: int | None) -> Tree:
    store, made = Store(points.sparkSession, path), uuid.uuid4().hex
    placed, block = index.leaf_of(points, dims, id, fanout, "blocks"), index.block_side(fanout) ** 2
    leaves_a_part = block * max(1, points_per_part // (fanout * block))  # whole nodes of level 1
    placed = placed.select(*points.columns, "node", F.expr(f"node div {leaves_a_part}").alias("part"))
    stored = store.write_parts(placed, "points", made)
    own = _summed(_as_entries(stored, dims, id), "node", dims)
    leaf = own.withColumns({"level": F.lit(0).cast("bigint"), "parent": F.expr(f"node div {block}"), "part": F.expr(f"node div {leaves_a_part}")})
    leaf = store.write_parts(leaf.select(*_node_columns(dims), "part"), "leaves", made)
    below, level, upper = leaf, 0, leaf.limit(0)
    while below.count() > 1:
        level += 1
        nodes = _summed(below, "parent", dims).withColumns({"level": F.lit(level).cast("bigint"), "parent": F.expr(f"node div {block}")})
        nodes = nodes.withColumn("part", F.expr(f"node div {leaves_a_part // block}") if level == 1 else F.lit(None).cast("bigint"))
        below = materialise(nodes.select(*_node_columns(dims), "part"), "level")
        upper = upper.unionByName(below)
    meta = {"dims": list(dims), "id": id, "fanout": fanout, "points_per_part": points_per_part, "batch": batch, "payload": points.schema.json()}
    return _finish(store, made, meta, leaf, upper, None, version)


def _finish(store: Store, made: str, meta: dict, leaf: DataFrame, upper: DataFrame, older: Tree | None, version: int | None = None) -> Tree:
    """Writes the upper levels and the manifest, and commits. leaf: the leaves of the parts that were made now."""
    upper.write.parquet(f"{store.path}/top/{made}")
    upper = store.spark.read.schema(upper.schema).parquet(f"{store.path}/top/{made}")
    manifest = leaf.groupBy("part").agg(F.sum("points").alias("points"), F.count("*").alias("leaves"), F.max("node").alias("last")).withColumn("made", F.lit(made))
    if older is not None:
        manifest = older.manifest.join(manifest, "part", "left_anti").unionByName(manifest)
    manifest.coalesce(1).write.parquet(f"{store.path}/manifests/{made}")  # a row a part
    manifest = store.spark.read.schema(manifest.schema).parquet(f"{store.path}/manifests/{made}")
    totals = manifest.agg(F.sum("points"), F.sum("leaves"), F.max("last"), F.max("part")).first()
    levels = {r["level"]: (r["n"], r["last"]) for r in upper.groupBy("level").agg(F.count("*").alias("n"), F.max("node").alias("last")).collect()}  # a row a level
    levels[0] = (totals[1] or 0, -1 if totals[2] is None else totals[2])
    meta |= {"made": made, "points": totals[0] or 0, "parts": -1 if totals[3] is None else totals[3], "levels": [levels[i][0] for i in range(len(levels))], "last": [levels[i][1] for i in range(len(levels))]}
    if version is None:
        version = store.newest() + 1 if older is None else older.version + 1
    store.commit(version, meta)
    return Tree(store.spark, store.path, version)


class Tree:
    """One version of a stored tree (the newest, if none is named). nodes_read counts the boxes that queries have looked at beyond
    those held, files(...) says what a query reads."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.store = Store(spark, path)
        self.spark, self.version = spark, self.store.newest() if version is None else version
        if not self.version:
            raise ValueError(f"no tree at {path}")
        self.meta = meta = self.store.meta(self.version)
        self.dims, self.id, self.fanout, self.height = tuple(meta["dims"]), meta["id"], meta["fanout"], len(meta["levels"]) - 1
        self.payload = StructType.fromJson(json.loads(meta["payload"]))
        self.point_schema = StructType([*self.payload.fields, _long("node")])
        self.manifest = spark.read.schema("part bigint, points bigint, leaves bigint, last bigint, made string").parquet(f"{self.store.path}/manifests/{meta['made']}")
        self.made = {r["part"]: r["made"] for r in self.manifest.select("part", "made").collect()}  # a row a part
        self.upper = spark.read.schema(_node_schema(self.dims) + ", part bigint").parquet(f"{self.store.path}/top/{meta['made']}")
        self.nodes_read = 0
        self.held: dict[int, pd.DataFrame] = {}
        room = MOST_HELD
        for level in range(self.height, -1, -1):
            room -= meta["levels"][level]
            if room < 0:
                break
            self.held[level] = self.nodes(level).toPandas()

    # --- what is stored ---

    def nodes(self, level: int, parts: list[int] | None = None) -> DataFrame:
        """The nodes of a level, of leaves those of some parts."""
        if level:
            return self.upper.filter(F.col("level") == level)
        wanted = None if parts is None else set(parts)
        named = [(p, made) for p, made in sorted(self.made.items()) if wanted is None or p in wanted]
        own = self.store.read_parts("leaves", named, _node_schema(self.dims))
        return own.withColumn("part", F.regexp_extract("_metadata.file_path", r"part=(\d+)/", 1).cast("bigint") if named else F.lit(None).cast("bigint"))

    def points(self, parts: list[int] | None = None) -> DataFrame:
        """All points with their leaf (node), or those of some parts."""
        wanted = None if parts is None else set(parts)
        return self.store.read_parts("points", [(p, made) for p, made in sorted(self.made.items()) if wanted is None or p in wanted], self.point_schema)

    def root(self) -> pd.DataFrame:
        return self.held[self.height] if self.height in self.held else self.nodes(self.height).toPandas()

    # --- single queries ---

    def _under(self, level: int, above: pd.DataFrame) -> pd.DataFrame:
        """The nodes of a level whose parents these are: of those held, or read by their parents' numbers."""
        if level in self.held:
            found = self.held[level]
            return found[found["parent"].isin(above["node"])]
        parents = [int(x) for x in above["node"]]
        source = self.nodes(level, sorted({int(p) for p in above["part"]}) if level == 0 else None)
        found = source.filter(F.col("parent").between(min(parents), max(parents)) & F.col("parent").isin(parents)).toPandas()
        self.nodes_read += len(found)
        return found

    def _leaves(self, keep) -> pd.DataFrame | None:
        """The leaves that are left when each level goes through keep; None if a level has too many."""
        if not self.meta["points"]:
            return pd.DataFrame({"node": [], "part": []})
        at = keep(self.root())
        for level in range(self.height - 1, -1, -1):
            at = keep(self._under(level, at)) if len(at) else at
            if len(at) > MOST_FRONTIER:
                return None
        return at

    def _read(self, leaves: pd.DataFrame | None) -> DataFrame:
        """The points of these leaves: their parts' files, by a filter on node that reaches the scan."""
        if leaves is None:
            return self.points()
        nodes = sorted(int(x) for x in leaves["node"])
        return self.points([int(p) for p in leaves["part"].unique()]).filter(F.col("node").between(min(nodes, default=0), max(nodes, default=-1)) & F.col("node").isin(nodes))

    def _bounds(self, nodes: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [nodes[f"{d}_min"].to_numpy(float) for d in self.dims], [nodes[f"{d}_max"].to_numpy(float) for d in self.dims]

    def range(self, low, high) -> DataFrame:
        """The points in a closed box."""

        def keep(nodes):
            lows, highs = self._bounds(nodes)
            return nodes[reduce(np.logical_and, ((a <= float(h)) & (b >= float(lo)) for a, b, lo, h in zip(lows, highs, low, high, strict=True)))]

        inverted = any(lo > h for lo, h in zip(low, high, strict=True))
        leaves = pd.DataFrame({"node": [], "part": []}) if inverted else self._leaves(keep)
        return range_query(self._read(leaves), low, high, self.dims).drop("node")

    def knn(self, at, k: int) -> DataFrame:
        """The k nearest with dist and rank, ties by id. A level's nodes are left if they can hold one of them: no farther than the least
        farthest corner within which nodes hold k points; at that very distance, with a small enough id."""
        q = [float(v) for v in at]

        def keep(nodes):
            lows, highs = self._bounds(nodes)
            gaps = [np.maximum(np.maximum(a - v, 0.0), v - b) for a, b, v in zip(lows, highs, q, strict=True)]
            corners = [np.maximum(np.abs(a - v), np.abs(b - v)) for a, b, v in zip(lows, highs, q, strict=True)]
            near, far = (np.sqrt(reduce(np.add, (x * x for x in xs))) for xs in (gaps, corners))
            first, last = nodes["id_min"].to_numpy(), nodes["id_max"].to_numpy()
            order = np.lexsort((last, far))
            enough = np.flatnonzero(np.cumsum(nodes["points"].to_numpy()[order]) >= k)
            if not len(enough):
                return nodes
            reach = order[enough[0]]
            return nodes[(near < far[reach]) | ((near == far[reach]) & (first <= last[reach]))]

        return knn(self._read(self._leaves(keep) if k > 0 else pd.DataFrame({"node": [], "part": []})).drop("node"), at, k, self.dims, self.id)

    # --- many queries at once ---

    def _grouped(self, queries: DataFrame, qid: str, boxes: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
        """(queries with their group, groups with their box). Groups are packed like leaves; where queries are sparser than points, a
        group has fewer, and no group goes over a tile of about a leaf's size, so that it doesn't span many leaves, nor far outside all of
        them. boxes: low and high side of a query, by dimension."""
        queries = materialise(queries, "queries")
        n = queries.count()
        size = int(min(self.fanout, max(1, n * self.fanout // max(self.meta["points"], 1))))
        wide = F.lit(0)
        for low, high in boxes.values():  # boxes of unlike sizes don't share a group
            wide = F.greatest(wide, F.ceil(F.log2(F.greatest(high - low, F.lit(2.0**-60)))))
        middle = {f"_m{i}": (low + high) / 2 for i, (low, high) in enumerate(boxes.values())}
        lows = {f"g_{d}_min": low for d, (low, _) in boxes.items()} | {f"g_{d}_max": high for d, (_, high) in boxes.items()}
        held = queries.withColumns({**middle, **lows, "_w": wide})
        packed = index.leaf_of(held, tuple(middle), qid, size, "str" if len(middle) > 1 else "slab") if size > 1 else held.withColumn("node", F.col(qid))
        root = self.root()
        width = cell_width([float(root[f"{d}_max"].iloc[0] - root[f"{d}_min"].iloc[0]) for d in self.dims], max(self.meta["points"], 1), self.fanout)
        tile = [F.floor(F.col(c) / F.lit(width)) for c in middle]
        packed = materialise(packed.withColumn("group", F.concat_ws(":", "node", "_w", *tile)).drop("node", "_w", *middle), "grouped")
        groups = packed.groupBy("group").agg(*(f(f"g_{d}_{s}").alias(f"g_{d}_{s}") for d in self.dims for s, f in (("min", F.min), ("max", F.max))))
        return packed.select(*queries.columns, "group"), groups

    def _met(self, groups: DataFrame, keep) -> DataFrame:
        """group and node (a leaf) of the pairs left when each level's pairs go through keep: from the root down, a node's entries come
        to it as one row. Levels of few nodes are broadcast; below, hot nodes' pairs are dealt out by a salt."""
        top = int(self.root()["node"].iloc[0])
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = groups.withColumn("node", F.lit(top).cast("bigint")).repartition(parts, "group")  # few bytes, many pairs: not in one task
        kept = ["group", *(f"g_{s}" for s in _sides(self.dims))]
        for level in range(self.height - 1, -1, -1):
            kid = F.struct("node", "points", "id_min", "id_max", *_sides(self.dims))
            kids = self.nodes(level).groupBy("parent").agg(F.collect_list(kid).alias("_kids")).withColumnRenamed("parent", "node")  # fanout at most
            if self.meta["levels"][level] <= BROADCAST_ROWS:
                joined = pairs.join(F.broadcast(kids), "node")
            else:
                pairs = materialise(pairs.select(*kept, "node"), "pairs")
                joined = dealt_join(pairs, kids, "node", "group", hot_keys(pairs, "node"), parts)
            pairs = keep(joined.select(*kept, F.explode("_kids").alias("_kid")).select(*kept, "_kid.*"))
        return pairs.select("group", "node")

    def _compared(self, pairs: DataFrame, queries: DataFrame, drop: list[str]) -> DataFrame:
        """The points of the leaves in pairs with the queries of their groups: at most a leaf's points by a group's queries a pair. The
        points are read once, whatever the number of queries."""
        pairs = materialise(pairs, "leaf-pairs")
        asked = dealt_join(pairs, queries, "group", "node", hot_keys(pairs, "group")).drop("group")
        asked = materialise(asked, "asked")
        points, n = self.points(), asked.count()
        if n <= BROADCAST_ROWS:
            return points.join(F.broadcast(asked), "node").drop("node", *drop)
        qid = next(c for c in asked.columns if c != "node")
        return dealt_join(asked, points, "node", qid, hot_keys(asked, "node"), tasks_for(asked, n, ASKED)).drop("node", *drop)

    def range_join(self, queries: DataFrame, prefix: str = "q_", qid: str = "qid") -> DataFrame:
        """points x queries (columns qid, {prefix}{dim}_min and _max) where the point lies in the box. qid must tell queries apart."""
        sides = {d: (F.col(f"{prefix}{d}_min"), F.col(f"{prefix}{d}_max")) for d in self.dims}
        right_way = reduce(lambda a, b: a & b, (low <= high for low, high in sides.values()))
        if not self.meta["points"]:
            return self.points().drop("node").crossJoin(queries.limit(0))
        grouped, groups = self._grouped(queries.select(qid, *(c for c in queries.columns if c != qid)).filter(right_way), qid, sides)
        own, theirs = g.box("", self.dims), g.box("g_", self.dims)
        pairs = self._met(groups, lambda p: p.filter(g.overlaps(own, theirs)))
        inside = reduce(lambda a, b: a & b, (F.col(d).between(low, high) for d, (low, high) in sides.items()))
        return self._compared(pairs, grouped, []).filter(inside)

    def knn_join(self, queries: DataFrame, k: int, prefix: str = "q_", qid: str = "qid") -> DataFrame:
        """The k nearest points of each query (columns qid and {prefix}{dim}) with dist and rank. A level's pairs are left by the rule of
        knn(), for groups: distances between boxes."""
        if not self.meta["points"] or k <= 0:
            return nearest(self.points().limit(0).drop("node").crossJoin(queries.limit(0)).withColumn("dist", F.lit(0.0)), 0, qid, self.id)
        grouped, groups = self._grouped(queries.select(qid, *(c for c in queries.columns if c != qid)), qid, {d: (F.col(f"{prefix}{d}"), F.col(f"{prefix}{d}")) for d in self.dims})
        gaps = [F.greatest(F.col(f"{d}_min") - F.col(f"g_{d}_max"), F.lit(0.0), F.col(f"g_{d}_min") - F.col(f"{d}_max")) for d in self.dims]
        corners = [F.greatest(F.abs(F.col(f"{d}_min") - F.col(f"g_{d}_max")), F.abs(F.col(f"{d}_max") - F.col(f"g_{d}_min"))) for d in self.dims]
        total = lambda xs: F.sqrt(reduce(lambda a, b: a + b, (x * x for x in xs)))
        each = Window.partitionBy("group")
        upto = each.orderBy("far", "id_max").rowsBetween(Window.unboundedPreceding, 0)

        def keep(pairs):
            seen = pairs.withColumns({"near": total(gaps), "far": total(corners)}).withColumn("held", F.sum("points").over(upto))
            seen = seen.withColumn("reach", F.min(F.when(F.col("held") >= k, F.struct("far", "id_max"))).over(each))
            at_reach = (F.col("near") == F.col("reach.far")) & (F.col("id_min") <= F.col("reach.id_max"))
            return seen.filter(F.col("reach").isNull() | (F.col("near") < F.col("reach.far")) | at_reach)

        found = self._compared(self._met(groups, keep), grouped, [])
        return nearest(found.withColumn("dist", g.dist(columns(self.dims), columns(self.dims, prefix))), k, qid, self.id)

    # --- growth ---

    def insert(self, new: DataFrame, batch: int | None = None) -> Tree:
        """A version with these points as well (columns as stored, ids not yet there). Only the parts whose leaves take a point are written
        anew, and the levels above the leaves; leaves and nodes that overflow are split, parts that have grown over twice their size
        are cut. More points than REBUILD of those there are laid out anew with them. A batch that is not after the last one's number is in
        already: it changes nothing."""
        if batch is not None and batch <= self.meta["batch"]:
            return self
        with scratch(self.spark):
            return self._insert(new, batch)

    def _insert(self, new: DataFrame, batch: int | None) -> Tree:
        dims, id, store, made = self.dims, self.id, self.store, uuid.uuid4().hex
        new = materialise(new.select(*self.payload.names), "new")
        if new.count() > REBUILD * self.meta["points"]:
            every = self.points().drop("node").unionByName(new)
            return build(every, store.path, dims, id, self.fanout, self.meta["points_per_part"], self.meta["batch"] if batch is None else batch, self.version + 1)
        sides = _sides(dims)
        if self.height:
            chosen = index.descend(new, self.upper, dims, id, to_level=1)
            level1 = self.nodes(1).select("node", "part")
            chosen = materialise(chosen.join(F.broadcast(level1) if self.meta["levels"][1] <= BROADCAST_ROWS else level1, "node"), "chosen")
            touched = [r[0] for r in chosen.select("part").distinct().collect()]  # parts at most
            leaves = materialise(self.nodes(0, touched), "leaves")
            at = new.select(F.col(id).alias("id"), *dims).join(chosen.select("id", "node"), "id")
            to = index.choose_child(at, leaves, dims, leaves.count()).select(F.col("id").alias(id), "node")
        else:
            touched, leaves = list(self.made), self.nodes(0)
            to = new.select(id, F.lit(int(self.root()["node"].iloc[0])).cast("bigint").alias("node"))
        placed = materialise(self.points(touched).unionByName(new.join(to, id)), "placed")
        # leaves, their parents, and the parts that these are in
        entries, lineage = index.divided(_as_entries(placed, dims, id), self.meta["last"][0] + 1, dims, "_key", self.fanout)
        leaf = self._linked(_summed(entries, "node", dims), lineage, leaves)
        kids, lineage = index.divided(leaf.select(F.col("node").alias("_key"), F.coalesce("parent", F.lit(0).cast("bigint")).alias("node"), "points", "id_min", "id_max", *sides), (self.meta["last"][1] if self.height else 0) + 1, dims, "_key", self.fanout)
        known = self.nodes(1) if self.height else self.upper.limit(0)
        nodes = self._linked(_summed(kids, "node", dims), lineage, known, "part").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
        nodes = materialise(self._cut_parts(nodes), "nodes")
        leaf = leaf.drop("parent").join(kids.select(F.col("_key").alias("node"), F.col("node").alias("parent")), "node").join(nodes.select(F.col("node").alias("parent"), "part"), "parent")
        leaf = store.write_parts(leaf.withColumn("level", F.lit(0).cast("bigint")).select(*_node_columns(dims), "part"), "leaves", made)
        moved = placed.drop("node").join(entries.select(F.col("_key").alias(id), "node"), id).join(leaf.select("node", "part"), "node")
        store.write_parts(moved.select(*self.payload.names, "node", "part"), "points", made)
        # the levels above: all their nodes, a row for 2,500 points
        below = self.nodes(1).filter(~F.col("part").isin(touched)) if self.height else self.upper.limit(0)
        below = materialise(below.unionByName(nodes.withColumn("level", F.lit(1).cast("bigint")).select(*_node_columns(dims), "part")), "level")
        upper, level = self.upper.limit(0), 1
        while below.count():
            if below.count() == 1:
                upper = upper.unionByName(below.withColumn("parent", F.lit(None).cast("bigint")))
                break
            known = self.nodes(level + 1)
            first_new = (self.meta["last"][level + 1] if level < self.height else 0) + 1
            entries, lineage = index.divided(below.select(F.col("node").alias("_key"), F.coalesce("parent", F.lit(0).cast("bigint")).alias("node"), "points", "id_min", "id_max", *sides), first_new, dims, "_key", self.fanout)
            upper = upper.unionByName(below.drop("parent").join(entries.select(F.col("_key").alias("node"), F.col("node").alias("parent")), "node").select(*_node_columns(dims), "part"))
            above = self._linked(_summed(entries, "node", dims), lineage, known).withColumns({"level": F.lit(level + 1).cast("bigint"), "part": F.lit(None).cast("bigint")})
            below, level = materialise(above.select(*_node_columns(dims), "part"), "level"), level + 1
        meta = {k: self.meta[k] for k in ("dims", "id", "fanout", "points_per_part", "payload")} | {"batch": self.meta["batch"] if batch is None else batch}
        return _finish(store, made, meta, leaf, upper, self)

    def _linked(self, made: DataFrame, lineage: DataFrame, known: DataFrame, *more: str) -> DataFrame:
        """Nodes with the parent (and more) of the node they were, or were split from; null where there was none."""
        origin = made.join(lineage, "node", "left").withColumn("origin", F.coalesce("origin", "node"))
        return materialise(origin.join(known.select(F.col("node").alias("origin"), "parent", *more), "origin", "left").drop("origin"), "linked")

    def _cut_parts(self, nodes: DataFrame) -> DataFrame:
        """Nodes of level 1 with their part; a part of more than twice its size is cut along the first dimension."""
        most = self.meta["points_per_part"]
        of = Window.partitionBy("part")
        before = F.sum("points").over(of.orderBy(f"{self.dims[0]}_min", "node").rowsBetween(Window.unboundedPreceding, 0)) - F.col("points")
        cut = nodes.withColumn("_cut", F.when(F.sum("points").over(of) > 2 * most, F.floor(before / F.lit(most))).otherwise(0))
        fresh = numbered(cut.filter("_cut > 0").select("part", "_cut").distinct(), ["part", "_cut"], "_rn")
        named = cut.join(fresh, ["part", "_cut"], "left")
        return named.withColumn("part", F.coalesce(F.col("_rn") + self.meta["parts"], "part")).drop("_cut", "_rn")
