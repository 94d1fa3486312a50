"""The index as data: packed leaves, levels of nodes, and the choices that maintain one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from tesselix.functions import geometry as g
from tesselix.operators.joins import BROADCAST_ROWS, dealt_join, hot_keys, tasks_for
from tesselix.operators.points import DIMS, blocks, columns
from tesselix.plans.ordering import numbered
from tesselix.sources.storage import materialise

#: Entries a node holds at most and, after a split, at least; of an overflowing node, how many would be reinserted.
FANOUT = 50
LEAST = 25
REINSERTED = 15
#: A node of more than so many times its fanout (a large batch has come in) is cut at once, not split in two again and again.
MANY = 4
#: Nodes that are broadcast together, and nodes that all points meet.
BLOCK = 50_000
FEW = 1_000


def block_side(fanout: int) -> int:
    """Of a node's entries in a square block: how many side by side."""
    return max(2, int(fanout**0.5))


def leaf_of(points: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT, method: str = "slab") -> DataFrame:
    """Adds node, the leaf of each point. slab: runs of `fanout` by the first coordinate, then id. str: slabs by the
    first coordinate, each packed by the second, so that leaves are about square. blocks: these leaves, square by
    distance and numbered so that nodes of every level above (block_side squared numbers each) are about square too; some numbers stay
    unused."""
    if method == "slab":
        return numbered(points, [dims[0], id], "_rn").withColumn("node", F.expr(f"(_rn - 1) div {fanout}")).drop("_rn")
    ranked = numbered(points, [dims[0], id], "_rn")
    n, *spans = points.agg(F.count("*"), *(F.max(d) - F.min(d) for d in dims[:2])).first()
    across = (n * fanout) ** 0.5
    if method == "blocks" and n and min(spans) > 0:
        across *= (spans[1] / spans[0]) ** 0.5  # square by distance, not by rank
    per_slab = max(fanout, int(min(across, n) // fanout) * fanout)
    slabs = ranked.withColumn("_slab", F.expr(f"(_rn - 1) div {per_slab}"))
    within = Window.partitionBy("_slab").orderBy(dims[1], id)  # a slab is about the root of n * fanout rows
    row = F.floor((F.row_number().over(within) - 1) / F.lit(fanout))
    if method == "str":
        return slabs.withColumn("node", F.col("_slab") * F.lit(-(-per_slab // fanout)) + row).drop("_rn", "_slab")
    side, most = block_side(fanout), max(per_slab // fanout, n // per_slab) + 1
    node, unit = F.lit(0), 1
    while unit < most:  # the digits of slab and row in turn
        digit = lambda c: F.floor(F.col(c) / F.lit(unit)) % F.lit(side)  # noqa: E731, B023
        node, unit = node + (digit("_slab") * F.lit(side) + digit("_row")) * F.lit(unit * unit), unit * side
    return slabs.withColumn("_row", row).withColumn("node", node.cast("bigint")).drop("_rn", "_slab", "_row")


def _boxes(df: DataFrame, dims: tuple[str, ...], low: str, high: str):
    return [e for d in dims for e in (F.min(low.format(d)).alias(f"{d}_min"), F.max(high.format(d)).alias(f"{d}_max"))]


def leaves(points: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT, method: str = "slab") -> DataFrame:
    """node, entries and box of each leaf."""
    placed = leaf_of(points, dims, id, fanout, method)
    return placed.groupBy("node").agg(F.count("*").alias("entries"), *_boxes(placed, dims, "{}", "{}"))


def node_boxes(members: DataFrame, node: str = "node", dims: tuple[str, ...] = DIMS) -> DataFrame:
    """The boxes of nodes from their entries' boxes: what keeping ancestors up to date comes to."""
    return members.groupBy(node).agg(F.count("*").alias("entries"), *_boxes(members, dims, "{}_min", "{}_max"))


def levels(points: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT, method: str = "slab") -> DataFrame:
    """All nodes, leaves at level 0: level, node, parent (null for the root), entries, box. Each level is the one below
    packed in runs of `fanout`; no points give no nodes."""
    level, at = materialise(leaves(points, dims, id, fanout, method), "leaves"), 0  # one in `fanout` rows; points are sorted once
    out = None
    while True:
        n = level.count()
        if not n and out is None:
            return level.select(F.lit(0).cast("bigint").alias("level"), "node", F.lit(None).cast("bigint").alias("parent"), *level.columns[1:])
        parent = F.expr(f"node div {fanout}") if n > 1 else F.lit(None).cast("bigint")
        own = level.select(F.lit(at).cast("bigint").alias("level"), F.col("node").cast("bigint").alias("node"), parent.cast("bigint").alias("parent"), *level.columns[1:])
        out = own if out is None else out.unionByName(own)
        if n <= 1:
            return out
        level, at = node_boxes(level.withColumn("node", F.expr(f"node div {fanout}")), "node", dims), at + 1


def _growth(dims):
    own = g.box("", dims)
    return F.min(F.struct(g.enlargement(own, g.point_box(columns(dims))).alias("growth"), g.area(own).alias("area"), "entries", "node"))


def choose_subtree(points: DataFrame, nodes: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", block: int = BLOCK) -> DataFrame:
    """For each point the node that grows least to take it, then the smallest, then the one of fewest entries, then the
    first: id, node, growth. Up to FEW nodes meet all points (or blocks of nodes, if these are to be small, in broadcasts); of more, a
    point meets those that bounds leave it."""
    if nodes.limit(FEW + 1).count() > FEW and block >= BLOCK:
        return _choose_by_bounds(points, nodes, dims, id)
    boxes = nodes.select("node", "entries", *(f"{d}_{s}" for d in dims for s in ("min", "max")))
    own = points.select(F.col(id).alias("id"), *dims)
    best = [own.crossJoin(F.broadcast(b)).groupBy("id").agg(_growth(dims).alias("_c")) for b in blocks(boxes, "node", block)]
    all_ = best[0]
    for b in best[1:]:
        all_ = all_.unionByName(b)
    if len(best) > 1:
        all_ = all_.groupBy("id").agg(F.min("_c").alias("_c"))
    return all_.select("id", "_c.node", "_c.growth")


def _choose_by_bounds(points: DataFrame, nodes: DataFrame, dims: tuple[str, ...], id: str) -> DataFrame:
    """choose_subtree by groups of nodes, groups of these, and so on. What a group's nodes grow by at least is known from its box and
    its least sides; with its least area, entries and number this is a tuple that none of its nodes' is below. A point goes down by the
    least tuple to a node, then again to all groups whose tuple isn't above that node's."""
    sides = [f"{d}_{s}" for d in dims for s in ("min", "max")]
    level = nodes.select("node", "entries", *sides, g.area(g.box("", dims)).alias("area"), *((F.col(f"{d}_max") - F.col(f"{d}_min")).alias(f"{d}_w") for d in dims))
    kept = level.columns
    tables = []
    while True:
        middle = level.withColumns({f"_m_{d}": (F.col(f"{d}_min") + F.col(f"{d}_max")) / 2 for d in dims}).withColumn("_id", F.col("group") if "group" in level.columns else F.col("node"))
        packed = middle.withColumnRenamed("node", "_node") if tables else middle.withColumn("group", F.lit(None).cast("bigint")).withColumnRenamed("node", "_node")
        packed = leaf_of(packed, tuple(f"_m_{d}" for d in dims), "_id", FANOUT, "str").withColumnRenamed("node", "parent").withColumnRenamed("_node", "node")
        packed = materialise(packed.select("parent", "group", *kept), "bounds")
        tables.append(packed)
        ends = [e for d in dims for e in (F.min(f"{d}_min").alias(f"{d}_min"), F.max(f"{d}_max").alias(f"{d}_max"), F.min(f"{d}_w").alias(f"{d}_w"))]
        level = packed.groupBy(F.col("parent").alias("group")).agg(F.min("node").alias("node"), F.min("entries").alias("entries"), F.min("area").alias("area"), *ends)
        if level.count() == 1:
            break
    p = columns(dims)

    def least(c, exact: bool):
        own = [c[f"{d}_min"] for d in dims], [c[f"{d}_max"] for d in dims]
        growth = g.enlargement(own, g.point_box(p))
        if not exact:
            apart = [F.greatest(lo - q, q - h, F.lit(0.0)) for lo, h, q in zip(*own, p, strict=True)]
            wide, grown = F.lit(1.0), F.lit(1.0)
            for d, e in zip(dims, apart, strict=True):
                wide, grown = wide * c[f"{d}_w"], grown * (c[f"{d}_w"] + e)
            growth = F.greatest(grown - wide - F.lit(1e-12) * g.area(g.union(own, g.point_box(p))), F.lit(0.0))  # less what rounding may take
        return F.struct(growth.alias("growth"), c["area"].alias("area"), c["entries"].alias("entries"), c["node"].alias("node"))

    def down(at, i):  # with the group's kids as one row
        table = tables[i]
        kids = table.groupBy(F.col("parent").alias("_at")).agg(F.collect_list(F.struct("group", *kept)).alias("_kids"))  # FANOUT at most
        if table.count() <= 10 * BROADCAST_ROWS:
            return at.join(F.broadcast(kids), "_at")
        at = materialise(at, "at")
        return dealt_join(at, kids, "_at", "id", hot_keys(at, "_at"), tasks_for(at, 0, 1))

    own = points.select(F.col(id).alias("id"), *dims)
    start = own.withColumn("_at", F.lit(0).cast("bigint")).repartition(tasks_for(own, 0, 1), "id")
    at = start
    for i in reversed(range(1, len(tables))):
        at = down(at, i).select("id", *dims, F.array_min(F.transform("_kids", lambda c: F.struct(least(c, False).alias("t"), c["group"].alias("group"))))["group"].alias("_at"))
    best = materialise(down(at, 0).select("id", *dims, F.array_min(F.transform("_kids", lambda c: least(c, True))).alias("_best"), F.lit(0).cast("bigint").alias("_at")), "best")
    at = best.repartition(tasks_for(best, 0, 1), "id")
    for i in reversed(range(1, len(tables))):
        near = F.filter("_kids", lambda c: least(c, False) <= F.col("_best"))
        at = down(at, i).select("id", *dims, "_best", F.explode(F.transform(near, lambda c: c["group"])).alias("_at"))
    found = down(at, 0).select("id", F.array_min(F.transform("_kids", lambda c: least(c, True))).alias("_c"))
    return found.groupBy("id").agg(F.min("_c").alias("_c")).select("id", "_c.node", "_c.growth")


def choose_child(at: DataFrame, children: DataFrame, dims: tuple[str, ...] = DIMS, n: int | None = None, boxes: bool = False) -> DataFrame:
    """Of points (id, dims; or boxes) at a node each, the child of that node that grows least to take them (choose_subtree's rule). A node's
    children come to the points as one row, so nothing is grouped by point. Up to BROADCAST_ROWS children (n of them) are broadcast; of
    more, the points of hot nodes are dealt out by a salt."""
    taken = g.box("", dims) if boxes else g.point_box(columns(dims))
    kept = [f"{d}_{s}" for d in dims for s in ("min", "max")] if boxes else list(dims)
    kid = F.struct("node", "entries", *(f"{d}_{s}" for d in dims for s in ("min", "max")))
    kids = children.groupBy("parent").agg(F.collect_list(kid).alias("_kids")).withColumnRenamed("parent", "node")  # a node's fanout
    if n is not None and n <= BROADCAST_ROWS:
        met = at.join(F.broadcast(kids), "node")
    else:
        at = materialise(at, "at")
        met = dealt_join(at, kids, "node", "id", hot_keys(at, "node"))

    def choice(c):
        own = [c[f"{d}_min"] for d in dims], [c[f"{d}_max"] for d in dims]
        return F.struct(g.enlargement(own, taken).alias("growth"), g.area(own).alias("area"), c["entries"], c["node"].alias("node"))

    return met.select("id", *kept, F.array_min(F.transform("_kids", choice))["node"].alias("node"))


def descend(points: DataFrame, nodes: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", to_level: int = 0, boxes: bool = False) -> DataFrame:
    """The leaf of each point or box (or its node at `to_level`) by the same choice made level by level from the root: id,
    node. A point meets the children of the node it is at only."""
    kept = [f"{d}_{s}" for d in dims for s in ("min", "max")] if boxes else list(dims)
    tree = materialise(nodes, "nodes")
    sizes = dict(tree.groupBy("level").count().collect())  # a row a level
    top = max(sizes, default=0)
    root = tree.filter(F.col("level") == top).select("node")  # one row
    at = points.select(F.col(id).alias("id"), *kept).crossJoin(F.broadcast(root))
    for level in range(top - 1, to_level - 1, -1):
        at = choose_child(at, tree.filter(F.col("level") == level), dims, sizes[level], boxes)
    return at.select("id", "node")


def overflowing(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    return nodes.filter(F.col("entries") > fanout)


def split_options(entries: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", least: int = LEAST, group: str = "node") -> DataFrame:
    """Every way to cut each group's entries (boxes) in two: group, dim, side, k, margin of the two boxes together. The
    entries are ordered by the low or the high side of each dimension; k goes from `least` to n - `least`. Prefix and
    suffix boxes are windows, so all cuts of an order cost one pass."""
    out = None
    n = F.count("*").over(Window.partitionBy(group))
    for d in dims:
        for side in ("min", "max"):
            w = Window.partitionBy(group).orderBy(f"{d}_{side}", id)
            head, tail = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
            first = [F.min(f"{x}_min").over(head) for x in dims], [F.max(f"{x}_max").over(head) for x in dims]
            second = [F.min(f"{x}_min").over(tail) for x in dims], [F.max(f"{x}_max").over(tail) for x in dims]
            cut = entries.select(group, F.lit(d).alias("dim"), F.lit(side).alias("side"), F.row_number().over(w).cast("bigint").alias("k"), n.alias("_n"), (g.margin(first) + g.margin(second)).alias("margin"))
            cut = cut.filter(f"k >= {least} AND k <= _n - {least}").drop("_n")
            out = cut if out is None else out.unionByName(cut)
    return out


def choose_split(entries: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", least: int = LEAST, group: str = "node") -> DataFrame:
    """Each group's split: the order of least margin sum, in it the cut of least margin; the first ones on ties (dims as
    given, min before max, then k): group, dim, side, k, margin, margin_sum."""
    options = split_options(entries, dims, id, least, group)
    rank = F.lit(0)
    for i, (d, side) in enumerate((d, side) for d in dims for side in ("min", "max")):
        rank = F.when((F.col("dim") == d) & (F.col("side") == side), i).otherwise(rank)
    # added up by k, so that sums are the same wherever rows lie: they are compared as they are
    own = F.array_sort(F.collect_list(F.struct("k", "margin")))
    sums = options.groupBy(group, "dim", "side").agg(F.aggregate(own, F.lit(0.0), lambda s, v: s + v["margin"]).alias("margin_sum"), F.min(F.struct("margin", "k")).alias("_b"))
    best = sums.groupBy(group).agg(F.min(F.struct("margin_sum", rank.alias("rank"), "dim", "side", "_b")).alias("_c"))
    return best.select(group, "_c.dim", "_c.side", F.col("_c._b.k").alias("k"), F.col("_c._b.margin").alias("margin"), "_c.margin_sum")


def split(entries: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", least: int = LEAST, group: str = "node") -> DataFrame:
    """entries with group_no 1 or 2, by each group's chosen split."""
    chosen = choose_split(entries, dims, id, least, group).select(group, "dim", "side", "k")
    value = F.lit(None).cast("double")
    for d in dims:
        for side in ("min", "max"):
            value = F.when((F.col("dim") == d) & (F.col("side") == side), F.col(f"{d}_{side}")).otherwise(value)
    ranked = entries.join(chosen, group).withColumn("_v", value)
    rn = F.row_number().over(Window.partitionBy(group).orderBy("_v", id))
    return ranked.withColumn("group_no", F.when(rn <= F.col("k"), 1).otherwise(2).cast("bigint")).select(*entries.columns, "group_no")


def reinsert_candidates(entries: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", n: int = REINSERTED, group: str = "node") -> DataFrame:
    """The n entries of each group whose centres are farthest from the mean centre, ties by id, with their squared distance."""
    centre = g.centre(g.box("", dims))
    # added up by id, so that distances are the same wherever rows lie: they are compared as they are
    own = F.array_sort(F.collect_list(F.struct(F.col(id).alias("id"), *(c.alias(d) for c, d in zip(centre, dims, strict=True)))))
    mean = lambda d: F.aggregate("_e", F.lit(0.0), lambda s, v: s + v[d]) / F.size("_e")
    middle = entries.groupBy(group).agg(own.alias("_e")).select(group, *(mean(d).alias(f"_m_{d}") for d in dims))  # a node's entries: few
    far = entries.join(middle, group).withColumn("dist2", g.dist2(centre, columns(dims, "_m_")))
    rn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("dist2"), id))
    return far.withColumn("_rn", rn).filter(F.col("_rn") <= n).select(*entries.columns, "dist2")


def reboxed(entries: DataFrame, nodes: DataFrame, level: int, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """The nodes from `level` up with the boxes and counts that these entries of that level's nodes give them; parents stay."""
    out, top = None, nodes.agg(F.max("level")).first()[0]
    for at in range(level, top + 1):
        known = nodes.filter(F.col("level") == at).select("level", "node", "parent")
        own = known.join(node_boxes(entries, "node", dims), "node").select(*nodes.columns)
        out = own if out is None else out.unionByName(own)
        entries = own.withColumn("node", F.col("parent"))
    return out


def reinserted(entries: DataFrame, nodes: DataFrame, level: int = 0, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT, n: int | None = None) -> DataFrame:
    """Overflow by reinsertion: of each node of more than `fanout` entries (boxes with their node, which is of this level) the n farthest
    from its middle leave (three tenths of the fanout, if n is not given), the tree's boxes shrink, and all of them
    go down again from the root to this level, so some come to other nodes. nodes: levels()."""
    over = overflowing(entries.groupBy("node").agg(F.count("*").alias("entries")), fanout).select("node")
    far = materialise(reinsert_candidates(entries.join(over, "node", "left_semi"), dims, id, fanout * REINSERTED // FANOUT if n is None else n).select(*entries.columns), "leaving")
    stay = materialise(entries.join(far.select(id), id, "left_anti"), "staying")
    to = descend(far, reboxed(stay, nodes, level, dims), dims, id, level, boxes=True)
    return stay.unionByName(far.drop("node").join(to.select(F.col("id").alias(id), "node"), id).select(*entries.columns))


def _packed(entries: DataFrame, first_new: int, dims: tuple[str, ...], id: str, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The entries of nodes of more than MANY times `fanout`, cut at once into nodes of at most that: slabs by the first coordinate, runs by the
    second, about square by distance. A node's first run keeps its number, others get numbers from first_new on: the entries, and node,
    origin of each new node. Places come from an order of all entries, so no node is one task's."""
    first, second = dims[0], dims[min(1, len(dims) - 1)]
    held = entries.withColumns({f"_m_{d}": (F.col(f"{d}_min") + F.col(f"{d}_max")) / 2 for d in (first, second)})
    spans = [F.max(f"_m_{d}") - F.min(f"_m_{d}") for d in (first, second)]
    size = MANY * fanout
    most = F.floor(F.count("*") / F.lit(size))  # slabs of a run at least
    slabs = F.when(spans[1] > 0, F.round(F.sqrt(most * spans[0] / spans[1]))).otherwise(most)
    of = held.groupBy("node").agg(F.count("*").alias("_n"), F.least(F.greatest(slabs, F.lit(1)), most).cast("bigint").alias("_slabs"))
    ranked = materialise(numbered(held, ["node", f"_m_{first}", id], "_rn"), "ranked")
    of = of.join(ranked.groupBy("node").agg(F.min("_rn").alias("_s")), "node")
    slabbed = ranked.join(of, "node").withColumn("_slab", F.expr("((_rn - _s) * _slabs) div _n")).select(*held.columns, "_slab")
    ranked = materialise(numbered(slabbed, ["node", "_slab", f"_m_{second}", id], "_rn"), "ranked")
    of = ranked.groupBy("node", "_slab").agg(F.count("*").alias("_n"), F.min("_rn").alias("_s"))
    of = of.withColumn("_runs", F.expr(f"(_n + {size - 1}) div {size}"))
    runs = materialise(ranked.join(of, ["node", "_slab"]).withColumn("_run", F.expr("((_rn - _s) * _runs) div _n")).select(*entries.columns, "_slab", "_run"), "runs")
    fresh = numbered(runs.filter("_slab > 0 OR _run > 0").select("node", "_slab", "_run").distinct(), ["node", "_slab", "_run"], "_nth")
    fresh = materialise(fresh.withColumn("_new", F.col("_nth") + (first_new - 1)).drop("_nth"), "fresh")
    moved = runs.join(fresh, ["node", "_slab", "_run"], "left").withColumn("node", F.coalesce("_new", "node")).select(*entries.columns)
    return materialise(moved, "entries"), fresh.select(F.col("_new").alias("node"), F.col("node").alias("origin"))


def divided(entries: DataFrame, first_new: int, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Splits nodes of more than `fanout` entries (boxes with their node) until none is left: the entries with their nodes, and
    node, origin of each new node. First halves keep their node's number, second halves get numbers from first_new on. Nodes of more than
    MANY times `fanout` are cut into such of that many at once, so the rounds don't grow with a batch; where to cut these is chosen by split()."""
    entries, settled = materialise(entries, "entries"), None
    lineage = entries.select("node", F.col("node").alias("origin")).limit(0)
    many = materialise(overflowing(entries.groupBy("node").agg(F.count("*").alias("entries")), MANY * fanout).select("node"), "many")
    if not many.isEmpty():
        cut, lineage = _packed(entries.join(many, "node", "left_semi"), first_new, dims, id, fanout)
        entries = entries.join(many, "node", "left_anti").unionByName(cut)
        first_new += lineage.count()
    while True:
        over = materialise(overflowing(entries.groupBy("node").agg(F.count("*").alias("entries")), fanout).select("node"), "over")
        n = over.count()
        if not n:
            return (entries if settled is None else settled.unionByName(entries)), lineage
        # only what was split is looked at and written again
        fits = entries.join(over, "node", "left_anti")
        named = numbered(over, ["node"], "_nth").join(lineage, "node", "left")
        named = materialise(named.select("node", (F.col("_nth") + (first_new - 1)).alias("_new"), F.coalesce("origin", "node").alias("origin")), "named")
        halves = split(entries.join(over, "node", "left_semi"), dims, id, fanout // 2).join(named, "node")
        moved = halves.withColumn("node", F.when(F.col("group_no") == 1, F.col("node")).otherwise(F.col("_new"))).select(*entries.columns)
        settled, entries = fits if settled is None else settled.unionByName(fits), materialise(moved, "entries")
        lineage = materialise(lineage.unionByName(named.select(F.col("_new").alias("node"), "origin")), "lineage")
        first_new += n


def grow(placed: DataFrame, nodes: DataFrame, new: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT, reinsert: bool = False) -> tuple[DataFrame, DataFrame]:
    """Inserts points (id and dims, ids not yet there) into a tree that stays otherwise as it is. Each point goes down to a leaf;
    leaves that overflow are split, second halves become children of the first one's parent, parents that overflow are split in
    turn, up to a new root. reinsert: before a level below the root is split, once, the farthest entries of its overflowing nodes go down
    to that level again. placed: id, dims, node; nodes: levels(). Gives both, boxes up to date."""
    nodes = materialise(nodes, "nodes")
    if nodes.isEmpty():
        return leaf_of(new, dims, id, fanout).select(id, *dims, "node"), levels(new, dims, id, fanout)
    boxes, top = [f"{d}_{s}" for d in dims for s in ("min", "max")], nodes.agg(F.max("level")).first()[0]
    to = descend(new, nodes, dims, id).select(F.col("id").alias(id), "node")
    points = materialise(placed.select(id, *dims, "node").unionByName(new.select(id, *dims).join(to, id).select(id, *dims, "node")), "placed")
    entries, key, level, out, below = points.select(F.col(id).alias("_key"), "node", *(F.col(b[:-4]).alias(b) for b in boxes)), "_key", 0, None, None
    columns_ = ["level", "node", "parent", "entries", *boxes]
    while True:
        known = nodes.filter(F.col("level") == level).select(F.col("node").alias("origin"), "parent")
        if reinsert and level < top:
            entries = materialise(reinserted(entries, nodes, level, dims, key, fanout), "reinserted")
        entries, lineage = divided(entries, (known.agg(F.max("origin")).first()[0] or 0) + 1, dims, key, fanout)
        if below is None:
            leaf = entries.select(F.col("_key").alias(id), "node")
        else:  # the level below has its parents now
            own = below.drop("parent").join(entries.select(F.col("_key").alias("node"), F.col("node").alias("parent")), "node").select(*columns_)
            out = own if out is None else out.unionByName(own)
        made = node_boxes(entries, "node", dims).join(lineage, "node", "left").withColumn("origin", F.coalesce("origin", "node")).join(known, "origin", "left")
        made = materialise(made.withColumn("level", F.lit(level).cast("bigint")).select(*columns_), "level")
        if made.count() == 1:
            root = made.withColumn("parent", F.lit(None).cast("bigint"))
            return points.drop("node").join(leaf, id).select(id, *dims, "node"), materialise(root if out is None else out.unionByName(root), "nodes")
        # without a parent: halves of the root, whose parent is a new root
        entries = made.select(F.col("node").alias("_key"), F.coalesce("parent", F.lit(0).cast("bigint")).alias("node"), *boxes)
        below, level = made, level + 1


def insert(points: DataFrame, new: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT, method: str = "slab") -> DataFrame:
    """The levels after a large batch of new points has come in, laid out anew; grow() leaves the tree as it is instead."""
    return levels(points.unionByName(new), dims, id, fanout, method)


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def read_node(nodes: DataFrame, level: int, node: int) -> DataFrame:
    """The entries of a node: the nodes below it (none for a leaf, whose entries are points)."""
    return nodes.filter((F.col("level") == level - 1) & (F.col("parent") == node))


def leaf_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("level = 0")
