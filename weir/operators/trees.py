"""Merge trees of vectors and what is read from them, in rounds over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.metric import BOXED, MAX_VALUES, boxes, corners, gaps, least, least_boxed, nearest, vectors_of, written
from weir.plans.ordering import with_position

_NODES = ("node", "vec", "size", "first")
# Nodes of narrow vectors that are merged on the driver at the end: some MB.
TOP = 1 << 17
_MERGES = "node long, left long, right long, distance double, size long, first long, vec array<double>, round int"


@dataclass(frozen=True)
class MergeTree:
    """`leaves` (node, id, vec) and `merges` (node, left, right, distance, size, first, vec, round).

    A merge joins two nodes that were nearest to each other into one at their midpoint; `size` counts its leaves and `first` is
    its least leaf. Leaves are numbered from 0 in the order of their ids, merges after them in the order of their rounds.
    """

    leaves: DataFrame
    merges: DataFrame


def _copies(nodes: DataFrame, shift: int) -> DataFrame:
    """Pairs of nodes at the same place: neighbours in the order of their vectors, so that a group of copies halves.

    Pairs begin at every second place; `shift` is 0 and 1 in turn, so that a pair across two of them is not left alone.
    """
    placed = with_position(nodes, "vec", "node", name="at").withColumn("pair", F.expr(f"(at + {shift}) div 2"))
    two = placed.groupBy("pair").agg(F.min_by(F.struct(*_NODES), "at").alias("a"), F.max_by(F.struct(*_NODES), "at").alias("b"))
    return two.where("a.node <> b.node AND a.vec = b.vec").select("a", "b", F.lit(0.0).alias("distance"))


def _mutual(nodes: DataFrame, metric: str, max_values: int) -> DataFrame:
    """Pairs of nodes that are nearest to each other."""
    near = written(nearest(nodes.select(F.col("node").alias("row"), "vec"), nodes.select(F.col("node").alias("id"), "vec"), metric, True, max_values),
                   "near")
    back = near.select(F.col("id").alias("row"), F.col("row").alias("id"))
    pairs = near.join(back, ["row", "id"]).where("row < id")
    a, b = (nodes.select(F.col("node").alias(key), F.struct(*_NODES).alias(name)) for key, name in (("row", "a"), ("id", "b")))
    return pairs.join(a, "row").join(b, "id").select("a", "b", F.col("dist").alias("distance"))


def _nearest_here(vec: np.ndarray, ids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(distance, id) of the nearest other node to each node."""
    if not 0 < vec.shape[1] <= BOXED or not np.isfinite(vec).all():
        dist, _, near = least(gaps(vec, vec, metric), ids, ids, True)
        return dist, near
    order, cuts = boxes(vec)
    found = [np.concatenate(c) for c in zip(*least_boxed(vec, ids, ids[order], vec[order], cuts, *corners(vec[order], cuts), metric, True))]
    at = np.argsort(found[0])
    return found[1][at], found[3][at]


def _merged(node: np.ndarray, left: np.ndarray, right: np.ndarray, dist: np.ndarray, size: np.ndarray, first: np.ndarray, vec: np.ndarray,
            rounds: int) -> pa.Table:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, vec.size + 1, vec.shape[1]) if vec.size else np.zeros(len(vec) + 1), pa.int32()),
                                    pa.array(vec.reshape(-1)))
    return pa.table([node, left, right, dist, size, first, flat, np.full(len(node), rounds, np.int32)], names=[c.split()[0] for c in _MERGES.split(", ")])


def _copy_rounds(nodes: pa.Table, total: int, rounds: int) -> tuple[list[pa.Table], int]:
    """The rounds that pair a bounded number of copies, from their places `at` among all nodes, and the number of the next round."""
    nodes = nodes.sort_by("at").combine_chunks()
    ids, at, size, first = (nodes[c].to_numpy() for c in ("node", "at", "size", "first"))
    vec, _ = vectors_of(nodes["vec"].combine_chunks(), len(nodes["vec"][0]))
    equal = ((vec[1:] == vec[:-1]) | (np.isnan(vec[1:]) & np.isnan(vec[:-1]))).all(1)
    group, out = np.concatenate(([0], np.cumsum(~equal))), []
    start, merged = at[np.unique(group, return_index=True)[1]], np.zeros(group[-1] + 1, np.int64)
    while (group[1:] == group[:-1]).any():
        a = np.flatnonzero((group[1:] == group[:-1]) & ((at[:-1] + rounds % 2) // 2 == (at[1:] + rounds % 2) // 2))
        a = a[np.argsort(ids[a])]
        b, new = a + 1, total + np.arange(len(a))
        if len(a):
            out.append(_merged(new, ids[a], ids[b], np.zeros(len(a)), size[a] + size[b], np.minimum(first[a], first[b]), (vec[a] + vec[b]) / 2, rounds))
        left = np.ones(len(ids), bool)
        left[a] = left[b] = False
        merged += np.bincount(group[a], minlength=len(merged))
        every = np.concatenate((group[left], group[a]))
        order = np.lexsort((np.concatenate((ids[left], new)), every))
        ids, size, first, vec = (np.concatenate((x[left], y))[order] for x, y in (
            (ids, new), (size, size[a] + size[b]), (first, np.minimum(first[a], first[b])), (vec, (vec[a] + vec[b]) / 2)))
        group = every[order]
        begin = np.searchsorted(group, np.arange(len(merged)))
        at = (start - np.cumsum(merged) + merged)[group] + np.arange(len(group)) - begin[group]
        total, rounds = total + len(a), rounds + 1
    return out, rounds


def _topmost_rounds(nodes: pa.Table, total: int, rounds: int, metric: str) -> pa.Table:
    """The last rounds, over the bounded number of nodes at the top of a tree."""
    nodes = nodes.sort_by("node").combine_chunks()
    ids, size, first = (nodes[c].to_numpy() for c in ("node", "size", "first"))
    vec, _ = vectors_of(nodes["vec"].combine_chunks(), len(nodes["vec"][0]) if len(ids) else 0) if len(ids) else (np.zeros((0, 0)), None)
    out = []
    while len(ids) > 1:
        order = np.lexsort((ids, *vec.T[::-1]))
        same = (vec[order[1:]] == vec[order[:-1]]).all(1)
        if same.any():
            at = np.arange(rounds % 2, len(same), 2)
            at = at[same[at]]
            a, b = np.minimum(order[at], order[at + 1]), np.maximum(order[at], order[at + 1])  # places rise with the numbers
            dist = np.zeros(len(a))
        else:
            dist, near = _nearest_here(vec, ids, metric)
            near = np.searchsorted(ids, near)
            a = np.flatnonzero((near[near] == np.arange(len(ids))) & (np.arange(len(ids)) < near))
            b, dist = near[a], dist[a]
        order = np.lexsort((ids[b], ids[a], dist))
        a, b, dist = a[order], b[order], dist[order]
        new = total + np.arange(len(a)), (vec[a] + vec[b]) / 2, size[a] + size[b], np.minimum(first[a], first[b])
        if len(a):
            out.append(_merged(new[0], ids[a], ids[b], dist, new[2], new[3], new[1], rounds))
        left = np.ones(len(ids), bool)
        left[a] = left[b] = False
        ids, vec, size, first = (np.concatenate((x[left], y)) for x, y in zip((ids, vec, size, first), new))
        total, rounds = total + len(a), rounds + 1
    return pa.concat_tables(out) if out else None


def merge_tree(df: DataFrame, id_col: str = "row_id", vec: str = "features", metric: str = "l2", max_values: int = MAX_VALUES,
               top: int | None = None) -> MergeTree:
    """A binary tree over all rows with a vector, by rounds that merge every pair of nodes that are nearest to each other.

    Distances are `l2` or `l1`, and a merged node stands at the midpoint of its two, whatever their sizes. Equal distances are
    ordered by a number of the pair, so that both sides choose alike; copies are paired along their order first, so that a
    group of any size is halved by each round and no pairs of it are made. Rounds grow with the logarithm of the rows where
    vectors have a few values; midpoints of many values come to lie near everything, and then a round may merge one pair. The
    last `top` nodes are merged on the driver, in the same rounds: 256 of wide vectors, TOP of those that are searched by groups. So are
    the copies, if they are no more than that. Null vectors are left out; one row is a tree without merges;
    an empty table has no leaves. Every round is written, so that a lost executor costs its own tasks.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    leaves = written(with_position(rows, "id", "vec", name="node"), "tree-leaves")
    nodes = leaves.select("node", "vec", F.lit(1).cast("long").alias("size"), F.col("node").alias("first"))
    total, count, rounds, merges = (n := leaves.count()), n, 0, []
    if top is None:
        widest = leaves.agg(F.max(F.size("vec"))).first()[0]
        top = TOP if widest is not None and 0 < widest <= BOXED else 256
    while count > max(1, top):
        copied = nodes.groupBy("vec").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = copied.agg(F.sum("n")).first()[0] or 0
        if 0 < copies <= top:
            # pairs across two places wait for another round, and few copies for many rounds, which no table needs to be read for
            placed = with_position(nodes, "vec", "node", name="at").join(copied.select("vec"), "vec", "left_semi")
            made, rounds = _copy_rounds(placed.select(*_NODES, "at").toArrow(), total, rounds)
            made = written(df.sparkSession.createDataFrame(pa.concat_tables(made), _MERGES), "merges")
            gone = made.select(F.explode(F.array("left", "right")).alias("node"))
            nodes = written(nodes.unionByName(made.select(*_NODES)).join(gone, "node", "left_anti"), "nodes")
            merges.append(made)
            merged = made.count()
            total, count = total + merged, count - merged
            continue
        pairs = _copies(nodes, rounds % 2) if copies else _mutual(nodes, metric, max_values)
        pairs = pairs.select(
            F.least("a.node", "b.node").alias("left"), F.greatest("a.node", "b.node").alias("right"), "distance",
            (F.col("a.size") + F.col("b.size")).alias("size"), F.least("a.first", "b.first").alias("first"),
            F.zip_with("a.vec", "b.vec", lambda x, y: (x + y) / 2).alias("vec"))
        made = written(with_position(pairs, "distance", "left", name="at").withColumn("node", F.col("at") + total).drop("at"), "merges")
        gone = made.select(F.explode(F.array("left", "right")).alias("node"))
        nodes = written(nodes.join(gone, "node", "left_anti").unionByName(made.select(*_NODES)), "nodes")
        merges.append(made.select("node", "left", "right", "distance", "size", "first", "vec", F.lit(rounds).alias("round")))
        merged = made.count()
        total, count, rounds = total + merged, count - merged, rounds + 1
    made = _topmost_rounds(nodes.select(*_NODES).toArrow(), total, rounds, metric)
    out = df.sparkSession.createDataFrame(made if made is not None else [], _MERGES)
    out = written(out, "merges") if made is not None else out
    for part in merges:
        out = out.unionByName(part)
    return MergeTree(leaves.select("node", "id", "vec"), out)


def _parents(tree: MergeTree) -> DataFrame:
    """(node, parent, distance): every node with the node it was merged into, null at the root, and its own merge distance."""
    ups = tree.merges.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    every = tree.leaves.select("node", F.lit(0.0).alias("distance"), F.lit(True).alias("leaf")).unionByName(
        tree.merges.select("node", "distance", F.lit(False).alias("leaf")))
    return every.join(ups, "node", "left")


def _doubled(rows: DataFrame, step, name: str) -> DataFrame:
    """Applies `step` to rows with pointers `jump` until none is left; pointers reach twice as far each time."""
    rows = written(rows, name)
    while rows.where("jump IS NOT NULL").limit(1).count():
        rows = written(step(rows), name)
    return rows


def _jumped(rows: DataFrame, above: DataFrame) -> DataFrame:
    """Rows with what lies at their pointers; those without one, most of them in the end, stay out of the join, where they
    would all meet in one task."""
    return rows.where("jump IS NOT NULL").join(above, "jump", "left").unionByName(rows.where("jump IS NULL"), allowMissingColumns=True)


def _topmost(tree: MergeTree, qualifies) -> DataFrame:
    """(id, node): each leaf's topmost node, itself among them, that `qualifies`; a pointer passes on what lies above it."""
    start = _parents(tree).select("node", "leaf", F.col("parent").alias("jump"), F.when(qualifies, F.col("node")).alias("top"))

    def step(rows):
        above = rows.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("top").alias("above"))
        return _jumped(rows, above).select("node", "leaf", F.col("next").alias("jump"), F.coalesce("above", "top").alias("top"))

    found = _doubled(start, step, "topmost").where("leaf AND top IS NOT NULL")
    return tree.leaves.drop("vec").join(found.select("node", "top"), "node").select("id", F.col("top").alias("node"))


def cut_tree(tree: MergeTree, distance: float) -> DataFrame:
    """(id, node): the cluster of every leaf when the tree is opened from the root down to nodes merged closer than `distance`.

    A node inside a cluster may have been merged at a larger distance; a leaf in none is a cluster of its own.
    """
    return _topmost(tree, F.col("leaf") | (F.col("distance") < distance))


def tree_members(tree: MergeTree, node: int) -> DataFrame:
    """(id): the leaves under a node; a leaf is its own member, an unknown node has none."""
    return _topmost(tree, F.col("node") == node).select("id")


def tree_measures(tree: MergeTree) -> DataFrame:
    """(node, height, depth) of every node: its leaves, and the largest sum of distances on a way from it down to a leaf.

    After i rounds a node knows what lies less than 2^i below it, and hands that to the node 2^i above.
    """
    start = _parents(tree).join(tree.merges.select(F.col("node").alias("parent"), F.col("distance").alias("up")), "parent", "left").select(
        "node", F.col("parent").alias("jump"), F.col("up").alias("way"), F.col("leaf").cast("long").alias("height"),
        F.when(F.col("leaf"), 0.0).alias("depth"))

    def step(rows):
        handed = rows.where("jump IS NOT NULL").groupBy(F.col("jump").alias("node")).agg(
            F.sum("height").alias("more"), F.max(F.col("depth") + F.col("way")).alias("below"))
        above = rows.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("way").alias("next_way"))
        return _jumped(rows, above).join(handed, "node", "left").select(
            "node", F.col("next").alias("jump"), (F.col("way") + F.col("next_way")).alias("way"),
            (F.col("height") + F.coalesce("more", F.lit(0))).alias("height"), F.greatest("depth", "below").alias("depth"))

    return _doubled(start, step, "measures").select("node", "height", "depth")
