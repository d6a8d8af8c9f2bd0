"""Nearest rows, leaders and merge trees against sequential models."""

import numpy as np
import pytest

from weir.operators import metric as M
from weir.operators import trees as T
from weir.operators import vectors as N

LENGTH = {"l2": lambda d: float(np.sqrt((d * d).sum())), "l1": lambda d: float(np.abs(d).sum())}


def table(spark, rows, schema="row_id long, features array<double>"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], schema)


def cloud(seed, n, width=3):
    """Copies, near copies, a line of equal gaps and loose points."""
    r = np.random.default_rng(seed)
    x = np.vstack([np.zeros((n // 3, width)), 0.01 * r.normal(size=(n // 4, width)), np.arange(n // 8)[:, None] * np.ones(width), r.normal(size=(n, width))])
    return list(enumerate(x[r.permutation(len(x))].tolist()))


@pytest.mark.parametrize("metric", ["l2", "l1"])
@pytest.mark.parametrize("others", [False, True])
def test_partitioned_books_answer_as_sent_ones_do(spark, metric, others):
    book, asked = cloud(1, 160), cloud(1 if others else 2, 160) + [(999, None)]
    b, q = table(spark, book, "id long, vec array<double>"), table(spark, asked, "row long, vec array<double>")
    want = sorted(map(tuple, M.nearest(q, b, metric, others).collect()))
    for block_rows, pivots in ((16, 4), (1000, 1)):
        got = M.nearest(q, b, metric, others, max_values=0, pivots=pivots, block_rows=block_rows).collect()
        assert sorted(map(tuple, got)) == want
    for row, dist, found in want:
        far = {i: LENGTH[metric](np.array(v) - np.array(dict(asked)[row])) for i, v in book if not (others and i == row)}
        assert dist == pytest.approx(min(far.values()), abs=1e-12) and far[found] == pytest.approx(dist, abs=1e-12)
        assert others or found == min(i for i, d in far.items() if d == min(far.values()))


def test_few_blocks_are_read_where_the_book_is_grouped(spark):
    r = np.random.default_rng(5)
    centres = 1000 * r.normal(size=(40, 4))
    x = list(enumerate((centres[np.arange(4000) % 40] + r.normal(size=(4000, 4))).tolist()))
    rows = table(spark, x, "row long, vec array<double>")
    book = rows.withColumnRenamed("row", "id")
    asked = M._partitioned_nearest(rows, book, 4000, 4, "l2", True, 32, 64)
    assert asked.count() < 4000 * 12  # answers, one for each block that is asked; there are over 62


@pytest.mark.parametrize("metric", ["l2", "l1"])
@pytest.mark.parametrize("others", [False, True])
def test_a_book_goes_by_pieces_where_requests_would_outgrow_it(spark, capsys, metric, others):
    book, asked = cloud(1, 160, 12), cloud(1 if others else 2, 160, 12) + [(999, None)]
    b, q = table(spark, book, "id long, vec array<double>"), table(spark, asked, "row long, vec array<double>")
    want = {r.row: (r.dist, r.id) for r in M.nearest(q, b, metric, others).collect()}
    for pieces in (200, 10 ** 6):
        found = M._partitioned_nearest(q, b, len(book), 12, metric, others, 4, 4, request_bytes=0, piece_values=pieces)
        found.explain()
        assert "Join" not in capsys.readouterr().out
        got = {}
        for r in found.collect():
            got[r.row] = min(got.get(r.row, r.found), r.found)
        assert {row: (r.dist, r.id) for row, r in got.items()} == want


def test_products_leave_what_the_differences_find():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(300, 12)), np.repeat(r.normal(size=(4, 12)), 20, 0), 1e6 + 1e-3 * r.normal(size=(100, 12)), np.zeros((40, 12)),
                        1e-22 * r.normal(size=(40, 12)), r.integers(0, 2, (200, 12))])
    ids = r.permutation(len(x))
    for own, matrix in ((x, x), (x, 1e25 * x), (1e-3 * x, x[:50])):
        for others in (True, False):
            names = ids[:len(matrix)]
            want = M.least(M.gaps(own, matrix, "l2"), ids, names, others)
            place, *got = M.least_of(own, ids, names, matrix, "l2", others)
            assert (place == np.arange(len(own))).all() and all((a == b).all() for a, b in zip(got, want))
            near, *_ = M.least_of(own, ids, names, matrix, "l2", others, want[0])
            assert (near == place).all() and len(M.least_of(own, ids, names, matrix, "l2", others, np.full(len(own), -np.inf))[0]) in (0, len(own))


@pytest.mark.parametrize("metric", ["l2", "l1"])
@pytest.mark.parametrize("others", [False, True])
def test_regions_find_what_a_sent_book_finds(spark, monkeypatch, metric, others):
    r = np.random.default_rng(8)
    lines = np.stack((r.normal(size=500).round(2), r.integers(0, 4, 500)), 1)
    book = list(enumerate(np.concatenate([lines, np.repeat(lines[:3], 30, 0), [[1e6, 0], [-1e6, 3]]]).tolist()))
    asked = book if others else list(enumerate((lines + 0.3).tolist())) + [(999, None)]
    b, q = table(spark, book, "id long, vec array<double>"), table(spark, asked, "row long, vec array<double>")
    want = sorted(map(tuple, M.nearest(q, b, metric, others).collect()))
    called = []
    monkeypatch.setattr(M, "REGION_ROWS", 40)
    monkeypatch.setattr(M, "_regional_nearest", lambda *a, f=M._regional_nearest: called.append(a) or f(*a))
    assert sorted(map(tuple, M.nearest(q, b, metric, others).collect())) == want and called


def test_regions_have_cuts_between_values():
    x = np.stack((np.repeat(np.arange(25.0), 40), np.random.default_rng(1).normal(size=1000)), 1)
    axis, cut, low, high = M._regions(x, 5)
    at = M._region_of(x, axis, cut)
    assert ((low[at] < x) & (x < high[at])).all() and np.bincount(at, minlength=32).max() < 100
    same = np.ones((10, 2))
    assert len(set(M._region_of(same, *M._regions(same, 3)[:2]).tolist())) == 1


def test_nearest_centroid_with_any_book(spark):
    book = table(spark, [(7, (0, 0)), (3, (0, 0)), (5, (9, 1))], "cid long, vec array<double>")
    rows = table(spark, [(1, (1, 1)), (2, None), (3, (8, 0)), (3, (8, 0))])
    for metric, near, far in (("l2", 2 ** 0.5, 2 ** 0.5), ("l1", 2.0, 2.0)):
        for size in (M.MAX_VALUES, 0):
            got = sorted(map(tuple, N.nearest_centroid(rows, book, metric=metric, max_values=size).drop("features").collect()))
            assert got == [(1, 3, pytest.approx(near)), (2, None, None), (3, 5, pytest.approx(far)), (3, 5, pytest.approx(far))]
    with pytest.raises(ValueError, match="empty"):
        N.nearest_centroid(rows, book.limit(0))
    with pytest.raises(Exception, match="2 values"):
        N.nearest_centroid(table(spark, [(1, (1, 2, 3))]), book, max_values=0).collect()


@pytest.mark.parametrize("metric,radius,batch", [("l2", 0.5, 40), ("l1", 1.0, 4096), ("l2", 0.0, 5)])
def test_leaders_are_those_of_one_pass(spark, metric, radius, batch):
    rows = cloud(3, 60)
    order = {i: (i * 7919) % 31 for i, _ in rows}  # many equal places, which go by id
    df = spark.createDataFrame([(i, order[i], v) for i, v in rows] + [(900, 1, None)], "row_id long, at int, features array<double>")
    leaders, want = [], {900: (None, None)}
    for i, v in sorted(rows, key=lambda r: (order[r[0]], r[0])):
        near = [(j, d) for j, w in leaders if (d := LENGTH[metric](np.array(v) - np.array(w))) < radius]
        if not near:
            leaders.append((i, v))
        want[i] = near[0] if near else (i, 0.0)
    got = M.leader_cluster(df, radius, "at", metric=metric, batch=batch).collect()
    assert len(got) == len(want)
    for r in got:
        leader, dist = want[r.row_id]
        assert r.leader == leader and (r.dist is None if dist is None else r.dist == pytest.approx(dist, abs=1e-12))
    assert M.leader_cluster(df.limit(0), 1.0, "at").collect() == []


# ---- trees -----------------------------------------------------------------------------------------

class Node:
    """A merge read from its table, with the recursions written out."""

    def __init__(self, name, left=None, right=None, distance=0.0):
        self.name, self.left, self.right, self.distance = name, left, right, distance

    def leaves(self):
        return [self.name] if self.left is None else self.left.leaves() + self.right.leaves()

    def depth(self):
        return 0.0 if self.left is None else max(self.left.depth(), self.right.depth()) + self.distance

    def clusters(self, cut):
        return [self] if self.left is None or self.distance < cut else self.left.clusters(cut) + self.right.clusters(cut)

    def every(self):
        return [self] if self.left is None else [self] + self.left.every() + self.right.every()


def rebuilt(tree):
    nodes = {r.node: Node(r.node) for r in tree.leaves.collect()}
    for r in tree.merges.orderBy("node").collect():
        nodes[r.node] = Node(r.node, nodes[r.left], nodes[r.right], r.distance)
    return nodes


def vectors_of(tree, rows):
    at = {r.node: np.array(dict(rows)[r.id]) for r in tree.leaves.collect()}
    for r in tree.merges.orderBy("node").collect():
        at[r.node] = (at[r.left] + at[r.right]) / 2
    return at


def test_every_merge_was_mutually_nearest(spark, metric="l1"):
    rows = cloud(4, 10)
    tree = T.merge_tree(table(spark, rows + [(500, None)]), metric=metric, top=0)
    at, merges = vectors_of(tree, rows), tree.merges.collect()
    assert len(merges) == len(rows) - 1 and {i for r in merges for i in (r.left, r.right)} == set(at) - {max(at)}
    alive = {r.node for r in tree.leaves.collect()}
    for k in range(max(r["round"] for r in merges) + 1):
        own = [r for r in merges if r["round"] == k]
        for r in own:
            far = {(i, j): LENGTH[metric](at[i] - at[j]) for i in (r.left, r.right) for j in alive if i != j}
            assert r.distance == pytest.approx(min(far.values()), abs=1e-12) == pytest.approx(far[r.left, r.right], abs=1e-12)
        alive = alive - {i for r in own for i in (r.left, r.right)} | {r.node for r in own}
    assert len(alive) == 1
    sizes = {n.name: len(n.leaves()) for n in rebuilt(tree).values()}
    assert all(r["size"] == sizes[r.node] for r in merges)


def test_the_last_rounds_on_the_driver_give_the_same_tree(spark):
    rows = cloud(6, 9)
    a, b = (T.merge_tree(table(spark, rows), top=top) for top in (0, 1000))
    assert sorted(map(tuple, a.merges.collect())) == sorted(map(tuple, b.merges.collect()))


def test_few_copies_are_paired_on_the_driver_as_the_rounds_pair_them(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.concatenate([np.repeat(r.normal(size=(9, 2)), r.integers(2, 6, 9), 0), r.normal(size=(90, 2)), np.repeat(r.normal(size=(1, 2)), 13, 0)])
    rows = list(enumerate(x[r.permutation(len(x))].tolist()))
    plain, called = T._copy_rounds, []
    monkeypatch.setattr(T, "_copy_rounds", lambda *a: called.append(a) or plain(*a))
    a, b, c = (sorted(map(tuple, T.merge_tree(table(spark, rows), top=top).merges.collect())) for top in (20, 60, 1000))
    assert a == b == c and called


def test_cuts_members_heights_and_depths(spark):
    rows = cloud(7, 24)
    tree = T.merge_tree(table(spark, rows))
    nodes, name = rebuilt(tree), {r.node: r.id for r in tree.leaves.collect()}
    root = nodes[max(nodes)]
    for cut in (0.02, 0.7):
        want = {(name[leaf], c.name) for c in root.clusters(cut) for leaf in c.leaves()}
        assert set(map(tuple, T.cut_tree(tree, cut).collect())) == want
    for node in (root.left.name, 0):
        assert sorted(r.id for r in T.tree_members(tree, node).collect()) == sorted(name[i] for i in nodes[node].leaves())
    assert T.tree_members(tree, 10 ** 6).collect() == []
    got = {r.node: (r.height, r.depth) for r in T.tree_measures(tree).collect()}
    assert got == {n.name: (len(n.leaves()), pytest.approx(n.depth())) for n in root.every()}


def test_a_chain_is_doubled(spark):
    """A tree as deep as it has merges: pointers, not levels, set the rounds."""
    n = 34
    leaves = spark.createDataFrame([(i, 100 + i, [0.0]) for i in range(n)], "node long, id long, vec array<double>")
    merges = [(n + i, n + i - 1 if i else 0, i + 1, float(i % 5), i + 2, 0, [0.0], i) for i in range(n - 1)]
    tree = T.MergeTree(leaves, spark.createDataFrame(merges, T._MERGES))
    nodes = rebuilt(tree)
    got = {r.node: (r.height, r.depth) for r in T.tree_measures(tree).collect()}
    assert got == {i: (len(x.leaves()), pytest.approx(x.depth())) for i, x in nodes.items()}
    assert {(r.id - 100, r.node) for r in T.cut_tree(tree, 3.5).collect()} == {
        (leaf, c.name) for c in nodes[max(nodes)].clusters(3.5) for leaf in c.leaves()}


def test_small_trees(spark):
    assert T.merge_tree(table(spark, [])).leaves.count() == 0
    one = T.merge_tree(table(spark, [(5, (1, 2))]))
    assert one.merges.count() == 0 and T.cut_tree(one, 1.0).collect() == [(5, 0)] and T.tree_measures(one).collect() == [(0, 1, 0.0)]
    copies = T.merge_tree(table(spark, [(i, (1, 2)) for i in range(13)]), top=0)
    assert copies.merges.count() == 12 and copies.merges.agg({"distance": "max", "round": "max"}).first()[0:2] in [(0.0, k) for k in range(3, 11)]


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("others", [True, False])
def test_groups_find_what_a_comparison_with_all_finds(metric, others):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(3000, 2)), r.integers(0, 12, (3000, 2)) / 4, np.repeat(r.normal(size=(3, 2)), 200, 0)])
    ids = r.permutation(len(x))
    order, cuts = M.boxes(x)
    compared, plain = [], M.gaps

    def counted(a, b, metric):
        compared.append(len(a) * len(b))
        return plain(a, b, metric)

    M.gaps = counted
    try:
        found = [np.concatenate(c) for c in zip(*M.least_boxed(x, ids, ids[order], x[order], cuts, *M.corners(x[order], cuts), metric, others))]
    finally:
        M.gaps = plain
    at = np.argsort(found[0])
    back = np.argsort(ids)
    for a, b in zip(found[1:], M.least(plain(x, x, metric), ids, ids, others)):
        assert (a[at] == b[back]).all()
    assert sum(compared) < len(x) ** 2 / 4


def test_requests_and_blocks_do_not_pass_through_the_driver(spark, capsys):
    from pyspark.sql import functions as F

    rows = spark.range(300).select(F.col("id").alias("row"), F.array(*[F.rand(i) for i in range(4)]).alias("vec"))
    M._partitioned_nearest(rows, rows.withColumnRenamed("row", "id"), 300, 4, "l2", True, 4, 64).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
