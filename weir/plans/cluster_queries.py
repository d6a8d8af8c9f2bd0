"""Leader clusters, merge trees and large codebooks over the given tables.

The twins run the same definitions as recursions over the raw rows: leaders one after the other, merges round by round.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import metric as M
from weir.operators import profiles as P
from weir.operators import trees as T
from weir.operators import vectors as N
from weir.plans.bindings import CENTROIDS_SQL, centroids, samples, samples_sql, table
from weir.plans.catalog import query
from weir.plans.sample_queries import r6

# Leaders over the vectors, whose nearest neighbours lie at about 1.1 to 1.3.
LEADER_RADIUS = 1.35

LEADER_SQL = f"""WITH RECURSIVE {samples_sql()},
left_over(step, row_id, v) AS (SELECT 0, row_id, features FROM samples UNION ALL
  SELECT step + 1, row_id, v FROM (SELECT step, row_id, v, first_value(v) OVER (ORDER BY row_id) AS lead FROM left_over)
  WHERE list_distance(v, lead) >= {LEADER_RADIUS}),
leaders AS (SELECT step, arg_min(row_id, row_id) AS leader, arg_min(v, row_id) AS lead FROM left_over GROUP BY step),
taken AS (SELECT row_id, max(step) AS step, any_value(v) AS v FROM left_over GROUP BY row_id)
SELECT row_id, leader, round(list_distance(v, lead), 6) AS dist FROM taken JOIN leaders USING (step)"""


@query("leader_cluster", LEADER_SQL)
def _leaders(spark, sf_dir):
    found = M.leader_cluster(samples(spark, sf_dir), LEADER_RADIUS, "row_id")
    return found.select("row_id", "leader", r6("dist").alias("dist"))


# Customers by account balance and nation: vectors of two values, in which midpoints stay apart.

def accounts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal") / 370, F.col("c_nationkey").cast("double")).alias("features"))


TREE_SQL = """accounts AS (SELECT c_custkey AS row_id, [c_acctbal / 370, CAST(c_nationkey AS DOUBLE)] AS features FROM customer),
tree(round, first, size, vec, l, r, lsize, rsize, d) AS (
  SELECT 0, row_id, CAST(1 AS BIGINT), features, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
    CAST(NULL AS DOUBLE) FROM accounts
  UNION ALL (WITH cur AS (SELECT * FROM tree),
    gaps AS (SELECT a.first AS a, b.first AS b, {dist} AS d FROM cur a JOIN cur b ON a.first <> b.first),
    near AS (SELECT a, arg_min(b, d) AS b, min(d) AS d FROM gaps GROUP BY a),
    pairs AS (SELECT x.a, x.b, x.d FROM near x JOIN near y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)
    SELECT a.round + 1, a.first, a.size + b.size, [(z[1] + z[2]) / 2 FOR z IN list_zip(a.vec, b.vec)], a.first, b.first, a.size, b.size, p.d
    FROM pairs p JOIN cur a ON a.first = p.a JOIN cur b ON b.first = p.b
    UNION ALL SELECT round + 1, first, size, vec, NULL, NULL, NULL, NULL, NULL FROM cur
    WHERE first NOT IN (SELECT unnest([a, b]) FROM pairs) AND (SELECT count(*) FROM cur) > 1)),
merges AS (SELECT first, size, l, r, lsize, rsize, d FROM tree WHERE l IS NOT NULL)"""
L2_TREE_SQL = TREE_SQL.format(dist="list_distance(a.vec, b.vec)")
L1_TREE_SQL = TREE_SQL.format(dist="list_sum([abs(z[1] - z[2]) FOR z IN list_zip(a.vec, b.vec)])")
# From every node down to the nodes and leaves it is made of; `way` sums the distances passed on.
DOWN_SQL = """parts AS (SELECT first, size, d, l AS part, lsize AS part_size FROM merges UNION ALL SELECT first, size, d, r, rsize FROM merges),
down(first, size, part, part_size, way) AS (SELECT first, size, part, part_size, d FROM parts UNION ALL
  SELECT down.first, down.size, parts.part, parts.part_size, down.way + parts.d FROM down JOIN parts ON down.part = parts.first AND down.part_size = parts.size)"""


def named(tree):
    """Merges and leaves under names that do not hang on numbers: the least leaf and the number of leaves."""
    leaf = tree.leaves.select("node", F.col("id").alias("first"), F.lit(1).cast("long").alias("size"))
    merge = tree.merges.select("node", F.col("first").alias("_f"), "size").join(
        tree.leaves.select(F.col("node").alias("_f"), F.col("id").alias("first")), "_f").select("node", "first", "size")
    return leaf.unionByName(merge)


def merge_rows(tree):
    names = named(tree)
    rows = tree.merges.select("node", "left", "right", "distance", "size", "first")
    for side in ("left", "right"):
        rows = rows.join(names.select(F.col("node").alias(side), F.struct("first", "size").alias(f"{side}_name")), side)
    rows = rows.join(names.select("node", F.col("first").alias("id")), "node")
    a, b = F.least("left_name", "right_name"), F.greatest("left_name", "right_name")
    return rows.select(F.col("id").alias("first"), "size", a["first"].alias("l"), b["first"].alias("r"), a["size"].alias("lsize"),
                       b["size"].alias("rsize"), r6("distance").alias("distance"))


MERGES_SQL = "SELECT first, size, l, r, lsize, rsize, round(d, 6) AS distance FROM merges"


@query("merge_tree", f"WITH RECURSIVE {L2_TREE_SQL} {MERGES_SQL}")
def _tree(spark, sf_dir):
    return merge_rows(T.merge_tree(accounts(spark, sf_dir)))


@query("merge_tree_l1", f"WITH RECURSIVE {L1_TREE_SQL} {MERGES_SQL}")
def _tree_l1(spark, sf_dir):
    return merge_rows(T.merge_tree(accounts(spark, sf_dir), metric="l1"))


# A cluster is a node merged closer than 1.5 under nodes that were not; its leaves are read downwards.
@query("cut_tree", f"""WITH RECURSIVE {L2_TREE_SQL}, {DOWN_SQL},
roots AS (SELECT first, size, d FROM merges ORDER BY size DESC LIMIT 1),
opened(first, size, d) AS (SELECT first, size, d FROM roots UNION ALL
  SELECT p.part, p.part_size, coalesce(m.d, 0) FROM opened o JOIN parts p ON p.first = o.first AND p.size = o.size
  LEFT JOIN merges m ON m.first = p.part AND m.size = p.part_size WHERE o.d >= 1.5),
clusters AS (SELECT first, size FROM opened WHERE d < 1.5)
SELECT part AS row_id, c.first AS cluster, c.size FROM clusters c JOIN down USING (first, size) WHERE part_size = 1
UNION ALL SELECT first, first, size FROM clusters WHERE size = 1""")
def _cut(spark, sf_dir):
    tree = T.merge_tree(accounts(spark, sf_dir))
    names = named(tree).select("node", F.col("first").alias("cluster"), "size")
    return T.cut_tree(tree, 1.5).join(names, "node").select(F.col("id").alias("row_id"), "cluster", "size")


# The members of the later of the root's two parts.
@query("tree_members", f"""WITH RECURSIVE {L2_TREE_SQL}, {DOWN_SQL},
root AS (SELECT r AS first, rsize AS size FROM merges ORDER BY merges.size DESC LIMIT 1)
SELECT part AS row_id FROM root JOIN down USING (first, size) WHERE part_size = 1 UNION ALL SELECT first FROM root WHERE size = 1""")
def _members(spark, sf_dir):
    tree = T.merge_tree(accounts(spark, sf_dir))
    root = tree.merges.orderBy(F.desc("size")).select("left", "right").first()
    later = named(tree).where(F.col("node").isin(root.left, root.right)).orderBy(F.desc("first")).first().node
    return T.tree_members(tree, later).select(F.col("id").alias("row_id"))


@query("tree_height", f"""WITH RECURSIVE {L2_TREE_SQL}, {DOWN_SQL}
SELECT first, size, count(*) AS height FROM down WHERE part_size = 1 GROUP BY first, size
UNION ALL SELECT row_id, 1, 1 FROM accounts""")
def _height(spark, sf_dir):
    tree = T.merge_tree(accounts(spark, sf_dir))
    return T.tree_measures(tree).join(named(tree), "node").select("first", "size", "height")


@query("tree_depth", f"""WITH RECURSIVE {L2_TREE_SQL}, {DOWN_SQL}
SELECT first, size, round(max(way), 6) AS depth FROM down GROUP BY first, size UNION ALL SELECT row_id, 1, 0 FROM accounts""")
def _depth(spark, sf_dir):
    tree = T.merge_tree(accounts(spark, sf_dir))
    return T.tree_measures(tree).join(named(tree), "node").select("first", "size", r6("depth").alias("depth"))


# ---- codebooks -------------------------------------------------------------------------------------

# A codebook as large as the table: every vector read backwards. It is partitioned whatever its size.
@query("nearest_centroid_large", f"""WITH {samples_sql()}
SELECT a.row_id, arg_min(b.row_id, (list_distance(a.features, list_reverse(b.features)), b.row_id)) AS cid,
  round(min(list_distance(a.features, list_reverse(b.features))), 6) AS dist FROM samples a, samples b GROUP BY a.row_id""")
def _large(spark, sf_dir):
    s = samples(spark, sf_dir)
    book = s.select(F.col("row_id").alias("cid"), F.reverse("features").alias("vec"))
    return N.nearest_centroid(s, book, max_values=0).select("row_id", "cid", r6("dist").alias("dist"))


@query("nearest_centroid_l1", f"""WITH {samples_sql()}, {CENTROIDS_SQL},
far AS (SELECT row_id, cid, sum(abs(v - c)) AS dist FROM cells JOIN centroids USING (pos) GROUP BY ALL)
SELECT row_id, arg_min(cid, (dist, cid)) AS cid, round(min(dist), 6) AS dist FROM far GROUP BY row_id""")
def _l1(spark, sf_dir):
    return N.nearest_centroid(samples(spark, sf_dir), centroids(spark, sf_dir), metric="l1").select("row_id", "cid", r6("dist").alias("dist"))


# ---- profiles of the rows themselves ---------------------------------------------------------------

def profile_rows(rows, profile):
    return P.classify(rows, profile).select("row_id", "cid", r6("dist").alias("dist"), "predicted")


# Centroids are the leaders of a pass over the vectors; a row may have a nearer one than the one that leads it.
@query("fit_profile_leader", LEADER_SQL.rsplit("SELECT", 1)[0] + f""", book AS (SELECT row_number() OVER (ORDER BY leader) - 1 AS cid, lead AS c FROM leaders),
far AS (SELECT row_id, cid, list_distance(features, c) AS dist FROM samples, book)
SELECT row_id, arg_min(cid, (dist, cid)) AS cid, round(min(dist), 6) AS dist, CASE WHEN min(dist) < {LEADER_RADIUS} THEN 'P' ELSE 'N' END AS predicted
FROM far GROUP BY row_id""")
def _profile_leader(spark, sf_dir):
    s = samples(spark, sf_dir)
    return profile_rows(s, P.fit_profile(s, "leader", threshold=LEADER_RADIUS))


# Centroids are the nodes of a merge tree cut at 1.5; rows that lie 1.5 or more from all of them are not normal.
@query("fit_profile_tree", f"""WITH RECURSIVE {L2_TREE_SQL}, {DOWN_SQL.split('down(', 1)[0].rstrip().rstrip(',')},
nodes AS (SELECT DISTINCT first, size, vec FROM tree),
opened(first, size, d) AS (SELECT * FROM (SELECT first, size, d FROM merges ORDER BY size DESC LIMIT 1) UNION ALL
  SELECT p.part, p.part_size, coalesce(m.d, 0) FROM opened o JOIN parts p ON p.first = o.first AND p.size = o.size
  LEFT JOIN merges m ON m.first = p.part AND m.size = p.part_size WHERE o.d >= 1.5),
book AS (SELECT row_number() OVER (ORDER BY first) - 1 AS cid, vec AS c FROM opened JOIN nodes USING (first, size) WHERE d < 1.5),
far AS (SELECT row_id, cid, list_distance(features, c) AS dist FROM accounts, book)
SELECT row_id, arg_min(cid, (dist, cid)) AS cid, round(min(dist), 6) AS dist, CASE WHEN min(dist) < 1.5 THEN 'P' ELSE 'N' END AS predicted
FROM far GROUP BY row_id""")
def _profile_tree(spark, sf_dir):
    a = accounts(spark, sf_dir)
    return profile_rows(a, P.fit_profile(a, "tree", threshold=1.5))


BY_RADIUS_SQL = f"""WITH RECURSIVE {samples_sql()}, means AS (SELECT pos, avg(v) AS m FROM cells GROUP BY pos),
inferred AS (SELECT sqrt(sum((v - m) * (v - m))) / 16 AS radius FROM cells JOIN means USING (pos)),
left_over(step, row_id, v) AS (SELECT 0, row_id, features FROM samples UNION ALL
  SELECT step + 1, row_id, v FROM (SELECT step, row_id, v, first_value(v) OVER (ORDER BY row_id) AS lead FROM left_over)
  WHERE list_distance(v, lead) >= (SELECT radius FROM inferred))
SELECT step AS cid, round(arg_min(v[1], row_id), 6) AS first_value, round(list_sum(arg_min(v, row_id)), 6) AS total FROM left_over GROUP BY step"""


@query("kmeans_by_radius", BY_RADIUS_SQL)
def _by_radius(spark, sf_dir):
    c = P.kmeans_by_radius(samples(spark, sf_dir), 4)
    return c.select("cid", r6(F.get("vec", F.lit(0))).alias("first_value"), r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"))
