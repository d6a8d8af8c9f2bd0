import numpy as np
import pytest

from pyspark.sql import functions as F
from weir.operators import profiles as P
from weir.operators import vectors as N
from weir.operators.evaluate import feature_windows, linear_trials

SCHEMA = "row_id long, features array<double>, source string, label string"


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row], f"s{i % 3}", "P") for i, row in enumerate(x)], SCHEMA)


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(7).normal(size=(300, 4))


def test_close_centres_are_merged_and_no_others(x):
    book = P.merged_centres(x[:40], 1.5)
    gaps = [np.sqrt(((a - b) ** 2).sum()) for i, a in enumerate(book) for b in book[i + 1:]]
    assert 1 < len(book) < 40 and min(gaps) >= 1.5
    np.testing.assert_allclose(P.merged_centres(np.array([[0.0], [1.0], [10.0]]), 2), [[0.5], [10.0]])


def test_profiles_find_separate_clusters_at_every_size(spark):
    centres = np.array([[0, 0], [50, 0], [0, 50], [50, 50]])
    for n in (60, 3000):
        rng = np.random.default_rng(n)
        df = points(spark, centres[rng.integers(0, 4, n)] + rng.normal(size=(n, 2)))
        p = P.fit_profile(df, "hier", threshold=20.0)
        found = sorted([round(v / 50) * 50 for v in r.vec] for r in p.centroids.collect())
        assert found == sorted(centres.tolist()) and p.init_size == 4
        assert P.classify(df, p).where("predicted <> 'P'").count() == 0


def test_one_class_centres_around_their_bound(spark, x):
    for bound in (299, 300, 301):
        model = P.fit_one_class(points(spark, x), nu=0.1, gamma=0.3, max_centres=bound)
        assert len(model.centres) == min(bound, 300) and set(model.weights) == {1.0}


def test_a_codebook_over_its_bound_is_partitioned(spark, x):
    book = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(x[:10])], "cid long, vec array<double>")
    rows = [sorted((str(r.features), r.cid, r.dist) for r in N.nearest_centroid(points(spark, x), book, max_values=n).collect()) for n in (40, 39)]
    assert len(rows[0]) == 300 and rows[0] == rows[1]


def test_odd_widths_do_not_decide(spark, x):
    odd = spark.createDataFrame([(-1, [1.0, 2.0], "s", "P")], SCHEMA)
    df = odd.unionByName(points(spark, x))
    assert N.common_width(df) == 4 and len(P.fit_pca(df).components) == 4


def test_classification_agrees_with_the_radius(spark, x):
    df = points(spark, x)
    profile = P.fit_profile(df, "flat", size=4)
    scored = P.classify(df, profile).collect()
    assert all((r.predicted == "P") == (r.dist < profile.max_radius) for r in scored)
    book = [r.vec for r in profile.centroids.orderBy("cid").collect()]
    want = [min(np.sqrt(((np.array(r.features) - c) ** 2).sum()) for c in book) for r in scored]
    np.testing.assert_allclose([r.dist for r in scored], want)


def test_growth_keeps_ids_labels_and_rows(spark, x):
    df = points(spark, x)
    profile = P.fit_profile(df.where("row_id < 5"), "hier", threshold=0.5)
    grown, near = P.grow_profile(profile, df)
    ids = [r.cid for r in grown.centroids.orderBy("cid").collect()]
    assert ids == list(range(len(ids))) and len(ids) > profile.init_size
    assert near.count() == 300 and near.where("cid is null").count() == 0
    before = {r.cid: r.label for r in profile.centroids.collect()}
    after = {r.cid: r.label for r in grown.centroids.collect()}
    assert all(after[c] == before[c] for c in before)


def test_one_class_cuts_at_the_quantile(spark, x):
    df = points(spark, x)
    model = P.fit_one_class(df, nu=0.1, gamma=0.3)
    scored = model.score(df)
    assert abs(scored.where("score = -1").count() - 30) <= 1
    far = model.score(points(spark, np.full((1, 4), 50.0))).first()
    assert far.score == -1 and far.predicted == "UNKNOWN"


def test_pca_matches_numpy(spark, x):
    pca = P.fit_pca(points(spark, x))
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(pca.singular_values, s, rtol=1e-6)
    np.testing.assert_allclose(np.abs(pca.components), np.abs(v), atol=1e-6)
    got = P.project(points(spark, x[:3]), pca).orderBy("row_id").collect()
    np.testing.assert_allclose(np.abs([r.projected for r in got]), np.abs(x[:3] @ v.T), atol=1e-6)


def test_wrong_width_fails(spark, x):
    book = spark.createDataFrame([(0, [1.0, 2.0])], "cid long, vec array<double>")
    with pytest.raises(Exception, match="2 values"):
        N.nearest_centroid(points(spark, x[:3]), book).collect()


def test_samples_are_fixed_by_the_seed(spark, x):
    df = points(spark, x)
    once = {r.row_id for r in N.sample_per_class(df, 15).collect()}
    again = {r.row_id for r in N.sample_per_class(df.repartition(5), 15).collect()}
    assert once == again and len(once) == 15
    held = N.holdout_splits(df, [0.5], 2).groupBy("round").agg(F.avg(F.col("held_out").cast("int")).alias("s")).collect()
    assert all(0.35 < r.s < 0.65 for r in held)


def test_feature_windows():
    assert [w[0] for w in feature_windows(26)] == ["ALL", "(0, 10)", "(5, 15)", "(10, 20)", "(15, 25)", "(20, 30)"]


def test_linear_trials_count_and_learn(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    rows = [(i, [float(v) for v in row], "s", "P" if row[0] - row[4] + 0.2 > 0 else "N") for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = linear_trials(df, [("ALL", 0, 6), ("blind", 1, 3)], (0.5, 0.9), 3).collect()
    assert len(got) == 2 * 2 * 2 * 3
    held = {(r.fraction, r.round): r.n for r in N.holdout_splits(df, (0.5, 0.9), 3).groupBy("fraction", "round").agg(
        F.count_if("held_out").alias("n")).collect()}
    for r in got:
        assert r.held_out == held[r.fraction, r.round]
        error = r.errors / r.held_out
        assert error < (0.1 if r.fraction == 0.5 else 0.3) if r.subset == "ALL" else 0.35 < error < 0.65


def test_one_class_takes_every_row_as_a_centre(spark):
    x = np.random.default_rng(3).normal(size=(1500, 3))
    model = P.fit_one_class(points(spark, x), nu=0.1, gamma=0.3, max_centres=None)
    kernel = np.exp(-0.3 * ((x[:, None] - x) ** 2).sum(-1)).mean(1)
    rows = {r.row_id: r for r in model.score(points(spark, x)).collect()}
    assert all(abs(rows[i].kernel_mean - k) < 1e-12 for i, k in enumerate(kernel))
    assert sum(r.score == 1 for r in rows.values()) == 1500 - 149
