import numpy as np
import pytest

from salesmart.operators import tiers
from salesmart.schema import TIER_FEATURES


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        level = (10.0, 40.0, 90.0)[i % 3]
        daily = float(level + rng.normal(0, 2))
        rows.append((i, f"p{i}", int(daily * 90), daily, daily / 20, 250.0, daily * 900, "x"))
    return spark.createDataFrame(
        rows,
        "product_id int, product_name string, total_sales bigint, avg_daily_sales double,"
        " sales_volatility double, avg_stock double, revenue double, extra string",
    )


def test_scaling(features):
    z = tiers.scale_features(features).select(*(f"{f}_z" for f in TIER_FEATURES)).toPandas()
    assert np.allclose(z.mean(), 0, atol=1e-9)
    # A constant feature scales to zero, the others to unit deviation.
    assert np.allclose(z.std(ddof=0), [1, 1, 1, 0, 1], atol=1e-9)


def test_tiers_are_recovered_and_ordered(features):
    rows = tiers.demand_tiers(features, seeds=range(4)).collect()
    expected = {0: "Low", 1: "Medium", 2: "High"}
    assert all(r.demand_level == expected[r.product_id % 3] for r in rows)
    assert rows[0].asDict().keys() == {*features.columns, "cluster", "demand_level"}


def test_best_fit_is_kept_and_rows_are_nearest_their_centre(features):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    scaled = tiers.scale_features(features)
    names = [f"{f}_z" for f in TIER_FEATURES]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(scaled).select("features").cache()
    seeds = range(3)
    best = tiers.fit_kmeans(vectors, seeds=seeds)
    costs = [KMeans(k=3, seed=s, maxIter=300, tol=tiers.default_tolerance(3)).fit(vectors).summary.trainingCost for s in seeds]
    assert best.summary.trainingCost == pytest.approx(min(costs))
    centres = np.array(best.clusterCenters())
    for row in best.transform(vectors).collect():
        distances = ((centres - row.features.toArray()) ** 2).sum(axis=1)
        assert distances[row.prediction] == pytest.approx(distances.min())


def test_labels_follow_mean_not_cluster_number(spark):
    df = spark.createDataFrame([(2, 1.0), (2, 2.0), (0, 50.0), (1, 10.0)], "cluster int, avg_daily_sales double")
    got = {(r.cluster, r.demand_level) for r in tiers.label_tiers(df).collect()}
    assert got == {(2, "Low"), (1, "Medium"), (0, "High")}


def test_scatter_legend(spark):
    df = spark.createDataFrame(
        [(1, "a", "Low", 1.0, 2.0), (2, "b", "Low", 1.0, 2.0), (3, "c", "High", 9.0, 2.0)],
        "product_id int, product_name string, demand_level string, avg_daily_sales double, revenue double",
    )
    legends = [r.legend for r in tiers.tier_scatter(df).orderBy("product_id").collect()]
    assert legends == ["Low (2)", "Low (2)", "High (1)"]


def test_check_sees_wrong_tiers(spark, features):
    """All zero for the fitted tiers; each kind of harm done to them shows."""
    from pyspark.sql import functions as F

    tiered = tiers.demand_tiers(features, seeds=range(3)).cache()
    costs = tiers.seed_costs(features, seeds=range(3))
    check = lambda df, costs=costs: tiers.clustering_check(df, costs).first().asDict()
    good = check(tiered)
    assert (good["rows"], good["clusters"]) == (120, 3)
    assert all(v == 0 for k, v in good.items() if k not in ("rows", "clusters"))

    one = F.col("product_id") == 0
    assert check(tiered.withColumn("cluster", F.when(one, (F.col("cluster") + 1) % 3).otherwise(F.col("cluster"))))["misplaced"] == 1
    swapped = F.when(F.col("demand_level") == "Low", "High").when(F.col("demand_level") == "High", "Low").otherwise("Medium")
    assert check(tiered.withColumn("demand_level", swapped))["out_of_order"] == 2
    assert check(tiered.withColumn("demand_level", F.when(~one, F.col("demand_level"))))["unlabelled"] == 1
    assert check(tiered.withColumn("demand_level", F.when(one, "High").otherwise(F.col("demand_level"))))["mixed_labels"] == 1
    assert check(tiered, [costs[0] / 2, *costs])["cheaper_seeds"] == 1
    assert check(tiered.withColumn("cluster", F.lit(0)))["clusters"] == 1


def test_fits_keep_blocks_and_find_what_rows_find(features):
    from pyspark.ml.clustering import KMeans

    vectors = tiers._assembled(features, TIER_FEATURES).select("features").cache()
    models = tiers.fits_by_seed(vectors, seeds=range(2))
    assert {m.getSolver() for m in models} == {"block"}
    rows = [KMeans(k=3, seed=s, maxIter=300, tol=tiers.default_tolerance(3), solver="row").fit(vectors) for s in range(2)]
    for a, b in zip(models, rows):
        assert np.allclose(a.clusterCenters(), b.clusterCenters())
        assert a.summary.numIter == b.summary.numIter
