"""Demand tiers: scaling, k-means and Low/Medium/High labels."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import partial

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.operators.quality import fill_missing_features, require_columns
from salesmart.schema import TIER_FEATURES, TIER_LABELS
from salesmart.session import concurrently


def _scaled_name(feature: str) -> str:
    return f"{feature}_z"


def scale_features(df: DataFrame, features: Sequence[str] = TIER_FEATURES) -> DataFrame:
    """Adds ``<feature>_z``: z-scores with the population deviation; constants scale to 0."""
    filled = df.transform(require_columns, features).transform(fill_missing_features, features)
    moments = filled.agg(
        F.struct(
            *(F.avg(f).alias(f"{f}_mean") for f in features),
            *(F.stddev_pop(f).alias(f"{f}_dev") for f in features),
        ).alias("moments")
    ).scalar()
    held = filled.withColumn("_moments", moments)

    def z_score(f: str):
        deviation = F.col(f"_moments.{f}_dev")
        centred = F.col(f) - F.col(f"_moments.{f}_mean")
        return centred / F.when(deviation == 0, 1.0).otherwise(deviation)

    return held.withColumns({_scaled_name(f): z_score(f) for f in features}).drop("_moments")


def default_tolerance(k: int) -> float:
    """Centre shift at which the k squared shifts add up to at most 1e-4."""
    return math.sqrt(1e-4 / k)


def fits_by_seed(
    vectors: DataFrame,
    k: int = 3,
    seeds: Iterable[int] = range(10),
    max_iter: int = 300,
    tol: float | None = None,
    parallelism: int = 10,
) -> list[KMeansModel]:
    """One k-means fit for each seed, in order.

    The fits are many short jobs over the same cached vectors; submitting them
    from several threads keeps the executors busy between iterations. Each fit keeps the
    vectors as blocks (small beside the cached rows), which an iteration reads as they
    are; the row solver would decode the cached rows again in every iteration.
    """
    tolerance = default_tolerance(k) if tol is None else tol

    def fit(seed: int) -> KMeansModel:
        return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tolerance, solver="block").fit(vectors)

    fits = {str(seed): partial(fit, seed) for seed in seeds}
    return list(concurrently(vectors.sparkSession, fits, parallelism).values())


def fit_kmeans(vectors: DataFrame, **options) -> KMeansModel:
    """Best of several k-means fits by training cost (ties go to the smaller seed)."""
    return min(fits_by_seed(vectors, **options), key=lambda m: m.summary.trainingCost)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The scaled features with their vector."""
    names = [_scaled_name(f) for f in features]
    return VectorAssembler(inputCols=names, outputCol="features").transform(scale_features(df, features))


def _cached(vectors: DataFrame, partitions: int | None) -> DataFrame:
    """Vectors kept for the fits, in the partitions of their table or the number asked for."""
    dealt = vectors if partitions is None else vectors.repartition(partitions)
    return dealt.persist(StorageLevel.MEMORY_AND_DISK)


def kmeans_clusters(
    df: DataFrame,
    features: Sequence[str] = TIER_FEATURES,
    k: int = 3,
    seeds: Iterable[int] = range(10),
    max_iter: int = 300,
    tol: float | None = None,
    parallelism: int = 10,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``cluster``. Fits eagerly on cached vectors; the assignment stays lazy."""
    assembled = _assembled(df, features)
    vectors = _cached(assembled.select("features"), partitions)
    try:
        model = fit_kmeans(vectors, k=k, seeds=seeds, max_iter=max_iter, tol=tol, parallelism=parallelism)
    finally:
        vectors.unpersist()
    assigned = model.setPredictionCol("cluster").transform(assembled)
    return assigned.select(*df.columns, "cluster")


def seed_costs(df: DataFrame, features: Sequence[str] = TIER_FEATURES, **options) -> list[float]:
    """The training cost of every seed's fit, for :func:`clustering_check`."""
    vectors = _cached(_assembled(df, features).select("features"), None)
    try:
        return [m.summary.trainingCost for m in fits_by_seed(vectors, **options)]
    finally:
        vectors.unpersist()


#: How much nearer another centre may be, in deviations: fits stop when centres move by less than a tenth of this.
NEARER = 0.1


def clustering_check(
    tiered: DataFrame,
    costs: Sequence[float],
    features: Sequence[str] = TIER_FEATURES,
    by: str = "avg_daily_sales",
    labels: Sequence[str] = TIER_LABELS,
) -> DataFrame:
    """Whether tiers are what they promise, measured on the labelled rows alone, as one row.

    ``rows``, ``clusters``, ``unlabelled``; ``misplaced``: rows clearly nearer to the mean
    of another cluster than to their own; ``cheaper_seeds``: fits (``costs``) whose squared
    distances add up to less than those of the rows to the means of their clusters;
    ``mixed_labels``: clusters with other than one label; ``out_of_order``: tiers whose mean
    ``by`` is not above that of the tier before. All but the first two should be 0.
    """
    scaled = scale_features(tiered, features)
    names = [_scaled_name(f) for f in features]
    means = scaled.groupBy("cluster").agg(F.array(*(F.avg(n) for n in names)).alias("centre"))
    centres = means.agg(F.collect_list(F.struct("cluster", "centre")).alias("centres")).scalar()
    point = F.array(*names)

    def squared(centre):
        return F.aggregate(F.zip_with(point, centre["centre"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)

    measured = scaled.withColumn("_centres", centres).select(
        "*",
        F.get(F.transform(F.filter("_centres", lambda c: c["cluster"] == F.col("cluster")), squared), F.lit(0)).alias("_own"),
        F.array_min(F.transform("_centres", squared)).alias("_nearest"),
    )
    tier = {t: F.avg(F.when(F.col("demand_level") == t, F.col(by))) for t in labels}
    cost = F.sum("_own")
    cheaper = sum((F.when(F.lit(c) < cost * (1 - 1e-9), 1).otherwise(0) for c in costs), F.lit(0))
    rising = [F.when(tier[b] > tier[a], 0).otherwise(1) for a, b in zip(labels, labels[1:])]
    labels_of = tiered.groupBy("cluster").agg(F.count_distinct("demand_level").alias("n"))
    mixed = labels_of.agg(F.count_if(F.col("n") != 1)).scalar()
    counts = {
        "rows": F.count(F.lit(1)),
        "clusters": F.count_distinct("cluster"),
        "unlabelled": F.count_if(F.col("demand_level").isNull()),
        "misplaced": F.count_if(F.sqrt("_own") - F.sqrt("_nearest") > NEARER),
        "cheaper_seeds": cheaper,
        "out_of_order": sum(rising, F.lit(0)),
    }
    checked = measured.agg(*(c.cast("bigint").alias(n) for n, c in counts.items()))
    return checked.withColumn("mixed_labels", mixed.cast("bigint"))


def label_tiers(
    clustered: DataFrame,
    by: str = "avg_daily_sales",
    labels: Sequence[str] = TIER_LABELS,
) -> DataFrame:
    """Adds ``demand_level``: labels go to clusters in ascending order of their mean ``by``.

    The order is a scalar subquery over one row per cluster, so the products are
    neither joined nor shuffled for it.
    """
    means = clustered.groupBy("cluster").agg(F.avg(by).alias("mean"))
    ascending = F.sort_array(F.collect_list(F.struct("mean", "cluster")))
    order = means.agg(F.transform(ascending, lambda c: c["cluster"]).alias("clusters")).scalar()
    position = F.array_position(order, F.col("cluster")).cast("int")
    return clustered.withColumn(
        "demand_level", F.get(F.array(*map(F.lit, labels)), position - 1)
    )


def demand_tiers(features: DataFrame, **kmeans_options) -> DataFrame:
    """The product table with ``cluster`` and ``demand_level``."""
    return label_tiers(kmeans_clusters(features, **kmeans_options))


def tier_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("demand_level").agg(F.count(F.lit(1)).alias("products"))


def tier_scatter(clusters: DataFrame) -> DataFrame:
    """Points (avg daily sales, revenue) per product with a legend such as ``Low (84)``.

    Tier sizes come from a scalar subquery, not from a window: a window by tier
    would move every product into a handful of partitions.
    """
    sizes = tier_sizes(clusters.filter(F.col("demand_level").isNotNull()))
    entries = F.map_from_entries(F.collect_list(F.struct("demand_level", "products")))
    size_of = sizes.agg(entries.alias("sizes")).scalar()
    level = F.col("demand_level")
    return clusters.select(
        "product_id",
        "product_name",
        "demand_level",
        "avg_daily_sales",
        "revenue",
        F.format_string("%s (%d)", level, F.try_element_at(size_of, level)).alias("legend"),
    )
