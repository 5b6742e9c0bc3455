"""Cluster bootstraps in parallel: a draw's slots pick clusters by keyed hashes, so draws are spread over tasks and are the
same in other SQL engines. Only per-cluster sums are resampled, never items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resampled(sums: DataFrame, cluster: str, draws: int, seed: int, *keep: str) -> DataFrame:
    """(draw, keep.., sums of the other columns) over `draws` resamples with replacement of as many clusters as there are.

    The clusters are numbered in one window: one short row each, as many as there are cities, not items."""
    rest = [c for c in sums.columns if c not in (cluster, *keep)]
    numbered = sums.select(cluster).distinct().withColumn("_at", F.row_number().over(Window.orderBy(F.col(cluster).asc_nulls_first())) - 1)
    n = numbered.count()
    indexed = sums.join(numbered, sums[cluster].eqNullSafe(numbered[cluster])).select("_at", *keep, *rest)
    slots = sums.sparkSession.range(draws).withColumnRenamed("id", "draw").select("draw", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("slot"))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "slot").cast("binary"))
    picks = slots.select("draw", (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long") % max(n, 1)).alias("_at"))
    times = picks.groupBy("draw", "_at").agg(F.count(F.lit(1)).alias("_times"))
    return times.join(indexed, "_at").groupBy("draw", *keep).agg(*(F.sum(F.col(c) * F.col("_times")).alias(c) for c in rest))


def limits(column: str, confidence: float = 0.95) -> list:
    """low and high: quantiles with linear interpolation."""
    return [F.percentile(column, q).alias(n) for n, q in (("low", (1 - confidence) / 2), ("high", (1 + confidence) / 2))]


def ratio_interval(rows: DataFrame, cluster: str, top: str, bottom: str, least_clusters: int = 6, draws: int = 10_000, seed: int = 42, digits: int = 4) -> DataFrame:
    """(low, high, method, clusters) of sum(top) / sum(bottom): a cluster bootstrap; with fewer than least_clusters the
    range of the clusters' own ratios, and nothing with fewer than two."""
    sums = rows.groupBy(cluster).agg(F.sum(top).alias("t"), F.sum(bottom).alias("b"))
    few = sums.agg(F.count(F.lit(1)).alias("clusters"), F.min(F.col("t") / F.col("b")).alias("least"), F.max(F.col("t") / F.col("b")).alias("greatest"))
    drawn = resampled(sums, cluster, draws, seed).select((F.col("t") / F.col("b")).alias("x")).agg(*limits("x"))
    many, two = F.col("clusters") >= least_clusters, F.col("clusters") >= 2
    pick = lambda a, b: F.round(F.when(many, F.col(a)).when(two, F.col(b)).otherwise(0.0), digits)
    method = F.when(many, "cluster bootstrap").when(two, "city range").otherwise("none")
    return few.crossJoin(drawn).select(pick("low", "least").alias("low"), pick("high", "greatest").alias("high"), method.alias("method"), "clusters")  # one row each
