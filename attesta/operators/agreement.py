"""Agreement between readers, and resampling over clusters from per-cluster counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.stats import Z95
from attesta.operators import resampling


def cohen_kappa(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """items, observed, expected, kappa, its standard error and limits from two readers' labels: counts by cell, then by
    margin. Where chance alone explains all agreement, kappa and its limits are 0."""
    cells = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("items"), F.sum(F.when(F.col(first) == F.col(second), F.col("n")).otherwise(0)).alias("same"))
    a = cells.groupBy(F.col(first).alias("label")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(F.col(second).alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("cross"))
    x = total.crossJoin(chance).select("items", (F.col("same") / F.col("items")).alias("o"), (F.col("cross") / F.col("items") / F.col("items")).alias("e"))  # one row each
    kappa = F.try_divide(F.col("o") - F.col("e"), 1 - F.col("e"))
    error = F.sqrt(F.try_divide(F.col("o") * (1 - F.col("o")), F.col("items") * F.pow(1 - F.col("e"), 2)))
    return x.select("items", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), *(F.round(F.when(F.col("e") >= 1, 0.0).otherwise(c), 6).alias(n) for n, c in (("kappa", kappa), ("standard_error", error), ("low", F.greatest(F.lit(-1.0), kappa - Z95 * error)), ("high", F.least(F.lit(1.0), kappa + Z95 * error)))))


def multi_reader(ratings: DataFrame, readers: int, categories: int, item: str = "item", label: str = "label") -> DataFrame:
    """Fleiss' kappa and Gwet's AC1 of items rated by the same number of readers."""
    counts = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    each = F.when(F.sum("n") == readers, F.sum(F.col("n") * F.col("n"))).otherwise(F.raise_error(F.concat(F.lit("not every reader rated item "), F.col(item).cast("string"))).cast("long"))
    items = counts.groupBy(item).agg(((each - readers) / (readers * (readers - 1))).alias("p"))
    share = counts.groupBy(label).agg(F.sum("n").alias("n")).crossJoin(items.agg(F.count(F.lit(1)).alias("k"), F.avg("p").alias("o"))).withColumn("q", F.col("n") / (F.col("k") * readers))  # one row
    x = share.groupBy("o", "k").agg(F.sum(F.col("q") * F.col("q")).alias("ef"), (F.sum(F.col("q") * (1 - F.col("q"))) / (categories - 1)).alias("ea"))
    kappa = F.when(F.col("ef") >= 1, 1.0).otherwise((F.col("o") - F.col("ef")) / (1 - F.col("ef")))
    return x.select(F.col("k").alias("items"), F.round("o", 6).alias("observed"), F.round(kappa, 6).alias("fleiss_kappa"), F.round((F.col("o") - F.col("ea")) / (1 - F.col("ea")), 6).alias("gwet_ac1"))


def clustered_difference(pairs: DataFrame, cluster: str, draws: int = 10_000, seed: int = 42, confidence: float = 0.95, digits: int = 6) -> DataFrame:
    """Mean paired difference with a cluster bootstrap interval and a two-sided p-value, no less than 1 / draws."""
    sums = pairs.groupBy(cluster).agg(F.sum("difference").alias("d"), F.count(F.lit(1)).alias("n"))
    m = resampling.resampled(sums, cluster, draws, seed).select((F.col("d") / F.col("n")).alias("m"))
    share = lambda c: F.avg(c.cast("double"))
    spread = m.agg(*resampling.limits("m", confidence), F.greatest(F.lit(1 / draws), F.least(F.lit(1.0), 2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0)))).alias("p_value"))
    whole = sums.agg((F.sum("d") / F.sum("n")).alias("difference"), F.count(F.lit(1)).alias("clusters"))
    both = whole.crossJoin(spread)  # one row each
    return both.select(*(F.round(c, digits).alias(c) for c in ("difference", "low", "high", "p_value")), "clusters")


def rank_stability(judged: DataFrame, cluster: str, draws: int = 2000, seed: int = 42, digits: int = 6) -> DataFrame:
    """Share of cluster resamples in which each system has the top Youden index, and its ranks' quantiles. Ranks are found
    within a draw: a row per system."""
    c = judged.groupBy("system", cluster).agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "truth and flagged"), ("p", "truth"), ("tn", "not truth and not flagged"), ("n", "not truth"))))
    j = F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("tp") / F.col("p") + F.col("tn") / F.col("n") - 1, 12)).otherwise(0.0)
    drawn = resampling.resampled(c, cluster, draws, seed, "system").select("draw", "system", j.alias("j"))
    w = Window.partitionBy("draw")
    ranked = drawn.withColumn("r", F.rank().over(w.orderBy(F.col("j").desc())) + (F.count(F.lit(1)).over(Window.partitionBy("draw", "j")) - 1) / 2.0).withColumn("best", F.max("j").over(w))
    found = ranked.groupBy("system").agg(F.avg((F.col("j") == F.col("best")).cast("double")).alias("top_share"), *resampling.limits("r"))
    return found.select("system", F.round("top_share", digits).alias("top_share"), F.round("low", digits).alias("rank_low"), F.round("high", digits).alias("rank_high"))


def bootstrap_ac1(ratings: DataFrame, categories: int, readers: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of Gwet's AC1 over resampled items; items with equal label counts are one row with a count."""
    counts = ratings.groupBy("item").pivot("label").count().fillna(0)
    labels = [c for c in counts.columns if c != "item"]
    kinds = counts.groupBy(*(F.col(f"`{c}`") for c in labels)).agg(F.count(F.lit(1)).alias("items"))

    def resample(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(labels)
        x, k = g[labels].to_numpy(float), g["items"].to_numpy()
        w = np.random.default_rng(seed).multinomial(k.sum(), k / k.sum(), draws)
        o = w @ (((x * x).sum(1) - readers) / (readers * (readers - 1))) / k.sum()
        q = w @ x / (k.sum() * readers)
        e = (q * (1 - q)).sum(1) / (categories - 1)
        low, high = np.quantile((o - e) / (1 - e), [0.025, 0.975])
        return pd.DataFrame([[low, high]], columns=["low", "high"])

    return kinds.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(resample, "low double, high double")
