"""Composite reports over judgements: gold labels, truth variants, replays, calibrated thresholds and weighted trends."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import stats
from attesta.operators import sampling, scoring


def gold_labels(readings: DataFrame, decisions: DataFrame, key: str = "item") -> DataFrame:
    """One label per item: the readers' common one, else the last decision's; `source` says which, `scored` whether any.

    readings: key, first, second; decisions: key, position, label (the highest position of an item counts)."""
    last = decisions.groupBy(key).agg(F.max_by("label", "position").alias("decided"))
    agreed = F.when(F.col("first") == F.col("second"), F.col("first"))
    both = readings.join(last, key, "left").withColumn("label", F.coalesce(agreed, "decided"))
    source = F.when(agreed.isNotNull(), "agreed").when(F.col("decided").isNotNull(), "adjudicated").otherwise("open")
    return both.select(key, "label", source.alias("source"), F.col("label").isNotNull().alias("scored"))


def truth_variants(judged: DataFrame, variants: dict[str, str], *by: str) -> DataFrame:
    """Confusion and measures under several truths, each a boolean SQL text whose null leaves an item out. One pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.expr(e).alias("truth")) for n, e in variants.items())))
    rows = judged.select("*", pairs.alias("_v")).select(*by, "flagged", F.col("_v.rule").alias("rule"), F.col("_v.truth").alias("truth")).where("truth is not null")
    return scoring.with_measures(scoring.confusion(rows, "rule", *by))


def field_accuracy(judged: DataFrame, *by: str) -> DataFrame:
    """hits, attempts and their share with limits; a null field_hit is no attempt."""
    counts = judged.groupBy(*by).agg(F.count_if("field_hit").alias("hits"), F.count("field_hit").alias("attempts"))
    return counts.select("*", *(F.round(F.expr(f("hits", "attempts")), 6).alias(n) for n, f in (("share", stats.wilson_point), ("low", stats.wilson_low), ("high", stats.wilson_high))))


def replay_agreement(first: DataFrame, second: DataFrame, item: str = "item", model: str = "model") -> DataFrame:
    """By model: items both runs answered, equal flags, flips each way; models whose runs cover other items are left out."""
    a, b = first.select(model, item, F.col("flagged").alias("f1")), second.select(model, item, F.col("flagged").alias("f2"))
    both = a.join(b, [model, item], "full_outer").groupBy(model).agg(
        F.count_if(F.expr("f1 is null or f2 is null")).alias("lone"), F.count(F.lit(1)).alias("items"), F.count_if(F.expr("f1 = f2")).alias("same"),
        F.count_if(F.expr("f1 and not f2")).alias("lost"), F.count_if(F.expr("not f1 and f2")).alias("gained"))
    return both.where("lone = 0").drop("lone")


def calibrated(scored: DataFrame, share: float, seed: int, *key: str) -> DataFrame:
    """The confusion on the rest of the threshold that is best on a keyed share of the items. The threshold is one row."""
    split = sampling.split_share(scored.withColumn("_all", F.lit("all")), ["_all"], share, seed, *key)
    cut = scoring.threshold(split.where("withheld"))
    rest = split.where("not withheld").crossJoin(cut).withColumn("flagged", F.col("score") < F.col("cut"))
    return scoring.with_measures(scoring.confusion(rest, "cut"))


def with_class_weights(rows: DataFrame, *by: str) -> DataFrame:
    """Adds w: each class of a group weighs 0.5 in all."""
    n = rows.groupBy(*by, "truth").agg(F.count(F.lit(1)).alias("_c"))
    return rows.join(n, [*by, "truth"]).withColumn("w", 0.5 / F.col("_c")).drop("_c")


def weighted_trend(rows: DataFrame, cluster: str, *by: str, digits: int = 8) -> DataFrame:
    """slope, intercept, se and clusters of the weighted least-squares line of y on x by group, with cluster-robust
    (CR1) variance. Sums by cluster are all that is shuffled: residual sums follow from them."""
    x, y, w = F.col("x").cast("double"), F.col("y").cast("double"), F.col("w")
    sums = {"sw": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y}
    g = rows.groupBy(*by, cluster).agg(*(F.sum(e).alias(n) for n, e in sums.items()), F.count(F.lit(1)).alias("k"))
    t = g.groupBy(*by).agg(*(F.sum(n).alias(n.upper().replace("S", "T", 1)) for n in sums), F.count(F.lit(1)).alias("clusters"), F.sum("k").alias("items"))
    t = t.withColumn("d", F.expr("TW * TXX - TX * TX")).withColumn("b", F.expr("try_divide(TW * TXY - TX * TY, d)")).withColumn("a", F.expr("(TY - b * TX) / TW"))
    both = g.join(t, list(by)) if by else g.crossJoin(t)  # without groups the totals are one row
    z = F.expr("(-TX * (sy - a * sw - b * sx) + TW * (sxy - a * sx - b * sxx)) / d")
    out = both.groupBy(*by, "a", "b", "clusters", "items").agg(F.sum(z * z).alias("s"))
    se = F.expr("sqrt(try_divide(clusters * 1e0, clusters - 1) * try_divide(items - 1e0, items - 2) * s)")
    return out.select(*by, F.round("b", digits).alias("slope"), F.round("a", digits).alias("intercept"), F.round(se, digits).alias("se"), "clusters", "items")


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its density's integral (Simpson)."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    f = lambda t: c * (1 + t * t / df) ** (-(df + 1) / 2)

    def half(t: float, n: int = 2000) -> float:
        h = t / n
        return h / 3 * (f(0) + f(t) + 4 * sum(f(h * k) for k in range(1, n, 2)) + 2 * sum(f(h * k) for k in range(2, n, 2)))

    goal, low, high = abs(p - 0.5), 0.0, 1.0
    while half(high) < goal and high < 1e6:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if half(mid) < goal else (low, mid)
    return math.copysign((low + high) / 2, p - 0.5)


def with_t_interval(trend: DataFrame, confidence: float = 0.95, digits: int = 8) -> DataFrame:
    """Adds low and high: slope -+ t * se with clusters - 1 degrees of freedom; null for fewer than two clusters."""

    @F.pandas_udf("double")
    def t_of(clusters: pd.Series) -> pd.Series:
        known = {n: t_quantile((1 + confidence) / 2, n - 1) for n in clusters.unique() if n > 1}
        return clusters.map(known)

    half = t_of("clusters") * F.col("se")
    return trend.select("*", F.round(F.col("slope") - half, digits).alias("low"), F.round(F.col("slope") + half, digits).alias("high"))


def pareto(rows: DataFrame, group: list[str], name: str, gain: str, cost: str) -> DataFrame:
    """Adds dominated: whether another configuration of the group gains no less at no more cost, and is better in one.
    A group's configurations are few (they are treatments, not items), so pairs within it are bounded."""
    other = rows.select(*group, F.col(name).alias("_n"), F.col(gain).alias("_g"), F.col(cost).alias("_c"))
    both = rows.join(other, group).where(F.col(name) != F.col("_n"))
    worse = (F.col("_g") >= F.col(gain)) & (F.col("_c") <= F.col(cost)) & ((F.col("_g") > F.col(gain)) | (F.col("_c") < F.col(cost)))
    found = both.groupBy(*group, name).agg(F.bool_or(worse).alias("dominated"))
    return rows.join(found, [*group, name], "left").withColumn("dominated", F.coalesce("dominated", F.lit(False)))


def explained_flags(rows: DataFrame, *by: str) -> DataFrame:
    """Of clean items: flagged, explained (every raised check was already held) and unexplained, with a total by rollup."""
    raised, held = F.col("raised"), F.coalesce("held", F.array().cast("array<string>"))
    hit = F.size(raised) > 0
    fine = F.size(F.array_except(raised, held)) == 0
    counts = rows.rollup(*by).agg(F.count(F.lit(1)).alias("items"), F.count_if(hit).alias("flagged"), F.count_if(hit & fine).alias("explained"), F.count_if(hit & ~fine).alias("unexplained"))
    return counts.select("*", *(F.round(F.expr(f("unexplained", "items")), 6).alias(n) for n, f in (("low", stats.wilson_low), ("high", stats.wilson_high))))
