"""Judgements joined to truth, confusions, paired comparisons, thresholds, weighted rates and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import stats


def confusion(judged: DataFrame, *by: str, truth: str = "truth", flag: str = "flagged") -> DataFrame:
    """tp, fn, tn, fp per group; an invalid answer counts as not flagged."""
    t, f = F.col(truth), F.coalesce(F.col(flag), F.lit(False))
    return judged.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in (("tp", t & f), ("fn", t & ~f), ("tn", ~t & ~f), ("fp", ~t & f))))


def with_measures(counts: DataFrame, digits: int = 6) -> DataFrame:
    return counts.select("*", *(F.expr(e).alias(n) for n, e in stats.measures(digits=digits).items()))


def strict_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that fails on a left row without a partner."""
    marked = left.join(right.withColumn("_has", F.lit(True)), on, "left")
    return marked.withColumn("_has", F.when(F.col("_has"), True).otherwise(F.raise_error(F.concat(F.lit(f"no partner for {on} "), F.col(on).cast("string"))).cast("boolean"))).where("_has").drop("_has")


def discordant(correct: DataFrame, item: str = "item", system: str = "system") -> DataFrame:
    """All unordered pairs of systems on the items both judged: first_only, second_only, both."""
    a, b = (correct.select(item, F.col(system).alias(f"{x}"), F.col("correct").alias(f"c{x}")) for x in ("first", "second"))
    return a.join(b, item).where("first < second").groupBy("first", "second").agg(F.count_if(F.expr("cfirst and not csecond")).alias("first_only"), F.count_if(F.expr("not cfirst and csecond")).alias("second_only"), F.count(F.lit(1)).alias("items"))


def with_mcnemar(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """Adds the exact p-value, the odds ratio of the discordant pairs and its limits."""
    low, high = stats.odds_limits("first_only", "second_only")
    p = stats.mcnemar_p(F.col("first_only"), F.col("second_only"))
    return pairs.select("*", F.round(p, digits).alias("p_value"), *(F.round(F.expr(e), digits).alias(n) for n, e in (("odds_ratio", stats.mcnemar_odds("first_only", "second_only")), ("odds_low", low), ("odds_high", high))))


def reweighted(judged: DataFrame, *by: str) -> DataFrame:
    """Horvitz-Thompson prevalence, recall and flag rate from inclusion probabilities."""
    w = 1 / F.when(F.col("pi") > 0, F.col("pi")).otherwise(F.raise_error(F.lit("inclusion probability must be positive")).cast("double"))
    s = judged.withColumn("_w", w).groupBy(*by).agg(
        F.sum("_w").alias("w"), F.sum(F.when(F.col("truth"), F.col("_w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("flagged"), F.col("_w")).otherwise(0.0)).alias("fl"),
        F.sum(F.when(F.col("truth") & F.col("flagged"), F.col("_w")).otherwise(0.0)).alias("hit"))
    return s.select(*by, F.round(F.try_divide("pos", "w"), 6).alias("prevalence"), F.round(F.try_divide("hit", "pos"), 6).alias("recall"), F.round(F.try_divide("fl", "w"), 6).alias("weighted_flag_rate"))


def threshold(scored: DataFrame, last: bool = True, buckets: int = 64) -> DataFrame:
    """(cut, j): the cut with the best Youden index when scores below it are flagged, from sorted running counts; of
    equally good cuts the highest (last) or lowest one.

    One row per distinct score is sorted, in buckets between approximate quantiles; a bucket begins with the counts of
    those before it, so no task sorts all scores."""
    by = scored.where("score is not null and not isnan(score)").groupBy("score").agg(F.count_if("truth").alias("p"), F.count_if(~F.col("truth")).alias("n"))
    cuts = by.agg(F.percentile_approx("score", [k / buckets for k in range(1, buckets)], 10_000).alias("_cuts"))  # one row
    dealt = by.crossJoin(cuts).withColumn("_b", F.greatest(F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("score"))), F.lit(0)), F.lit(0))).drop("_cuts")
    sums = dealt.groupBy(F.col("_b").alias("_k")).agg(F.sum("p").alias("_p"), F.sum("n").alias("_q"))
    all_ = Window.partitionBy(F.lit(1))  # a row per bucket
    before = all_.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_p", "_q")), F.sum("_p").over(all_).alias("_pos"), F.sum("_q").over(all_).alias("_neg"))
    run = Window.partitionBy("_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    j = dealt.withColumns({"tp": F.coalesce(F.sum("p").over(run), F.lit(0)), "fp": F.coalesce(F.sum("n").over(run), F.lit(0))}).join(F.broadcast(sums), F.col("_b") == F.col("_k"))  # as many rows as buckets
    j = j.withColumns({"tp": F.col("tp") + F.col("_p0"), "fp": F.col("fp") + F.col("_q0")})
    j = j.withColumn("j", F.round(F.expr(stats.youden("tp", "(_pos - tp)", "(_neg - fp)", "fp")), 12))
    tie = F.col("score") if last else -F.col("score")
    return j.agg(F.max(F.struct("j", tie.alias("t"), "score")).alias("m")).select(F.col("m.score").alias("cut"), F.col("m.j").alias("j"))


def gates(rows: DataFrame, required: int) -> DataFrame:
    """(model, eligible): all of the required gates pass."""
    return rows.groupBy("model").agg((F.bool_and("passes") & (F.count_distinct("gate") == required)).alias("eligible"))


def cascade(items: DataFrame, *by: str) -> DataFrame:
    """Seven configurations of rule, lookup, model and reader stages: flagged, caught and read shares of all items."""
    r, k, m, c = (F.coalesce(F.col(x), F.lit(False)) for x in ("rule_flag", "lookup_flag", "model_flag", "candidate"))
    stages = {"C0": (F.lit(True), F.lit(True)), "C1": (r, F.lit(False)), "C2": (r | k, F.lit(False)), "C3": (r | k | (c & m), F.lit(False)), "C4": (r | k | c, c & ~(r | k)), "C5": (r | k | (c & m), c & m & ~(r | k)), "C6": (m, F.lit(False))}
    counts = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("positives"), *(a for s, (flag, read) in stages.items() for a in (F.count_if(flag).alias(f"f{s}"), F.count_if(flag & F.col("truth")).alias(f"t{s}"), F.count_if(read).alias(f"r{s}"))))
    stack = ", ".join(f"'{s}', f{s}, t{s}, r{s}" for s in stages)
    return counts.selectExpr(*by, "n", "positives", f"stack({len(stages)}, {stack}) as (configuration, flagged, caught, read_by_hand)").withColumn("recall", F.round(F.expr("try_divide(caught, positives)"), 6)).withColumn("read_per_1000", F.round(F.expr("1000 * read_by_hand / n"), 6))


def winsorised(rows: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """Median, mean and mean with each reader's values capped at the order statistic int(n * share), to 4 digits."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    cap = ranked.where(F.col("_r") == F.least(F.floor(F.col("_n") * share) + 1, F.col("_n"))).select(by, F.col(value).alias("_cap"))
    return rows.join(cap, by).groupBy(by).agg(F.round(F.median(value), 4).alias("median"), F.round(F.avg(value), 4).alias("mean"), F.round(F.avg(F.least(value, "_cap")), 4).alias("winsorised_mean"))


def distinct_first(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
