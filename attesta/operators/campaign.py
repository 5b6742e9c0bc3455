"""Around the studies: choice of cities and models, control sets, matched subsets, arms, runs and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import records as R
from attesta.functions import stats
from attesta.operators import injection, judging, sampling, scoring

#: The share of invalid answers that a run may have, and how far reported and configured sizes may differ.
CEILING, TOLERANCE_B = 0.15, 0.1


def completeness(counts: DataFrame, *fields: str) -> DataFrame:
    """Adds completeness: the mean share in percent of a city's named records that carry each field; 0 without records."""
    share = sum((F.try_divide(F.col(f) * 100.0, F.col("named")) for f in fields), F.lit(0.0)) / len(fields)
    return counts.withColumn("completeness", F.round(F.coalesce(share, F.lit(0.0)), 2))


def select_cities(candidates: DataFrame, size: int, metric: str = "completeness", group: str = "language") -> DataFrame:
    """Of each group the `size` best and worst eligible cities, of distinct countries. (.., maturity, separated): separated
    says whether the two cells are full, share no city and don't overlap in the metric. Candidate cities are few."""
    rows = candidates.where("eligible")
    cells = []
    for name, order in (("mature", [F.col(metric).desc(), F.col("city")]), ("developing", [F.col(metric), F.col("city").desc()])):
        first = rows.withColumn("_c", F.row_number().over(Window.partitionBy(group, "country").orderBy(*order))).where("_c = 1").drop("_c")
        ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
        cells.append(ranked.where(F.col("_r") <= size).withColumn("maturity", F.lit(name)).drop("_r"))
    both = cells[0].unionByName(cells[1])
    mature = F.col("maturity") == "mature"
    fine = both.groupBy(group).agg(
        ((F.count_if(mature) == size) & (F.count_if(~mature) == size) & (F.count_distinct("city") == 2 * size) & (F.min(F.when(mature, F.col(metric))) > F.max(F.when(~mature, F.col(metric))))).alias("separated"))
    return both.join(fine, group)


def select_models(scored: DataFrame, score: str) -> DataFrame:
    """(role, model): the best and the median model, ties by name. One row per model is ranked."""
    all_ = Window.partitionBy(F.lit(1))
    ranked = scored.withColumn("_r", F.row_number().over(all_.orderBy(F.col(score).desc(), "model")) - 1).withColumn("_n", F.count(F.lit(1)).over(all_))
    roles = F.array_compact(F.array(F.when(F.col("_r") == 0, "best"), F.when(F.col("_r") == F.floor(F.col("_n") / 2), "median")))
    return ranked.select(F.explode(roles).alias("role"), "model")


def choose_version(scored: DataFrame, score: str) -> DataFrame:
    """(model, version): each model's best prompt version, the lower one of equals."""
    return scored.groupBy("model").agg(F.min_by("version", F.struct((-F.col(score)).alias("s"), "version")).alias("version"))


def matched_pairs_kept(items: DataFrame, dictionary: Column) -> DataFrame:
    """(pair_id): pairs whose clean member could have been a donor by its name: long enough, without a category token."""
    token = R.indicated_category(F.col("name"), dictionary).isNotNull()
    return items.where(~F.col("corrupted") & (F.length("name") >= judging.DONOR_CHARS) & ~token).select("pair_id").distinct()


def whole_and_subset(judged: DataFrame, kept: DataFrame, *by: str, key: str = "pair_id") -> DataFrame:
    """Measures of models on all items and on the kept ones: items and Youden's index of both, and its change. One pass."""
    rows = judged.join(kept.withColumn("_k", F.lit(True)), key, "left").withColumn("_k", F.coalesce("_k", F.lit(False)))
    part = F.explode(F.when(F.col("_k"), F.array(F.lit("whole"), F.lit("matched"))).otherwise(F.array(F.lit("whole"))))
    counts = scoring.confusion(rows.withColumn("part", part), *by, "part").withColumn("j", F.round(F.expr(stats.youden("tp", "fn", "tn", "fp")), 6)).withColumn("items", F.expr("tp + fn + tn + fp"))
    pick = lambda c, p: F.max(F.when(F.col("part") == p, F.col(c)))
    out = counts.groupBy(*by).agg(*(pick(c, p).alias(f"{c}_{p}") for c in ("items", "j") for p in ("whole", "matched")))
    return out.withColumn("j_change", F.round(F.col("j_matched") - F.col("j_whole"), 6))


def mutual_accuracy(readings: DataFrame) -> DataFrame:
    """Each reader's labels against the other's on items both decided: (predicted, reference, positives, balanced accuracy
    and its limits). readings: item, first, second."""
    decided = readings.where(F.col("first").isin(*judging.DECIDED) & F.col("second").isin(*judging.DECIDED))
    ways = F.explode(F.array(*(F.struct(F.lit(p).alias("predicted"), F.lit(r).alias("reference"), (F.col(r) == judging.WRONG).alias("truth"), (F.col(p) == judging.WRONG).alias("flagged")) for p, r in (("second", "first"), ("first", "second")))))
    counts = scoring.with_measures(scoring.confusion(decided.select(ways.alias("w")).select("w.*"), "predicted", "reference"))
    return counts.select("predicted", "reference", (F.col("tp") + F.col("fn")).alias("positives"), "balanced_accuracy", "ba_low", "ba_high")


def split_pairs(items: DataFrame, shares: dict[str, float], seed: int = 42, pair: str = "pair_id") -> DataFrame:
    """Adds split: pairs, not items, are dealt; only their ids are ranked."""
    return items.join(sampling.assign_splits(items.select(pair).distinct(), shares, seed, pair), pair)


def control_set(records: DataFrame, group: str, signature: str, dictionary: Column, key: str, count: int, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Pairs whose halves differ in the borrowed name alone: half of each group's records is withheld and gives the names,
    the other gives the pairs, whose own names must be such that they could be borrowed, too.

    Adds pair_id, member, corrupted, donor, shown_name and split; pairs without a donor are left out."""
    parted = sampling.split_share(records, [group], 0.5, seed, key)
    hidden, seen = parted.where("withheld").drop("withheld"), parted.where(~F.col("withheld")).drop("withheld")
    donors = injection.donor_pool(hidden, group, dictionary)
    fit = injection.donor_pool(seen, group, dictionary)
    pairs = injection.pairs(fit, group, signature, count, key, seed)
    given = injection.name_donors(pairs.where("corrupted"), donors, key, group, seed=seed).select(key, "donor", "d_name")
    both = pairs.join(given, key, "left")
    whole = both.where(F.col("donor").isNotNull()).select("pair_id").distinct()
    out = both.join(whole, "pair_id").withColumn("shown_name", F.coalesce("d_name", "name")).drop("d_name")
    return split_pairs(out, shares, seed)


def item_rows(records: DataFrame, stratum: str, probability: Column) -> DataFrame:
    """Drawn records as items: what the screen says of them, the matched place, and the fields they show. Records as
    baseline.screen_records gives them, with tags, lat and lon."""
    match = F.when(F.col("place_id").isNotNull(), F.struct("place_id", F.round("place_km", 1).alias("distance_km"), "same_country"))
    return records.withColumns({
        "stratum": F.lit(stratum), "inclusion_probability": F.round(probability, 8), "screen_positive": F.size("rules") > 0, "gazetteer_match": match,
        "carries_brand_tag": R.carries_brand_tag(F.col("tags")), "shown": R.item_view(F.col("tags"), F.col("lat"), F.col("lon")),
    })


def preexisting_flags(verdicts: Column) -> Column:
    """array<struct<check, field, detail>> of the flags that a record raised before anything was done to it."""
    return F.transform(F.filter(verdicts, lambda v: v["outcome"] == "flag"), lambda v: F.struct(v["check"].alias("check"), F.coalesce(v["field"], F.lit("")).alias("field"), v["detail"].alias("detail")))


def expected_yield(items: DataFrame, rates: DataFrame, labelled: int, cell: str) -> DataFrame:
    """(observed, expected): positives found among the first `labelled` positions, and with those to be expected of the rest."""
    rest = items.join(rates, cell, "left")
    return rest.agg(F.count_if((F.col("position") <= labelled) & F.col("positive")).alias("observed"), F.sum(F.when(F.col("position") <= labelled, F.col("positive").cast("double")).otherwise(F.coalesce("rate", F.lit(0.0)))).alias("expected"))


def compare_arms(plan: DataFrame, judged: DataFrame) -> DataFrame:
    """Each planned comparison (arm, arm_run, arm_model, base_run, base_model) on equal items: indices with limits, flag
    rates, discordant pairs and an exact test. Comparisons whose runs cover other items are left out."""
    side = lambda s: judged.select(F.col("run").alias(f"{s}_run"), F.col("model").alias(f"{s}_model"), "item_id", "truth", F.col("flagged").alias(f"{s}_f"))
    keys = ["arm", "arm_run", "arm_model", "base_run", "base_model"]
    a = plan.join(side("arm"), ["arm_run", "arm_model"])
    b = plan.join(side("base"), ["base_run", "base_model"])
    both = a.join(b, [*keys, "item_id", "truth"], "full_outer")
    right = lambda s: F.col("truth") == F.col(f"{s}_f")
    counts = lambda s: [F.count_if(c).alias(f"{s}_{n}") for n, c in (("tp", F.col("truth") & F.col(f"{s}_f")), ("fn", F.col("truth") & ~F.col(f"{s}_f")), ("tn", ~F.col("truth") & ~F.col(f"{s}_f")), ("fp", ~F.col("truth") & F.col(f"{s}_f")))]
    g = both.groupBy(*keys).agg(
        F.count_if(F.col("arm_f").isNull() | F.col("base_f").isNull()).alias("lone"), F.count(F.lit(1)).alias("items"), F.count_if(right("arm") & ~right("base")).alias("first_only"), F.count_if(~right("arm") & right("base")).alias("second_only"), *counts("arm"), *counts("base"))
    g = scoring.with_mcnemar(g.where("lone = 0").drop("lone"))
    out = g
    for s in ("arm", "base"):
        m = stats.measures(*(f"{s}_{n}" for n in ("tp", "fn", "tn", "fp")))
        out = out.withColumns({f"{s}_{n}": F.expr(m[n]) for n in ("youden_j", "j_low", "j_high", "flag_rate")})
    return out.drop(*(f"{s}_{n}" for s in ("arm", "base") for n in ("tp", "fn", "tn", "fp")))


def planned(models: DataFrame, runs: DataFrame) -> DataFrame:
    """Every run by every model: a plan of some hundred rows."""
    return models.crossJoin(runs)  # a plan: models by runs


def run_problems(plan: DataFrame, answers: DataFrame, summary: DataFrame, footprints: DataFrame) -> DataFrame:
    """(run, model, problem): runs without or with too few answers, with too many invalid ones, models on the host, and
    models that the summary lacks. plan: run, model, constrained, expected."""
    n = answers.groupBy("run", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("bad"))
    both = plan.join(n, ["run", "model"], "left")
    why = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "no answers"), F.when(F.col("n") != F.col("expected"), "other number of answers"),
        F.when(F.col("constrained") & (F.col("bad") / F.col("n") > CEILING), "too many invalid answers")))
    rows = both.select("run", "model", F.explode(why).alias("problem"))
    none = F.lit(None).cast("string").alias("run")
    host = footprints.where("offloaded").select(none, "model", F.lit("partly on the host").alias("problem"))
    absent = plan.select("model").distinct().join(summary.select("model").distinct(), "model", "left_anti").select(none, "model", F.lit("not in the summary").alias("problem"))
    return rows.unionByName(host).unionByName(absent)


def run_summary(answers: DataFrame) -> DataFrame:
    """By run and model: answers, invalid ones, median seconds, tokens a second and tokens, and all seconds; zeros and
    nulls are no measurements."""
    real = lambda c: F.when(F.col(c) > 0, F.col(c))
    return answers.groupBy("run", "model").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid"), F.round(F.median(real("total_sec")), 3).alias("median_total_sec"),
        F.round(F.median(real("tokens_per_sec")), 2).alias("median_tokens_per_sec"), F.round(F.median(real("output_tokens")), 1).alias("median_output_tokens"), F.round(F.sum(real("total_sec")), 1).alias("wall_sec")).withColumn("invalid_rate", F.round(F.col("invalid") / F.col("answers"), 4))


def timings(body: Column) -> dict[str, Column]:
    """Seconds, tokens and tokens a second from a server's answer in nanoseconds (a struct)."""
    sec = lambda c: F.round(body[c] / 1e9, 4)
    rate = F.when((body["eval_count"] > 0) & (body["eval_duration"] > 0), F.round(body["eval_count"] / (body["eval_duration"] / 1e9), 3))
    return {"prompt_tokens": body["prompt_eval_count"], "output_tokens": body["eval_count"], "load_sec": sec("load_duration"), "eval_sec": sec("eval_duration"), "total_sec": sec("total_duration"), "tokens_per_sec": rate}


def spent(answers: DataFrame, budget: float) -> DataFrame:
    """(model, cost, left): what the answers of a paid model cost; costs that are no numbers count as 0."""
    cost = F.coalesce(F.col("cost").try_cast("double"), F.lit(0.0))
    return answers.groupBy("model").agg(F.round(F.sum(cost), 6).alias("cost")).withColumn("left", F.round(F.lit(budget) - F.col("cost"), 6))


def parameters_b(raw: Column) -> Column:
    """Thousands of millions of parameters from texts like 7B, 350M or 1.5; null where there is none."""
    v = F.upper(F.trim(raw))
    n = F.regexp_replace(v, "[BM]$", "").try_cast("double")
    return F.round(F.when(v.endswith("M"), n * 0.001).otherwise(n), 3)


def classify_models(rows: DataFrame, threshold_gb: float, quantization: str) -> DataFrame:
    """Adds measured_class, as_expected and problem to models (footprint_gb, quantization, reported, configured_b, offloaded, expected_class)."""
    measured = F.when(F.col("footprint_gb") <= threshold_gb, "deployable").when(F.col("footprint_gb").isNotNull(), "reference")
    why = F.concat_ws("; ", *(F.when(c, t) for c, t in (
        (F.col("quantization") != quantization, "other quantization"), (F.abs(parameters_b(F.col("reported")) - F.col("configured_b")) > TOLERANCE_B, "other size"), (F.col("offloaded"), "partly on the host"))))
    return rows.withColumn("measured_class", measured).withColumn("as_expected", F.col("measured_class") == F.col("expected_class")).withColumn("problem", why)


def training_pairs(items: DataFrame, prompt: Column) -> DataFrame:
    """(item_id, messages): a prompt and the answer that the item's truth asks for, for adapters."""
    answer = F.concat(F.lit('{"verdict": "'), F.when(F.col("corrupted"), "wrong").otherwise("belongs"), F.lit('"}'))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return items.select("item_id", F.array(turn("user", prompt), turn("assistant", answer)).alias("messages"))
