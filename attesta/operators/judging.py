"""Runs of answers against truth: judged rows, scores by model, gates, costs, prevalence, bounds and artefacts of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import records as R
from attesta.functions import stats
from attesta.operators import scoring

#: The positive verdict, the decided labels, the level of significance and the donors' least name length.
WRONG, DECIDED, ALPHA, DONOR_CHARS = "wrong", ("belongs", "wrong"), 0.05, 6


def said_wrong(lenient: bool = False) -> Column:
    """The answer's verdict is positive; unless lenient, only where it satisfies its schema."""
    verdict = F.coalesce(F.col("parsed.verdict") == WRONG, F.lit(False))
    return verdict if lenient else verdict & F.coalesce("valid", F.lit(False))


def _judged(answers: DataFrame, truth: DataFrame, positive: Column, group: str, hit: Column, lenient: bool) -> DataFrame:
    both = scoring.strict_join(answers, truth, "item_id").withColumn("flagged", said_wrong(lenient))
    return both.select("run", "model", "item_id", "city", F.col(group).alias("grp"), positive.alias("truth"), "flagged", F.coalesce("valid", F.lit(False)).alias("valid"), hit.alias("field_hit"), *(["pi"] if "pi" in truth.columns else []))


def judge_detect(answers: DataFrame, items: DataFrame, lenient: bool = False) -> DataFrame:
    """run, model, item_id, city, grp (class), truth, flagged, valid, field_hit (of flagged corrupted items: whether the
    field is the corrupted one; else null). An answer without an item fails the job."""
    hit = F.when(F.col("corrupted") & F.col("flagged"), F.coalesce(F.col("parsed.field") == F.col("corrupted_field"), F.lit(False)))
    return _judged(answers, items, F.col("corrupted"), "class", hit, lenient)


def judge_name(answers: DataFrame, items: DataFrame, lenient: bool = False) -> DataFrame:
    return _judged(answers, items, F.col("corrupted"), "class", F.lit(None).cast("boolean"), lenient)


def judge_natural(answers: DataFrame, gold: DataFrame, core_only: bool = False, lenient: bool = False) -> DataFrame:
    """The same on gold labels (item_id, city, stratum, label, scored, decidable_core); unscored items are left out."""
    known = _judged(answers, gold, F.when(F.col("scored") & (F.col("decidable_core") | F.lit(not core_only)), F.coalesce(F.col("label") == WRONG, F.lit(False))), "stratum", F.lit(None).cast("boolean"), lenient)
    return known.where("truth is not null")


def judge_baseline(judged_records: DataFrame, items: DataFrame) -> DataFrame:
    """The rule baseline's verdicts (item_id, verdicts) as a model's judgements."""
    both = scoring.strict_join(items, judged_records.select("item_id", "verdicts"), "item_id")
    flags = F.filter("verdicts", lambda v: v["outcome"] == "flag")
    hit = F.when(F.col("corrupted") & (F.size(flags) > 0), F.exists(flags, lambda v: v["field"].eqNullSafe(F.col("corrupted_field"))))
    return both.select(F.lit("baseline").alias("run"), F.lit("rules").alias("model"), "item_id", "city", F.col("class").alias("grp"), F.col("corrupted").alias("truth"), (F.size(flags) > 0).alias("flagged"), F.lit(True).alias("valid"), hit.alias("field_hit"))


def scores(judged: DataFrame, *by: str) -> DataFrame:
    """A confusion with its measures, invalid answers and field accuracy by run, model (and more)."""
    t, f = F.col("truth"), F.col("flagged")
    counts = judged.groupBy("run", "model", *by).agg(
        *(F.count_if(c).alias(n) for n, c in (("tp", t & f), ("fn", t & ~f), ("tn", ~t & ~f), ("fp", ~t & f))),
        F.count_if(~F.col("valid")).alias("invalid"), F.count_if("field_hit").alias("field_hits"), F.count("field_hit").alias("field_attempts"))
    return scoring.with_measures(counts)


def pool_summary(scored: DataFrame, measures: dict[str, float], *by: str) -> DataFrame:
    """By group and measure: models, median, maximum, minimum and how many are below chance."""
    rows = scored.unpivot(list(by), list(measures), "quantity", "value").withColumn("chance", F.create_map(*(F.lit(x) for kv in measures.items() for x in kv))[F.col("quantity")])
    return rows.groupBy(*by, "quantity").agg(
        F.count(F.lit(1)).alias("models"), F.round(F.median("value"), 6).alias("median"), F.round(F.max("value"), 6).alias("maximum"),
        F.round(F.min("value"), 6).alias("minimum"), F.count_if(F.col("value") < F.col("chance")).alias("below_chance"))


def falls(before: DataFrame, after: DataFrame, *measures: str) -> DataFrame:
    """What models lose from one run to another, over those that are in both."""
    both = before.select("model", *(F.col(m).alias(f"b_{m}") for m in measures)).join(after.select("model", *measures), "model")
    rows = both.select("model", *((F.col(f"b_{m}") - F.col(m)).alias(m) for m in measures)).unpivot(["model"], list(measures), "quantity", "fall")
    return rows.groupBy("quantity").agg(F.count(F.lit(1)).alias("models"), F.round(F.median("fall"), 6).alias("median"), F.round(F.max("fall"), 6).alias("maximum"), F.round(F.min("fall"), 6).alias("minimum"), F.count_if(F.col("fall") <= 0).alias("not_lower"))


def against(judged: DataFrame, other: DataFrame, *by: str) -> DataFrame:
    """Each model against one other system (item_id, truth, flagged) on the items of both: discordant pairs, exact test,
    and passes: significantly better."""
    right = other.select("item_id", (F.col("truth") == F.col("flagged")).alias("_o"))
    own = F.col("truth") == F.col("flagged")
    pairs = judged.join(right, "item_id").groupBy("model", *by).agg(F.count_if(own & ~F.col("_o")).alias("first_only"), F.count_if(~own & F.col("_o")).alias("second_only"))
    better = (F.col("p_value") < ALPHA) & (F.col("first_only") > F.col("second_only"))
    return scoring.with_mcnemar(pairs).withColumn("passes", better)


def input_dependence(full: DataFrame, reduced: DataFrame, view: str = "view") -> DataFrame:
    """By model and reduced view: Youden's index on both, its drop, and an exact test on the items of both."""
    counts = "count_if(truth and flagged) tp, count_if(truth and not flagged) fn, count_if(not truth and not flagged) tn, count_if(not truth and flagged) fp".split(", ")
    j = F.round(F.expr(stats.youden("tp", "fn", "tn", "fp")), 6)
    index = lambda rows, *by: rows.groupBy("model", *by).agg(*map(F.expr, counts)).select("model", *by, j.alias("j"))
    right = full.select("model", "item_id", (F.col("truth") == F.col("flagged")).alias("_f"))
    own = F.col("truth") == F.col("flagged")
    pairs = reduced.join(right, ["model", "item_id"]).groupBy("model", view).agg(F.count_if(F.col("_f") & ~own).alias("first_only"), F.count_if(~F.col("_f") & own).alias("second_only"))
    both = scoring.with_mcnemar(pairs).join(index(full).withColumnRenamed("j", "j_full"), "model").join(index(reduced, view).withColumnRenamed("j", "j_reduced"), ["model", view])
    return both.withColumn("j_drop", F.round(F.col("j_full") - F.col("j_reduced"), 6)).withColumn("moves_with_input", F.col("p_value") < ALPHA)


def gate_rows(dominance: DataFrame, scored: DataFrame, dependence: DataFrame, kappa: DataFrame) -> DataFrame:
    """One long table (model, gate, value, low, high, p_value, passes) of the four gates; that of the labels has no model."""
    none = F.lit(None).cast("double")
    row = lambda df, gate, value, low, high, p, passes: df.select("model", F.lit(gate).alias("gate"), value.alias("value"), low.alias("low"), high.alias("high"), p.alias("p_value"), passes.alias("passes"))
    c = F.col
    rows = row(dominance, "baseline_dominance", c("odds_ratio"), none, none, c("p_value"), c("passes"))
    rows = rows.unionByName(row(scored, "flag_rate_correction", c("youden_j"), c("j_low"), c("j_high"), none, c("j_low") > 0))
    rows = rows.unionByName(row(dependence, "input_dependence", c("j_reduced"), none, none, c("p_value"), c("moves_with_input")))
    return rows.unionByName(row(kappa.withColumn("model", F.lit("")), "label_stability", c("kappa"), c("low"), c("high"), none, F.lit(None).cast("boolean")))


def cost_table(footprints: DataFrame, runs: DataFrame, scored: DataFrame, threshold_gb: float) -> DataFrame:
    """Models with a footprint, a run and a score: seconds a record, records an hour, and whether they fit the device."""
    both = footprints.join(runs, "model").join(scored, "model")
    hourly = F.round(F.try_divide(F.lit(3600.0), F.col("seconds"))).cast("long")
    return both.select("model", "footprint_gb", (F.col("footprint_gb") <= threshold_gb).alias("deployable"), F.round("seconds", 3).alias("seconds"), hourly.alias("records_per_hour"), "youden_j", "flag_rate")


def prevalence(records: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """Of drawn records (label, pi): raw and weighted shares of wrong names, and the bounds that undecided ones leave open.
    Records without a label are left out; a probability that isn't positive fails the job."""
    w = 1 / F.when(F.col("pi") > 0, F.col("pi")).otherwise(F.raise_error(F.lit("inclusion probability must be positive")).cast("double"))
    decided, wrong = F.col("label").isin(*DECIDED), F.col("label") == WRONG
    s = records.where("label is not null").withColumn("_w", w).groupBy(*by).agg(
        F.count_if(decided).alias("decided"), F.count_if(wrong).alias("wrong"), F.count_if(~decided).alias("cannot_say"),
        *(F.coalesce(F.sum(F.when(c, F.col("_w"))), F.lit(0.0)).alias(n) for n, c in (("wd", decided), ("ww", wrong), ("wu", ~decided))))
    raw = {"raw_prevalence": stats.wilson_point("wrong", "decided"), "raw_low": stats.wilson_low("wrong", "decided"), "raw_high": stats.wilson_high("wrong", "decided")}
    weighted = {"weighted_prevalence": "ww / wd", "bound_low": "ww / (wd + wu)", "bound_high": "(ww + wu) / (wd + wu)"}
    share = lambda e: F.coalesce(F.expr(f"try_divide({e.rsplit(' / ', 1)[0]}, {e.rsplit(' / ', 1)[1]})"), F.lit(0.0))
    return s.select(*by, "decided", "wrong", "cannot_say", *(F.round(F.when(F.col("decided") > 0, F.expr(e)), digits).alias(n) for n, e in raw.items()), *(F.round(share(e), digits).alias(n) for n, e in weighted.items()))


def cell_bounds(gold: DataFrame, cell: str) -> DataFrame:
    """(cell, upper): the upper limit of the share of wrong names by cell, from decided gold labels."""
    counts = gold.where(F.col("label").isin(*DECIDED)).groupBy(cell).agg(F.count_if(F.col("label") == WRONG).alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.select(cell, F.expr(stats.wilson_high("k", "n")).alias("upper"))


def precision_bounds(flags: DataFrame, bounds: DataFrame, cell: str, *by: str) -> DataFrame:
    """The most that a model's precision can be on unlabelled items, from its flags by cell; models without flags have none."""
    counts = flags.where("flagged").groupBy(*by, cell).agg(F.count(F.lit(1)).alias("f")).join(bounds, cell)
    return counts.groupBy(*by).agg(F.sum("f").alias("flags"), F.round(F.least(F.lit(1.0), F.sum(F.col("f") * F.col("upper")) / F.sum("f")), 6).alias("bound"))


def decoding_counts(answers: DataFrame, *by: str) -> DataFrame:
    """Answers, rejected ones (those that break their schema), and rejected ones whose verdict can still be read."""
    rejected = ~F.coalesce("valid", F.lit(False))
    readable = F.coalesce(F.col("parsed.verdict").isin(*DECIDED), F.lit(False))
    counts = answers.groupBy(*by).agg(F.count(F.lit(1)).alias("answers"), F.count_if(rejected).alias("rejected"), F.count_if(rejected & readable).alias("rejected_but_readable"))
    return counts.withColumn("rejected_rate", F.round(F.col("rejected") / F.col("answers"), 6))


def features(items: DataFrame, dictionary: Column) -> DataFrame:
    """Adds what a shortcut could read of an item (name, branded, repeated): name_chars, name_tokens, carries_category_token."""
    token = R.indicated_category(F.col("name"), dictionary).isNotNull()
    tokens = F.size(F.filter(F.split("name", " "), lambda x: x != ""))
    return items.withColumns({"name_chars": F.length("name"), "name_tokens": tokens, "carries_category_token": token, "short_name": F.length("name") < DONOR_CHARS})


def feature_shares(measured: DataFrame, *names: str) -> DataFrame:
    """By half and feature: items, those that carry it, and the share with its limits."""
    rows = measured.unpivot(["corrupted"], list(names), "feature", "has")
    counts = rows.groupBy(F.when(F.col("corrupted"), "corrupted").otherwise("clean").alias("half"), "feature").agg(F.count(F.lit(1)).alias("items"), F.count_if("has").alias("carrying"))
    limits = (("share", stats.wilson_point), ("low", stats.wilson_low), ("high", stats.wilson_high))
    return counts.select("*", *(F.round(F.expr(f("carrying", "items")), 6).alias(n) for n, f in limits))


def shortcut_scores(measured: DataFrame, shortcuts: dict[str, Column]) -> DataFrame:
    """How well each shortcut, taken as a flag, tells corrupted items from clean ones."""
    flags = F.explode(F.array(*(F.struct(F.lit(n).alias("shortcut"), F.coalesce(c, F.lit(False)).alias("flagged")) for n, c in shortcuts.items())))
    return scoring.with_measures(scoring.confusion(measured.select("corrupted", flags.alias("x")).select("corrupted", "x.*"), "shortcut", truth="corrupted"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two folded names by their sets of tokens; 0 where both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != "")) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))
