"""Append-only logs: the last action of a key, resuming, running stop rules and validated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The labels a reader may give.
LABELS = ("belongs", "wrong", "cannot_say")


def last_action(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key, combined before the shuffle."""
    rest = [c for c in events.columns if c not in (key, *order)]
    last = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return last.select(key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def unanswered(items: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    return items.join(answers.select(key).distinct(), key, "left_anti")


def stop_rule(answers: DataFrame, by: str, order: str, least: int = 40, share: float = 0.15) -> DataFrame:
    """(by, stopped_at): the first position at which more than `share` of at least `least` answers are invalid."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = answers.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_bad", F.count_if(~F.col("valid")).over(w))
    return run.where((F.col("_n") >= least) & (F.col("_bad") / F.col("_n") > share)).groupBy(by).agg(F.min("_n").alias("stopped_at"))


def valid_annotator(name: Column) -> Column:
    return name.rlike("^[a-z0-9][a-z0-9-]{1,30}$")


def valid_label(label: Column, source: Column, url: Column, no_source: Column) -> Column:
    """A known label with evidence, or without where that is stated."""
    return label.isin(*LABELS) & ((F.coalesce(source, F.lit("")) != "") | (F.coalesce(url, F.lit("")) != "") | F.coalesce(no_source, F.lit(False)))


def disagreements(labels: DataFrame, first: str, second: str) -> DataFrame:
    a, b = (labels.where(F.col("annotator") == x).select("item_id", F.col("label").alias(n)) for x, n in ((first, "label_a"), (second, "label_b")))
    return a.join(b, "item_id").where("label_a <> label_b")
