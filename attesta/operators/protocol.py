"""Labelling and adjudication as validated event logs: every event is accepted or refused with a reason, and all states
follow from the accepted ones. A log is ordered by `position`; files are only ever appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.eventlog import LABELS, valid_annotator

#: What a decision may rest on, the label that asks for evidence, and the one that is always open to a meeting.
REASONS = ("source_positive_and_specific", "sources_conflict", "no_source_positive", "one_reader_consulted_no_source")
RUNS, EVIDENCE_FOR, UNDECIDED = ("main", "practice"), ("wrong",), "cannot_say"


def judged_labels(events: DataFrame) -> DataFrame:
    """Adds refusal (null: accepted) and no_source as it is recorded to events (kind, run, annotator, label,
    evidence_source, evidence_url, no_source)."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    consulted = said("evidence_source") | said("evidence_url")
    none = F.coalesce("no_source", F.lit(False))
    label = F.col("kind") == "label"
    cases = (
        (~F.coalesce(valid_annotator(F.col("annotator")), F.lit(False)), "not an annotator"), (~F.coalesce(F.col("run").isin(*RUNS), F.lit(False)), "unknown run"),
        (label & ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "unknown label"), (label & F.col("label").isin(*EVIDENCE_FOR) & ~consulted, "evidence required"),
        (label & ~consulted & ~none, "nothing stated"),
    )
    refusal = F.coalesce(*(F.when(c, text) for c, text in cases))
    return events.withColumn("refusal", refusal).withColumn("no_source", F.when(label, none & ~consulted))


def progress(judged: DataFrame, items: DataFrame) -> DataFrame:
    """(annotator, run, labelled, total, remaining, consented) from judged_labels() and the run's items (run, item_id)."""
    fine = judged.where("refusal is null")
    # consent is given once, whatever the run
    consent = fine.groupBy("annotator").agg(F.bool_or(F.col("kind") == "consent").alias("consented"))
    done = fine.groupBy("annotator", "run").agg(F.count_if(F.col("kind") == "label").alias("labelled"))
    total = items.groupBy("run").agg(F.count(F.lit(1)).alias("total"))
    both = done.join(consent, "annotator").join(total, "run")
    return both.select("annotator", "run", "labelled", "total", (F.col("total") - F.col("labelled")).alias("remaining"), "consented")


def next_items(judged: DataFrame, items: DataFrame) -> DataFrame:
    """(annotator, run, item_id): the first item, in order of ids, that an annotator hasn't come to; none when all are done.
    Items of a run are numbered in one window: as many as people can read."""
    numbered = items.withColumn("_at", F.row_number().over(Window.partitionBy("run").orderBy("item_id")) - 1)
    done = progress(judged, items).select("annotator", "run", F.col("labelled").alias("_at"))
    return done.join(numbered, ["run", "_at"]).select("annotator", "run", "item_id")


def complete_readers(judged: DataFrame, items: DataFrame, run: str = "main") -> DataFrame:
    return progress(judged, items).where((F.col("run") == run) & (F.col("remaining") == 0)).select("annotator")


def judged_actions(actions: DataFrame, disputed: DataFrame) -> DataFrame:
    """Adds refusal (null: accepted) to a meeting's actions (meeting, position, kind, item_id, label, reason).

    disputed: meeting, item_id, label_a, label_b. A meeting opens, decides each disputed item by one of its two readings or
    as undecided, may decide again, and closes when none is left; after that all is refused. One window per meeting: its
    actions are as many as two people can take."""
    total = disputed.groupBy("meeting").agg(F.count(F.lit(1)).alias("_total"))
    known = actions.join(total, "meeting", "left").join(disputed, ["meeting", "item_id"], "left")
    order = Window.partitionBy("meeting").orderBy("position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max(F.col("kind") == "opened").over(before), F.lit(False))
    allowed = F.col("label").eqNullSafe(UNDECIDED) | (F.col("label") == F.col("label_a")) | (F.col("label") == F.col("label_b"))
    fine = (F.col("kind") == "decision") & F.col("_opened") & F.coalesce(allowed, F.lit(False)) & F.col("label_a").isNotNull() & F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))
    known = known.withColumn("_opened", opened).withColumn("_fine", fine)
    first = F.col("_fine") & (F.sum(F.col("_fine").cast("int")).over(Window.partitionBy("meeting", "item_id").orderBy("position")) == 1)
    known = known.withColumn("_first", first)
    left = F.coalesce("_total", F.lit(0)) - F.coalesce(F.sum(F.col("_first").cast("int")).over(before), F.lit(0))
    known = known.withColumn("_left", left)
    closed = F.coalesce(F.max((F.col("kind") == "closed") & (F.col("_left") == 0)).over(before), F.lit(False))
    decision = F.col("kind") == "decision"
    cases = (
        (closed, "closed"), (decision & ~F.col("_opened"), "not opened"), (decision & F.col("label_a").isNull(), "not disputed"),
        (decision & ~F.coalesce(allowed, F.lit(False)), "a third reading"), (decision & ~F.coalesce(F.col("reason").isin(*REASONS), F.lit(False)), "unknown reason"),
        ((F.col("kind") == "closed") & (F.col("_left") > 0), "items undecided"),
    )
    return known.withColumn("refusal", F.coalesce(*(F.when(c, text) for c, text in cases))).select(*actions.columns, "refusal")


def decisions(judged: DataFrame) -> DataFrame:
    """(meeting, item_id, label, reason): the last accepted decision of each item."""
    last = judged.where("kind = 'decision' and refusal is null").groupBy("meeting", "item_id").agg(F.max_by(F.struct("label", "reason"), "position").alias("m"))
    return last.select("meeting", "item_id", "m.label", "m.reason")


def meeting_state(judged: DataFrame, disputed: DataFrame) -> DataFrame:
    """(meeting, opened, closed, decided, total)."""
    fine = judged.where("refusal is null")
    now = fine.groupBy("meeting").agg(F.bool_or(F.col("kind") == "opened").alias("opened"), F.bool_or(F.col("kind") == "closed").alias("closed"), F.count_distinct(F.when(F.col("kind") == "decision", F.col("item_id"))).alias("decided"))
    total = disputed.groupBy("meeting").agg(F.count(F.lit(1)).alias("total"))
    return total.join(now, "meeting", "left").select("meeting", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("opened", "closed")), F.coalesce("decided", F.lit(0)).cast("long").alias("decided"), "total")
