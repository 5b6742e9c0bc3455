"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations alone.

Every document gets a keyed hash of 60 bits of its id, source and text. Words are summed by source and hash bucket; in
the running sums each source's budget falls into one bucket, the boundary bucket. Documents below it are taken, those
above are not, and only the boundary bucket is split again, five times by 12 bits. Where rows agree in the whole hash
there (repeated rows), that bucket is split on by a hash of a number given to each of its rows. No document is sorted.

Targets: sources weigh 3, 1, 2, repeating in code point order (null last), and share 150 % of all words; a target
stops at twice its source's words and the excess is reshared by weight (water filling, in closed form). A source
takes each document `floor(target / words)` times and once more below the threshold, but never over `most` times.

Edge cases: a null text has size 0; null ids and sources count as values of their own; a source without words has
target 0; of repeated rows as many are taken as come nearest to the target, and which of those that differ in other
columns alone isn't defined; of the last row at the threshold nothing or all is taken, whichever is nearer; very long
texts count whole; columns of `docs` may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import saved, word_count

HASH_BITS, LEVEL_BITS = 60, 12
#: Of the rows at a threshold that agree in the whole hash, told apart by their numbers.
TIE_BITS = 48


def mix_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source meets here, nothing larger."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    cap = F.col("source_size") * most
    budget = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(share)
    filled = (
        ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap").cast("double") / F.col("w")).withColumn("budget", budget)
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("w_left"))
    )
    open_level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("level") < F.col("ratio"), open_level * F.col("w")).otherwise(F.col("cap").cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def _hash(seed: str, id_col: str, text_col: str, source_col: str) -> Column:
    told = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, source_col))
    key = F.concat_ws(":", F.lit(seed), *told, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _tie(number: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(1 << TIE_BITS))


def _times(h: Column, tie: Column, most: int, at: str = "") -> Column:
    """How many times a plan's row takes a document of this hash, at the threshold of this tie hash."""
    full, prefix, tied, rest, edge_n = (F.col(at + c) for c in ("full", "prefix", "tied", "rest", "edge_n"))
    last = (tie < tied) | ((tie == tied) & (rest * 2 >= edge_n) & (edge_n > 0))
    return F.least(full + F.when((h < prefix) | ((h == prefix) & last), 1).otherwise(0), F.lit(most)).cast("long")


def _refined(rows: DataFrame, plan: DataFrame, bits: int, label: str) -> DataFrame:
    """The plan (source, rest, ..) with prefix, the hash of `bits` bits in which the source's rest falls, what is left of
    the rest there, and its words and rows. rows: source, size, h."""
    plan = plan.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(bits // LEVEL_BITS):
        up = bits - LEVEL_BITS * level
        here = rows.join(plan.select(F.col("source").alias("s"), "prefix", "rest"), F.col("source").eqNullSafe(F.col("s")))
        if level:
            here = here.where(F.shiftright("h", up) == F.col("prefix"))
        buckets = here.groupBy("source", "prefix", "rest", F.shiftright("h", up - LEVEL_BITS).alias("next")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        run = buckets.withColumn("cum", F.sum("n").over(Window.partitionBy("source").orderBy("next")))  # at most 2^LEVEL_BITS rows a source
        edge = run.where("cum > rest").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("next", "cum", "n", "rows")).alias("x"))
        edge = edge.select("s", F.col("x.next").alias("next"), (F.col("x.cum") - F.col("x.n")).alias("below"), F.col("x.n").alias("edge_n"), F.col("x.rows").alias("edge_rows"))
        # a source that no bucket bounds (no words) keeps its prefix: nothing of it counts
        plan = plan.drop("edge_n", "edge_rows").join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            *(c for c in plan.columns if c not in ("prefix", "rest", "edge_n", "edge_rows")), F.coalesce("next", F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
            (F.col("rest") - F.coalesce("below", F.lit(0))).alias("rest"), F.coalesce("edge_n", F.lit(0)).alias("edge_n"), F.coalesce("edge_rows", F.lit(0)).alias("edge_rows"))
        plan = saved(plan, f"{label}{level}", 1)
    return plan


def _plan(docs: DataFrame, seed: str, weights: tuple[int, ...], share: float, most: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, hashes and numbers, and a row per source with its target and threshold."""
    h = _hash(seed, id_col, text_col, source_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"))
    sized = saved(sized.withColumn("number", F.monotonically_increasing_id()), "mix-sizes")
    totals = mix_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = saved(totals.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-plan", 1)
    return sized, _refined(sized, plan, HASH_BITS, "mix-level").withColumn("tied", F.lit(0).cast("long"))


def _untied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with a threshold among rows of the same hash, by their tie hashes. rows: source, size, h, tie."""
    edge = plan.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
    rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("p"))).select("source", "size", F.col("tie").alias("h"))
    split = _refined(rows, plan.drop("tied").withColumnRenamed("prefix", "whole"), TIE_BITS, "mix-tie")
    return split.withColumnRenamed("prefix", "tied").withColumnRenamed("whole", "prefix")


def _has_ties(plan: DataFrame) -> bool:
    return bool(plan.where("edge_rows > 1").head(1))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, times (copies taken), source."""
    sized, plan = _plan(docs, seed, weights, share, most, id_col, text_col, source_col)
    tie = F.lit(0).cast("long")
    if _has_ties(plan):
        plan, tie = _untied(sized.withColumn("tie", _tie(F.col("number"))), plan), _tie(F.col("number"))
    out = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("times", _times(F.col("h"), tie, most))
    return out.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times", "source")


def mixed_rows(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str | None = None) -> DataFrame:
    """The rows of `docs`, each as many times as mix() takes it, numbered from 1 in copy_col where given. Rows meet their
    source's threshold only; those that repeat there, if any, are written and numbered first."""
    _, plan = _plan(docs, seed, weights, share, most, id_col, text_col, source_col)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(source_col).alias("source"), _hash(seed, id_col, text_col, source_col).alias("h"))
    edge = plan.select(F.struct("source", "full", "prefix", "tied", "rest", "edge_n", "edge_rows").alias("plan"))
    met = rows.join(edge, F.col("source").eqNullSafe(F.col("plan.source")))

    def taken(met: DataFrame, tie: Column) -> DataFrame:
        n = met.withColumn("times", _times(F.col("h"), tie, most, "plan.").cast("int")).where("times > 0")
        return n.select("row.*", F.explode(F.sequence(F.lit(1), "times")).alias(copy_col)) if copy_col else n.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")

    none = F.lit(0).cast("long")
    if not _has_ties(plan):
        return taken(met, none)
    alike = (F.col("h") == F.col("plan.prefix")) & (F.col("plan.edge_rows") > 1)
    tied = saved(met.where(alike).select("row", "source", "h", F.monotonically_increasing_id().alias("number")), "mix-alike")
    finer = _untied(tied.select("source", "h", word_count(F.col("row")[text_col]).alias("size"), _tie(F.col("number")).alias("tie")), plan)
    finer = tied.join(finer.select(F.struct("source", "full", "prefix", "tied", "rest", "edge_n").alias("plan")), F.col("source").eqNullSafe(F.col("plan.source")))
    return taken(met.where(~alike), none).unionByName(taken(finer, _tie(F.col("number"))))
