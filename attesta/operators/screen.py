"""Name screening: duplicates far apart, token contradictions, the token dictionary and rule priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.records import category_key, haversine_km

PRIORITY = ("gazetteer", "duplicate", "token")


def category_tokens(records: DataFrame, least_count: int = 20, least_share: float = 0.5) -> DataFrame:
    """(token, category, n, share): tokens of folded names whose most common category holds enough of their records."""
    tokens = records.select("category", F.explode(F.array_distinct(F.split("name", " "))).alias("token")).where("token <> ''")
    counts = tokens.groupBy("token", "category").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("token").agg(F.sum("n").alias("total"), F.max("n").alias("n"), F.min_by("category", F.struct((-F.col("n")).alias("m"), "category")).alias("category"))
    return best.where((F.col("total") >= least_count) & (F.col("n") / F.col("total") >= least_share)).select("token", "category", "total", (F.col("n") / F.col("total")).alias("share"))


def name_counts(records: DataFrame, *by: str) -> DataFrame:
    return records.where("name <> ''").groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"))


def duplicate_distant_name(records: DataFrame, key: str, group: str, km: float = 2.0, most: int = 3, other_key: bool = True) -> DataFrame:
    """(key, other, distance_km): the first other record of the same group and folded name, of another category (and
    top-level key), at least km away, where at most `most` records share the name."""
    shared = F.count(F.lit(1)).over(Window.partitionBy(group, "name"))
    few = records.where("name <> ''").withColumn("_n", shared).where((F.col("_n") <= most) & (F.col("_n") > 1)).drop("_n")
    other = few.select(group, "name", F.col(key).alias("other"), F.col("category").alias("o_category"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    both = few.join(other, [group, "name"]).where(F.col(key) != F.col("other")).where("category <> o_category")
    if other_key:
        both = both.where(category_key(F.col("category")) != category_key(F.col("o_category")))
    both = both.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))).where(F.col("distance_km") >= km)
    return both.groupBy(key).agg(F.min(F.struct("other", "distance_km")).alias("m")).select(key, "m.other", "m.distance_km")


def token_contradiction(indicated: Column, category: Column, other_key: bool = True) -> Column:
    hit = indicated.isNotNull() & (indicated != category)
    return F.coalesce(hit & (category_key(indicated) != category_key(category)) if other_key else hit, F.lit(False))


def owning_rule(rules: Column, priority: tuple[str, ...] = PRIORITY) -> Column:
    """The first rule of the priority list that hit, else the alphabetically first."""
    return F.coalesce(*(F.when(F.array_contains(rules, r), r) for r in priority), F.array_min(rules))


def clean_name_eligible(records: DataFrame, group: str, dictionary: Column, least: int = 6) -> DataFrame:
    """Records with a long enough name, unique in its group, without a dictionary token."""
    once = F.count(F.lit(1)).over(Window.partitionBy(group, "name")) == 1
    return records.withColumn("_u", once).where(F.col("_u") & (F.length("name") >= least) & ~F.exists(F.split("name", " "), lambda t: dictionary[t].isNotNull())).drop("_u")
