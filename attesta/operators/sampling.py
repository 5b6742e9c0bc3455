"""Keyed sampling, apportionment and corruptions. Draws are ordered by md5 of a seed and a key: exact sizes, no
replacement, the same for any partitioning, and the same in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(seed: int | str, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def ranked(records: DataFrame, by: list[str], seed: int, *key: str) -> DataFrame:
    """Adds _r, the rank in keyed order within `by`, and _n, the group's size.

    A group is cut into 256 buckets by the first digits of its keyed hashes: rows are sorted within a bucket, and a bucket's
    offset is the number of rows in the group's earlier ones. So no group, however large, is sorted in one task."""
    hashed = records.withColumn("_h", keyed(seed, *by, *key)).withColumn("_b", F.substring("_h", 1, 2))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = hashed.groupBy(group.alias("_g"), F.col("_b").alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_g")  # at most 256 rows of a group
    offsets = counts.withColumn("_o", F.sum("_c").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).withColumn("_n", F.sum("_c").over(w))
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *key))
    inner = hashed.withColumn("_i", within)
    both = inner.join(offsets, group.eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_k")))
    return both.withColumn("_r", F.col("_i") + F.col("_o")).drop("_g", "_k", "_c", "_o", "_i", "_b", "_h")


def draw(records: DataFrame, by: list[str], quota: Column | int, seed: int, *key: str) -> DataFrame:
    """At most `quota` records of each stratum, with their inclusion probability (8 digits)."""
    quota = F.lit(quota) if isinstance(quota, int) else quota
    out = ranked(records, by, seed, *key).where(F.col("_r") <= quota).withColumn("inclusion_probability", F.round(F.least(quota / F.col("_n"), F.lit(1.0)), 8))
    return out.drop("_r", "_n")


def split_share(records: DataFrame, by: list[str], share: float, seed: int, *key: str) -> DataFrame:
    """Adds `withheld`: of each group the first floor(share * n) in keyed order."""
    return ranked(records, by, seed, *key).withColumn("withheld", F.col("_r") <= F.floor(F.col("_n") * share)).drop("_r", "_n")


def assign_splits(records: DataFrame, shares: dict[str, float], seed: int, *key: str) -> DataFrame:
    """Adds `split`: consecutive cuts of the keyed order, the last takes the remainder."""
    out, done, cuts = F.lit(list(shares)[-1]), F.lit(0), []
    for name in list(shares)[:-1]:
        done = done + F.round(F.col("_n") * shares[name]).cast("long")
        cuts.append((name, done))
    for name, end in reversed(cuts):
        out = F.when(F.col("_r") <= end, name).otherwise(out)
    return ranked(records, [], seed, *key).withColumn("split", out).drop("_r", "_n")


def equal_allocation(groups: DataFrame, total: int, seed: int, key: str) -> DataFrame:
    """(key, quota): total dealt evenly, the remainder to the first groups in keyed order."""
    all_, rank = Window.partitionBy(F.lit(1)), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(keyed(seed, key), key))
    k = F.count(F.lit(1)).over(all_)
    return groups.withColumn("quota", (F.floor(F.lit(total) / k) + F.when(rank <= F.lit(total) % k, 1).otherwise(0)).cast("long"))


def largest_remainder(groups: DataFrame, total: int, share: str, key: str) -> DataFrame:
    """(.., quota): apportionment by largest remainders of total * share, ties by key."""
    all_ = Window.partitionBy(F.lit(1))
    exact = F.col(share) * total
    rest = F.row_number().over(all_.orderBy((exact - F.floor(exact)).desc(), key))
    left = F.lit(total) - F.sum(F.floor(exact)).over(all_)
    return groups.withColumn("quota", (F.floor(exact) + F.when(rest <= left, 1).otherwise(0)).cast("long"))


def redistribute(quotas: dict[str, int], available: dict[str, int]) -> dict[str, int]:
    """Shortfalls go one by one to the groups with the most to spare (few groups, on the driver)."""
    out = {g: min(q, available[g]) for g, q in quotas.items()}
    for _ in range(sum(quotas.values()) - sum(out.values())):
        g = max(sorted(out), key=lambda x: available[x] - out[x])
        if available[g] <= out[g]:
            raise ValueError("fewer records than asked for")
        out[g] += 1
    return out


def matched_pairs(records: DataFrame, by: list[str], seed: int, *key: str) -> DataFrame:
    """Adds pair_no (within `by`) and corrupted: neighbours in keyed order pair up, a keyed coin corrupts one; odd ones out go."""
    r = ranked(records, by, seed, *key)
    r = r.where(F.col("_r") <= F.col("_n") - F.col("_n") % 2).withColumn("pair_no", F.floor((F.col("_r") - 1) / 2))
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *by, "pair_no")), 1, 1), 16, 10).cast("int") % 2
    return r.withColumn("corrupted", (F.col("_r") % 2) == coin).drop("_r", "_n")


def corrupt_website(url: Column, kind: Column) -> Column:
    """Five malformations by kind 0 to 4; each must be flagged by the website rule."""
    bare = F.regexp_replace(url, "^[a-zA-Z]+://", "")
    return (
        F.when(kind == 0, bare).when(kind == 1, F.concat(F.lit("https://http://"), bare)).when(kind == 2, F.concat(F.lit("https://"), F.lit("nodots/"), bare))
        .when(kind == 3, F.concat(F.lit("https:// "), bare)).otherwise(F.concat(F.lit("gopher://"), bare))
    )
