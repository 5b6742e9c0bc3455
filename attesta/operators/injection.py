"""Building injected and control sets: eligibility, donors drawn by keyed tries, pairs of one field signature, and the
counterfactual without the donors' exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import records as R
from attesta.functions import rules
from attesta.operators import corruption, sampling, spatial

#: Least name length and distances of donors.
DONOR_CHARS, DONOR_KM, CITY_DONOR_KM, TRIES = 6, 2.0, 100.0, 24


def eligible(tags: Column, name: Column, known_codes: Column, numeric_keys: tuple[str, ...]) -> dict[str, Column]:
    """Whether a record can carry each class of corruption."""
    has = lambda key: R.item_value(tags, key).isNotNull()
    return {
        "M1": (F.coalesce(name, F.lit("")) != "") & R.primary_category(tags).isNotNull(), "M2": F.coalesce(corruption.calling_code(R.item_value(tags, "phone"), known_codes).isNotNull(), F.lit(False)),
        "M3": has("addr:city"), "S1": has("phone"), "S2": has("opening_hours"), "S3": has("website"), "S4": R.numeric_tag(tags, numeric_keys).isNotNull(),
    }


def donor_pool(records: DataFrame, group: str, dictionary: Column | None = None) -> DataFrame:
    """Records (group, name, category, branded) whose name can be borrowed: long enough, the only one in its group, no
    brand's, with a category, and, where a dictionary is given, without a category token."""
    counts = records.groupBy(group, "name").agg(F.count(F.lit(1)).alias("_n"))
    fine = records.where((F.length("name") >= DONOR_CHARS) & ~F.col("branded") & F.col("category").isNotNull()).join(counts.where("_n = 1").drop("_n"), [group, "name"])
    return fine if dictionary is None else fine.where(~F.exists(F.split("name", " "), lambda t: dictionary[t].isNotNull()))


def drawn_donors(records: DataFrame, pool: DataFrame, key: str, group: str, fits: Column, seed: int = 42, tries: int = TRIES) -> DataFrame:
    """(key, donor columns): of a record's keyed tries into its group's pool the first that fits; records that none of
    `tries` fits have none. Each try is one join row, so no group is paired with itself, and a round's few tries are only made
    for records without a donor yet. Columns of the pool but `group` must not be among the records'."""
    numbered = pool.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy("donor")) - 1)
    size = pool.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), "_try", F.col(key).cast("string")).cast("binary"))
    own = [c for c in pool.columns if c != group]
    left, found, begin = records.join(size, group), [], 0
    while True:
        end = min(tries, 3 * begin + 1)
        asked = left.withColumn("_try", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        asked = asked.withColumn("_at", F.conv(F.substring(told, 1, 8), 16, 10).cast("long") % F.col("_size"))
        found.append(asked.join(numbered, [group, "_at"]).where(fits).groupBy(key).agg(F.min_by(F.struct(*own), "_try").alias("d")).localCheckpoint())
        if end == tries:
            break
        left = left.join(found[-1].select(F.col(key).alias("_done")), F.col(key).eqNullSafe(F.col("_done")), "left_anti").localCheckpoint()
        if left.isEmpty():
            break
        begin = end
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return all_.select(key, "d.*")


def name_donors(records: DataFrame, pool: DataFrame, key: str, group: str, km: float = DONOR_KM, seed: int = 42) -> DataFrame:
    """Donors of another category and folded name in the same group, at least km away."""
    d = pool.select(group, F.col(key).alias("donor"), F.col("name").alias("d_name"), F.col("category").alias("d_category"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    away = R.haversine_km(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    return drawn_donors(records, d, key, group, (F.col("donor") != F.col(key)) & (F.col("category") != F.col("d_category")) & (F.col("name") != F.col("d_name")) & (away >= km), seed)


def city_donors(records: DataFrame, places: DataFrame, key: str, group: str, near_km: float = 25.0, km: float = CITY_DONOR_KM, seed: int = 42) -> DataFrame:
    """Places of the record's country at least km away whose name no place within near_km bears."""
    near = spatial.names_near(records, places.select("p_lat", "p_lon", "names"), near_km, key).withColumnRenamed("names", "_near")
    d = places.select(group, F.col("place_id").alias("donor"), F.get("names", F.lit(0)).alias("d_name"), F.col("p_lat").alias("d_lat"), F.col("p_lon").alias("d_lon"))
    away = R.haversine_km(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    fits = (away >= km) & ~F.coalesce(F.array_contains("_near", F.col("d_name")), F.lit(False))
    return drawn_donors(records.join(near, key, "left"), d, key, group, fits, seed)


def counterfactual(corrupted: DataFrame, pool: DataFrame, dictionary: Column, key: str, group: str, seed: int = 42) -> DataFrame:
    """(outcome, n) of the category-token rule on names redrawn from a pool without the tokens' exclusion."""
    drawn = name_donors(corrupted, pool, key, group, seed=seed)
    verdict = rules.category_token(R.indicated_category(F.col("d_name"), dictionary), F.col("category"))
    return corrupted.select(key, "category").join(drawn, key).select(verdict["outcome"].alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def pairs(records: DataFrame, group: str, signature: str, count: Column | int, key: str, seed: int = 42) -> DataFrame:
    """At most `count` pairs of records of one group and field signature; one of each is to be corrupted. Adds pair_id,
    member (1 or 2) and corrupted."""
    both = sampling.matched_pairs(records, [group, signature], seed, key)
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:pair"), F.col(group).cast("string"), signature, "pair_no").cast("binary"))
    chosen = both.select(group, signature, "pair_no").distinct().withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(order, signature, "pair_no")))
    chosen = chosen.where(F.col("_at") <= count)
    out = both.join(chosen, [group, signature, "pair_no"]).withColumn("pair_id", F.concat_ws("-", F.col(group).cast("string"), F.lpad(F.col("_at").cast("string"), 4, "0")))
    return out.withColumn("member", F.when(F.col("corrupted"), 1).otherwise(2)).drop("_at", "pair_no")
