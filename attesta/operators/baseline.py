"""The composed rule baseline (format rules, then reference lookups) and the composed name screen in its two variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import records as R
from attesta.functions import rules
from attesta.operators import screen, spatial

#: The screen as it stands and as it was first written.
FINAL = {"km": 2.0, "other_key": True, "most": 3, "no_brands": True, "absent_km": 25.0, "least_chars": 4}
FIRST_PASS = {"km": 2.0, "other_key": False, "most": None, "no_brands": False, "absent_km": 25.0, "least_chars": 4}
MATCH_KM = 25.0


def format_rules(tags: Column) -> Column:
    """array of verdicts; a field that the record doesn't carry gives none."""
    of = lambda key, rule: F.when(R.item_value(tags, key).isNotNull(), rule(R.item_value(tags, key)))
    each = F.array(of("phone", rules.phone_syntax), of("opening_hours", rules.opening_hours_syntax), of("website", rules.website_syntax))
    return F.concat(F.array_compact(each), rules.value_range(tags))


def reference_lookups(tags: Column, code: Column, known_codes: Column, names_near: Column) -> Column:
    """array of verdicts, abstentions among them."""
    phone, city = R.item_value(tags, "phone"), R.item_value(tags, "addr:city")
    return F.array_compact(F.array(F.when(phone.isNotNull(), rules.phone_country_code(phone, code, known_codes)), F.when(city.isNotNull(), rules.address_city(city, names_near))))


def baseline(records: DataFrame, places: DataFrame, codes: DataFrame, key: str, km: float = MATCH_KM) -> DataFrame:
    """Adds format_verdicts, lookup_verdicts and flagged to records (key, country, tags, lat, lon).

    places: p_lat, p_lon, names (folded); codes: country, code, a dimension of some hundred rows, gathered into one array.
    Only records with an address city look for places around them."""
    known = codes.agg(F.collect_set("code").alias("_known"))
    with_city = records.where(R.item_value(F.col("tags"), "addr:city").isNotNull()).select(key, "lat", "lon")
    near = spatial.names_near(with_city, places.select("p_lat", "p_lon", "names"), km, key).withColumnRenamed("names", "_near")
    both = records.join(near, key, "left").join(codes.select("country", F.col("code").alias("_code")), "country", "left").crossJoin(known)  # one row
    out = both.withColumn("format_verdicts", format_rules(F.col("tags"))).withColumn("lookup_verdicts", reference_lookups(F.col("tags"), F.col("_code"), F.col("_known"), F.col("_near")))
    return out.withColumn("flagged", rules.flagged(F.concat("format_verdicts", "lookup_verdicts"))).drop("_near", "_code", "_known")


def distant_namesakes(records: DataFrame, key: str, group: str, km: float, most: int | None, other_key: bool) -> DataFrame:
    """(key) of records whose name another record of the group bears at least km away under another category (and key).

    A name's records are never paired: those of other categories are counted, and so are those of them that are near;
    where some are left, one is far."""
    kind = R.category_key(F.col("category")) if other_key else F.col("category")
    rows = records.where("name <> '' and category is not null").withColumn("_kind", kind)
    name, same = Window.partitionBy(group, "name"), Window.partitionBy(group, "name", "_kind")
    all_ = rows.withColumn("_all", F.count(F.lit(1)).over(name)).withColumn("_others", F.col("_all") - F.count(F.lit(1)).over(same)).where("_others > 0")
    if most is not None:
        all_ = all_.where(F.col("_all") <= most)
    other = all_.select(F.col(group).alias("_g"), F.col("name").alias("_n"), F.col("_kind").alias("_k"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = spatial.radius_join(all_, other, km, on=(F.col(group) == F.col("_g")) & (F.col("name") == F.col("_n")) & (F.col("_kind") != F.col("_k")))
    close = near.where(F.col("distance_km") < km).groupBy(key).agg(F.count(F.lit(1)).alias("_close"))
    return all_.join(close, key, "left").where(F.col("_others") > F.coalesce("_close", F.lit(0))).select(key)


def screen_records(records: DataFrame, dictionary: Column, places: DataFrame, key: str, group: str, settings: dict) -> DataFrame:
    """Adds rules (array of those that hit, in order), owner, place_id, place_km and same_country to records
    (key, group, name, category, branded, country, lat, lon), whose names are folded.

    dictionary: map of token to category; places: place_id, names, p_lat, p_lon, p_country."""
    unbranded = records.where(~F.col("branded")) if settings["no_brands"] else records
    far = distant_namesakes(records, key, group, settings["km"], settings["most"], settings["other_key"]).withColumn("_far", F.lit(True))
    matched = spatial.place_match(unbranded, places, settings["absent_km"], key, settings["least_chars"])
    matched = matched.join(places.select("place_id", "p_country"), "place_id").select(key, "place_id", F.col("distance_km").alias("place_km"), "p_country")
    out = records.join(far, key, "left").join(matched, key, "left")
    indicated = R.indicated_category(F.col("name"), dictionary)
    duplicate = F.coalesce("_far", F.lit(False)) & (~F.col("branded") if settings["no_brands"] else F.lit(True))
    hits = ((duplicate, "duplicate"), (screen.token_contradiction(indicated, F.col("category"), settings["other_key"]), "token"), (F.col("place_id").isNotNull(), "gazetteer"))
    out = out.withColumn("rules", F.array_compact(F.array(*(F.when(c, n) for c, n in hits))))
    return out.withColumn("owner", F.when(F.size("rules") > 0, screen.owning_rule(F.col("rules")))).withColumn("same_country", F.col("p_country") == F.col("country")).drop("_far", "p_country")
