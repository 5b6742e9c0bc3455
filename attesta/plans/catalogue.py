"""One query per operator of the engine, each over whole tables, with the SQL that says the same in DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import records as R
from attesta.functions import rules, stats
from attesta.operators import agreement, eventlog, retrieval, sampling, scoring, screen, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tally(verdicts: DataFrame, *by: str) -> DataFrame:
    return verdicts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


# derived coordinates: the tables have none
LAT, LON = "({k} * 37 % 12000) / 100.0 - 60", "({k} * 91 % 34000) / 100.0 - 170"
HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians({p}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({p})) * power(sin(radians({q} - ({b})) / 2), 2))))"


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("nation"), F.expr(f"cast({LAT} as double)".format(k="c_custkey")).alias("lat"), F.expr(f"cast({LON} as double)".format(k="c_custkey")).alias("lon"), "c_mktsegment")


def places(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_nationkey").alias("nation"), F.expr("cast((s_suppkey * 53 + 11) * 37 % 12000 / 100.0 - 60 as double)").alias("p_lat"), F.expr("cast((s_suppkey * 53 + 11) * 91 % 34000 / 100.0 - 170 as double)").alias("p_lon"),
        F.expr("concat('source', s_suppkey % 2)").alias("source"), F.expr("array(concat('place ', s_suppkey % 37), concat('town ', s_suppkey % 11))").alias("names"))


GEO = f"""pts AS (SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment, ({LAT.format(k="c_custkey")})::DOUBLE AS lat, ({LON.format(k="c_custkey")})::DOUBLE AS lon FROM customer),
plc AS (SELECT s_suppkey AS place_id, s_nationkey AS nation, ((s_suppkey * 53 + 11) * 37 % 12000 / 100.0 - 60)::DOUBLE AS p_lat, ((s_suppkey * 53 + 11) * 91 % 34000 / 100.0 - 170)::DOUBLE AS p_lon,
  'source' || (s_suppkey % 2) AS source, ['place ' || (s_suppkey % 37), 'town ' || (s_suppkey % 11)] AS names FROM supplier),
near AS (SELECT *, {HAVERSINE.format(a="lat", b="lon", p="p_lat", q="p_lon")} AS km FROM pts, plc)"""

KM = 150


@query(f"WITH {GEO} SELECT id, place_id, round(km, 6) AS distance_km FROM near WHERE km <= {KM}")
def spatial_within(spark, d):
    near = spatial.radius_join(points(spark, d), places(spark, d).drop("nation"), KM)
    return near.select("id", "place_id", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {GEO} SELECT nation, count(*)::BIGINT AS covered FROM pts WHERE id IN (SELECT id FROM near WHERE km <= {KM}) GROUP BY nation")
def spatial_semi(spark, d):
    return spatial.has_nearby(points(spark, d), places(spark, d).drop("nation"), KM, "id").groupBy("nation").agg(F.count(F.lit(1)).alias("covered"))


@query(f"WITH {GEO}, c AS (SELECT DISTINCT id, source FROM near WHERE km <= {KM}) SELECT source, count(DISTINCT id)::BIGINT AS covered, (SELECT count(*) FROM pts)::BIGINT AS of FROM c GROUP BY source UNION ALL SELECT 'union', count(DISTINCT id)::BIGINT, (SELECT count(*) FROM pts)::BIGINT FROM c")
def spatial_coverage(spark, d):
    return spatial.coverage(points(spark, d), places(spark, d).drop("nation"), KM, "id")


@query(f"WITH {GEO} SELECT id, place_id, rank, round(km, 6) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, place_id)::INT AS rank FROM near WHERE km <= 400) WHERE rank <= 3")
def topk_nearest(spark, d):
    return spatial.topk_near(points(spark, d), places(spark, d).drop("nation"), 400, "id", 3, "place_id").select("id", "place_id", "rank", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {GEO} SELECT nation, count(*)::BIGINT AS n FROM (SELECT p.nation, {HAVERSINE.format(a='lat', b='lon', p='p_lat', q='p_lon')} AS km FROM pts p JOIN plc USING (nation)) WHERE km >= 2000 GROUP BY nation")
def far_places(spark, d):
    return spatial.far_counts(points(spark, d), places(spark, d), 2000, "nation")


@query(f"WITH {GEO}, r AS (SELECT *, 'place ' || (id % 50) AS name FROM pts), j AS (SELECT id, place_id, {HAVERSINE.format(a='lat', b='lon', p='p_lat', q='p_lon')} AS km FROM r JOIN (SELECT place_id, p_lat, p_lon, unnest(list_distinct(names)) AS name FROM plc) USING (name)) SELECT id, arg_min(place_id, (round(km, 9), place_id)) AS place_id, round(min(km), 6) AS distance_km FROM j GROUP BY id HAVING min(km) > 25")
def gazetteer_place_match(spark, d):
    named = points(spark, d).withColumn("name", F.concat(F.lit("place "), F.col("id") % 50))
    return spatial.place_match(named, places(spark, d), 25, "id", digits=9).select("id", "place_id", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {GEO}, n AS (SELECT id, list_distinct(flatten(list(names))) AS names FROM near WHERE km <= {KM} GROUP BY id) SELECT CASE WHEN names IS NULL THEN 'abstain' WHEN list_contains(names, 'town ' || (id % 11)) THEN 'pass' ELSE 'flag' END AS outcome, count(*)::BIGINT AS n FROM pts LEFT JOIN n USING (id) GROUP BY ALL")
def address_city_verdicts(spark, d):
    p = points(spark, d)
    names = spatial.names_near(p, places(spark, d).drop("nation"), KM, "id")
    v = p.join(names, "id", "left").select(rules.address_city(F.concat(F.lit("town "), F.col("id") % 11), F.col("names")).alias("v"))
    return tally(v.select("v.outcome"), "outcome")


# validation rules
_URL = """CASE page_id % 6 WHEN 0 THEN regexp_replace(url, '^[a-zA-Z]+://', '') WHEN 1 THEN 'https://http://' || regexp_replace(url, '^[a-zA-Z]+://', '')
 WHEN 2 THEN 'https://nodots/' || regexp_replace(url, '^[a-zA-Z]+://', '') WHEN 3 THEN 'https:// ' || regexp_replace(url, '^[a-zA-Z]+://', '') WHEN 4 THEN 'gopher://' || regexp_replace(url, '^[a-zA-Z]+://', '') ELSE url END"""


def corrupted_urls(spark, d) -> DataFrame:
    kind = F.col("page_id") % 6
    return t(spark, d, "pages").select("page_id", kind.alias("kind"), F.when(kind == 5, F.col("url")).otherwise(sampling.corrupt_website(F.col("url"), kind)).alias("website"))


@query(rf"""WITH u AS (SELECT trim({_URL}) AS v FROM pages),
v AS (SELECT CASE WHEN v = '' THEN 'flag' WHEN contains(v, ' ') THEN 'flag' WHEN NOT regexp_matches(v, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/\s?#]+)([^\s]*)$') THEN 'flag'
  WHEN lower(regexp_extract(v, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://', 1)) NOT IN ('http', 'https') THEN 'flag' WHEN contains(regexp_extract(v, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/\s?#]+([^\s]*)$', 1), '://') THEN 'flag'
  WHEN NOT regexp_matches(regexp_extract(v, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/\s?#]+)', 1), '^[A-Za-z0-9\-._~%]+(\.[A-Za-z0-9\-._~%]+)+(:[0-9]+)?$') THEN 'flag' ELSE 'pass' END AS outcome FROM u),
c AS (SELECT outcome, count(*)::BIGINT AS n, (SELECT count(*) FROM v)::BIGINT AS total FROM v GROUP BY outcome)
SELECT outcome, n, total, round({stats.wilson_point('n', 'total')}, 6) AS share, round({stats.wilson_low('n', 'total')}, 6) AS low, round({stats.wilson_high('n', 'total')}, 6) AS high FROM c""")
def website_verdicts(spark, d):
    v = corrupted_urls(spark, d).select(rules.website_syntax(F.col("website")).alias("v")).select("v.outcome")
    c = tally(v, "outcome")
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(total).select("outcome", "n", "total", *(F.round(F.expr(f("n", "total")), 6).alias(a) for a, f in (("share", stats.wilson_point), ("low", stats.wilson_low), ("high", stats.wilson_high))))  # one row


@query("SELECT page_id % 6 AS kind, count(*)::BIGINT AS n, CASE WHEN page_id % 6 = 5 THEN 0 ELSE count(*) END::BIGINT AS flags FROM pages GROUP BY page_id % 6")
def corruption_roundtrip(spark, d):
    v = corrupted_urls(spark, d).withColumn("v", rules.website_syntax(F.col("website")))
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v.outcome") == "flag").alias("flags"))


_PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


@query(rf"""WITH p AS (SELECT doc_id % 3 AS k, unnest(regexp_extract_all(text, '{_PHONE}')) AS v FROM documents),
x AS (SELECT trim(CASE k WHEN 0 THEN v WHEN 1 THEN v || 'kk' ELSE '+' || v END) AS v FROM p),
o AS (SELECT CASE WHEN v = '' THEN 'flag' WHEN NOT regexp_matches(v, '^[+0-9 ()\-./]+$') THEN 'flag' WHEN strpos(substr(v, 2), '+') > 0 THEN 'flag'
 WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) NOT BETWEEN 5 AND 15 THEN 'flag' ELSE 'pass' END AS outcome FROM x) SELECT outcome, count(*)::BIGINT AS n FROM o GROUP BY outcome""")
def phone_verdicts(spark, d):
    docs = t(spark, d, "documents").select((F.col("doc_id") % 3).alias("k"), F.explode(F.regexp_extract_all("text", F.lit(_PHONE), F.lit(0))).alias("v"))
    v = F.when(F.col("k") == 0, F.col("v")).when(F.col("k") == 1, F.concat("v", F.lit("kk"))).otherwise(F.concat(F.lit("+"), "v"))
    return tally(docs.select(rules.phone_syntax(v)["outcome"].alias("outcome")), "outcome")


_HOURS = ["Mo-Fr 09:00-17:00", "24/7", "Mo-Sa 08:00-12:00,13:00-18:00; Su off", "Mo-Fr 09:00-52:30", "opens in the morning", "Mo, Tu 09:00-17:00", "Mo-Fr", "Mo-Fr 09:00-17:00;", "99:99-12:00, 13:00-17:00",
    "24/7 open", "Su OFF", "Mo-Fr Closed", "closed , 09:00-17:00", "|| 08:00-09:60", "week 1-3 10:00 - 12:00", " || Off ;24/7", "10:00-12:00-14:00", "", "Mo  09:00-10:00,", "unknown,open"]
_N_HOURS = len(_HOURS)
# the grammar, evaluated on each value
_HOURS_SQL = rf"""v AS (SELECT {_HOURS!r}[event_id % {_N_HOURS} + 1] AS value FROM events), d AS (SELECT DISTINCT value, trim(value) AS s FROM v),
r AS (SELECT value, s, trim(ltrim(trim(unnest(string_split(s, ';'))), '|')) AS rule FROM d),
p AS (SELECT value, s, rule, strpos(rule, ' ') AS blank, unnest(string_split(CASE WHEN strpos(rule, ' ') > 0 THEN substr(rule, strpos(rule, ' ') + 1) ELSE rule END, ',')) AS span FROM r),
g AS (SELECT value, s = '24/7 open' OR rule = '24/7' OR (rule <> '' AND (blank = 0 OR regexp_matches(substr(rule, 1, blank - 1), '{rules.SELECTOR}'))
  AND (lower(trim(span)) IN {rules.STATES} OR (regexp_matches(trim(span), '{rules.TIMES}') AND coalesce(try_cast(regexp_extract(trim(span), '{rules.TIMES}', 1) AS INT) <= 48 AND try_cast(regexp_extract(trim(span), '{rules.TIMES}', 3) AS INT) <= 48
  AND try_cast(regexp_extract(trim(span), '{rules.TIMES}', 2) AS INT) <= 59 AND try_cast(regexp_extract(trim(span), '{rules.TIMES}', 4) AS INT) <= 59, false)))) AS ok FROM p),
o AS (SELECT value, CASE WHEN trim(value) <> '' AND bool_and(ok) THEN 'pass' ELSE 'flag' END AS outcome FROM g GROUP BY value)"""


def hours_values(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.element_at(F.array(*map(F.lit, _HOURS)), (F.col("event_id") % _N_HOURS + 1).cast("int")).alias("value"))


@query(f"WITH {_HOURS_SQL} SELECT value, outcome, count(*)::BIGINT AS n FROM v JOIN o USING (value) GROUP BY ALL")
def opening_hours_verdicts(spark, d):
    return hours_values(spark, d).select("value", rules.opening_hours_syntax(F.col("value"))["outcome"].alias("outcome")).groupBy("value", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT 'stars' AS field, (p_size % 12)::VARCHAR AS v, 1 AS lo, 7 AS hi FROM part UNION ALL SELECT 'height', CASE WHEN p_size % 7 = 0 THEN 'tall' ELSE (p_size / 40.0)::DECIMAL(18,3)::VARCHAR END, 0.5, 900 FROM part UNION ALL SELECT 'min_age', (p_size * 5 - 20)::VARCHAR, 0, 120 FROM part WHERE p_size % 2 = 0)
SELECT field, CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 'not a number' WHEN v::DOUBLE < lo OR v::DOUBLE > hi THEN 'outside the range' ELSE 'inside the range' END AS detail, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def value_range_verdicts(spark, d):
    tags = F.create_map(F.lit("stars"), (F.col("p_size") % 12).cast("string"), F.lit("height"), F.when(F.col("p_size") % 7 == 0, "tall").otherwise((F.col("p_size") / 40.0).cast("decimal(18,3)").cast("string")),
        F.lit("min_age"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") * 5 - 20).cast("string")))
    v = t(spark, d, "part").select(tags.alias("tags")).select(F.inline(rules.value_range(F.col("tags"))))
    return v.groupBy("field", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT 1 + c_nationkey * 7 AS own, CASE c_custkey % 4 WHEN 0 THEN '0' ELSE '+' END || (1 + ((c_nationkey + CASE c_custkey % 4 WHEN 3 THEN 1 ELSE 0 END) % 25) * 7) || ' 5550134' AS v FROM customer),
m AS (SELECT own, v, (SELECT max(1 + n_nationkey * 7) FROM nation WHERE starts_with(regexp_replace(v, '[^0-9]', '', 'g'), (1 + n_nationkey * 7)::VARCHAR)) AS prefix FROM x)
SELECT CASE WHEN NOT starts_with(v, '+') THEN 'abstain' WHEN prefix <> own THEN 'flag' ELSE 'pass' END AS outcome, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def calling_code_check(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (1 + F.col("n_nationkey") * 7).alias("code"))
    codes = nation.agg(F.collect_list("code").alias("codes"))  # one row: the dimension of calling codes
    x = t(spark, d, "customer").join(F.broadcast(nation), "c_nationkey").crossJoin(F.broadcast(codes))
    used = 1 + ((F.col("c_nationkey") + F.when(F.col("c_custkey") % 4 == 3, 1).otherwise(0)) % 25) * 7
    v = F.concat(F.when(F.col("c_custkey") % 4 == 0, "0").otherwise("+"), used.cast("string"), F.lit(" 5550134"))
    return tally(x.select(rules.phone_country_code(v, F.col("code"), F.col("codes"))["outcome"].alias("outcome")), "outcome")


# records and tokens
def part_records(spark, d) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("shop="), F.lower("p_type")).alias("category"), F.col("p_brand").alias("grp"),
        F.expr(f"cast({LAT} as double)".format(k="p_partkey")).alias("lat"), F.expr(f"cast({LON} as double)".format(k="p_partkey")).alias("lon"), "p_size", "p_type")


@query("""WITH k AS (SELECT list_distinct(string_split(p_name, ' ')) AS ts, 'shop=' || lower(p_type) AS category FROM part), c AS (SELECT token, category, count(*) AS n FROM (SELECT unnest(ts) AS token, category FROM k) WHERE token <> '' GROUP BY ALL),
b AS (SELECT token, sum(n)::BIGINT AS total, max(n) AS n, arg_min(category, (-n, category)) AS category FROM c GROUP BY token) SELECT token, category, total, round(n / total, 6) AS share FROM b WHERE total >= 20 AND n / total >= 0.15""")
def category_tokens(spark, d):
    return screen.category_tokens(part_records(spark, d), 20, 0.15).select("token", "category", "total", F.round("share", 6).alias("share"))


@query("""WITH dict(token, cat) AS (VALUES ('ring', 'shop=economy'), ('widget', 'shop=promo')), x AS (SELECT p_partkey, 'shop=' || lower(p_type) AS category, (SELECT arg_min(cat, list_position(string_split(p_name, ' '), token)) FROM dict WHERE list_contains(string_split(p_name, ' '), token)) AS ind FROM part)
SELECT CASE WHEN ind IS NULL THEN 'abstain' WHEN ind <> category THEN 'flag' ELSE 'pass' END AS outcome, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def token_contradiction(spark, d):
    dictionary = F.create_map(F.lit("ring"), F.lit("shop=economy"), F.lit("widget"), F.lit("shop=promo"))
    r = part_records(spark, d)
    return tally(r.select(rules.category_token(R.indicated_category(F.col("name"), dictionary), F.col("category"))["outcome"].alias("outcome")), "outcome")


@query("SELECT p_brand AS grp, p_name AS name, count(*)::BIGINT AS n FROM part WHERE p_name <> '' GROUP BY ALL")
def name_counts(spark, d):
    return screen.name_counts(part_records(spark, d), "grp")


@query(f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS grp, 'shop=' || lower(p_type) AS category, ({LAT.format(k='p_partkey')})::DOUBLE AS lat, ({LON.format(k='p_partkey')})::DOUBLE AS lon, count(*) OVER (PARTITION BY p_brand, p_name) AS c FROM part),
j AS (SELECT a.id, b.id AS other, {HAVERSINE.format(a='a.lat', b='a.lon', p='b.lat', q='b.lon')} AS km FROM p a JOIN p b ON a.grp = b.grp AND a.name = b.name AND a.id <> b.id AND a.category <> b.category WHERE a.c <= 3)
SELECT id, min(other) AS other, round(arg_min(km, other), 6) AS distance_km FROM j WHERE km >= 2 GROUP BY id""")
def duplicate_distant_name(spark, d):
    return screen.duplicate_distant_name(part_records(spark, d), "id", "grp", other_key=False).select("id", "other", F.round("distance_km", 6).alias("distance_km"))


@query("""WITH h AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN 'duplicate' END, CASE WHEN p_size % 3 = 0 THEN 'token' END, CASE WHEN p_size % 5 = 0 THEN 'gazetteer' END], lambda x: x IS NOT NULL) AS r FROM part)
SELECT CASE WHEN list_contains(r, 'gazetteer') THEN 'gazetteer' WHEN list_contains(r, 'duplicate') THEN 'duplicate' ELSE 'token' END AS rule, count(*)::BIGINT AS n FROM h WHERE len(r) > 0 GROUP BY ALL""")
def owning_rule_counts(spark, d):
    hits = F.array_compact(F.array(*(F.when(F.col("p_size") % k == 0, F.lit(n)) for k, n in ((2, "duplicate"), (3, "token"), (5, "gazetteer")))))
    return tally(t(spark, d, "part").select(hits.alias("r")).where(F.size("r") > 0).select(screen.owning_rule(F.col("r")).alias("rule")), "rule")


@query("""SELECT p_brand AS grp, count(*)::BIGINT AS frame, count(*) FILTER (p_size % 2 = 0)::BIGINT AS duplicate, count(*) FILTER (p_size % 3 = 0)::BIGINT AS token, count(*) FILTER (p_size % 5 = 0)::BIGINT AS gazetteer FROM part GROUP BY p_brand
UNION ALL SELECT 'all', count(*), count(*) FILTER (p_size % 2 = 0), count(*) FILTER (p_size % 3 = 0), count(*) FILTER (p_size % 5 = 0) FROM part""")
def screen_rollup(spark, d):
    counts = t(spark, d, "part").rollup("p_brand").agg(F.count(F.lit(1)).alias("frame"), *(F.count_if(F.col("p_size") % k == 0).alias(n) for k, n in ((2, "duplicate"), (3, "token"), (5, "gazetteer"))), F.grouping("p_brand").alias("g"))
    return counts.select(F.when(F.col("g") == 1, "all").otherwise(F.col("p_brand")).alias("grp"), "frame", "duplicate", "token", "gazetteer")


_SIG = "list_filter([CASE WHEN p_name <> '' THEN 'name' END, 'category', CASE WHEN p_size % 2 = 0 THEN 'phone' END, CASE WHEN p_size % 3 = 0 THEN 'website' END, CASE WHEN p_size % 5 = 0 THEN 'stars' END], lambda x: x IS NOT NULL)"


def tagged_parts(spark, d) -> DataFrame:
    p = F.col("p_size")
    tags = F.create_map(F.lit("name"), F.col("p_name"), F.lit("shop"), F.lower("p_type"), F.lit("contact:phone"), F.when(p % 2 == 0, "+1").otherwise(""), F.lit("website"), F.when(p % 3 == 0, "https://a.b"), F.lit("stars"), F.when(p % 5 == 0, p.cast("string")).otherwise("many"))
    return t(spark, d, "part").select("p_partkey", tags.alias("tags"))


@query(f"SELECT array_to_string({_SIG}, ',') AS signature, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def field_signature_counts(spark, d):
    return tally(tagged_parts(spark, d).select(F.concat_ws(",", R.field_signature(F.col("tags"), ("stars", "rooms"))).alias("signature")), "signature")


@query("SELECT 'shop=' || lower(p_type) AS category, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def primary_category(spark, d):
    return tally(tagged_parts(spark, d).select(R.primary_category(F.col("tags")).alias("category")), "category")


# sampling
@query("SELECT doc_id, source, inclusion_probability FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || coalesce(source, '') || ':' || doc_id), doc_id) AS r, round(least(5.0 / count(*) OVER (PARTITION BY source), 1.0), 8) AS inclusion_probability FROM documents) WHERE r <= 5")
def stratified_draw(spark, d):
    return sampling.draw(t(spark, d, "documents").select("doc_id", "source"), ["source"], 5, 42, "doc_id")


@query("SELECT source, withheld, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(source, '') || ':' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.5) AS withheld FROM documents) GROUP BY ALL")
def withheld_split(spark, d):
    s = sampling.split_share(t(spark, d, "documents").select("doc_id", "source"), ["source"], 0.5, 7, "doc_id")
    return s.groupBy("source", "withheld").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT source, (floor(473 / k) + CASE WHEN r <= 473 % k THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents))")
def equal_allocation(spark, d):
    return sampling.equal_allocation(t(spark, d, "documents").select("source").distinct(), 473, 42, "source")


@query("WITH s AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang) SELECT lang, (floor(share * 101) + CASE WHEN row_number() OVER (ORDER BY share * 101 - floor(share * 101) DESC, lang) <= 101 - sum(floor(share * 101)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM s")
def largest_remainder(spark, d):
    docs = t(spark, d, "documents")
    share = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).crossJoin(docs.agg(F.count(F.lit(1)).alias("of"))).select("lang", (F.col("n") / F.col("of")).alias("share"))  # one row
    return sampling.largest_remainder(share, 101, "share", "lang").select("lang", "quota")


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY md5('42:' || p_brand || ':' || p_size || ':' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)
SELECT p_partkey, p_brand, p_size, floor((r - 1) / 2)::BIGINT AS pair_no, r % 2 = ('0x' || substr(md5('42:' || p_brand || ':' || p_size || ':' || floor((r - 1) / 2)::BIGINT), 1, 1))::INT % 2 AS corrupted FROM r WHERE r <= n - n % 2""")
def matched_pairs(spark, d):
    return sampling.matched_pairs(t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], 42, "p_partkey")


# judgements: documents with labels, detectors derived from their sizes
_JUDGED = "SELECT l.doc_id, lang, source, quality = 0 AS truth, n_chars < 500 AS d1, n_chars % 3 = 0 AS d2, doc_id % 2 = 0 AS d3 FROM labels l JOIN documents USING (doc_id)"


def judged(spark, d) -> DataFrame:
    both = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return both.select("doc_id", "lang", "source", (F.col("quality") == 0).alias("truth"), (F.col("n_chars") < 500).alias("d1"), (F.col("n_chars") % 3 == 0).alias("d2"), (F.col("doc_id") % 2 == 0).alias("d3"))


_COUNTS = ", ".join(f"count(*) FILTER ({c})::BIGINT AS {n}" for n, c in (("tp", "truth AND {f}"), ("fn", "truth AND NOT {f}"), ("tn", "NOT truth AND NOT {f}"), ("fp", "NOT truth AND {f}")))


@query(f"WITH j AS ({_JUDGED}), c AS (SELECT lang, {_COUNTS.format(f='d1')} FROM j GROUP BY lang) SELECT *, {', '.join(f'{e} AS {n}' for n, e in stats.measures().items())} FROM c")
def confusion_by_group(spark, d):
    return scoring.with_measures(scoring.confusion(judged(spark, d), "lang", flag="d1"))


def long_form(spark, d) -> DataFrame:
    return judged(spark, d).unpivot(["doc_id", "lang", "source", "truth"], ["d1", "d2", "d3"], "system", "flagged").withColumn("correct", F.col("truth") == F.col("flagged")).withColumnRenamed("doc_id", "item")


_LONG = f"l AS (SELECT doc_id AS item, source, truth, system, flagged, truth = flagged AS correct FROM ({_JUDGED}) UNPIVOT (flagged FOR system IN (d1, d2, d3)))"


@query(f"""WITH {_LONG}, p AS (SELECT a.system AS first, b.system AS second, count(*) FILTER (a.correct AND NOT b.correct)::BIGINT AS first_only, count(*) FILTER (NOT a.correct AND b.correct)::BIGINT AS second_only, count(*)::BIGINT AS items FROM l a JOIN l b ON a.item = b.item AND a.system < b.system GROUP BY ALL),
k AS (SELECT *, least(first_only, second_only) AS m, first_only + second_only AS n FROM p),
lt AS (SELECT first, second, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM k, unnest(range(0, m + 1)) AS r(i) GROUP BY ALL)
SELECT first, second, first_only, second_only, items, round(CASE WHEN first_only = second_only THEN 1 ELSE least(1, 2 * tail) END, 6) AS p_value, round({stats.mcnemar_odds('first_only', 'second_only')}, 6) AS odds_ratio, round({stats.odds_limits('first_only', 'second_only')[0]}, 6) AS odds_low, round({stats.odds_limits('first_only', 'second_only')[1]}, 6) AS odds_high FROM k JOIN lt USING (first, second)""")
def pairwise_mcnemar(spark, d):
    return scoring.with_mcnemar(scoring.discordant(long_form(spark, d)))


@query(f"""WITH j AS (SELECT *, 1 / (CASE lang WHEN 'en' THEN 0.2 WHEN 'fr' THEN 0.5 ELSE 0.8 END)::DOUBLE AS w FROM ({_JUDGED})) SELECT source, round(sum(CASE WHEN truth THEN w ELSE 0 END) / sum(w), 6) AS prevalence,
round(sum(CASE WHEN truth AND d1 THEN w ELSE 0 END) / nullif(sum(CASE WHEN truth THEN w ELSE 0 END), 0), 6) AS recall, round(sum(CASE WHEN d1 THEN w ELSE 0 END) / sum(w), 6) AS weighted_flag_rate FROM j GROUP BY source""")
def reweighted_prevalence(spark, d):
    pi = F.when(F.col("lang") == "en", 0.2).when(F.col("lang") == "fr", 0.5).otherwise(0.8)
    return scoring.reweighted(judged(spark, d).withColumn("pi", pi).withColumnRenamed("d1", "flagged"), "source")


@query("SELECT lang, source, count(*)::BIGINT AS n, count(*) FILTER (quality = 0)::BIGINT AS bad FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))")
def prevalence_grouping_sets(spark, d):
    both = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return both.groupingSets([[], [F.col("lang")], [F.col("source")]], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("bad"))


def _threshold_sql(last: bool) -> str:
    return f"""WITH s AS (SELECT n_chars::DOUBLE AS score, quality = 0 AS truth FROM labels JOIN documents USING (doc_id)), b AS (SELECT score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM s GROUP BY score),
r AS (SELECT score, coalesce(sum(p) OVER w, 0) AS tp, coalesce(sum(n) OVER w, 0) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM b WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT score, round({stats.youden('tp', '(pp - tp)', '(nn - fp)', 'fp')}, 12) AS j FROM r) SELECT score AS cut, j FROM j ORDER BY j DESC, score {'DESC' if last else 'ASC'} LIMIT 1"""


def scored(spark, d) -> DataFrame:
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 0).alias("truth"))


@query(_threshold_sql(True))
def oracle_threshold(spark, d):
    return scoring.threshold(scored(spark, d))


@query(_threshold_sql(False))
def oracle_cut(spark, d):
    return scoring.threshold(scored(spark, d), last=False)


@query(f"""WITH i AS (SELECT lang, truth, d1 AS rule_flag, d2 AS lookup_flag, d3 AS candidate, d1 OR d3 AS model_flag FROM ({_JUDGED})),
s AS (SELECT lang, truth, unnest(['C0','C1','C2','C3','C4','C5','C6']) AS configuration, unnest([true, rule_flag, rule_flag OR lookup_flag, rule_flag OR lookup_flag OR (candidate AND model_flag), rule_flag OR lookup_flag OR candidate, rule_flag OR lookup_flag OR (candidate AND model_flag), model_flag]) AS f,
 unnest([true, false, false, false, candidate AND NOT (rule_flag OR lookup_flag), candidate AND model_flag AND NOT (rule_flag OR lookup_flag), false]) AS r FROM i)
SELECT lang, configuration, count(*)::BIGINT AS n, count(*) FILTER (truth)::BIGINT AS positives, count(*) FILTER (f)::BIGINT AS flagged, count(*) FILTER (f AND truth)::BIGINT AS caught, count(*) FILTER (r)::BIGINT AS read_by_hand,
 round(count(*) FILTER (f AND truth)::DOUBLE / nullif(count(*) FILTER (truth), 0), 6) AS recall, round(1000 * count(*) FILTER (r)::DOUBLE / count(*), 6) AS read_per_1000 FROM s GROUP BY ALL""")
def cascade(spark, d):
    i = judged(spark, d).select("lang", "truth", F.col("d1").alias("rule_flag"), F.col("d2").alias("lookup_flag"), F.col("d3").alias("candidate"), (F.col("d1") | F.col("d3")).alias("model_flag"))
    return scoring.cascade(i, "lang")


@query(f"WITH {_LONG}, g AS (SELECT system AS model, 'accuracy' AS gate, avg(correct::INT) > 0.5 AS passes FROM l GROUP BY ALL UNION ALL SELECT system, 'flags', count(*) FILTER (flagged) > 0 FROM l GROUP BY ALL) SELECT model, bool_and(passes) AND count(DISTINCT gate) = 2 AS eligible FROM g GROUP BY model")
def gates_union(spark, d):
    l = long_form(spark, d).withColumnRenamed("system", "model")  # noqa: E741
    rows = l.groupBy("model").agg((F.avg(F.col("correct").cast("int")) > 0.5).alias("passes")).withColumn("gate", F.lit("accuracy"))
    return scoring.gates(rows.unionByName(l.groupBy("model").agg((F.count_if("flagged") > 0).alias("passes")).withColumn("gate", F.lit("flags"))), 2)


@query(f"WITH {_LONG}, p AS (PIVOT (SELECT source, system, correct::INT AS c FROM l) ON system IN ('d1', 'd2', 'd3') USING round(avg(c), 6)) SELECT source, d1, d2, d3 FROM p UNION ALL SELECT 'median', round(median(d1), 6), round(median(d2), 6), round(median(d3), 6) FROM p")
def view_pivot(spark, d):
    p = long_form(spark, d).withColumn("c", F.col("correct").cast("int")).groupBy("source").pivot("system", ["d1", "d2", "d3"]).agg(F.round(F.avg("c"), 6))
    return p.unionByName(p.agg(*(F.round(F.median(c), 6).alias(c) for c in ("d1", "d2", "d3"))).withColumn("source", F.lit("median")))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), c AS (SELECT user_id, value AS cap FROM r WHERE r = least(floor(n * 0.95) + 1, n))
SELECT user_id, round(median(value), 4) AS median, round(avg(value), 4) AS mean, round(avg(least(value, cap)), 4) AS winsorised_mean FROM events JOIN c USING (user_id) GROUP BY user_id""")
def winsorised_reader_time(spark, d):
    return scoring.winsorised(t(spark, d, "events").select("user_id", "value"), "user_id", "value")


# agreement
_READERS = "SELECT doc_id, quality AS first, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS second, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS third FROM labels"


def readers(spark, d) -> DataFrame:
    q = F.col("quality")
    return t(spark, d, "labels").select("doc_id", q.alias("first"), F.when(F.col("doc_id") % 7 == 0, 1 - q).otherwise(q).alias("second"), F.when(F.col("doc_id") % 5 == 0, F.col("toxic")).otherwise(q).alias("third"))


@query(f"""WITH r AS ({_READERS}), n AS (SELECT count(*)::DOUBLE AS n FROM r), o AS (SELECT count(*) FILTER (first = second) / n AS o FROM r, n GROUP BY n),
e AS (SELECT sum(a.c * b.c) / n / n AS e FROM (SELECT first AS l, count(*)::DOUBLE AS c FROM r GROUP BY 1) a JOIN (SELECT second AS l, count(*)::DOUBLE AS c FROM r GROUP BY 1) b USING (l), n GROUP BY n)
SELECT n::BIGINT AS items, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa, round(sqrt(o * (1 - o) / (n * power(1 - e, 2))), 6) AS standard_error,
round(greatest(-1, (o - e) / (1 - e) - {stats.Z95} * sqrt(o * (1 - o) / (n * power(1 - e, 2)))), 6) AS low, round(least(1, (o - e) / (1 - e) + {stats.Z95} * sqrt(o * (1 - o) / (n * power(1 - e, 2)))), 6) AS high FROM n, o, e""")
def cohen_kappa(spark, d):
    return agreement.cohen_kappa(readers(spark, d))


@query(f"""WITH l AS (SELECT doc_id, unnest([first, second, third]) AS label FROM ({_READERS})), c AS (SELECT doc_id, label, count(*) AS n FROM l GROUP BY ALL), i AS (SELECT doc_id, (sum(n * n) - 3) / 6.0 AS p FROM c GROUP BY doc_id),
o AS (SELECT avg(p) AS o, count(*) AS k FROM i), s AS (SELECT label, sum(n) / (k * 3.0) AS q FROM c, o GROUP BY label, k), x AS (SELECT sum(q * q) AS ef, sum(q * (1 - q)) AS ea FROM s)
SELECT k::BIGINT AS items, round(o, 6) AS observed, round((o - ef) / (1 - ef), 6) AS fleiss_kappa, round((o - ea) / (1 - ea), 6) AS gwet_ac1 FROM o, x""")
def multi_reader_agreement(spark, d):
    return agreement.multi_reader(readers(spark, d).unpivot(["doc_id"], ["first", "second", "third"], "reader", "label").withColumnRenamed("doc_id", "item"), 3, 2)


def _drawn_sql(draws: int) -> str:
    """Resamples of the table c(cluster, ..): (draw, cluster, times)."""
    return f"""k AS (SELECT cluster, row_number() OVER (ORDER BY cluster NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM c)),
p AS (SELECT draw, ('0x' || substr(md5('42:' || draw || ':' || slot), 1, 12))::BIGINT % n AS idx FROM range({draws}) AS a(draw), (SELECT idx AS slot, n FROM k) AS s),
drawn AS (SELECT draw, cluster, count(*) AS times FROM p JOIN k USING (idx) GROUP BY ALL)"""


@query(f"""WITH c AS (SELECT source AS cluster, sum((d1 = truth)::INT - (d2 = truth)::INT) AS d, count(*) AS n FROM ({_JUDGED}) GROUP BY source), {_drawn_sql(10_000)},
m AS (SELECT sum(times * d)::DOUBLE / sum(times * c.n) AS m FROM drawn JOIN c ON drawn.cluster IS NOT DISTINCT FROM c.cluster GROUP BY draw)
SELECT round((SELECT sum(d)::DOUBLE / sum(n) FROM c), 6) AS difference, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
round(greatest(0.0001, least(1, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT)))), 6) AS p_value, (SELECT count(*) FROM c)::BIGINT AS clusters FROM m""")
def clustered_paired_difference(spark, d):
    return agreement.clustered_difference(judged(spark, d).withColumn("difference", (F.col("d1") == F.col("truth")).cast("int") - (F.col("d2") == F.col("truth")).cast("int")), "source")


@query(f"""WITH {_LONG}, c AS (SELECT system, source AS cluster, count(*) FILTER (truth AND flagged) AS tp, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth AND NOT flagged) AS tn, count(*) FILTER (NOT truth) AS n FROM l GROUP BY ALL), {_drawn_sql(2000).replace('p AS', 'q AS').replace('FROM p JOIN', 'FROM q JOIN')},
s AS (SELECT draw, system, sum(times * tp) AS tp, sum(times * p) AS p, sum(times * tn) AS tn, sum(times * c.n) AS n FROM drawn JOIN c ON drawn.cluster IS NOT DISTINCT FROM c.cluster GROUP BY ALL),
j AS (SELECT draw, system, CASE WHEN p > 0 AND n > 0 THEN round(tp::DOUBLE / p + tn::DOUBLE / n - 1, 12) ELSE 0 END AS j FROM s),
r AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY j DESC) + (count(*) OVER (PARTITION BY draw, j) - 1) / 2.0 AS r, max(j) OVER (PARTITION BY draw) AS best FROM j)
SELECT system, round(avg((j = best)::INT), 6) AS top_share, round(quantile_cont(r::DOUBLE, 0.025), 6) AS rank_low, round(quantile_cont(r::DOUBLE, 0.975), 6) AS rank_high FROM r GROUP BY system""")
def rank_stability(spark, d):
    return agreement.rank_stability(long_form(spark, d), "source")


@query()
def bootstrap_ac1(spark, d):
    return agreement.bootstrap_ac1(readers(spark, d).unpivot(["doc_id"], ["first", "second", "third"], "reader", "label").withColumnRenamed("doc_id", "item"), 2, 3)


# retrieval
@query("""SELECT vec_id, arg_min(c_id, (-round(s, 9), c_id)) AS best, round(max(s), 6) AS score FROM (SELECT a.vec_id, b.vec_id AS c_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id) GROUP BY vec_id""")
def cosine_best_match(spark, d):
    e = t(spark, d, "embeddings")
    return retrieval.top_matches(e, e, 1, "label", "vec_id", "embedding").select(F.col("id").alias("vec_id"), F.col("other").alias("best"), F.round("score", 6).alias("score"))


# logs
@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def event_log_last_action(spark, d):
    return eventlog.last_action(t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_type", "ts")


@query("SELECT role, count(*)::BIGINT AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY role")
def resume_anti_join(spark, d):
    done = t(spark, d, "labels").select(F.col("doc_id").alias("conv_id"))
    return tally(eventlog.unanswered(t(spark, d, "conversations"), done, "conv_id"), "role")


@query("""WITH r AS (SELECT user_id, count(*) OVER w AS n, count(*) FILTER (event_type = 'error') OVER w AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, min(n)::BIGINT AS stopped_at FROM r WHERE n >= 40 AND bad / n > 0.15 GROUP BY user_id""")
def running_invalid_stop(spark, d):
    return eventlog.stop_rule(t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("valid")), "user_id", "event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_last_action(spark, d):
    from attesta.streaming import last_action_stream, run_once

    schema = t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    table = run_once(last_action_stream(stream.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id"), "last-action")
    return table.select("user_id", F.col("m.event_type").alias("event_type"))


@query("SELECT (props::JSON ->> 'k')::INT % 10 AS k, count(*)::BIGINT AS n FROM events WHERE json_valid(props) GROUP BY ALL")
def json_answers(spark, d):
    parsed = t(spark, d, "events").select(F.from_json("props", "k int").alias("p")).where("p.k is not null")
    return tally(parsed.select((F.col("p.k") % 10).alias("k")), "k")


@query("SELECT true AS valid, count(*)::BIGINT AS n FROM events")
def answer_validity(spark, d):
    text = F.concat(F.lit("Answer: "), F.col("props"), F.lit(" {end}"))
    schema = {"properties": {"k": {}}, "required": ["k"], "additionalProperties": False}
    return tally(t(spark, d, "events").select(R.answer_validity(text, schema, constrained=False).alias("valid")), "valid")


# relational
@query("SELECT c_nationkey, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey")
def distinct_first_wins(spark, d):
    return scoring.distinct_first(t(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal").desc(), "c_custkey").select("c_nationkey", "c_custkey")


@query("""WITH n AS (SELECT n_regionkey, n_name, sum(c_acctbal) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY round(b, 2) DESC, n_name) AS top, row_number() OVER (PARTITION BY n_regionkey ORDER BY round(b, 2), n_name) AS low FROM n)
SELECT n_regionkey, n_name, CASE WHEN top <= 1 THEN 'top' ELSE 'bottom' END AS kind FROM r WHERE top <= 1 OR low <= 1""")
def top_bottom(spark, d):
    n = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.sum("c_acctbal").alias("b"))
    w = Window.partitionBy("n_regionkey")
    r = n.withColumn("top", F.row_number().over(w.orderBy(F.round("b", 2).desc(), "n_name"))).withColumn("low", F.row_number().over(w.orderBy(F.round("b", 2), "n_name")))
    return r.where("top <= 1 or low <= 1").select("n_regionkey", "n_name", F.when(F.col("top") <= 1, "top").otherwise("bottom").alias("kind"))


@query("SELECT n_name, e.event_type FROM (SELECT DISTINCT event_type FROM events) e, nation LEFT JOIN (SELECT DISTINCT c_nationkey AS n_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END AS event_type, true AS done FROM customer ) x ON x.n_nationkey = nation.n_nationkey AND x.event_type = e.event_type WHERE done IS NULL")
def completeness_check(spark, d):
    plan = t(spark, d, "nation").select("n_nationkey", "n_name").crossJoin(t(spark, d, "events").select("event_type").distinct())  # the plan: runs by systems
    done = t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("view").alias("event_type"))
    return plan.join(done, ["n_nationkey", "event_type"], "left_anti").select("n_name", "event_type")


@query("""SELECT l_suppkey, round(sum(l_quantity), 6) AS quantity, round(avg(p_retailprice), 6) AS price, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY l_suppkey""")
def three_way_cost_join(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(t(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 6).alias("quantity"), F.round(F.avg("p_retailprice"), 6).alias("price"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey::DOUBLE), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey::DOUBLE), 2) AS intercept, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def size_trend(spark, d):
    o, x, y = t(spark, d, "orders"), F.col("o_custkey").cast("double"), F.col("o_totalprice")
    return o.groupBy("o_orderpriority").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT p_brand, round(corr(a, b), 6) AS rho FROM r GROUP BY p_brand""")
def spearman_trend(spark, d):
    rank = lambda c: F.rank().over(Window.partitionBy("p_brand").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("p_brand", c)) - 1) / 2.0
    return t(spark, d, "part").withColumns({"a": rank("p_size"), "b": rank("p_retailprice")}).groupBy("p_brand").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query(f"""WITH j AS ({_JUDGED}), f AS (SELECT lang, d1, count(*) AS n FROM j GROUP BY ALL), c AS (SELECT lang, count(*) FILTER (truth) AS k, count(*) AS n FROM j GROUP BY lang) SELECT round(least(1, sum(f.n * {stats.wilson_high('c.k', 'c.n')}) / sum(f.n)), 6) AS bound FROM f JOIN c USING (lang) WHERE d1""")
def precision_bound(spark, d):
    j = judged(spark, d)
    cells = j.groupBy("lang").agg(F.count_if("truth").alias("k"), F.count(F.lit(1)).alias("n"), F.count_if("d1").alias("f"))
    return cells.agg(F.round(F.least(F.lit(1.0), F.sum(F.col("f") * F.expr(stats.wilson_high("k", "n"))) / F.sum("f")), 6).alias("bound"))


def hypergeometric(pool: int, positives: int, reviewed: int) -> np.ndarray:
    """Probabilities of the possible numbers of positives among the reviewed, from 0; those below 1e-30 are 0.

    Only numbers within 12 standard deviations of the mean are computed, so the time grows with a root of the pool."""
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    share = positives / pool if pool else 0.0
    around = 12 * math.sqrt(max(1.0, reviewed * share * (1 - share))) + 12
    first, last = max(0, reviewed - (pool - positives), math.floor(reviewed * share - around)), min(positives, reviewed, math.ceil(reviewed * share + around))
    out = np.zeros(last + 1)
    for k in range(first, last + 1):
        out[k] = math.exp(log(positives, k) + log(pool - positives, reviewed - k) - log(pool, reviewed))
    return out


def random_triage(pool: int, positives: int, reviewed: int) -> tuple[float, int, int]:
    """Mean and central 95 % bounds of the positives that a random review finds."""
    total = np.cumsum(hypergeometric(pool, positives, reviewed))
    return reviewed * positives / pool, int(np.searchsorted(total, 0.025)), int(np.searchsorted(total, 0.975 - 1e-12))
