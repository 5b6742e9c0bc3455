"""Queries of the studies: corruptions, the composed baseline and screen, runs against truth, gates, protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import records as R
from attesta.functions import rules, stats
from attesta.operators import agreement, baseline, corruption, injection, judging, protocol, resampling, sampling, scoring, spatial
from attesta.plans.catalogue import GEO, HAVERSINE, KM, LAT, LON, _COUNTS, _JUDGED, _LONG, _drawn_sql, judged, long_form, part_records, places, points, query, readers, t

_MEASURES = ", ".join(f"{e} AS {n}" for n, e in stats.measures().items())


# corruptions: every malformation of every kind changes the value and is flagged by its rule
_HOURS_OK = ("Mo-Fr 09:00-17:00", "24/7", "Mo-Sa 08:00-12:00,13:00-18:00; Su off", "10:00-12:00", "week 1-3 10:00 - 12:00")
_KIND = lambda kinds, k: f"({list(kinds)!r})[{k} % {len(kinds)} + 1]"


@query(f"""WITH x AS (SELECT 'website' AS field, {_KIND(corruption.WEBSITE_KINDS, 'page_id')} AS kind FROM pages WHERE url IS NOT NULL
UNION ALL SELECT 'phone', {_KIND(corruption.PHONE_KINDS, 'c_custkey')} FROM customer UNION ALL SELECT 'opening_hours', {_KIND(corruption.HOURS_KINDS, 'floor(event_id / 5)::BIGINT')} FROM events
UNION ALL SELECT 'stars', {_KIND(corruption.RANGE_KINDS, 'p_partkey')} FROM part UNION ALL SELECT 'level', {_KIND(corruption.RANGE_KINDS, 'p_partkey')} FROM part)
SELECT field, kind, count(*)::BIGINT AS n, count(*)::BIGINT AS flagged, count(*)::BIGINT AS changed FROM x GROUP BY ALL""")
def corruption_flags(spark, d):
    def each(field, rows, value, key, pick, kinds, corrupt, rule):
        kind = F.element_at(F.array(*map(F.lit, kinds)), (pick % len(kinds) + 1).cast("int"))
        made = F.coalesce(*(F.when(kind == k, corrupt(value, k, key)) for k in kinds))
        return rows.select(F.lit(field).alias("field"), kind.alias("kind"), value.alias("value"), made.alias("made")).select("field", "kind", rule(F.col("made"))["outcome"].alias("outcome"), (~F.col("made").eqNullSafe(F.col("value"))).alias("changed"))

    c = F.col
    ranged = lambda tag: (lambda v: F.get(rules.value_range(F.create_map(F.lit(tag), v)), F.lit(0)))
    hours = F.element_at(F.array(*map(F.lit, _HOURS_OK)), (c("event_id") % 5 + 1).cast("int"))
    rows = [
        each("website", t(spark, d, "pages").where("url is not null"), c("url"), c("page_id"), c("page_id"), corruption.WEBSITE_KINDS, corruption.corrupt_website, rules.website_syntax),
        each("phone", t(spark, d, "customer"), F.concat(F.lit("+"), F.replace("c_phone", F.lit("-"), F.lit(" "))), c("c_custkey"), c("c_custkey"), corruption.PHONE_KINDS, corruption.corrupt_phone, rules.phone_syntax)
        if "c_phone" in t(spark, d, "customer").columns
        else each("phone", t(spark, d, "customer"), F.concat(F.lit("+90 232 "), (c("c_custkey") % 900000 + 100000).cast("string")), c("c_custkey"), c("c_custkey"), corruption.PHONE_KINDS, corruption.corrupt_phone, rules.phone_syntax),
        each("opening_hours", t(spark, d, "events"), hours, c("event_id"), F.floor(c("event_id") / 5), corruption.HOURS_KINDS, corruption.corrupt_hours, rules.opening_hours_syntax),
        *(each(tag, t(spark, d, "part"), c("p_size").cast("string"), c("p_partkey"), c("p_partkey"), corruption.RANGE_KINDS, lambda v, k, key, tag=tag: corruption.corrupt_range(tag, k, key, value=v), ranged(tag)) for tag in ("stars", "level")),
    ]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "flag").alias("flagged"), F.count_if("changed").alias("changed"))


_CODES = "1 + c_nationkey * 7"


@query(f"""WITH x AS (SELECT {_CODES} AS own, c_custkey FROM customer) SELECT own, count(*)::BIGINT AS n, 0::BIGINT AS same_code, count(*)::BIGINT AS same_rest FROM x GROUP BY own""")
def calling_code_swaps(spark, d):
    known = F.array(*(F.lit(1 + 7 * k) for k in range(25)))
    own = F.expr(_CODES)
    value = F.concat(F.lit(" +"), own.cast("string"), F.lit(" (000) 01-34"))
    made = t(spark, d, "customer").select(own.alias("own"), corruption.corrupt_calling_code(value, known, F.col("c_custkey")).alias("made"))
    read = corruption.calling_code(F.col("made"), known)
    return made.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.count_if(read == F.col("own")).alias("same_code"), F.count_if(F.col("made").endswith(" (000) 01-34")).alias("same_rest"))


# the composed baseline
def baseline_records(spark, d) -> DataFrame:
    k = F.col("id")
    used = 1 + ((F.col("nation") + F.when(k % 4 == 3, 1).otherwise(0)) % 25) * 7
    tags = F.create_map(
        F.lit("name"), F.concat(F.lit("n"), k), F.lit("phone"), F.when(k % 6 != 5, F.concat(F.when(k % 4 == 0, "0").otherwise("+"), used.cast("string"), F.lit(" 5550134"))),
        F.lit("addr:city"), F.concat(F.lit("town "), k % 11), F.lit("contact:website"), F.when(k % 4 == 0, "https://a.example/x").when(k % 4 == 1, "nodots"), F.lit("stars"), (k % 9).cast("string"))
    return points(spark, d).select("id", F.col("nation").alias("country"), "lat", "lon", F.col("c_mktsegment").alias("class"), F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"))


_BASELINE = f"""{GEO}, n AS (SELECT id, list_distinct(flatten(list(names))) AS names FROM near WHERE km <= {KM} GROUP BY id),
x AS (SELECT id, c_mktsegment AS class, nation, names, CASE WHEN id % 6 <> 5 THEN (CASE id % 4 WHEN 0 THEN '0' ELSE '+' END) || (1 + ((nation + CASE id % 4 WHEN 3 THEN 1 ELSE 0 END) % 25) * 7) || ' 5550134' END AS v FROM pts LEFT JOIN n USING (id)),
b AS (SELECT id, class, id % 4 = 1 OR id % 9 NOT BETWEEN 1 AND 7 AS f,
  coalesce(starts_with(v, '+') AND (SELECT max(1 + n_nationkey * 7) FROM nation WHERE starts_with(regexp_replace(v, '[^0-9]', '', 'g'), (1 + n_nationkey * 7)::VARCHAR)) <> 1 + nation * 7, false)
  OR coalesce(NOT list_contains(names, 'town ' || (id % 11)), false) AS l FROM x)"""


def baseline_verdicts(spark, d) -> DataFrame:
    codes = t(spark, d, "nation").select(F.col("n_nationkey").alias("country"), (1 + F.col("n_nationkey") * 7).alias("code"))
    return baseline.baseline(baseline_records(spark, d), places(spark, d), codes, "id", KM)


@query(f"WITH {_BASELINE} SELECT class, count(*)::BIGINT AS n, count(*) FILTER (f)::BIGINT AS by_format, count(*) FILTER (l)::BIGINT AS by_lookup, count(*) FILTER (f OR l)::BIGINT AS flagged FROM b GROUP BY class")
def rule_baseline_by_class(spark, d):
    v = baseline_verdicts(spark, d)
    return v.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(rules.flagged(F.col("format_verdicts"))).alias("by_format"), F.count_if(rules.flagged(F.col("lookup_verdicts"))).alias("by_lookup"), F.count_if("flagged").alias("flagged"))


@query(f"""WITH {_BASELINE}, j AS (SELECT class AS grp, id % 3 = 0 AS truth, f OR l AS flagged, CASE WHEN id % 3 = 0 AND (f OR l) THEN id % 9 NOT BETWEEN 1 AND 7 END AS hit FROM b),
c AS (SELECT grp, {_COUNTS.format(f='flagged')}, count(*) FILTER (hit)::BIGINT AS field_hits, count(hit)::BIGINT AS field_attempts FROM j GROUP BY grp) SELECT *, {_MEASURES} FROM c""")
def baseline_scored(spark, d):
    v = baseline_verdicts(spark, d)
    items = v.select(F.col("id").alias("item_id"), F.lit("x").alias("city"), "class", (F.col("id") % 3 == 0).alias("corrupted"), F.lit("stars").alias("corrupted_field"))
    j = judging.judge_baseline(v.select(F.col("id").alias("item_id"), F.concat("format_verdicts", "lookup_verdicts").alias("verdicts")), items)
    return judging.scores(j, "grp").drop("run", "model", "invalid")


# the composed screen
_DICTIONARY = {"ring": "shop=economy", "widget": "office=promo"}


def screen_input(spark, d) -> tuple[DataFrame, DataFrame]:
    p = part_records(spark, d)
    k = F.col("id")
    records = p.withColumn("category", F.when(k % 2 == 0, F.col("category")).otherwise(F.concat(F.lit("office="), F.lower("p_type")))).withColumns({"branded": k % 5 == 0, "country": k % 25})
    at = t(spark, d, "supplier").join(t(spark, d, "part").select("p_partkey", "p_name"), F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("place_id"), "p_name")
    where = places(spark, d).select("place_id", "p_lat", "p_lon", F.col("nation").alias("p_country"))
    return records.drop("p_size", "p_type"), where.join(at, "place_id").select("place_id", "p_lat", "p_lon", "p_country", F.array("p_name").alias("names"))


def _screen_sql(name: str, s: dict) -> str:
    brand = "NOT branded" if s["no_brands"] else "true"
    kind = "string_split(a.category, '=')[1] <> string_split(b.category, '=')[1]" if s["other_key"] else "a.category <> b.category"
    most = f"a.c <= {s['most']}" if s["most"] else "true"
    key = "string_split(ind, '=')[1] <> string_split(category, '=')[1]" if s["other_key"] else "true"
    return f"""SELECT '{name}' AS variant, id, country, {brand} AND id IN (SELECT a.id FROM r a JOIN r b ON a.grp = b.grp AND a.name = b.name AND {kind} WHERE {most} AND {HAVERSINE.format(a='a.lat', b='a.lon', p='b.lat', q='b.lon')} >= {s['km']}) AS dup,
  ind IS NOT NULL AND ind <> category AND {key} AS tok, CASE WHEN {brand} AND length(name) >= {s['least_chars']} AND km > {s['absent_km']} THEN p_country END AS place FROM r LEFT JOIN m USING (id)"""


_VARIANTS = {"final": baseline.FINAL, "first_pass": baseline.FIRST_PASS}


@query(f"""WITH r AS (SELECT p_partkey AS id, p_name AS name, p_brand AS grp, CASE WHEN p_partkey % 2 = 0 THEN 'shop=' ELSE 'office=' END || lower(p_type) AS category, p_partkey % 5 = 0 AS branded, p_partkey % 25 AS country,
  ({LAT.format(k='p_partkey')})::DOUBLE AS lat, ({LON.format(k='p_partkey')})::DOUBLE AS lon, count(*) OVER (PARTITION BY p_brand, p_name) AS c,
  (SELECT arg_min(cat, list_position(string_split(p_name, ' '), token)) FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _DICTIONARY.items())}) AS dict(token, cat) WHERE list_contains(string_split(p_name, ' '), token)) AS ind FROM part),
pl AS (SELECT s_suppkey AS place_id, p_name AS name, s_nationkey AS nation, ((s_suppkey * 53 + 11) * 37 % 12000 / 100.0 - 60)::DOUBLE AS p_lat, ((s_suppkey * 53 + 11) * 91 % 34000 / 100.0 - 170)::DOUBLE AS p_lon FROM supplier JOIN part ON s_suppkey = p_partkey),
m AS (SELECT id, min(km) AS km, arg_min(nation, (km, place_id)) AS p_country FROM (SELECT id, place_id, nation, {HAVERSINE.format(a='lat', b='lon', p='p_lat', q='p_lon')} AS km FROM r JOIN pl USING (name)) GROUP BY id),
h AS ({" UNION ALL ".join(_screen_sql(n, s) for n, s in _VARIANTS.items())})
SELECT variant, CASE WHEN place IS NOT NULL THEN 'gazetteer' WHEN dup THEN 'duplicate' ELSE 'token' END AS owner, count(*)::BIGINT AS n, sum(dup::INT + tok::INT + (place IS NOT NULL)::INT)::BIGINT AS hits, count(*) FILTER (place = country)::BIGINT AS same_country FROM h WHERE dup OR tok OR place IS NOT NULL GROUP BY ALL""")
def screen_variants(spark, d):
    records, where = screen_input(spark, d)
    words = F.create_map(*(F.lit(x) for kv in _DICTIONARY.items() for x in kv))
    rows = [baseline.screen_records(records, words, where, "id", "grp", s).withColumn("variant", F.lit(n)) for n, s in _VARIANTS.items()]
    hit = rows[0].unionByName(rows[1]).where("owner is not null")
    return hit.groupBy("variant", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("rules")).alias("hits"), F.count_if("same_country").alias("same_country"))


# injected sets
def donor_input(spark, d) -> DataFrame:
    return part_records(spark, d).select("id", "grp", F.concat("name", F.lit(" "), F.col("id") % 700).alias("name"), "category", "lat", "lon", (F.col("id") % 5 == 0).alias("branded"))


_DONORS = f"""r AS (SELECT p_partkey AS id, p_brand AS grp, p_name || ' ' || (p_partkey % 700) AS name, 'shop=' || lower(p_type) AS category, ({LAT.format(k='p_partkey')})::DOUBLE AS lat, ({LON.format(k='p_partkey')})::DOUBLE AS lon, p_partkey % 5 = 0 AS branded FROM part),
open_pool AS (SELECT * FROM r WHERE length(name) >= 6 AND NOT branded AND (grp, name) IN (SELECT (grp, name) FROM r GROUP BY grp, name HAVING count(*) = 1)),
pool AS (SELECT * FROM open_pool WHERE NOT list_has_any(string_split(name, ' '), {list(_DICTIONARY)!r}))"""


def _tries_sql(pool: str) -> str:
    return f"""num AS (SELECT id AS donor, grp, name AS d_name, category AS d_category, lat AS d_lat, lon AS d_lon, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM {pool}),
tried AS (SELECT r.*, try, ('0x' || substr(md5('42:' || try || ':' || id), 1, 8))::BIGINT % size AS idx FROM r JOIN (SELECT DISTINCT grp, size FROM num) USING (grp), range({injection.TRIES}) AS a(try)),
donors AS (SELECT id, arg_min(donor, try) AS donor, arg_min(d_name, try) AS d_name FROM tried JOIN num USING (grp, idx) WHERE donor <> id AND category <> d_category AND name <> d_name AND {HAVERSINE.format(a='lat', b='lon', p='d_lat', q='d_lon')} >= 2 GROUP BY id)"""


def _words():
    return F.create_map(*(F.lit(x) for kv in _DICTIONARY.items() for x in kv))


@query(f"WITH {_DONORS} SELECT grp, count(*)::BIGINT AS open, (SELECT count(*) FROM pool p WHERE p.grp = o.grp)::BIGINT AS pool FROM open_pool o GROUP BY grp")
def donor_pools(spark, d):
    rows = donor_input(spark, d)
    n = lambda p, name: p.groupBy("grp").agg(F.count(F.lit(1)).alias(name))
    return n(injection.donor_pool(rows, "grp"), "open").join(n(injection.donor_pool(rows, "grp", _words()), "pool"), "grp", "left").withColumn("pool", F.coalesce("pool", F.lit(0)))


@query(f"WITH {_DONORS}, {_tries_sql('pool')} SELECT id, donor FROM donors")
def name_donors(spark, d):
    rows = donor_input(spark, d)
    return injection.name_donors(rows, injection.donor_pool(rows, "grp", _words()), "id", "grp").select("id", "donor")


@query(f"""WITH {_DONORS}, {_tries_sql('open_pool')}, v AS (SELECT category, (SELECT arg_min(cat, list_position(string_split(d_name, ' '), token)) FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _DICTIONARY.items())}) AS dict(token, cat) WHERE list_contains(string_split(d_name, ' '), token)) AS ind FROM donors JOIN r USING (id))
SELECT CASE WHEN ind IS NULL THEN 'abstain' WHEN ind <> category THEN 'flag' ELSE 'pass' END AS outcome, count(*)::BIGINT AS n FROM v GROUP BY ALL""")
def exclusion_counterfactual(spark, d):
    rows = donor_input(spark, d)
    return injection.counterfactual(rows, injection.donor_pool(rows, "grp"), _words(), "id", "grp")


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS grp, 'sig' || (p_size % 4) AS signature, row_number() OVER (PARTITION BY p_brand, p_size % 4 ORDER BY md5('42:' || p_brand || ':sig' || (p_size % 4) || ':' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand, p_size % 4) AS n FROM part),
p AS (SELECT id, grp, signature, floor((r - 1) / 2)::BIGINT AS pair_no, r % 2 = ('0x' || substr(md5('42:' || grp || ':' || signature || ':' || floor((r - 1) / 2)::BIGINT), 1, 1))::INT % 2 AS corrupted FROM r WHERE r <= n - n % 2),
c AS (SELECT grp, signature, pair_no, row_number() OVER (PARTITION BY grp ORDER BY md5('42:pair:' || grp || ':' || signature || ':' || pair_no), signature, pair_no) AS k FROM (SELECT DISTINCT grp, signature, pair_no FROM p))
SELECT id, grp, signature, grp || '-' || lpad(k::VARCHAR, 4, '0') AS pair_id, CASE WHEN corrupted THEN 1 ELSE 2 END AS member, corrupted FROM p JOIN c USING (grp, signature, pair_no) WHERE k <= 12""")
def injected_pairs(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.concat(F.lit("sig"), F.col("p_size") % 4).alias("signature"))
    return injection.pairs(rows, "grp", "signature", 12, "id").select("id", "grp", "signature", "pair_id", "member", "corrupted")


# runs of answers against truth
_ANSWERS = f"""{_LONG}, ans AS (SELECT system AS model, item, source AS city, truth AS corrupted, item % 17 <> 0 AND flagged AS said, item % 13 <> 0 AS valid, CASE WHEN item % 2 = 0 THEN 'phone' ELSE 'name' END AS field, CASE WHEN item % 3 = 0 THEN 'phone' ELSE 'name' END AS corrupted_field, 'c' || (item % 4) AS class FROM l)"""


def answer_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    l, i = long_form(spark, d), F.col("item")  # noqa: E741
    verdict = F.when(F.col("flagged"), "wrong").otherwise("clean")
    answers = l.select(F.lit("detect").alias("run"), F.col("system").alias("model"), i.alias("item_id"), F.when(i % 17 != 0, F.struct(verdict.alias("verdict"), F.when(i % 2 == 0, "phone").otherwise("name").alias("field"))).alias("parsed"), (i % 13 != 0).alias("valid"))
    items = judged(spark, d).select(F.col("doc_id").alias("item_id"), F.col("source").alias("city"), F.concat(F.lit("c"), F.col("doc_id") % 4).alias("class"), F.col("truth").alias("corrupted"), F.when(F.col("doc_id") % 3 == 0, "phone").otherwise("name").alias("corrupted_field"))
    return answers, items


def _scores_sql(flag: str, by: str, hit: str = "CASE WHEN corrupted AND said AND valid THEN field = corrupted_field END") -> str:
    return f"""SELECT {by}, {_COUNTS.replace('truth', 'corrupted').format(f=f'({flag})')}, count(*) FILTER (NOT valid)::BIGINT AS invalid, count(*) FILTER ({hit})::BIGINT AS field_hits, count({hit})::BIGINT AS field_attempts FROM ans GROUP BY ALL"""


@query(f"WITH {_ANSWERS}, c AS ({_scores_sql('said AND valid', 'model, class AS grp')}) SELECT *, {_MEASURES} FROM c")
def detect_scores(spark, d):
    return judging.scores(judging.judge_detect(*answer_rows(spark, d)), "grp").drop("run")


@query(f"""WITH {_ANSWERS}, c AS (SELECT model, s.set, {_COUNTS.replace('truth', '(label = 1)').format(f='(said AND valid)')}, count(*) FILTER (NOT valid)::BIGINT AS invalid FROM (SELECT ans.*, CASE item % 5 WHEN 0 THEN NULL ELSE (quality = 0)::INT END AS label, item % 2 = 0 AS core FROM ans JOIN labels ON doc_id = item), (VALUES ('adjudicated'), ('decidable_core')) AS s(set)
WHERE label IS NOT NULL AND (core OR s.set = 'adjudicated') GROUP BY ALL) SELECT *, {_MEASURES} FROM c""")
def natural_scores(spark, d):
    answers, _ = answer_rows(spark, d)
    i = F.col("doc_id")
    gold = judged(spark, d).select(i.alias("item_id"), F.col("source").alias("city"), F.col("lang").alias("stratum"), F.when(F.col("truth"), "wrong").otherwise("belongs").alias("label"), (i % 5 != 0).alias("scored"), (i % 2 == 0).alias("decidable_core"))
    both = [judging.scores(judging.judge_natural(answers, gold, core)).withColumn("set", F.lit(n)) for n, core in (("adjudicated", False), ("decidable_core", True))]
    return both[0].unionByName(both[1]).drop("run", "field_hits", "field_attempts")


@query(f"WITH {_ANSWERS} SELECT model, count(*)::BIGINT AS answers, count(*) FILTER (NOT valid)::BIGINT AS rejected, count(*) FILTER (NOT valid AND said)::BIGINT AS rejected_but_readable, round(count(*) FILTER (NOT valid) / count(*), 6) AS rejected_rate FROM ans GROUP BY model")
def decoding_counts(spark, d):
    return judging.decoding_counts(answer_rows(spark, d)[0], "model")


@query(f"WITH {_ANSWERS}, c AS ({_scores_sql('said', 'model', 'NULL::BOOLEAN')}) SELECT model, tp, fn, tn, fp, {_MEASURES} FROM c")
def lenient_scores(spark, d):
    return judging.scores(judging.judge_name(*answer_rows(spark, d), lenient=True)).drop("run", "invalid", "field_hits", "field_attempts")


_SCORED = f"c AS ({_scores_sql('said AND valid', 'model, class AS grp')}), s AS (SELECT model, grp, round({stats.balanced_accuracy('tp', 'fn', 'tn', 'fp')}, 6) AS balanced_accuracy, round({stats.youden('tp', 'fn', 'tn', 'fp')}, 6) AS youden_j FROM c)"


@query(f"""WITH {_ANSWERS}, {_SCORED}, u AS (SELECT grp, 'balanced_accuracy' AS quantity, balanced_accuracy AS v, 0.5 AS chance FROM s UNION ALL SELECT grp, 'youden_j', youden_j, 0 FROM s)
SELECT grp, quantity, count(*)::BIGINT AS models, round(median(v), 6) AS median, round(max(v), 6) AS maximum, round(min(v), 6) AS minimum, count(*) FILTER (v < chance)::BIGINT AS below_chance FROM u GROUP BY ALL""")
def pool_summary(spark, d):
    return judging.pool_summary(judging.scores(judging.judge_detect(*answer_rows(spark, d)), "grp"), {"balanced_accuracy": 0.5, "youden_j": 0.0}, "grp")


@query(f"""WITH {_ANSWERS}, {_SCORED}, f AS (SELECT a.youden_j - b.youden_j AS fall FROM s a JOIN s b USING (model) WHERE a.grp = 'c0' AND b.grp = 'c1')
SELECT 'youden_j' AS quantity, count(*)::BIGINT AS models, round(median(fall), 6) AS median, round(max(fall), 6) AS maximum, round(min(fall), 6) AS minimum, count(*) FILTER (fall <= 0)::BIGINT AS not_lower FROM f""")
def fall_between_runs(spark, d):
    s = judging.scores(judging.judge_detect(*answer_rows(spark, d)), "grp")
    return judging.falls(s.where("grp = 'c0'"), s.where("grp = 'c1'"), "youden_j")


def _tail_sql(table: str) -> str:
    return f"""k AS (SELECT *, least(first_only, second_only) AS m, first_only + second_only AS nn FROM {table}), w AS (SELECT *, row_number() OVER () AS rid FROM k),
tails AS (SELECT rid, sum(exp(lgamma(nn + 1) - lgamma(i + 1) - lgamma(nn - i + 1) - nn * ln(2))) AS tail FROM w, unnest(range(0, m + 1)) AS z(i) GROUP BY rid),
e AS (SELECT w.* EXCLUDE (m, nn, rid), round(CASE WHEN first_only = second_only THEN 1 ELSE least(1, 2 * tail) END, 6) AS p_value, round({stats.mcnemar_odds('first_only', 'second_only')}, 6) AS odds_ratio,
  round({stats.odds_limits('first_only', 'second_only')[0]}, 6) AS odds_low, round({stats.odds_limits('first_only', 'second_only')[1]}, 6) AS odds_high FROM w JOIN tails USING (rid))"""


_VIEWS = """vw AS (SELECT system AS model, item, truth, flagged, v.view, CASE v.view WHEN 'name_only' THEN flagged AND item % 3 <> 0 ELSE item % 2 = 0 END AS reduced FROM l, (VALUES ('name_only'), ('neither')) AS v(view))"""


@query(f"""WITH {_LONG}, {_VIEWS}, pr AS (SELECT model, view, count(*) FILTER (truth = flagged AND truth <> reduced)::BIGINT AS first_only, count(*) FILTER (truth <> flagged AND truth = reduced)::BIGINT AS second_only FROM vw GROUP BY ALL), {_tail_sql('pr')},
fj AS (SELECT system AS model, {_COUNTS.format(f='flagged')} FROM l GROUP BY ALL), rj AS (SELECT model, view, {_COUNTS.format(f='reduced')} FROM vw GROUP BY ALL),
o AS (SELECT e.*, round({stats.youden('fj.tp', 'fj.fn', 'fj.tn', 'fj.fp')}, 6) AS j_full, round({stats.youden('rj.tp', 'rj.fn', 'rj.tn', 'rj.fp')}, 6) AS j_reduced FROM e JOIN fj USING (model) JOIN rj USING (model, view))
SELECT *, round(j_full - j_reduced, 6) AS j_drop, p_value < 0.05 AS moves_with_input FROM o""")
def input_dependence(spark, d):
    return judging.input_dependence(*view_rows(spark, d))


def view_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    full = long_form(spark, d).select(F.col("system").alias("model"), F.col("item").alias("item_id"), "truth", "flagged")
    cut = F.when(F.col("view") == "name_only", F.col("flagged") & (F.col("item_id") % 3 != 0)).otherwise(F.col("item_id") % 2 == 0)
    return full, full.withColumn("view", F.explode(F.array(F.lit("name_only"), F.lit("neither")))).withColumn("flagged", cut)


@query(f"""WITH {_LONG}, {_VIEWS}, js AS (SELECT system AS model, {_COUNTS.format(f='flagged')} FROM l GROUP BY ALL), mj AS (SELECT model, {', '.join(f"{stats.measures()[n]} AS {n}" for n in ('youden_j', 'j_low', 'j_high'))} FROM js),
pr AS (SELECT model, 'dom' AS gate, count(*) FILTER (truth = flagged AND item % 2 = 0 <> truth)::BIGINT AS first_only, count(*) FILTER (truth <> flagged AND item % 2 = 0 = truth)::BIGINT AS second_only FROM vw WHERE view = 'neither' GROUP BY ALL
  UNION ALL SELECT model, 'view', count(*) FILTER (truth = flagged AND truth <> reduced)::BIGINT, count(*) FILTER (truth <> flagged AND truth = reduced)::BIGINT FROM vw WHERE view = 'neither' GROUP BY ALL), {_tail_sql('pr')},
rj AS (SELECT model, {_COUNTS.format(f='reduced')} FROM vw WHERE view = 'neither' GROUP BY ALL)
SELECT model, 'baseline_dominance' AS gate, odds_ratio AS value, NULL::DOUBLE AS low, NULL::DOUBLE AS high, p_value, p_value < 0.05 AND first_only > second_only AS passes FROM e WHERE gate = 'dom'
UNION ALL SELECT model, 'flag_rate_correction', youden_j, j_low, j_high, NULL, j_low > 0 FROM mj
UNION ALL SELECT model, 'input_dependence', round({stats.youden('tp', 'fn', 'tn', 'fp')}, 6), NULL, NULL, p_value, p_value < 0.05 FROM e JOIN rj USING (model) WHERE gate = 'view'""".replace("item % 2 = 0 <> truth", "(item % 2 = 0) <> truth").replace("item % 2 = 0 = truth", "(item % 2 = 0) = truth"))
def gate_table(spark, d):
    full, reduced = view_rows(spark, d)
    other = full.where("model = 'd3'").select("item_id", "truth", "flagged")
    scored = scoring.with_measures(scoring.confusion(full, "model"))
    kappa = agreement.cohen_kappa(readers(spark, d))
    rows = judging.gate_rows(judging.against(full, other), scored, judging.input_dependence(full, reduced.where("view = 'neither'")), kappa)
    return rows.where("gate <> 'label_stability'")


@query(f"""WITH {_LONG}, s AS (SELECT system AS model, {_COUNTS.format(f='flagged')} FROM l GROUP BY ALL), f(model, gb, sec) AS (VALUES ('d1', 3.5, 0.25), ('d2', 9.0, 0.0), ('d4', 1.0, 1.0))
SELECT model, gb::DOUBLE AS footprint_gb, gb <= 8 AS deployable, round(sec::DOUBLE, 3) AS seconds, CASE WHEN sec > 0 THEN round(3600 / sec)::BIGINT END AS records_per_hour, round({stats.youden('tp', 'fn', 'tn', 'fp')}, 6) AS youden_j, {stats.measures()['flag_rate']} AS flag_rate FROM s JOIN f USING (model)""")
def cost_table(spark, d):
    f = spark.createDataFrame([("d1", 3.5, 0.25), ("d2", 9.0, 0.0), ("d4", 1.0, 1.0)], "model string, footprint_gb double, seconds double")
    scored = scoring.with_measures(scoring.confusion(long_form(spark, d).withColumnRenamed("system", "model"), "model")).select("model", "youden_j", "flag_rate")
    return judging.cost_table(f.select("model", "footprint_gb"), f.select("model", "seconds"), scored, 8.0)


# prevalence and bounds
_DRAWN = f"""w AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN 'cannot_say' WHEN truth THEN 'wrong' ELSE 'belongs' END AS label, (CASE lang WHEN 'en' THEN 0.2 WHEN 'fr' THEN 0.5 ELSE 0.8 END)::DOUBLE AS pi, n_chars FROM ({_JUDGED.replace('SELECT l.doc_id', 'SELECT n_chars, l.doc_id')}) WHERE doc_id % 11 <> 0)"""


def drawn(spark, d) -> DataFrame:
    pi = F.when(F.col("lang") == "en", 0.2).when(F.col("lang") == "fr", 0.5).otherwise(0.8)
    label = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, "cannot_say").when(F.col("truth"), "wrong").otherwise("belongs")
    return judged(spark, d).withColumns({"pi": pi, "label": label})


@query(f"""WITH {_DRAWN}, s AS (SELECT source, count(*) FILTER (label <> 'cannot_say')::BIGINT AS decided, count(*) FILTER (label = 'wrong')::BIGINT AS wrong, count(*) FILTER (label = 'cannot_say')::BIGINT AS cannot_say,
 coalesce(sum(1 / pi) FILTER (label <> 'cannot_say'), 0) AS wd, coalesce(sum(1 / pi) FILTER (label = 'wrong'), 0) AS ww, coalesce(sum(1 / pi) FILTER (label = 'cannot_say'), 0) AS wu FROM w GROUP BY source)
SELECT source, decided, wrong, cannot_say, CASE WHEN decided > 0 THEN round({stats.wilson_point('wrong', 'decided')}, 4) END AS raw_prevalence, CASE WHEN decided > 0 THEN round({stats.wilson_low('wrong', 'decided')}, 4) END AS raw_low, CASE WHEN decided > 0 THEN round({stats.wilson_high('wrong', 'decided')}, 4) END AS raw_high,
 CASE WHEN wd > 0 THEN round(ww / wd, 4) ELSE 0 END AS weighted_prevalence, round(ww / (wd + wu), 4) AS bound_low, round((ww + wu) / (wd + wu), 4) AS bound_high FROM s""")
def prevalence_bounds(spark, d):
    return judging.prevalence(drawn(spark, d), "source")


@query(f"""WITH {_DRAWN}, c AS (SELECT doc_id % 40 AS cluster, sum(CASE WHEN label = 'wrong' THEN 1 / pi ELSE 0 END) AS tt, sum(1 / pi) AS bb FROM w WHERE label <> 'cannot_say' GROUP BY 1), {_drawn_sql(10_000)},
m AS (SELECT sum(times * tt) / sum(times * bb) AS m FROM drawn JOIN c USING (cluster) GROUP BY draw) SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, 'cluster bootstrap' AS method, (SELECT count(*) FROM c)::BIGINT AS clusters FROM m""")
def prevalence_interval(spark, d):
    rows = drawn(spark, d).where(F.col("label").isin(*judging.DECIDED)).select((F.col("doc_id") % 40).alias("cluster"), F.when(F.col("label") == "wrong", 1 / F.col("pi")).otherwise(0.0).alias("top"), (1 / F.col("pi")).alias("bottom"))
    return resampling.ratio_interval(rows, "cluster", "top", "bottom")


@query(f"""WITH {_DRAWN}, b AS (SELECT lang, {stats.wilson_high('k', 'n')} AS upper FROM (SELECT lang, count(*) FILTER (label = 'wrong') AS k, count(*) AS n FROM w WHERE label <> 'cannot_say' GROUP BY lang)), {_LONG},
f AS (SELECT system AS model, lang, count(*) AS f FROM l JOIN documents ON item = doc_id WHERE flagged GROUP BY ALL) SELECT model, sum(f)::BIGINT AS flags, round(least(1, sum(f * upper) / sum(f)), 6) AS bound FROM f JOIN b USING (lang) GROUP BY model""")
def label_free_bounds(spark, d):
    flags = long_form(spark, d).select(F.col("system").alias("model"), "lang", "flagged")
    return judging.precision_bounds(flags, judging.cell_bounds(drawn(spark, d), "lang"), "lang", "model")


@query("SELECT lang, positives, round(11.0 / positives, 6) AS floor_strict, round(6.0 / positives, 6) AS floor_usual FROM (SELECT lang, count(*) FILTER (quality = 0)::BIGINT AS positives FROM labels JOIN documents USING (doc_id) GROUP BY lang) WHERE positives > 0")
def detectability(spark, d):
    n = judged(spark, d).groupBy("lang").agg(F.count_if("truth").alias("positives")).where("positives > 0")
    return n.select("lang", "positives", *(F.round(F.lit(float(stats.min_discordant(a))) / F.col("positives"), 6).alias(c) for c, a in (("floor_strict", 0.001), ("floor_usual", 0.05))))


# artefacts of items
_ITEMS = f"""x AS (SELECT p_partkey % 2 = 0 AS corrupted, p_name AS name, p_partkey % 5 = 0 AS branded, count(*) OVER (PARTITION BY p_brand, p_name) > 1 AS repeated, list_has_any(string_split(p_name, ' '), {list(_DICTIONARY)!r}) AS token, length(p_name) < 13 AS short FROM part)"""


def artefact_items(spark, d) -> DataFrame:
    p = t(spark, d, "part")
    n = p.groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    items = p.join(n, ["p_brand", "p_name"]).select((F.col("p_partkey") % 2 == 0).alias("corrupted"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5 == 0).alias("branded"), (F.col("n") > 1).alias("repeated"))
    return judging.features(items, _words()).withColumn("short", F.col("name_chars") < 13)


@query(f"""WITH {_ITEMS}, u AS (SELECT corrupted, unnest(['carries_category_token', 'branded', 'repeated', 'short']) AS feature, unnest([token, branded, repeated, short]) AS has FROM x),
c AS (SELECT CASE WHEN corrupted THEN 'corrupted' ELSE 'clean' END AS half, feature, count(*)::BIGINT AS items, count(*) FILTER (has)::BIGINT AS carrying FROM u GROUP BY ALL)
SELECT *, round({stats.wilson_point('carrying', 'items')}, 6) AS share, round({stats.wilson_low('carrying', 'items')}, 6) AS low, round({stats.wilson_high('carrying', 'items')}, 6) AS high FROM c""")
def artefact_shares(spark, d):
    return judging.feature_shares(artefact_items(spark, d), "carries_category_token", "branded", "repeated", "short")


@query(f"""WITH {_ITEMS}, u AS (SELECT corrupted AS truth, unnest(['no_token', 'repeated_or_short']) AS shortcut, unnest([NOT token, repeated OR short]) AS f FROM x), c AS (SELECT shortcut, {_COUNTS.format(f='f')} FROM u GROUP BY ALL) SELECT *, {_MEASURES} FROM c""")
def shortcut_scores(spark, d):
    return judging.shortcut_scores(artefact_items(spark, d), {"no_token": ~F.col("carries_category_token"), "repeated_or_short": F.col("repeated") | F.col("short")})


# protocols
_EVENTS = """ev AS (SELECT event_id, 'main' AS run, 'reader-' || (user_id % 5) AS annotator, CASE WHEN event_type = 'click' AND event_id % 50 = 0 THEN 'consent' ELSE 'label' END AS kind,
 CASE event_id % 6 WHEN 0 THEN 'wrong' WHEN 1 THEN 'maybe' WHEN 2 THEN 'cannot_say' ELSE 'belongs' END AS label, CASE WHEN event_id % 4 = 0 THEN 'register' ELSE '' END AS src, event_id % 3 = 0 AS none FROM events),
jl AS (SELECT *, CASE WHEN kind = 'label' AND label = 'maybe' THEN 'unknown label' WHEN kind = 'label' AND label = 'wrong' AND src = '' THEN 'evidence required' WHEN kind = 'label' AND src = '' AND NOT none THEN 'nothing stated' END AS refusal FROM ev)"""


def label_events(spark, d) -> DataFrame:
    e = F.col("event_id")
    return t(spark, d, "events").select(
        e.alias("position"), F.lit("main").alias("run"), F.concat(F.lit("reader-"), F.col("user_id") % 5).alias("annotator"), F.when((F.col("event_type") == "click") & (e % 50 == 0), "consent").otherwise("label").alias("kind"),
        F.when(e % 6 == 0, "wrong").when(e % 6 == 1, "maybe").when(e % 6 == 2, "cannot_say").otherwise("belongs").alias("label"), F.when(e % 4 == 0, "register").otherwise("").alias("evidence_source"), F.lit("").alias("evidence_url"), (e % 3 == 0).alias("no_source"))


@query(f"WITH {_EVENTS} SELECT annotator, kind, refusal, count(*)::BIGINT AS n FROM jl GROUP BY ALL")
def label_protocol(spark, d):
    return protocol.judged_labels(label_events(spark, d)).groupBy("annotator", "kind", "refusal").agg(F.count(F.lit(1)).alias("n"))


_NEXT = "pg AS (SELECT annotator, run, count(*) FILTER (kind = 'label') AS done, bool_or(kind = 'consent') AS consented FROM jl WHERE refusal IS NULL GROUP BY ALL), it AS (SELECT 'i' || lpad(o_orderkey::VARCHAR, 9, '0') AS item_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS total FROM orders)"


def label_items(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(F.lit("main").alias("run"), F.concat(F.lit("i"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("item_id"))


@query(f"WITH {_EVENTS}, {_NEXT} SELECT annotator, run, done::BIGINT AS labelled, (SELECT count(*) FROM it)::BIGINT AS total, ((SELECT count(*) FROM it) - done)::BIGINT AS remaining, consented FROM pg")
def label_progress(spark, d):
    return protocol.progress(protocol.judged_labels(label_events(spark, d)), label_items(spark, d))


@query(f"WITH {_EVENTS}, {_NEXT} SELECT annotator, run, item_id FROM pg JOIN it ON done = idx")
def next_item(spark, d):
    return protocol.next_items(protocol.judged_labels(label_events(spark, d)), label_items(spark, d))


_DISPUTED = "dp AS (SELECT c_nationkey AS meeting, c_custkey AS item_id, 'belongs' AS label_a, CASE WHEN c_custkey % 3 = 0 THEN 'cannot_say' ELSE 'wrong' END AS label_b FROM customer WHERE c_custkey % 5 = 0)"


def meeting_input(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    disputed = t(spark, d, "customer").where(k % 5 == 0).select(F.col("c_nationkey").alias("meeting"), k.alias("item_id"), F.lit("belongs").alias("label_a"), F.when(k % 3 == 0, "cannot_say").otherwise("wrong").alias("label_b"))
    m, i = F.col("meeting"), F.col("item_id")
    act = lambda position, kind, item=None, label=None, reason=None: F.struct(position.cast("long").alias("position"), F.lit(kind).alias("kind"), (F.lit(None) if item is None else item).cast("long").alias("item_id"), (F.lit(None).cast("string") if label is None else label).alias("label"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))
    label = F.when((m % 4 == 0) & (i % 10 == 0), "wrong").otherwise(F.col("label_b"))
    per_item = disputed.select("meeting", F.inline(F.array(act(10 + 2 * i, "decision", i, F.lit("belongs"), F.lit(protocol.REASONS[0])), act(11 + 2 * i, "decision", i, label, F.when((m % 5 == 1) & (i % 4 == 0), "because").otherwise(protocol.REASONS[1])))))
    per_meeting = disputed.select("meeting").distinct().select("meeting", F.inline(F.array(act(F.when(m % 3 == 2, 3000).otherwise(0), "opened"), act(F.lit(500), "closed"), act(F.lit(10_000_000), "closed"), act(F.lit(10_000_001), "closed"))))
    return per_item.unionByName(per_meeting), disputed


@query(f"""WITH {_DISPUTED}, act AS (SELECT meeting, 10 + 2 * item_id AS position, 'decision' AS kind, item_id, 'belongs' AS label, 'source_positive_and_specific' AS reason FROM dp
 UNION ALL SELECT meeting, 11 + 2 * item_id, 'decision', item_id, CASE WHEN meeting % 4 = 0 AND item_id % 10 = 0 THEN 'wrong' ELSE label_b END, CASE WHEN meeting % 5 = 1 AND item_id % 4 = 0 THEN 'because' ELSE 'sources_conflict' END FROM dp
 UNION ALL SELECT meeting, CASE WHEN meeting % 3 = 2 THEN 3000 ELSE 0 END, 'opened', NULL, NULL, NULL FROM (SELECT DISTINCT meeting FROM dp) UNION ALL SELECT meeting, p, 'closed', NULL, NULL, NULL FROM (SELECT DISTINCT meeting FROM dp), (VALUES (500), (10000000), (10000001)) AS v(p)),
op AS (SELECT meeting, min(position) AS opened_at FROM act WHERE kind = 'opened' GROUP BY meeting),
fine AS (SELECT act.* FROM act JOIN op USING (meeting) JOIN dp USING (meeting, item_id) WHERE kind = 'decision' AND position > opened_at AND reason <> 'because' AND label IN (label_a, label_b, 'cannot_say')),
first_ok AS (SELECT meeting, item_id, min(position) AS position FROM fine GROUP BY ALL), tot AS (SELECT meeting, count(*) AS total FROM dp GROUP BY meeting),
cl AS (SELECT act.meeting, min(act.position) AS closed_at FROM act JOIN tot USING (meeting) WHERE kind = 'closed' AND (SELECT count(*) FROM first_ok f WHERE f.meeting = act.meeting AND f.position < act.position) = total GROUP BY act.meeting)
SELECT meeting, opened_at < coalesce(closed_at, 20000000) AS opened, closed_at IS NOT NULL AS closed, (SELECT count(DISTINCT item_id) FROM fine f WHERE f.meeting = tot.meeting AND f.position < coalesce(closed_at, 20000000))::BIGINT AS decided, total::BIGINT AS total FROM tot LEFT JOIN op USING (meeting) LEFT JOIN cl USING (meeting)""")
def adjudication_state(spark, d):
    actions, disputed = meeting_input(spark, d)
    return protocol.meeting_state(protocol.judged_actions(actions, disputed), disputed)


# named in the survey, of operators that other queries use in part
@query(f"WITH {GEO} SELECT id, arg_min(place_id, (km, place_id)) AS place_id, round(min(km), 6) AS distance_km FROM near GROUP BY id")
def nearest_place(spark, d):
    return spatial.nearest(points(spark, d), places(spark, d).drop("nation"), "id").select("id", "place_id", F.round("distance_km", 6).alias("distance_km"))


@query("""WITH v AS (SELECT s.s_suppkey AS id, p.p_partkey AS other, string_split(a.p_name, ' ') AS x, string_split(p.p_name, ' ') AS y FROM supplier s JOIN part a ON a.p_partkey = s.s_suppkey JOIN part p ON p.p_brand = a.p_brand AND p.p_partkey <> a.p_partkey),
j AS (SELECT id, other, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS s FROM v) SELECT id, arg_min(other, (-round(s, 9), other)) AS best, round(max(s), 6) AS score FROM j GROUP BY id HAVING max(s) > 0""")
def token_jaccard_match(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    one = p.join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey")), "p_partkey").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_name").alias("name"))
    return screen_match(one, p.select(F.col("p_partkey").alias("other"), "p_brand", F.col("p_name").alias("o_name")))


def screen_match(records: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry of each record's group with the most similar set of tokens. Only names that share a token meet, and each name
    of a group once, under the least id that bears it."""
    named = entries.groupBy("p_brand", "o_name").agg(F.sort_array(F.collect_set("other")).alias("_ids")).select("p_brand", "o_name", F.slice("_ids", 1, 2).alias("_ids"))
    token = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda x: x != "")))
    met = records.withColumn("_t", token("name")).join(named.withColumn("_t", token("o_name")), ["p_brand", "_t"]).select("id", "name", "o_name", "_ids").distinct()
    other = F.get(F.filter("_ids", lambda x: x != F.col("id")), F.lit(0))
    scored = met.select("id", other.alias("other"), judging.token_jaccard(F.col("name"), F.col("o_name")).alias("s")).where("other is not null")
    best = scored.groupBy("id").agg(F.min(F.struct((-F.round("s", 9)).alias("r"), "other", "s")).alias("m"))
    return best.select("id", F.col("m.other").alias("best"), F.round("m.s", 6).alias("score"))


@query("""WITH c AS (SELECT source, count(*) AS available FROM documents GROUP BY source) SELECT source, least(available, 200)::BIGINT AS quota FROM c""")
def redistribute(spark, d):
    n = {r.source or "": r.n for r in t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    out = sampling.redistribute({s: min(200, k) for s, k in n.items()}, n)
    return spark.createDataFrame([(s or None, q) for s, q in out.items()], "source string, quota long")
