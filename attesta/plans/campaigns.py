"""Queries around the studies: choices, control sets, arms and the bookkeeping of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import stats
from attesta.operators import campaign, judging, scoring
from attesta.plans.catalogue import HAVERSINE, _COUNTS, _JUDGED, _LONG, judged, long_form, query, readers, t
from attesta.plans.studies import _DICTIONARY, _DONORS, _tail_sql, _words, answer_rows, donor_input

_CITIES = """c AS (SELECT c_custkey AS city, c_nationkey % 5 AS language, c_nationkey AS country, c_custkey % 97 AS named, c_custkey % 31 AS phone, c_custkey % 17 AS website, c_custkey % 7 <> 0 AS eligible FROM customer),
k AS (SELECT *, CASE WHEN named = 0 THEN 0 ELSE round((100.0::DOUBLE * phone / named + 100.0::DOUBLE * website / named) / 2, 2) END AS completeness FROM c)"""


def city_rows(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(k.alias("city"), (F.col("c_nationkey") % 5).alias("language"), F.col("c_nationkey").alias("country"), (k % 97).alias("named"), (k % 31).alias("phone"), (k % 17).alias("website"), (k % 7 != 0).alias("eligible"))
    return campaign.completeness(c, "phone", "website")


@query(f"""WITH {_CITIES}, e AS (SELECT * FROM k WHERE eligible), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, country ORDER BY completeness DESC, city) AS r FROM e) WHERE r = 1),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, country ORDER BY completeness, city DESC) AS r FROM e) WHERE r = 1),
b AS (SELECT language, country, city, completeness, 'mature' AS maturity FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY completeness DESC, city) AS q FROM m) WHERE q <= 2
 UNION ALL SELECT language, country, city, completeness, 'developing' FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY completeness, city DESC) AS q FROM v) WHERE q <= 2)
SELECT b.*, s.separated FROM b JOIN (SELECT language, count(*) FILTER (maturity = 'mature') = 2 AND count(*) FILTER (maturity <> 'mature') = 2 AND count(DISTINCT city) = 4 AND min(completeness) FILTER (maturity = 'mature') > max(completeness) FILTER (maturity <> 'mature') AS separated FROM b GROUP BY language) s USING (language)""")
def city_selection(spark, d):
    return campaign.select_cities(city_rows(spark, d), 2).select("language", "country", "city", "completeness", "maturity", "separated")


_MODEL_J = f"s AS (SELECT system AS model, {_COUNTS.format(f='flagged')} FROM l GROUP BY ALL), j AS (SELECT model, round({stats.youden('tp', 'fn', 'tn', 'fp')}, 6) AS j FROM s)"


@query(f"WITH {_LONG}, {_MODEL_J}, r AS (SELECT model, row_number() OVER (ORDER BY j DESC, model) - 1 AS r, count(*) OVER () AS n FROM j) SELECT 'best' AS role, model FROM r WHERE r = 0 UNION ALL SELECT 'median', model FROM r WHERE r = n // 2")
def model_selection(spark, d):
    scored = scoring.with_measures(scoring.confusion(long_form(spark, d).withColumnRenamed("system", "model"), "model"))
    return campaign.select_models(scored, "youden_j")


@query(f"WITH {_LONG}, s AS (SELECT system AS model, item % 3 AS version, {_COUNTS.format(f='flagged')} FROM l GROUP BY ALL) SELECT model, arg_min(version, (-round({stats.youden('tp', 'fn', 'tn', 'fp')}, 6), version)) AS version FROM s GROUP BY model")
def prompt_version_choice(spark, d):
    rows = long_form(spark, d).withColumn("version", F.col("item") % 3).withColumnRenamed("system", "model")
    return campaign.choose_version(scoring.with_measures(scoring.confusion(rows, "model", "version")), "youden_j")


_NAMES = "CASE item % 4 WHEN 0 THEN 'ring shop' WHEN 1 THEN 'abc' ELSE 'long name' END"


@query(f"""WITH {_LONG}, x AS (SELECT system AS model, floor(item / 2)::BIGINT AS pair_id, truth, flagged, {_NAMES} AS name FROM l), kept AS (SELECT DISTINCT pair_id FROM x WHERE NOT truth AND length(name) >= 6 AND NOT list_has_any(string_split(name, ' '), {list(_DICTIONARY)!r})),
s AS (SELECT model, {_COUNTS.format(f='flagged')} FROM x GROUP BY ALL), m AS (SELECT model, {_COUNTS.format(f='flagged')} FROM x SEMI JOIN kept USING (pair_id) GROUP BY ALL),
o AS (SELECT s.model, s.tp + s.fn + s.tn + s.fp AS items_whole, round({stats.youden('s.tp', 's.fn', 's.tn', 's.fp')}, 6) AS j_whole, m.tp + m.fn + m.tn + m.fp AS items_matched, round({stats.youden('m.tp', 'm.fn', 'm.tn', 'm.fp')}, 6) AS j_matched FROM s JOIN m USING (model))
SELECT *, round(j_matched - j_whole, 6) AS j_change FROM o""")
def matched_subset(spark, d):
    i = F.col("item")
    rows = long_form(spark, d).select(F.col("system").alias("model"), F.floor(i / 2).alias("pair_id"), "truth", "flagged", F.when(i % 4 == 0, "ring shop").when(i % 4 == 1, "abc").otherwise("long name").alias("name"))
    kept = campaign.matched_pairs_kept(rows.select("pair_id", "name", F.col("truth").alias("corrupted")), _words())
    return campaign.whole_and_subset(rows, kept, "model")


_READ = "CASE WHEN doc_id % 9 = 0 THEN 'cannot_say' WHEN {c} = 1 THEN 'belongs' ELSE 'wrong' END"


@query(f"""WITH r AS (SELECT {_READ.format(c='quality')} AS first, {_READ.format(c='(CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END)').replace('% 9', '% 10')} AS second FROM labels), d AS (SELECT first = 'wrong' AS a, second = 'wrong' AS b FROM r WHERE first <> 'cannot_say' AND second <> 'cannot_say'),
w AS (SELECT 'second' AS predicted, 'first' AS reference, a AS truth, b AS f FROM d UNION ALL SELECT 'first', 'second', b, a FROM d), c AS (SELECT predicted, reference, {_COUNTS.format(f='f')} FROM w GROUP BY ALL)
SELECT predicted, reference, (tp + fn)::BIGINT AS positives, {', '.join(f"{stats.measures()[n]} AS {n}" for n in ('balanced_accuracy', 'ba_low', 'ba_high'))} FROM c""")
def mutual_accuracy(spark, d):
    said = lambda c, n: F.when(F.col("doc_id") % n == 0, "cannot_say").when(F.col(c) == 1, "belongs").otherwise("wrong")
    return campaign.mutual_accuracy(readers(spark, d).select(said("first", 9).alias("first"), said("second", 10).alias("second")))


@query(f"""WITH {_DONORS}, h AS (SELECT r.*, 'sig' || (id % 3) AS signature, row_number() OVER (PARTITION BY grp ORDER BY md5('42:' || grp || ':' || id), id) <= floor(count(*) OVER (PARTITION BY grp) * 0.5) AS withheld FROM r),
fit AS (SELECT * FROM h WHERE length(name) >= 6 AND NOT branded AND NOT list_has_any(string_split(name, ' '), {list(_DICTIONARY)!r}) AND (withheld, grp, name) IN (SELECT (withheld, grp, name) FROM h GROUP BY withheld, grp, name HAVING count(*) = 1)),
p0 AS (SELECT *, row_number() OVER (PARTITION BY grp, signature ORDER BY md5('42:' || grp || ':' || signature || ':' || id), id) AS rn, count(*) OVER (PARTITION BY grp, signature) AS n FROM fit WHERE NOT withheld),
p1 AS (SELECT *, floor((rn - 1) / 2)::BIGINT AS pair_no, rn % 2 = ('0x' || substr(md5('42:' || grp || ':' || signature || ':' || floor((rn - 1) / 2)::BIGINT), 1, 1))::INT % 2 AS corrupted FROM p0 WHERE rn <= n - n % 2),
ch AS (SELECT grp, signature, pair_no, row_number() OVER (PARTITION BY grp ORDER BY md5('42:pair:' || grp || ':' || signature || ':' || pair_no), signature, pair_no) AS k FROM (SELECT DISTINCT grp, signature, pair_no FROM p1)),
p2 AS (SELECT p1.*, grp || '-' || lpad(k::VARCHAR, 4, '0') AS pair_id FROM p1 JOIN ch USING (grp, signature, pair_no) WHERE k <= 8),
num AS (SELECT id AS donor, grp, name AS d_name, category AS d_category, lat AS d_lat, lon AS d_lon, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM fit WHERE withheld),
tried AS (SELECT p2.id, p2.grp, p2.name, p2.category, p2.lat, p2.lon, try, ('0x' || substr(md5('42:' || try || ':' || id), 1, 8))::BIGINT % size AS idx FROM p2 JOIN (SELECT DISTINCT grp, size FROM num) USING (grp), range(24) AS a(try) WHERE corrupted),
dn AS (SELECT id, arg_min(donor, try) AS donor, arg_min(d_name, try) AS d_name FROM tried JOIN num USING (grp, idx) WHERE donor <> id AND category <> d_category AND name <> d_name AND {HAVERSINE.format(a='lat', b='lon', p='d_lat', q='d_lon')} >= 2 GROUP BY id),
o AS (SELECT p2.*, donor, coalesce(d_name, name) AS shown_name FROM p2 LEFT JOIN dn USING (id)), w AS (SELECT * FROM o WHERE pair_id IN (SELECT pair_id FROM o WHERE donor IS NOT NULL)),
sp AS (SELECT pair_id, row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) AS r, count(*) OVER () AS of FROM (SELECT DISTINCT pair_id FROM w))
SELECT id, pair_id, CASE WHEN corrupted THEN 1 ELSE 2 END AS member, corrupted, donor, shown_name, CASE WHEN r <= round(of * 0.2) THEN 'dev' WHEN r <= round(of * 0.2) + round(of * 0.3) THEN 'train' ELSE 'test' END AS split FROM w JOIN sp USING (pair_id)""")
def control_set(spark, d):
    rows = donor_input(spark, d).withColumn("signature", F.concat(F.lit("sig"), F.col("id") % 3))
    return campaign.control_set(rows, "grp", "signature", _words(), "id", 8, {"dev": 0.2, "train": 0.3, "test": 0.5}).select("id", "pair_id", "member", "corrupted", "donor", "shown_name", "split")


@query("""WITH x AS (SELECT doc_id, quality = 0 AS positive, lang, row_number() OVER (ORDER BY doc_id) AS position FROM labels JOIN documents USING (doc_id)), r AS (SELECT lang, avg(positive::INT) AS rate FROM x WHERE position <= 100 GROUP BY lang)
SELECT count(*) FILTER (position <= 100 AND positive)::BIGINT AS observed, round(sum(CASE WHEN position <= 100 THEN positive::INT ELSE coalesce(rate, 0) END), 6) AS expected FROM x LEFT JOIN r USING (lang)""")
def expected_yield(spark, d):
    from pyspark.sql import Window

    x = judged(spark, d).select("lang", F.col("truth").alias("positive"), F.row_number().over(Window.orderBy("doc_id")).alias("position"))  # labelled items: as many as people label
    rates = x.where("position <= 100").groupBy("lang").agg(F.avg(F.col("positive").cast("int")).alias("rate"))
    return campaign.expected_yield(x, rates, 100, "lang").select("observed", F.round("expected", 6).alias("expected"))


_ARMS = "('a', 'd1', 'd2'), ('b', 'd3', 'd1'), ('c', 'd2', 'd4')"


@query(f"""WITH {_LONG}, pl(arm, arm_model, base_model) AS (VALUES {_ARMS}), pr AS (SELECT arm, arm_model, base_model, count(*)::BIGINT AS items, count(*) FILTER (x.correct AND NOT y.correct)::BIGINT AS first_only, count(*) FILTER (NOT x.correct AND y.correct)::BIGINT AS second_only FROM pl JOIN l x ON x.system = arm_model JOIN l y ON y.system = base_model AND y.item = x.item GROUP BY ALL),
{_tail_sql('pr')}, s AS (SELECT system, {_COUNTS.format(f='flagged')} FROM l GROUP BY ALL), m AS (SELECT system, {', '.join(f"{stats.measures()[n]} AS {n}" for n in ('youden_j', 'j_low', 'j_high', 'flag_rate'))} FROM s)
SELECT e.*, x.youden_j AS arm_youden_j, x.j_low AS arm_j_low, x.j_high AS arm_j_high, x.flag_rate AS arm_flag_rate, y.youden_j AS base_youden_j, y.j_low AS base_j_low, y.j_high AS base_j_high, y.flag_rate AS base_flag_rate FROM e JOIN m x ON x.system = arm_model JOIN m y ON y.system = base_model""")
def arm_comparisons(spark, d):
    rows = long_form(spark, d).select(F.lit("r").alias("run"), F.col("system").alias("model"), F.col("item").alias("item_id"), "truth", "flagged")
    plan = spark.createDataFrame([("a", "r", "d1", "r", "d2"), ("b", "r", "d3", "r", "d1"), ("c", "r", "d2", "r", "d4")], "arm string, arm_run string, arm_model string, base_run string, base_model string")
    return campaign.compare_arms(plan, rows).drop("arm_run", "base_run")


_RUNS = """a AS (SELECT 'run' || (user_id % 3) AS run, event_type AS model, event_id % 6 <> 0 AS valid, value AS total_sec, (event_id % 5)::DOUBLE AS tokens_per_sec, event_id % 4 AS output_tokens, CASE WHEN event_id % 8 = 0 THEN 'n/a' ELSE (event_id % 8 / 100.0)::VARCHAR END AS cost FROM events)"""


def run_rows(spark, d):
    e = F.col("event_id")
    return t(spark, d, "events").select(
        F.concat(F.lit("run"), F.col("user_id") % 3).alias("run"), F.col("event_type").alias("model"), (e % 6 != 0).alias("valid"), F.col("value").alias("total_sec"), (e % 5).cast("double").alias("tokens_per_sec"), (e % 4).alias("output_tokens"),
        F.when(e % 8 == 0, "n/a").otherwise((e % 8 / 100.0).cast("string")).alias("cost"))


@query(f"""WITH {_RUNS} SELECT run, model, count(*)::BIGINT AS answers, count(*) FILTER (NOT valid)::BIGINT AS invalid, round(median(total_sec) FILTER (total_sec > 0), 3) AS median_total_sec, round(median(tokens_per_sec) FILTER (tokens_per_sec > 0), 2) AS median_tokens_per_sec,
 round(median(output_tokens) FILTER (output_tokens > 0), 1) AS median_output_tokens, round(sum(total_sec) FILTER (total_sec > 0), 1) AS wall_sec, round(count(*) FILTER (NOT valid) / count(*), 4) AS invalid_rate FROM a GROUP BY ALL""")
def run_summary(spark, d):
    return campaign.run_summary(run_rows(spark, d))


@query(f"WITH {_RUNS} SELECT model, round(sum(coalesce(try_cast(cost AS DOUBLE), 0)), 6) AS cost, round(100 - round(sum(coalesce(try_cast(cost AS DOUBLE), 0)), 6), 6) AS \"left\" FROM a GROUP BY model")
def spending(spark, d):
    return campaign.spent(run_rows(spark, d), 100.0)


@query(f"""WITH {_RUNS}, p AS (SELECT 'run' || r AS run, model, r <> 1 AS constrained, (SELECT count(*) FROM a WHERE run = 'run0' AND model = 'click') AS expected FROM range(4) AS z(r), (SELECT DISTINCT model FROM a UNION ALL SELECT 'ghost') m),
n AS (SELECT run, model, count(*) AS n, count(*) FILTER (NOT valid) AS bad FROM a GROUP BY ALL), q AS (SELECT run, model, unnest(list_filter([CASE WHEN n IS NULL THEN 'no answers' END, CASE WHEN n <> expected THEN 'other number of answers' END, CASE WHEN constrained AND bad / n > 0.15 THEN 'too many invalid answers' END], lambda x: x IS NOT NULL)) AS problem FROM p LEFT JOIN n USING (run, model))
SELECT run, model, problem FROM q UNION ALL SELECT NULL, 'view', 'partly on the host' UNION ALL SELECT NULL, 'ghost', 'not in the summary'""")
def run_problems(spark, d):
    a = run_rows(spark, d)
    models = a.select("model").distinct().unionByName(spark.createDataFrame([("ghost",)], "model string"))
    runs = spark.range(4).select(F.concat(F.lit("run"), "id").alias("run"), (F.col("id") != 1).alias("constrained"))
    expected = a.where("run = 'run0' and model = 'click'").agg(F.count(F.lit(1)).alias("expected"))
    plan = campaign.planned(models, runs).crossJoin(expected)  # one row
    return campaign.run_problems(plan, a, a.select("model"), spark.createDataFrame([("view", True), ("click", False)], "model string, offloaded boolean"))


@query("""WITH m(model, footprint_gb, quantization, reported, configured_b, offloaded, expected_class) AS (VALUES ('a', 3.0, 'q4', '7B', 7.0, false, 'deployable'), ('b', 20.0, 'q8', '350M', 0.35, false, 'deployable'), ('c', NULL, 'q4', 'many', 1.0, true, 'reference'), ('d', 9.0, 'q4', '1.5', 2.0, true, 'reference'))
SELECT model, CASE WHEN footprint_gb <= 8 THEN 'deployable' WHEN footprint_gb IS NOT NULL THEN 'reference' END AS measured_class, CASE WHEN footprint_gb IS NULL THEN NULL ELSE (CASE WHEN footprint_gb <= 8 THEN 'deployable' ELSE 'reference' END) = expected_class END AS as_expected,
 array_to_string(list_filter([CASE WHEN quantization <> 'q4' THEN 'other quantization' END, CASE WHEN abs(try_cast(regexp_replace(reported, '[BM]$', '') AS DOUBLE) * CASE WHEN ends_with(reported, 'M') THEN 0.001 ELSE 1 END - configured_b) > 0.1 THEN 'other size' END, CASE WHEN offloaded THEN 'partly on the host' END], lambda x: x IS NOT NULL), '; ') AS problem FROM m""")
def model_classes(spark, d):
    rows = [("a", 3.0, "q4", "7B", 7.0, False, "deployable"), ("b", 20.0, "q8", "350M", 0.35, False, "deployable"), ("c", None, "q4", "many", 1.0, True, "reference"), ("d", 9.0, "q4", "1.5", 2.0, True, "reference")]
    df = spark.createDataFrame(rows, "model string, footprint_gb double, quantization string, reported string, configured_b double, offloaded boolean, expected_class string")
    return campaign.classify_models(df, 8.0, "q4").select("model", "measured_class", "as_expected", "problem")


@query(f"""WITH {_LONG}, b AS (SELECT system AS model, item, truth, flagged, truth = flagged AS right FROM l), o AS (SELECT item, right AS other FROM b WHERE model = 'd3'), pr AS (SELECT model, count(*) FILTER (right AND NOT other)::BIGINT AS first_only, count(*) FILTER (NOT right AND other)::BIGINT AS second_only FROM b JOIN o USING (item) GROUP BY model), {_tail_sql('pr')}
SELECT *, p_value < 0.05 AND first_only > second_only AS passes FROM e""".replace("AS right", "AS hit").replace("right AND", "hit AND").replace("NOT right", "NOT hit").replace("item, right AS other", "item, hit AS other"))
def baseline_dominance(spark, d):
    answers, items = answer_rows(spark, d)
    rows = long_form(spark, d).select(F.col("system").alias("model"), F.col("item").alias("item_id"), "truth", "flagged")
    return judging.against(rows, rows.where("model = 'd3'").select("item_id", "truth", "flagged"))


@query(f"SELECT city, count(*)::BIGINT AS n, count(*) FILTER (truth)::BIGINT AS wrong FROM (SELECT source AS city, truth FROM ({_JUDGED})) GROUP BY city")
def truth_by_city(spark, d):
    _, items = answer_rows(spark, d)
    return items.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count_if("corrupted").alias("wrong"))
