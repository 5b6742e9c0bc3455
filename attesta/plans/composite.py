"""Queries of the composite reports, beside the catalogue's, in the same form."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import rules, stats
from attesta.operators import reports, retrieval, scoring
from attesta.plans.catalogue import _COUNTS, _JUDGED, _LONG, _READERS, ORACLE_SQL, corrupted_urls, hours_values, judged, long_form, query, random_triage, readers, t, tally

_MEASURES = ", ".join(f"{e} AS {n}" for n, e in stats.measures().items())
_VARIANTS = {"strict": "quality = 0", "lenient": "quality = 0 OR toxic = 1", "definite": "CASE WHEN quality = 0 AND toxic = 1 THEN NULL ELSE quality = 0 END"}


@query(f"""WITH j AS (SELECT quality, toxic, n_chars < 500 AS flagged, lang FROM labels JOIN documents USING (doc_id)),
v AS ({" UNION ALL ".join(f"SELECT '{n}' AS rule, lang, flagged, {e} AS truth FROM j" for n, e in _VARIANTS.items())}),
c AS (SELECT rule, lang, {_COUNTS.format(f='flagged')} FROM v WHERE truth IS NOT NULL GROUP BY ALL) SELECT *, {_MEASURES} FROM c""")
def label_rule_sensitivity(spark, d):
    both = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("flagged", F.col("n_chars") < 500)
    return reports.truth_variants(both, _VARIANTS, "lang")


@query(f"""WITH r AS ({_READERS}), x AS (SELECT doc_id, doc_id % 3 AS k FROM r WHERE first IS DISTINCT FROM second),
d AS (SELECT doc_id, CASE k WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS decided FROM x), g AS (SELECT CASE WHEN first = second THEN first ELSE decided END AS label, CASE WHEN first = second THEN 'agreed' WHEN decided IS NOT NULL THEN 'adjudicated' ELSE 'open' END AS source FROM r LEFT JOIN d USING (doc_id))
SELECT label::INT AS label, source, label IS NOT NULL AS scored, count(*)::BIGINT AS n FROM g GROUP BY ALL""")
def gold_labels(spark, d):
    r = readers(spark, d).withColumnRenamed("doc_id", "item")
    apart, k = r.where(~F.col("first").eqNullSafe(F.col("second"))), F.col("item") % 3
    # two actions each: the later one counts
    log = apart.where(k != 0).select("item", F.explode(F.array(F.struct(F.lit(0).alias("position"), F.when(k == 1, 0).otherwise(1).alias("label")), F.struct(F.lit(1).alias("position"), F.when(k == 1, 1).otherwise(0).alias("label")))).alias("a")).select("item", "a.*")
    return reports.gold_labels(r, log).groupBy(F.col("label").cast("int").alias("label"), "source", "scored").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT source, count(*) FILTER (hit)::BIGINT AS hits, count(hit)::BIGINT AS attempts FROM (SELECT source, CASE WHEN d1 THEN d2 END AS hit FROM ({_JUDGED})) GROUP BY source)
SELECT *, round({stats.wilson_point('hits', 'attempts')}, 6) AS share, round({stats.wilson_low('hits', 'attempts')}, 6) AS low, round({stats.wilson_high('hits', 'attempts')}, 6) AS high FROM c""")
def field_accuracy(spark, d):
    return reports.field_accuracy(judged(spark, d).withColumn("field_hit", F.when(F.col("d1"), F.col("d2"))), "source")


@query(f"""WITH {_LONG}, b AS (SELECT system AS model, flagged AS f1, CASE WHEN item % 11 = 0 THEN NOT flagged ELSE flagged END AS f2 FROM l WHERE system <> 'd3')
SELECT model, count(*)::BIGINT AS items, count(*) FILTER (f1 = f2)::BIGINT AS same, count(*) FILTER (f1 AND NOT f2)::BIGINT AS lost, count(*) FILTER (NOT f1 AND f2)::BIGINT AS gained FROM b GROUP BY model""")
def replay_agreement(spark, d):
    first = long_form(spark, d).withColumnRenamed("system", "model")
    turned = first.withColumn("flagged", F.when(F.col("item") % 11 == 0, ~F.col("flagged")).otherwise(F.col("flagged")))
    # the third model's replay is incomplete, so it is left out
    return reports.replay_agreement(first, turned.where("model <> 'd3' or item % 2 = 0"))


@query(f"""WITH s AS (SELECT doc_id, n_chars::DOUBLE AS score, quality = 0 AS truth FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (ORDER BY md5('42:all:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.3) AS cal FROM s), b AS (SELECT score, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM p WHERE cal GROUP BY score),
r AS (SELECT score, coalesce(sum(p) OVER w, 0) AS tp, coalesce(sum(n) OVER w, 0) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM b WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT score AS cut FROM r ORDER BY round({stats.youden('tp', '(pp - tp)', '(nn - fp)', 'fp')}, 12) DESC, score DESC LIMIT 1), c AS (SELECT cut, {_COUNTS.format(f='score < cut')} FROM p, k WHERE NOT cal GROUP BY cut) SELECT *, {_MEASURES} FROM c""")
def calibrated_split_scores(spark, d):
    s = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 0).alias("truth"))
    return reports.calibrated(s, 0.3, 42, "doc_id")


@query(f"""WITH {_LONG}, n AS (SELECT system, truth, count(*) AS c FROM l GROUP BY ALL), r AS (SELECT system, source, (item % 97)::DOUBLE AS x, correct::INT::DOUBLE AS y, 0.5::DOUBLE / c AS w FROM l JOIN n USING (system, truth)),
g AS (SELECT system, source, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT system, sum(sw) AS tw, sum(sx) AS tx, sum(sy) AS ty, sum(sxx) AS txx, sum(sxy) AS txy, count(*) AS clusters, sum(k) AS items FROM g GROUP BY system),
f AS (SELECT *, tw * txx - tx * tx AS d, (tw * txy - tx * ty) / (tw * txx - tx * tx) AS b FROM h), e AS (SELECT *, (ty - b * tx) / tw AS a FROM f)
SELECT system, round(b, 8) AS slope, round(a, 8) AS intercept, round(sqrt(clusters / (clusters - 1.0::DOUBLE) * (items - 1.0::DOUBLE) / (items - 2.0::DOUBLE) * sum(power((-tx * (sy - a * sw - b * sx) + tw * (sxy - a * sx - b * sxx)) / d, 2))), 8) AS se, clusters::BIGINT AS clusters, items::BIGINT AS items
FROM g JOIN e USING (system) GROUP BY system, a, b, clusters, items""")
def weighted_size_trend(spark, d):
    rows = reports.with_class_weights(long_form(spark, d), "system").withColumns({"x": F.col("item") % 97, "y": F.col("correct").cast("int")})
    return reports.weighted_trend(rows, "source", "system")


@query("""WITH c AS (SELECT count(*) AS pool, count(*) FILTER (quality = 0) AS positives, floor(count(*) / 5)::BIGINT AS reviewed FROM labels),
p AS (SELECT k, exp(lgamma(positives + 1) - lgamma(k + 1) - lgamma(positives - k + 1) + lgamma(pool - positives + 1) - lgamma(reviewed - k + 1) - lgamma(pool - positives - reviewed + k + 1) - lgamma(pool + 1) + lgamma(reviewed + 1) + lgamma(pool - reviewed + 1)) AS p
  FROM c, unnest(range(0, least(positives, reviewed) + 1)) AS r(k) WHERE reviewed - k <= pool - positives), s AS (SELECT k, sum(p) OVER (ORDER BY k) AS total FROM p)
SELECT pool, positives, reviewed, round(reviewed * positives / pool, 6) AS expected, (SELECT min(k) FROM s WHERE total >= 0.025) AS low, (SELECT min(k) FROM s WHERE total >= 0.975 - 1e-12) AS high FROM c""")
def random_triage_bounds(spark, d):
    counts = t(spark, d, "labels").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("quality") == 0).alias("positives")).withColumn("reviewed", F.floor(F.col("pool") / 5))

    def bounds(batches):
        for b in batches:  # one row
            mean, low, high = zip(*(random_triage(*map(int, r)) for r in b[["pool", "positives", "reviewed"]].itertuples(index=False)), strict=True)
            yield b.assign(expected=[round(x, 6) for x in mean], low=low, high=high)

    return counts.mapInPandas(bounds, "pool long, positives long, reviewed long, expected double, low long, high long")


@query(f"""SELECT 'website_syntax' AS "check", outcome, n FROM ({ORACLE_SQL['website_verdicts']}) UNION ALL SELECT 'opening_hours_syntax', outcome, sum(n)::BIGINT FROM ({ORACLE_SQL['opening_hours_verdicts']}) GROUP BY outcome
UNION ALL SELECT 'value_range', CASE detail WHEN 'inside the range' THEN 'pass' ELSE 'flag' END, sum(n)::BIGINT FROM ({ORACLE_SQL['value_range_verdicts']}) GROUP BY ALL""")
def rule_baseline_by_check(spark, d):
    hours = hours_values(spark, d).select(rules.opening_hours_syntax(F.col("value")).alias("v")).select("v.*")
    tags = F.create_map(F.lit("stars"), (F.col("p_size") % 12).cast("string"), F.lit("height"), F.when(F.col("p_size") % 7 == 0, "tall").otherwise((F.col("p_size") / 40.0).cast("decimal(18,3)").cast("string")),
        F.lit("min_age"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") * 5 - 20).cast("string")))
    ranges = t(spark, d, "part").select(F.inline(rules.value_range(tags)))
    websites = corrupted_urls(spark, d).select(rules.website_syntax(F.col("website")).alias("v")).select("v.*")
    return tally(websites.unionByName(hours).unionByName(ranges), "check", "outcome")


@query("""WITH r AS (SELECT p_brand, list_filter([CASE WHEN p_size % 2 = 0 THEN 'a' END, CASE WHEN p_size % 3 = 0 THEN 'b' END], lambda x: x IS NOT NULL) AS raised, CASE WHEN p_size % 5 = 0 THEN ['a'] WHEN p_size % 7 = 0 THEN ['a', 'b'] END AS held FROM part),
x AS (SELECT p_brand, len(raised) > 0 AS hit, len(list_filter(raised, lambda y: NOT list_contains(coalesce(held, []), y))) = 0 AS fine FROM r),
c AS (SELECT p_brand, count(*)::BIGINT AS items, count(*) FILTER (hit)::BIGINT AS flagged, count(*) FILTER (hit AND fine)::BIGINT AS explained, count(*) FILTER (hit AND NOT fine)::BIGINT AS unexplained FROM x GROUP BY ROLLUP (p_brand))
SELECT *, round(""" + stats.wilson_low("unexplained", "items") + ", 6) AS low, round(" + stats.wilson_high("unexplained", "items") + ", 6) AS high FROM c")
def clean_flags_explained(spark, d):
    p = F.col("p_size")
    raised = F.array_compact(F.array(F.when(p % 2 == 0, "a"), F.when(p % 3 == 0, "b")))
    held = F.when(p % 5 == 0, F.array(F.lit("a"))).when(p % 7 == 0, F.array(F.lit("a"), F.lit("b")))
    return reports.explained_flags(t(spark, d, "part").select("p_brand", raised.alias("raised"), held.alias("held")), "p_brand")


@query(f"""WITH c AS ({ORACLE_SQL['cascade']}) SELECT lang, configuration, recall, read_per_1000, EXISTS (SELECT 1 FROM c b WHERE b.lang IS NOT DISTINCT FROM a.lang AND b.configuration <> a.configuration AND b.recall >= a.recall AND b.read_per_1000 <= a.read_per_1000 AND (b.recall > a.recall OR b.read_per_1000 < a.read_per_1000)) AS dominated FROM c a""")
def cascade_dominated(spark, d):
    i = judged(spark, d).select("lang", "truth", F.col("d1").alias("rule_flag"), F.col("d2").alias("lookup_flag"), F.col("d3").alias("candidate"), (F.col("d1") | F.col("d3")).alias("model_flag"))
    return reports.pareto(scoring.cascade(i, "lang").select("lang", "configuration", "recall", "read_per_1000"), ["lang"], "configuration", "recall", "read_per_1000")


@query("""WITH s AS (SELECT a.vec_id, b.vec_id AS c_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id <> b.vec_id)
SELECT vec_id, c_id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, c_id)::INT AS rank FROM s) WHERE rank <= 3""")
def similar_topk(spark, d):
    e = t(spark, d, "embeddings")
    return retrieval.top_matches(e, e, 3, "label", "vec_id", "embedding").select(F.col("id").alias("vec_id"), F.col("other").alias("c_id"), "rank", F.round("score", 6).alias("score"))
