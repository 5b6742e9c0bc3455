import math

import pytest
from pyspark.sql import functions as F

from attesta.functions import stats
from attesta.operators import agreement, eventlog, sampling, scoring, spatial
from attesta.plans.catalogue import hypergeometric, random_triage


def value(spark, text):
    return spark.range(1).select(F.expr(text).alias("x")).first().x


def test_wilson(spark):
    for k, n, low, high in ((9, 300, 0.0159, 0.056), (14, 300, 0.028, 0.0768), (100, 100, 0.963, 1.0)):
        assert round(value(spark, stats.wilson_low(str(k), str(n))), 4) == low
        assert round(value(spark, stats.wilson_high(str(k), str(n))), 4) == high
    assert value(spark, stats.wilson_low("0", "250")) == 0 and 0 < value(spark, stats.wilson_high("0", "250")) < 0.05


def test_balanced_accuracy_interval(spark):
    c = spark.createDataFrame([(14, 286, 291, 9), (40, 0, 60, 0), (40, 0, 0, 60), (10, 2, 0, 0)], "tp long, fn long, tn long, fp long")
    a, b, z, e = scoring.with_measures(c, 4).collect()
    assert (a.balanced_accuracy, a.ba_low, a.ba_high) == (0.5083, 0.4923, 0.525)
    assert (b.youden_j, z.youden_j, z.flag_rate, e.youden_j, e.balanced_accuracy) == (1, 0, 1, 0, 0)


def test_mcnemar(spark):
    pairs = spark.createDataFrame([(0, 0), (12, 0), (15, 15), (111, 102), (127, 114)], "first_only long, second_only long")
    got = [(round(r.p_value, 5), None if r.odds_ratio is None else round(r.odds_ratio, 4)) for r in scoring.with_mcnemar(pairs).orderBy("first_only").collect()]
    assert got == [(1.0, None), (0.00049, None), (1.0, 1.0), (0.58369, 1.0882), (0.43959, 1.114)]
    assert (stats.min_discordant(0.001), stats.min_discordant(0.05)) == (11, 6)


def test_mcnemar_of_many_pairs(spark):
    pairs = spark.createDataFrame([(600, 500), (30000, 29000), (5, 1030), (3_000_000, 3_001_000), (0, 4)], "first_only long, second_only long")
    got = {(r.first_only, r.second_only): r for r in scoring.with_mcnemar(pairs, 9).collect()}

    def exact(b, c):
        return min(1.0, 2 * math.fsum(math.exp(math.lgamma(b + c + 1) - math.lgamma(k + 1) - math.lgamma(b + c - k + 1) - (b + c) * math.log(2)) for k in range(max(0, min(b, c) - 20_000), min(b, c) + 1)))

    assert all(abs(r.p_value - exact(*k)) < 2e-7 for k, r in got.items()) and 0.0027 < got[600, 500].p_value < 0.003
    assert got[0, 4].odds_low == 0 and got[600, 500].odds_low < 1.2 < got[600, 500].odds_high and stats.min_detectable(110, 0.001) == 0.1
    assert math.isclose(stats.binomial_tail(3, 10), 176 / 1024) and math.isclose(stats.binomial_tail(8, 10), 1013 / 1024)


def test_agreement(spark):
    cells = {"bb": 185, "bc": 11, "bw": 5, "cb": 2, "cc": 3, "cw": 1, "wb": 7, "wc": 15, "ww": 21}
    df = spark.createDataFrame([tuple(k) for k, n in cells.items() for _ in range(n)], "first string, second string")
    assert agreement.cohen_kappa(df).first().kappa == 0.537684
    two = [(i, x) for i, (a, b) in enumerate([("y", "y")] * 40 + [("y", "n")] * 10 + [("n", "y")] * 5 + [("n", "n")] * 45) for x in (a, b)]
    r = agreement.multi_reader(spark.createDataFrame(two, "item int, label string"), 2, 2).first()
    assert r.fleiss_kappa == round((0.85 - 0.50125) / (1 - 0.50125), 6) and r.gwet_ac1 == round((0.85 - 0.49875) / (1 - 0.49875), 6)


def test_radius_join_wraps_and_reaches(spark):
    points = spark.createDataFrame([(1, 60.0, 0.0), (2, 10.0, 179.95), (3, 89.99, 0.0)], "id int, lat double, lon double")
    places = spark.createDataFrame([("a", 60.0, 0.35), ("b", 60.0, 1.5), ("c", 10.0, -179.95), ("d", 89.99, 120.0)], "p string, p_lat double, p_lon double")
    assert {(r.id, r.p) for r in spatial.radius_join(points, places, 20).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_radius_join_keeps_rows_of_any_type(spark):
    points = spark.createDataFrame([(1, 10.0, 5.0, {"a": "b"})] * 2 + [(2, None, 5.0, {}), (3, 90.0, 10.0, {}), (4, -10.0, -180.0, {})], "id int, lat double, lon double, tags map<string,string>")
    places = spark.createDataFrame([("p", 10.01, 5.0), ("p", 10.01, 5.0), ("q", 89.9, -170.0), ("r", -10.0, 179.9), ("s", None, 1.0)], "p string, p_lat double, p_lon double")
    assert sorted((r.id, r.p) for r in spatial.radius_join(points, places, 25).collect()) == [(1, "p")] * 4 + [(3, "q"), (4, "r")]


@pytest.mark.parametrize("km", [0.5, 7, 300, 4000, 25_000])
def test_radius_join_finds_all(spark, km):
    from pyspark.sql import functions as F

    from attesta.functions.records import haversine_km

    at = lambda a, b: (F.expr(f"cast((id * {a}) % 1801 / 10.0 - 90 as double)"), F.expr(f"cast((id * {b}) % 3601 / 10.0 - 180 as double)"))
    points = spark.range(400).select("id", at(97, 53)[0].alias("lat"), at(97, 53)[1].alias("lon"))
    places = spark.range(400).select(F.col("id").alias("p"), (at(97, 53)[0] * 0.999).alias("p_lat"), (at(97, 53)[1] * 0.999).alias("p_lon"))
    want = points.crossJoin(places).where(haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) <= km).count()
    assert spatial.radius_join(points, places, km).count() == want


def test_best_matches(spark):
    from attesta.operators import retrieval

    rows = [(i, i % 2, [float(i % 5 - 2), float(i % 7), 1.0]) for i in range(60)] + [(90, 0, None), (91, 1, [0.0, 0.0, 0.0]), (92, 7, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = {(r.id, r["rank"]): (r.other, r.score) for r in retrieval.top_matches(v, v, 3, "g", "id", "v").collect()}

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    for i, g, a in rows:
        best = sorted((-round(cos(a, b), 9), j) for j, h, b in rows if a and b and g == h and i != j)[:3]
        assert [got[i, k + 1][0] for k in range(len(best))] == [j for _, j in best] and (i, len(best) + 1) not in got


def test_sampling(spark):
    assert sampling.redistribute({"a": 5, "b": 5}, {"a": 2, "b": 20}) == {"a": 2, "b": 8}
    with pytest.raises(ValueError, match="fewer"):
        sampling.redistribute({"a": 5}, {"a": 2})
    q = spark.createDataFrame([("a", 0.35), ("b", 0.35), ("c", 0.15), ("d", 0.15)], "k string, s double")
    assert sum(r.quota for r in sampling.largest_remainder(q, 473, "s", "k").collect()) == 473
    e = sampling.equal_allocation(spark.range(12).select(F.col("id").cast("string").alias("k")), 100, 1, "k")
    quotas = [r.quota for r in e.collect()]
    assert sum(quotas) == 100 and max(quotas) - min(quotas) <= 1
    s = sampling.split_share(spark.range(101).withColumn("g", F.lit("x")), ["g"], 0.5, 3, "id")
    assert s.where("withheld").count() == 50
    assert stats.phase2_size([0.25, 0.05], [0.5, 0.5], 30, 120) == 600 and stats.phase2_size([0.25], [1], 130, 120) == 0


def test_ranks_of_any_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "cold").alias("g"))
    got = sampling.ranked(rows, ["g"], 5, "id").collect()
    want = {}
    for r in rows.withColumn("h", sampling.keyed(5, "g", "id")).collect():
        want.setdefault(r.g, []).append((r.h, r.id))
    assert {r.id: (r._r, r._n) for r in got} == {i: (k + 1, len(x)) for x in want.values() for k, (_, i) in enumerate(sorted(x))}
    splits = sampling.assign_splits(rows, {"a": 0.2, "b": 0.3, "c": 0.5}, 5, "id").groupBy("split").count()
    assert {r.split: r["count"] for r in splits.collect()} == {"a": 600, "b": 900, "c": 1500}


def test_threshold_in_buckets(spark):
    s = spark.range(5000).select((F.col("id") * 7919 % 1777 / 10.0).alias("score"), (F.col("id") * 31 % 100 < 40 - F.col("id") * 7919 % 1777 / 60.0).alias("truth"))
    rows = s.collect()
    cuts = sorted({r.score for r in rows})
    pos = sum(r.truth for r in rows)
    best = max((round(sum(r.truth for r in rows if r.score < c) / pos - sum(not r.truth for r in rows if r.score < c) / (len(rows) - pos), 12), c) for c in cuts)
    assert all(tuple(scoring.threshold(s, buckets=b).first()) == (best[1], best[0]) for b in (1, 7, 64))


def test_threshold_and_weights(spark):
    s = spark.createDataFrame([(0.1, True), (0.2, True), (0.8, False), (0.9, False), (float("nan"), True)], "score double, truth boolean")
    r = scoring.threshold(s).first()
    assert (r.cut, r.j) == (0.8, 1.0)
    w = spark.createDataFrame([(0.1, True, True), (0.001, False, False)], "pi double, truth boolean, flagged boolean")
    x = scoring.reweighted(w).first()
    assert x.prevalence < 0.05 and x.recall == 1
    assert stats.precision_bound({"a": 100, "b": 100}, {"a": 0.2, "b": 0.1}, 100) == pytest.approx(0.3)


def test_strict_join_fails(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no partner"):
        scoring.strict_join(left, right, "k").collect()
    assert scoring.strict_join(left.where("k = 1"), right, "k").count() == 1


def test_eventlog(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "k string, pos int, label string")
    assert {(r.k, r.label) for r in eventlog.last_action(e, "k", "pos").collect()} == {("a", "z"), ("b", "y")}
    assert eventlog.unanswered(e, e.where("k = 'a'"), "k").count() == 1
    names = spark.createDataFrame([("ann-1",), ("-x",), ("A",)], "n string")
    assert [r[0] for r in names.select(eventlog.valid_annotator(F.col("n"))).collect()] == [True, False, False]


def test_readers_must_all_rate(spark):
    with pytest.raises(Exception, match="not every reader"):
        agreement.multi_reader(spark.createDataFrame([(1, "y"), (1, "n"), (2, "y")], "item int, label string"), 2, 2).collect()


def test_triage_of_large_pools():
    mean, low, high = random_triage(4_000_000, 900_000, 200_000)
    assert mean == 45_000 and 44_500 < low < mean < high < 45_500
    assert random_triage(10, 10, 4) == (4, 4, 4)


def test_triage():
    p = hypergeometric(50, 10, 20)
    assert math.isclose(sum(p), 1) and random_triage(50, 10, 20)[0] == 4


def test_far_counts(spark):
    points = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 97 % 1801) / 10.0 - 90).alias("lat"), ((F.col("id") * 53 % 3601) / 10.0 - 180).alias("lon"))
    points = points.unionAll(points.limit(40)).unionAll(spark.createDataFrame([(0, None, 1.0), (7, 1.0, 1.0)], points.schema))
    places = points.select("g", (F.col("lat") * 0.9).alias("p_lat"), (-F.col("lon")).alias("p_lon"))
    for km in (0, 300, 2000, 15_000, 20_100):
        want = {r.g: r["count"] for r in spatial.far_places(points, places, km, "g").groupBy("g").count().collect()}
        assert {r.g: r.n for r in spatial.far_counts(points, places, km, "g").collect()} == want


def crowd(spark, n):
    """Points and places of whom each would meet all others within 400 km."""
    at = lambda a, b: ((F.col("id") * a % 997 / 997).alias("lat"), (F.col("id") * b % 991 / 991).alias("lon"))
    points = spark.range(n).select("id", *at(389, 577))
    return points, spark.range(n).select(F.col("id").alias("place_id"), *(c.alias(x) for c, x in zip(at(211, 757), ("p_lat", "p_lon"), strict=True)))


def test_closest_meets_few(spark, monkeypatch):
    """The rows that a search meets grow with the points, not with points times places, for groups, too."""
    met, real = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a, **k: met.append(real(*a, **k)) or met[-1])
    points, places = crowd(spark, 2000)
    both = points.crossJoin(places).withColumn("km", spatial.haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    want = {r.id: [x.place_id for x in r.m] for r in both.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("km", "place_id"))), 1, 3).alias("m")).collect()}
    got = {}
    for r in spatial.topk_near(points, places, 400, "id", 3, "place_id").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.place_id)
    assert got == want
    assert {r.id: r.place_id for r in spatial.nearest(points, places, "id").collect()} == {i: m[0] for i, m in want.items()}
    named = places.select("place_id", "p_lat", "p_lon", F.array(F.lit("same"), F.concat(F.lit("name "), F.col("place_id") % 5)).alias("names"))
    found = spatial.place_match(points.withColumn("name", F.lit("same")), named, -1, "id")
    assert {r.id: r.place_id for r in found.collect()} == {i: m[0] for i, m in want.items()}
    assert sum(m.count() for m in met) < 60 * 2000


def test_place_match_ties_and_odd_rows(spark):
    records = spark.createDataFrame([(1, "name", 0.0, 10.0), (2, "name", 80.0, 0.0), (3, "none", 0.0, 0.0), (4, "name", None, 0.0), (5, "abc", 0.0, 0.0)], "id int, name string, lat double, lon double")
    places = spark.createDataFrame([(9, ["name", "abc"], 0.0, 9.3), (8, ["name"], 0.0, 10.7), (7, ["name"], None, 10.0), (6, ["name", "name"], -80.0, 180.0)], "place_id int, names array<string>, p_lat double, p_lon double")
    got = {r.id: (r.place_id, round(r.distance_km, 3)) for r in spatial.place_match(records, places, 25, "id", digits=9).collect()}
    assert set(got) == {1, 2, 4} and got[4] == (6, 20015.114) and got[1] == (8, 77.837) and got[2][0] in (8, 9)
    assert spatial.place_match(records, places.limit(0), 25, "id").count() == 0


def test_range_corruptions_change_the_value(spark):
    from attesta.functions import rules
    from attesta.operators import corruption

    for tag, kind in (("stars", "far_above_maximum"), ("level", "negative")):
        plain = spark.range(100).select("id", corruption.corrupt_range(tag, kind, F.col("id")).alias("a"))
        rows = plain.select("a", corruption.corrupt_range(tag, kind, F.col("id"), value=F.col("a")).alias("b")).collect()
        low, high = rules.VALUE_RANGES[tag]
        assert all(r.a != r.b and not low <= float(r.b) <= high for r in rows)


def test_calling_code_is_found_once_a_row(spark):
    """Nothing of a row's own, such as its digits, is worked out anew for each known code."""
    from attesta.operators import corruption

    known = F.array(*(F.lit(k) for k in range(1, 200, 7)))
    df = spark.range(1).select(corruption.calling_code(F.concat(F.lit("+"), F.col("id")), known).alias("a"), corruption.corrupt_calling_code(F.concat(F.lit("+15 "), F.col("id")), known, F.col("id")).alias("b"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("[^0-9]") == 2 and df.first().a is None and df.first().b.endswith(" 0")


def test_donor_tries_are_made_as_needed(spark):
    from attesta.operators import injection

    n = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def fits(key, donor):
        n.add(1)
        return key != donor and (key % 10 != 0 or donor % 40 == 7)

    records = spark.range(2000).select("id", (F.col("id") % 2).alias("g"))
    pool = records.select("g", F.col("id").alias("donor"))
    got = {r.id: r.donor for r in injection.drawn_donors(records, pool, "id", "g", fits(F.col("id"), F.col("donor")).eqNullSafe(True)).collect()}
    import hashlib

    groups = [list(range(g, 2000, 2)) for g in (0, 1)]
    want = {}
    for i in range(2000):
        for k in range(injection.TRIES):
            d = groups[i % 2][int(hashlib.md5(f"42:{k}:{i}".encode()).hexdigest()[:8], 16) % 1000]
            if i != d and (i % 10 or d % 40 == 7):
                want.setdefault(i, d)
    assert got == want and n.value < 4 * (2000 + 24 * 200)
