import json

import pytest
from pyspark.sql import functions as F

from attesta import sources
from attesta.functions import prompts, records, rules
from attesta.operators import baseline, corruption, injection, protocol
from attesta.streaming import last_action_stream, run_once


def lines(path, rows, tail=""):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows) + tail, encoding="utf-8")
    return str(path)


def test_records_by_city_are_pruned(spark, tmp_path):
    rows = [{"osm_type": "node", "osm_id": i, "city": c, "country": "CZ", "lat": 1.5, "lon": 2.5, "name": f"n{i}", "tags": {"shop": "x", "phone": "+1"} if i else {}} for i, c in enumerate(["a", "b", "a"])]
    read = sources.read_records(spark, lines(tmp_path / "r.jsonl", rows, "\n"))
    assert [r.tags for r in read.orderBy("osm_id").collect()][:2] == [{}, {"shop": "x", "phone": "+1"}]
    sources.write_by_city(read, f"{tmp_path}/city")
    back = sources.read_records(spark, f"{tmp_path}/city").where("city = 'a'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(city" in back._jdf.queryExecution().toString()
    assert [tuple(r) for r in sources.count_fields(read, "phone", "website").orderBy("city").collect()] == [("a", 2, 1, 0), ("b", 1, 1, 0)]


def test_places(spark, tmp_path):
    (tmp_path / "p.csv").write_text("source,place_id,name,alternate_names,lat,lon,country,feature_code,population\ngeonames,1,Łódź,\"Lodz,Łódź,\",51.7,19.4,PL,PPL,700000\nwikidata,2,!!,,1,2,XX,,many\n", encoding="utf-8")
    a, b = sources.read_places(spark, f"{tmp_path}/p.csv").orderBy("place_id").collect()
    assert sorted(a.names) == ["lodz", "łodz"] and a.population == 700000 and (b.names, b.population) == (None, 0)
    raw = spark.createDataFrame([("1", "A", None, "5", "6", "P", "PPL", "CZ", "9"), ("2", "B", "b", "x", "6", "P", "PPL", "CZ", "9"), ("3", "C", "", "1", "1", "H", "LK", "CZ", None)], "id string, name string, alternate_names string, lat string, lon string, feature_class string, feature_code string, country string, population string")
    assert [(r.place_id, r.population) for r in sources.parse_gazetteer(raw, ("P",)).collect()] == [("1", 9)]
    entry = lambda q, n, c: {"item": {"value": f"http://x/entity/{q}"}, "itemLabel": {"value": n}, "coord": {"value": c}}
    body = json.dumps({"results": {"bindings": [entry("Q1", "Brno", "Point(16.6 49.2)"), entry("Q1", "Brno", "Point(16.6 49.2)"), entry("Q2", "Q2", "Point(1 2)"), entry("Q3", "x", "nowhere")]}})
    assert [(r.place_id, r.lat, r.lon) for r in sources.parse_bindings(spark.createDataFrame([(body,), ("{",)], "body string")).collect()] == [("Q1", 49.2, 16.6)]


def test_answers_survive_a_cut_line(spark, tmp_path):
    rows = [{"run": "r", "model": "m", "item_id": f"i{k}", "parsed": {"verdict": "wrong", "field": None}, "valid": k != 1} for k in range(3)]
    path = lines(tmp_path / "a.jsonl", [*rows, rows[0]], '{"run": "r", "model": "m", "item_id": "i9", "par')
    assert sources.read_answers(spark, path).count() == 4
    assert sorted(r.item_id for r in sources.answered_items(spark, path).collect()) == ["i0", "i1", "i2"]
    assert tuple(sources.invalid_answers(spark, path).first()) == ("r", "m", 1, 4)


def test_items_gold_and_tables(spark, tmp_path):
    item = {"item_id": "M1-1", "class": "M1", "city": "Brno", "split": "test", "record": {"name": "x", "lat": "1.5", "lon": "2"}, "corrupted": True}
    items = sources.read_items(spark, lines(tmp_path / "i.jsonl", [item, item | {"item_id": "S1-1", "class": "S1", "split": "dev"}]))
    assert [r.item_id for r in items.where("split = 'test'").collect()] == ["M1-1"] and sources.read_items(spark, f"{tmp_path}/i.jsonl", "S1", "dev").count() == 1
    r = sources.as_records(items).first()
    assert (r.tags, r.lat, r.lon) == ({"name": "x"}, 1.5, 2.0)
    gold = sources.read_gold(spark, lines(tmp_path / "g.jsonl", [{"item_id": "M1-1", "city": "Cork", "label": "wrong", "scored": True}]))
    assert {tuple(x) for x in sources.cluster_units(items, gold).collect()} == {("M1-1", "Cork"), ("S1-1", "Brno")}
    (tmp_path / "t.csv").write_text("category,token,share\namenity=cafe,kavarna,0.9\namenity=bar,kavarna,0.1\n,x,1\n", encoding="utf-8")
    tokens = sources.read_category_tokens(spark, f"{tmp_path}/t.csv")
    assert [tuple(x) for x in tokens.collect()] == [("kavarna", "amenity=bar")]
    assert spark.range(1).select(records.indicated_category(F.lit("stara kavarna"), sources.token_map(tokens)).alias("c")).first().c == "amenity=bar"
    sources.write_one(sources.read_table(spark, f"{tmp_path}/t.csv", "token string, share double, none int"), f"{tmp_path}/out", "share")
    assert [r.share for r in sources.read_table(spark, f"{tmp_path}/out", "share double").collect()] == [0.1, 0.9, 1.0]


def test_label_logs(spark, tmp_path):
    event = lambda k, label, **more: {"kind": "label", "annotator": "ann", "item_id": f"i{k}", "position": k, "label": label, "no_source": False, "evidence_source": "", "evidence_url": ""} | more
    (tmp_path / "l").mkdir()
    rows = [{"kind": "consent", "annotator": "ann"}, event(1, "wrong", evidence_source="register"), event(2, "wrong"), event(2, "maybe", no_source=True), event(2, "belongs"), event(2, "belongs", no_source=True), event(3, "cannot_say", evidence_url="u", no_source=True)]
    lines(tmp_path / "l/ann.jsonl", rows)
    lines(tmp_path / "l/ann.practice.jsonl", rows[:2])
    lines(tmp_path / "l/adjudication.jsonl", [{"kind": "opened"}])
    assert sources.read_label_events(spark, f"{tmp_path}/l", "practice").count() == 2
    judged = protocol.judged_labels(sources.read_label_events(spark, f"{tmp_path}/l"))
    assert [r.refusal for r in judged.where("kind = 'label'").orderBy("position", "label", "no_source").collect()] == [None, "nothing stated", None, "unknown label", "evidence required", None]
    assert [r.no_source for r in judged.where("label = 'cannot_say'").collect()] == [False]
    items = spark.createDataFrame([("main", f"i{k}") for k in (4, 1, 3, 2)], "run string, item_id string")
    assert tuple(protocol.progress(judged, items).first()) == ("ann", "main", 3, 4, 1, True)
    assert protocol.next_items(judged, items).first().item_id == "i4"
    assert protocol.next_items(judged, items.where("item_id <> 'i4'")).count() == 0 and protocol.complete_readers(judged, items.where("item_id <> 'i4'")).first().annotator == "ann"


def test_meeting_refuses(spark, tmp_path):
    disputed = spark.createDataFrame([("m", "i1", "wrong", "belongs"), ("m", "i2", "wrong", "cannot_say")], "meeting string, item_id string, label_a string, label_b string")
    why = protocol.REASONS[0]
    steps = [("decision", "i1", "wrong", why), ("opened", None, None, None), ("closed", None, None, None), ("decision", "i1", "wrong", why), ("decision", "i2", "belongs", why), ("decision", "i2", "wrong", "no"), ("decision", "i9", "wrong", why),
        ("decision", "i1", "cannot_say", why), ("decision", "i2", "cannot_say", why), ("closed", None, None, None), ("decision", "i1", "wrong", why), ("closed", None, None, None), ("opened", None, None, None)]
    rows = spark.createDataFrame([("m", k, *s) for k, s in enumerate(steps)], "meeting string, position long, kind string, item_id string, label string, reason string")
    sources.append_events(rows.where("position < 5"), f"{tmp_path}/log")
    sources.append_events(rows.where("position >= 5"), f"{tmp_path}/log")
    judged = protocol.judged_actions(sources.read_actions(spark, f"{tmp_path}/log").drop("note"), disputed)
    assert [r.refusal for r in judged.orderBy("position").collect()] == ["not opened", None, "items undecided", None, "a third reading", "unknown reason", "not disputed", None, None, None, "closed", "closed", "closed"]
    assert {(r.item_id, r.label) for r in protocol.decisions(judged).collect()} == {("i1", "cannot_say"), ("i2", "cannot_say")}
    assert tuple(protocol.meeting_state(judged, disputed).first()) == ("m", True, True, 2, 2)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    add = lambda rows: spark.createDataFrame(rows, "k string, pos int, label string").write.mode("append").parquet(folder)
    stream = lambda: last_action_stream(spark.readStream.schema("k string, pos int, label string").parquet(folder), "k", "pos")
    add([("a", 1, "x"), ("b", 5, "y")])
    assert {(r.k, r.m.label) for r in run_once(stream(), "s", state).collect()} == {("a", "x"), ("b", "y")}
    add([("a", 2, "z"), ("b", 4, "old")])
    assert {(r.k, r.m.label) for r in run_once(stream(), "s", state).collect()} == {("a", "z"), ("b", "y")}


def test_corruptions_are_flagged_and_repeatable(spark):
    df = spark.range(300).select(F.col("id"), F.concat(F.lit("+420 541 "), F.col("id") + 100).alias("phone"), F.lit("Mo-Fr 09:00-17:00").alias("hours"), F.concat(F.lit("https://www.a"), F.col("id"), F.lit(".cz/x[1].html")).alias("url"))
    k = F.col("id")
    for column, kinds, corrupt, rule in (("phone", corruption.PHONE_KINDS, corruption.corrupt_phone, rules.phone_syntax), ("hours", corruption.HOURS_KINDS, corruption.corrupt_hours, rules.opening_hours_syntax), ("url", corruption.WEBSITE_KINDS, corruption.corrupt_website, rules.website_syntax)):
        for kind in kinds:
            x = df.select(corrupt(F.col(column), kind, k).alias("v"), F.col(column).alias("o"))
            rows = x.select(rule(F.col("v"))["outcome"].alias("f"), (F.col("v") != F.col("o")).alias("d"), "v").collect()
            assert {(r.f, r.d) for r in rows} == {("flag", True)}, kind
        one = df.select("id", corruption.broken(F.col(column), kinds, corrupt, rule, k).alias("b")).orderBy("id").collect()
        assert {r.b.kind for r in one} == set(kinds)
        again = df.repartition(7).select("id", corruption.broken(F.col(column), kinds, corrupt, rule, k).alias("b")).orderBy("id").collect()
        assert one == again and one != df.select("id", corruption.broken(F.col(column), kinds, corrupt, rule, k, seed=1).alias("b")).orderBy("id").collect()
    with pytest.raises(ValueError, match="no such"):
        corruption.corrupt_hours(F.col("x"), "other", k)
    known = F.array(F.lit(1), F.lit(420), F.lit(42), F.lit(90))
    r = df.limit(50).select(corruption.corrupt_calling_code(F.col("phone"), known, k).alias("v"), F.substring("phone", 5, 20).alias("rest")).collect()
    assert {x.v.split(" ")[0] for x in r} == {"+1", "+42", "+90"} and all(x.v.endswith(x.rest) for x in r)


def test_baseline_and_screen(spark):
    tags = [{"phone": "+42 1234567", "addr:city": "brno", "website": "nodots"}, {"phone": "+1 1234567"}, {}, {"contact:phone": "12", "addr:city": "praha", "stars": "9"}]
    r = spark.createDataFrame([(i, "CZ", 49.2, 16.6, x) for i, x in enumerate(tags)], "id int, country string, lat double, lon double, tags map<string,string>")
    places = spark.createDataFrame([(1, 49.2, 16.61, ["brno"], "CZ"), (2, 10.0, 10.0, ["praha"], "XX")], "place_id int, p_lat double, p_lon double, names array<string>, p_country string")
    codes = spark.createDataFrame([("CZ", 42), ("US", 1)], "country string, code int")
    got = {x.id: ([(v.check, v.outcome) for v in x.format_verdicts + x.lookup_verdicts], x.flagged) for x in baseline.baseline(r, places, codes, "id").collect()}
    assert got[0] == ([("phone_syntax", "pass"), ("website_syntax", "flag"), ("phone_country_code", "pass"), ("address_city", "pass")], True)
    assert got[1] == ([("phone_syntax", "pass"), ("phone_country_code", "flag")], True) and got[2] == ([], False)
    assert got[3] == ([("phone_syntax", "flag"), ("value_range", "flag"), ("phone_country_code", "abstain"), ("address_city", "flag")], True)
    s = spark.createDataFrame([(1, "g", "praha", "amenity=cafe", False, "XX", 49.2, 16.6), (2, "g", "praha", "shop=x", False, "CZ", 49.3, 16.6), (3, "g", "praha", "amenity=bar", True, "CZ", 49.2, 16.6), (4, "g", "stara kavarna", "shop=y", False, "CZ", 1.0, 1.0), (5, "g", None, None, False, "CZ", None, None)],
        "id int, grp string, name string, category string, branded boolean, country string, lat double, lon double")
    words = F.create_map(F.lit("kavarna"), F.lit("shop=z"))
    final, first = ({x.id: (x.rules, x.owner, x.same_country) for x in baseline.screen_records(s, words, places, "id", "grp", v).collect()} for v in (baseline.FINAL, baseline.FIRST_PASS))
    assert final[1] == (["duplicate", "gazetteer"], "gazetteer", True) and final[2][0] == ["duplicate", "gazetteer"] and final[2][2] is False
    assert final[3][0] == [] and first[3][0] == ["duplicate", "gazetteer"] and final[4][0] == [] and first[4] == (["token"], "token", None) and final[5][0] == []


def test_city_donors_and_eligibility(spark):
    r = spark.createDataFrame([(i, "CZ", 49.2, 16.6) for i in range(40)], "id int, country string, lat double, lon double")
    places = spark.createDataFrame([(1, "CZ", 49.2, 16.61, ["brno"]), (2, "CZ", 50.1, 14.4, ["praha"]), (3, "CZ", 55.0, 14.4, ["brno"]), (4, "XX", 0.0, 0.0, ["far"])], "place_id int, country string, p_lat double, p_lon double, names array<string>")
    got = injection.city_donors(r, places, "id", "country").collect()
    assert len(got) == 40 and {x.d_name for x in got} == {"praha"}
    e = spark.createDataFrame([({"shop": "x", "phone": "+42 1", "stars": "5"}, "n"), ({"contact:website": "w", "phone": "42"}, "")], "tags map<string,string>, name string")
    cols = injection.eligible(F.col("tags"), F.col("name"), F.array(F.lit(42)), ("stars",))
    assert [[c for c in cols if x[c]] for x in e.select(*(v.alias(k) for k, v in cols.items())).collect()] == [["M1", "M2", "S1", "S4"], ["S1", "S3"]]


def test_prompts(spark):
    template = {"instruction": "do", "views": {"name_only": "by name"}, "exemplar_intro": "ex", "exemplar_ids": ["e1"], "evidence_intro": "ev", "evidence_nearest": "within {radius_m} m", "evidence_similar": "within {radius_km} km", "evidence_none": "none"}
    exemplars = {"e1": {"record": {"name": "A", "shop": "b", "lat": "1"}, "label": "wrong", "field": "name"}}
    evidence = F.struct(F.array(F.struct(F.lit("N").alias("name"), F.lit(5).alias("distance_m"))).alias("nearest"), F.array().cast("array<struct<name:string,distance_km:int>>").alias("similar"), F.lit(250).alias("radius_m"), F.lit(25).alias("radius_km"))
    shown = F.create_map(F.lit("shop"), F.lit("x"), F.lit("name"), F.lit("Ž"))
    text = spark.range(1).select(prompts.prompt(template, exemplars, "name", shown, "name_only", evidence=evidence).alias("p")).first().p
    assert text.split("\n\n") == ["do", "by name", "ex", '{\n  "lat": "1",\n  "name": "A"\n}\n{"verdict": "wrong"}', '{\n  "name": "Ž"\n}', "ev\nwithin 250 m\n- N (5 m)\nwithin 25 km\nnone"]
    plain = {k: v for k, v in template.items() if not k.startswith("evidence")}
    assert prompts.exemplar_text(exemplars["e1"], "detect", "full").endswith('{"field": "name", "verdict": "wrong"}')
    for wrong in (lambda: prompts.prompt(plain, exemplars, "detect", shown, "name_only"), lambda: prompts.prompt(plain, exemplars, "name", shown, "full"), lambda: prompts.prompt(template, exemplars, "name", shown, "name_only"), lambda: prompts.prompt(plain, exemplars, "other", shown)):
        with pytest.raises(ValueError, match="no|match"):
            wrong()
