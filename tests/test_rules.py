import pytest
from pyspark.sql import functions as F

from attesta.functions import records, rules


def outcomes(spark, values, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", rule(F.col("v"))["outcome"].alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (rules.phone_syntax, {"+90 232 445 12 34": "pass", "+90 232 44kk5 12 34": "flag", "+9 111": "flag", "++90 232 445 12 34": "flag", "": "flag"}),
        (rules.opening_hours_syntax, {"Mo-Fr 09:00-17:00": "pass", "24/7": "pass", "Mo-Sa 08:00-12:00,13:00-18:00; Su off": "pass", "Mo-Fr 09:00-52:30": "flag", "opens in the morning": "flag", "Mo, Tu 09:00-17:00": "flag", "Mo-Fr": "flag", "Mo-Fr 09:00-17:00;": "flag", "99:99-12:00, 13:00-17:00": "pass",
            "24/7 open": "pass", "Su OFF": "pass", "Mo-Fr Closed": "pass", "closed , 09:00-17:00": "flag", "\t24/7\n": "pass", "10:00-12:00-14:00": "flag", " ": "flag"}),
        (rules.website_syntax, {"https://www.example.ie/menu": "pass", "https://example": "flag", "https://http://example.com": "flag", "https://a.org/x?u=http://b.org": "flag"}),
    ],
)
def test_verdicts(spark, rule, cases):
    assert outcomes(spark, list(cases), rule) == list(cases.values())


def test_value_range(spark):
    cases = {"4": "pass", "350": "flag", "nan": "pass", "1_0": "pass", "1d": "flag"}
    df = spark.createDataFrame([(i, {"building:levels": v}) for i, v in enumerate(cases)] + [(99, {"building:levels": ""}), (100, {"x": "1"})], "i int, tags map<string,string>")
    rows = df.select("i", F.inline(rules.value_range(F.col("tags")))).orderBy("i").collect()
    assert [r.outcome for r in rows] == list(cases.values())


def test_fold_and_tokens(spark):
    assert [records.fold_text(x) for x in ("Straße  Él!", "Łódź", None)] == ["strasse el", "łodz", None]
    df = spark.createDataFrame([("deniz eczanesi",), ("deniz yildizi",)], "n string")
    d = F.create_map(F.lit("eczanesi"), F.lit("amenity=pharmacy"))
    assert [r[0] for r in df.select(records.indicated_category(F.col("n"), d)).collect()] == ["amenity=pharmacy", None]


def test_first_object_and_schema():
    assert records.first_object('x {"a": "}", "b": {"c": 1}} {') == '{"a": "}", "b": {"c": 1}}'
    assert records.first_object("no") is None and records.first_object(None) is None and records.first_object('"{" }') is None
    assert records.first_object('He said "{" {"a":1}') == '{"a":1}' and records.first_object('} {"a": "\\"}"}') == '{"a": "\\"}"}'
    schema = {"properties": {"verdict": {"enum": ["a", "b"]}}, "required": ["verdict"], "additionalProperties": False}
    assert records.satisfies({"verdict": "a"}, schema)
    assert not records.satisfies({"verdict": "c"}, schema) and not records.satisfies({"verdict": "a", "x": 1}, schema) and not records.satisfies([], schema)
