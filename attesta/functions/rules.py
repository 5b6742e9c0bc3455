"""Three-valued validation rules as Columns of struct<check, field, outcome, detail>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inclusive ranges of numeric keys, bounds, and the patterns of the accepted values.
VALUE_RANGES = {
    "capacity": (1, 10000), "building:levels": (1, 200), "level": (-10, 200), "height": (0.5, 900), "rooms": (1, 5000), "beds": (1, 5000),
    "min_age": (0, 120), "max_age": (0, 120), "stars": (1, 7), "width": (0.1, 100), "seats": (1, 5000),
}
MIN_DIGITS, MAX_DIGITS, MAX_HOUR, SCHEMES = 5, 15, 48, ("http", "https")
SELECTOR = r"^(Mo|Tu|We|Th|Fr|Sa|Su|PH|SH|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|week|[0-9]{4}|\[[-0-9,]+\]|[-,:0-9 ])+$"
TIMES = r"^(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})$"
PHONE = r"^[+0-9 ()\-./]+$"
URL, HOST = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/\s?#]+)([^\s]*)$", r"^[A-Za-z0-9\-._~%]+(\.[A-Za-z0-9\-._~%]+)+(:[0-9]+)?$"
STATES = ("off", "closed", "open", "unknown")
VERDICT = "struct<check:string,field:string,outcome:string,detail:string>"


def verdict(check: str, field, outcome: Column, detail: Column) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit(check).alias("check"), field.alias("field"), outcome.alias("outcome"), detail.alias("detail"))


def _first(check: str, field, cases: list[tuple[Column, str, str]], fine: str) -> Column:
    """The verdict of the first case that holds, else pass."""
    outcome, detail = F.lit("pass"), F.lit(fine)
    for when, out, text in reversed(cases):
        outcome, detail = F.when(when, out).otherwise(outcome), F.when(when, text).otherwise(detail)
    return verdict(check, field, outcome, detail)


def phone_syntax(value: Column, field="phone") -> Column:
    v = strip(value)
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return _first("phone_syntax", field, [
        (v == "", "flag", "empty"), (~v.rlike(PHONE), "flag", "other characters"),
        ((F.instr(F.substring(v, 2, 10_000), "+") > 0), "flag", "plus sign inside"),
        (digits < MIN_DIGITS, "flag", "too few digits"), (digits > MAX_DIGITS, "flag", "too many digits")], "digits")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _span_ok(span: Column) -> Column:
    s = strip(span)
    part = lambda k: F.regexp_extract(s, TIMES, k).try_cast("int")
    clock = s.rlike(TIMES) & (part(1) <= MAX_HOUR) & (part(3) <= MAX_HOUR) & (part(2) <= 59) & (part(4) <= 59)
    return F.lower(s).isin(*STATES) | F.coalesce(clock, F.lit(False))


def opening_hours_syntax(value: Column, field="opening_hours") -> Column:
    """Rules between semicolons: 24/7, or time spans between commas, behind a selector where a blank follows the first word."""

    def rule_ok(rule: Column) -> Column:
        r = strip(F.regexp_replace(strip(rule), r"^\|+", ""))
        at = F.instr(r, " ")
        spans = F.when(at > 0, F.substring(r, at + 1, F.length(r))).otherwise(r)
        return (r != "") & ((r == "24/7") | (((at == 0) | F.substring_index(r, " ", 1).rlike(SELECTOR)) & F.forall(F.split(spans, ",", -1), _span_ok)))

    v = strip(value)
    return _first("opening_hours_syntax", field, [(v == "", "flag", "empty"), ((v != "24/7 open") & ~F.forall(F.split(v, ";", -1), rule_ok), "flag", "not a rule list")], "rule list")


def website_syntax(value: Column, field="website") -> Column:
    v = strip(value)
    scheme, host, rest = (F.regexp_extract(v, URL, k) for k in (1, 2, 3))
    return _first("website_syntax", field, [
        (v == "", "flag", "empty"), (F.instr(v, " ") > 0, "flag", "blank inside"), (~v.rlike(URL), "flag", "not scheme and host"),
        (~F.lower(scheme).isin(*SCHEMES), "flag", "other scheme"), (F.instr(rest, "://") > 0, "flag", "two schemes"),
        (~host.rlike(HOST), "flag", "host is not a dotted name")], "url")


def number(value: Column) -> Column:
    """A plain decimal number, else null; nan passes as a number that no limit excludes."""
    v = F.trim(F.regexp_replace(value, "(?<=[0-9])_(?=[0-9])", ""))
    return F.when(v.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"), v.try_cast("double"))


def value_range(tags: Column, ranges: dict | None = None) -> Column:
    """array of verdicts, one for each numeric key that is present."""
    def one(key: str, lo: float, hi: float) -> Column:
        n = number(tags[key])
        v = _first("value_range", key, [(n.isNull(), "flag", "not a number"), (~F.isnan(n) & ((n < lo) | (n > hi)), "flag", "outside the range")], "inside the range")
        return F.when(F.coalesce(tags[key], F.lit("")) != "", v)

    return F.array_compact(F.array(*(one(k, lo, hi) for k, (lo, hi) in (ranges or VALUE_RANGES).items())))


def phone_country_code(value: Column, code: Column, known_codes: Column, field="phone") -> Column:
    """`code`: the country's calling code; `known_codes`: array of all calling codes, for the longest prefix match."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    prefix = F.array_max(F.filter(known_codes, lambda c: F.startswith(digits, c.cast("string"))).cast("array<int>"))
    return _first("phone_country_code", field, [
        (~F.startswith(F.trim(value), F.lit("+")), "abstain", "no international prefix"),
        (prefix.isNull() | code.isNull() | (F.length(digits) < MIN_DIGITS), "abstain", "not parsable"), (prefix != code, "flag", "another country")], "own country")


def address_city(value: Column, names_near: Column, field="addr:city") -> Column:
    """`names_near`: array of the folded names of the places around; null or empty: none."""
    return _first("address_city", field, [
        (names_near.isNull() | (F.size(names_near) == 0), "abstain", "no place around"), (~F.array_contains(names_near, value), "flag", "not a place around")], "a place around")


def category_token(indicated: Column, category: Column, field="name") -> Column:
    return _first("category_token", field, [(indicated.isNull() | category.isNull(), "abstain", "no indicative token"), (indicated != category, "flag", "another category")], "same category")


def flagged(verdicts: Column) -> Column:
    return F.exists(verdicts, lambda v: v["outcome"] == "flag")
