"""Keyed corruptions of one field. Every random choice is a hash of a seed, a salt and the record's key, so a corruption is
the same for any partitioning. `broken` takes the first kind, in keyed order, that changes the value and is flagged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import rules

#: The kinds of malformation by field, what they insert, and the sentences in place of hours.
PHONE_KINDS = ("letters_inserted", "digits_removed", "separator_garbage", "doubled_plus", "plus_misplaced")
HOURS_KINDS = ("unknown_day_token", "hour_out_of_clock", "missing_separator", "unclosed_range", "prose_instead_of_syntax")
WEBSITE_KINDS = ("scheme_removed_and_broken", "space_inserted", "tld_removed", "double_scheme", "unbalanced_brackets")
RANGE_KINDS = ("negative", "far_above_maximum", "zero_where_positive")
GARBAGE, BRACKETS, MINUTES = ("**", "##", "!!", "??", "%%"), ("[", "]", "{", "}"), ("00", "15", "30", "45")
BROKEN_SCHEMES, SCHEMES = ("htp:/", "ttps:/", "http:/", "://"), ("https://", "http://")
PROSE = (
    "opens in the morning and closes late", "please call ahead for the hours", "closed whenever the owner travels",
    "hours vary with the season", "open most days until evening",
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def pick(n: Column | int, key: Column, *salt) -> Column:
    """A keyed number from 0 to n - 1."""
    told = F.md5(F.concat_ws(":", *(F.lit(str(s)) for s in salt), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(told, 1, 8), 16, 10).cast("long") % n).cast("int")


def choice(values: tuple[str, ...], key: Column, *salt) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), pick(len(values), key, *salt) + 1)


def insert(text: Column, fragment: Column, key: Column, *salt, within: Column | None = None) -> Column:
    """The fragment behind one of the first characters, never before the first one."""
    at = 1 + pick(F.greatest((F.length(text) if within is None else within) - 1, F.lit(1)), key, *salt)
    return F.concat(F.substring(text, F.lit(1), at), fragment, F.substring(text, at + 1, F.length(text)))


def corrupt_phone(value: Column, kind: str, key: Column, seed: int = 42) -> Column:
    v = rules.strip(value)
    if kind == "letters_inserted":
        return insert(v, F.repeat(F.substring(F.lit(LETTERS), 1 + pick(26, key, seed, "letter"), F.lit(1)), 2), key, seed, "at")
    if kind == "digits_removed":
        keep = 2 + pick(3, key, seed, "keep")
        digit = lambda c: c.rlike("^[0-9]$")
        state = F.aggregate(
            F.split(v, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")),
            lambda a, c: F.struct((a["n"] + digit(c).cast("int")).alias("n"), F.when(digit(c) & (a["n"] >= keep), a["s"]).otherwise(F.concat(a["s"], c)).alias("s")))
        return state["s"]
    if kind == "separator_garbage":
        return insert(v, choice(GARBAGE, key, seed, "garbage"), key, seed, "at")
    if kind == "doubled_plus":
        return F.concat(F.when(F.startswith(v, F.lit("+")), "+").otherwise("++"), v)
    if kind == "plus_misplaced":
        return insert(F.regexp_replace(v, r"^\++", ""), F.lit("+"), key, seed, "at")
    raise ValueError(f"no such malformation of a phone number: {kind}")


def corrupt_hours(value: Column, kind: str, key: Column, seed: int = 42) -> Column:
    v, clock, span = rules.strip(value), r"\d{1,2}:\d{2}", r"^(.*?\d{1,2}:\d{2})-(\d{1,2}:\d{2})"
    if kind == "unknown_day_token":
        two = F.concat(*(F.upper(F.substring(F.lit(LETTERS), 1 + pick(26, key, seed, s), F.lit(1))) for s in "ab"))
        return F.concat(F.when(two.isin("PH", "SH"), "XX").otherwise(two), F.lit(" "), v)
    if kind == "hour_out_of_clock":
        hour, minute = 49 + pick(51, key, seed, "hour"), choice(MINUTES, key, seed, "minute")
        at = F.concat(hour.cast("string"), F.lit(":"), minute)
        return F.when(v.rlike(clock), F.regexp_replace(v, F.lit(f"^(.*?){clock}"), F.concat(F.lit("$1"), at))).otherwise(F.concat(F.lit("Mo-Fr "), at, F.lit("-"), (hour + 1).cast("string"), F.lit(":00")))
    if kind == "missing_separator":  # the one inside a span: without that of a range of days the value still reads
        return F.when(v.rlike(span), F.regexp_replace(v, F.lit(span), F.lit("$1$2"))).otherwise(F.concat(v, F.lit(" 0900 1700")))
    if kind == "unclosed_range":
        return F.concat(F.lit("Mo-Fr "), F.lpad((6 + pick(15, key, seed, "hour")).cast("string"), 2, "0"), F.lit(":00-"))
    if kind == "prose_instead_of_syntax":
        return choice(PROSE, key, seed, "prose")
    raise ValueError(f"no such malformation of opening hours: {kind}")


def corrupt_website(value: Column, kind: str, key: Column, seed: int = 42) -> Column:
    v = rules.strip(value)
    body = F.regexp_replace(v, "^.*?://", "")
    host = F.regexp_extract(body, "^[^/]*", 0)
    if kind == "scheme_removed_and_broken":
        return F.concat(choice(BROKEN_SCHEMES, key, seed, "scheme"), body)
    if kind == "space_inserted":
        return insert(v, F.lit(" "), key, seed, "at")
    if kind == "tld_removed":
        bare = F.replace(F.regexp_replace(host, r"\.[A-Za-z]{2,}$", ""), F.lit("."), F.lit(""))
        return F.concat(F.substring(v, F.lit(1), F.length(v) - F.length(body)), F.when(bare == "", "host").otherwise(bare), F.substring(body, F.length(host) + 1, F.length(body)))
    if kind == "double_scheme":
        return F.concat(choice(SCHEMES, key, seed, "scheme"), v)
    if kind == "unbalanced_brackets":  # up to the host's end: behind it the rule lets them by
        return insert(v, choice(BRACKETS, key, seed, "bracket"), key, seed, "at", within=F.length(v) - F.length(body) + F.length(host))
    raise ValueError(f"no such malformation of a website: {kind}")


def corrupt_range(tag: str, kind: str, key: Column, seed: int = 42, value: Column | None = None) -> Column:
    """A number outside the tag's range, as text; the next one further out, where it is the one that the text `value` holds."""
    own, out = None if value is None else rules.number(value), 1 if kind == "far_above_maximum" else -1
    low, high = map(float, rules.VALUE_RANGES[tag])
    if kind == "negative":
        made = F.lit(-abs(low) if low <= 0 else 0.0) - (1 + pick(500, key, seed, "below"))
    elif kind == "far_above_maximum":
        made = F.lit(high) * (3 + pick(38, key, seed, "times")) + (1 + pick(99, key, seed, "more"))
    elif kind == "zero_where_positive":
        made = F.lit(0.0) if low > 0 else F.lit(low) - (1 + pick(50, key, seed, "below"))
    else:
        raise ValueError(f"no such corruption of a number: {kind}")
    made = made if own is None else F.when(own == made, made + out).otherwise(made)
    return F.when(made == F.floor(made), F.floor(made).cast("string")).otherwise(made.cast("string"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once a row however often it is used, in lambdas above all."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def calling_code(value: Column, known: Column) -> Column:
    """The longest calling code of the array `known` that an international number begins with, else null."""
    fits = lambda digits: F.filter(known, lambda c: F.startswith(digits, c.cast("string")))
    longest = lambda codes: F.array_max(F.transform(codes, lambda c: F.struct(F.length(c.cast("string")).alias("n"), c.cast("int").alias("c"))))["c"]
    return F.when(F.startswith(rules.strip(value), F.lit("+")), once(F.regexp_replace(value, "[^0-9]", ""), lambda digits: longest(fits(digits))))


def corrupt_calling_code(value: Column, known: Column, key: Column, seed: int = 42) -> Column:
    """Another calling code in place of the number's own; all other characters stay. Null without a readable code."""
    parts = F.struct(rules.strip(value).alias("v"), calling_code(value, known).alias("own"))

    def changed(p: Column) -> Column:
        v, own = p["v"], p["own"]
        others = F.sort_array(F.filter(known, lambda c: c.cast("int") != own))
        new = once(others, lambda o: F.get(o, pick(F.greatest(F.size(o), F.lit(1)), key, seed, "code")))
        own_text, plus = own.cast("string"), F.instr(v, "+")
        at = plus + F.instr(F.substring(v, plus + 1, F.length(v)), own_text)
        return F.concat(F.substring(v, F.lit(1), at - 1), new.cast("string"), F.substring(v, at + F.length(own_text), F.length(v)))

    return once(parts, changed)


def corrupt_with_donor(original: Column, donor: Column) -> Column:
    """A donor's name in place of a name or an address's city."""
    return F.when(~donor.eqNullSafe(original), donor)


def broken(value: Column, kinds: tuple[str, ...], corrupt: Callable, rule: Callable, key: Column, seed: int = 42) -> Column:
    """struct<kind, value>: the first kind in keyed order whose value differs and is flagged by the rule; null if none is."""
    tried = F.array(*(F.struct(F.md5(F.concat_ws(":", F.lit(f"{seed}:{k}"), key.cast("string")).cast("binary")).alias("order"), F.lit(k).alias("kind"), corrupt(value, k, key, seed).alias("value")) for k in kinds))
    fits = F.filter(F.array_sort(tried), lambda x: ~x["value"].eqNullSafe(value) & (rule(x["value"])["outcome"] == "flag"))
    return F.when(F.size(fits) > 0, F.struct(fits[0]["kind"].alias("kind"), fits[0]["value"].alias("value")))
