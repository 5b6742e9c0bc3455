"""Projections of named, located records; tags are map<string, string>."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Category keys by priority, and the keys of an item.
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare")
ITEM_KEYS = ("name", "category", "addr:city", "addr:street", "addr:housenumber", "phone", "opening_hours", "website")
EARTH_KM = 6371.0088


def fold_text(name: str | None) -> str | None:
    if name is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in plain).split())


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    """Exact Unicode fold: case, marks, punctuation and runs of blanks go."""
    return names.map(fold_text)


def fold_ascii(name: Column) -> Column:
    """The same fold for ASCII names, on the JVM."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9_]+", " "))


def city_slug(city: Column) -> Column:
    return F.replace(F.lower(city), F.lit(" "), F.lit("-"))


def present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def primary_category(tags: Column) -> Column:
    return F.coalesce(*(F.when(present(tags[k]).isNotNull(), F.concat(F.lit(f"{k}="), tags[k])) for k in POI_KEYS))


def category_key(category: Column) -> Column:
    return F.substring_index(category, "=", 1)


def item_value(tags: Column, key: str) -> Column:
    return primary_category(tags) if key == "category" else F.coalesce(present(tags[key]), present(tags[f"contact:{key}"]))


def numeric_tag(tags: Column, keys: tuple[str, ...]) -> Column:
    from attesta.functions.rules import number

    return F.coalesce(*(F.when(number(tags[k]).isNotNull(), F.lit(k)) for k in keys))


def field_signature(tags: Column, numeric_keys: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(item_value(tags, k).isNotNull(), F.lit(k)) for k in ITEM_KEYS), numeric_tag(tags, numeric_keys)))


def carries_brand_tag(tags: Column) -> Column:
    return F.exists(F.map_keys(tags), lambda k: (k == "brand") | F.startswith(k, F.lit("brand:")))


def item_view(tags: Column, lat: Column, lon: Column) -> Column:
    pairs = [x for k in ITEM_KEYS for x in (F.lit(k), item_value(tags, k))]
    shown = F.create_map(*pairs, F.lit("lat"), F.round(lat, 5).cast("string"), F.lit("lon"), F.round(lon, 5).cast("string"))
    return F.map_filter(shown, lambda k, v: v.isNotNull())


def apply_view(shown: Column, view: str) -> Column:
    keep = {"full": None, "name_only": lambda k: k.isin("name", "lat", "lon"), "tags_only": lambda k: k != "name", "neither": lambda k: k.isin("lat", "lon")}[view]
    return F.map_filter(shown, lambda k, v: keep(k)) if keep else shown


@F.pandas_udf(T.StringType())
def render_record(shown: pd.Series) -> pd.Series:
    return shown.map(lambda m: json.dumps(dict(m), sort_keys=True, indent=2, ensure_ascii=False))


def indicated_category(name: Column, dictionary: Column) -> Column:
    """Category of the first token of the folded name that the map `dictionary` holds."""
    return F.get(F.filter(F.transform(F.split(name, " "), lambda t: dictionary[t]), lambda x: x.isNotNull()), F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def decide(score: Column, threshold) -> Column:
    """Below the threshold; a missing or NaN score abstains, so it is not."""
    return F.when(score.isNull() | F.isnan(score), False).otherwise(score < threshold)


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text; strings and escapes are respected, before its first brace, too."""
    depth, start, quoted, skip = 0, 0, False, False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def satisfies(parsed, schema: dict) -> bool:
    """Required and allowed keys and enumerations of a flat JSON schema."""
    if not isinstance(parsed, dict):
        return False
    props = schema.get("properties", {})
    if not schema.get("additionalProperties", True) and set(parsed) - set(props):
        return False
    return set(schema.get("required", [])) <= set(parsed) and all(v in props[k]["enum"] for k, v in parsed.items() if "enum" in props.get(k, {}))


def answer_validity(text: Column, schema: dict, constrained: bool = True) -> Column:
    @F.pandas_udf(T.BooleanType())
    def valid(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return satisfies(json.loads(t if constrained else first_object(t) or ""), schema)
            except (TypeError, ValueError):
                return False

        return texts.map(one)

    return valid(text)
