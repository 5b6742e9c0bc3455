"""Readers with declared schemas, and sinks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []
RECORD = "osm_type string, osm_id bigint, city string, country string, language string, maturity string, lat double, lon double, name string, tags map<string,string>, pos bigint"
PLACE_CSV = "source string, place_id string, name string, alternate_names string, lat string, lon string, country string, feature_code string, population string"
ANSWER = "run string, model string, item_id string, task string, prompt_version int, view string, parsed struct<verdict:string,field:string>, valid boolean, prompt_tokens bigint, output_tokens bigint, total_sec double"
LABEL_EVENT = "kind string, run string, annotator string, item_id string, position int, label string, evidence_source string, evidence_url string, no_source boolean, note string, seconds_on_item double, labelled_at string"

ITEM = "item_id string, pair_id string, class string, city string, country string, language string, maturity string, split string, osm_type string, osm_id bigint, record map<string,string>, corrupted boolean, corrupted_field string, original string, injected string, kind string, preexisting_flags array<struct<check:string,field:string,detail:string>>"
GOLD = "item_id string, city string, stratum string, language string, maturity string, label string, scored boolean, decidable_core boolean, inclusion_probability double"
ACTION = "meeting string, position bigint, kind string, item_id string, label string, reason string, note string"


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder that all machines see, below spark.checkpoint.dir; only a local session without it takes a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="attesta-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of records; a table partitioned by city is pruned by filters on it."""
    return spark.read.schema(RECORD).json(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer CSV: folded, distinct, non-empty names; a population that is not a number is 0."""
    from attesta.functions.records import fold

    raw = spark.read.schema(PLACE_CSV).csv(path, header=True)
    each = raw.select("place_id", "source", F.explode(F.array_distinct(F.concat(F.array("name"), F.split(F.coalesce("alternate_names", F.lit("")), ",")))).alias("n")).withColumn("n", fold("n")).where("n <> ''")
    names = each.groupBy("source", "place_id").agg(F.collect_set("n").alias("names"))
    population = F.when(F.col("population").rlike("^[0-9]+$"), F.col("population").try_cast("bigint")).otherwise(0)
    return raw.select("source", "place_id", F.col("name").alias("display_name"), F.col("lat").cast("double").alias("p_lat"), F.col("lon").cast("double").alias("p_lon"), "country", F.coalesce(population, F.lit(0)).alias("population")).join(names, ["source", "place_id"], "left")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; broken lines, such as one that a crash cut off, are dropped, and blank ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, read by name and typed; an empty cell is null."""
    fields = T._parse_datatype_string(schema).fields
    raw = spark.read.option("header", True).csv(path)
    cell = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
    return raw.select(*(cell(f).alias(f.name) for f in fields))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer files of all runs and models; broken lines are dropped."""
    return read_lines(spark, path, ANSWER).where("item_id is not null")


def answered_items(spark: SparkSession, path: str) -> DataFrame:
    """(run, model, item_id) that need not be asked again."""
    return read_answers(spark, path).select("run", "model", "item_id").distinct()


def invalid_answers(spark: SparkSession, path: str) -> DataFrame:
    """(run, model, invalid, answers) of the files."""
    return read_answers(spark, path).groupBy("run", "model").agg(F.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid"), F.count(F.lit(1)).alias("answers"))


def read_items(spark: SparkSession, path: str, item_class: str | None = None, split: str | None = None) -> DataFrame:
    """Injected or control items, of one class or split where asked for."""
    items = read_lines(spark, path, ITEM)
    items = items if item_class is None else items.where(F.col("class") == item_class)
    return items if split is None else items.where(F.col("split") == split)


def as_records(items: DataFrame) -> DataFrame:
    """What rules and screens read of an item: its shown fields as tags, and its coordinates as numbers."""
    shown = F.col("record")
    tags = F.map_filter(shown, lambda k, _: ~k.isin("lat", "lon"))
    return items.select("*", tags.alias("tags"), shown["lat"].cast("double").alias("lat"), shown["lon"].cast("double").alias("lon"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, GOLD)


def cluster_units(items: DataFrame, gold: DataFrame, unit: str = "city") -> DataFrame:
    """(item_id, unit) of both sets; the natural one counts where both know an item."""
    both = items.select("item_id", unit, F.lit(0).alias("o")).unionByName(gold.select("item_id", unit, F.lit(1).alias("o")))
    return both.groupBy("item_id").agg(F.max_by(unit, "o").alias(unit))


def read_label_events(spark: SparkSession, folder: str, run: str = "main") -> DataFrame:
    """All annotators' logs of a run; `x.jsonl` is main, `x.practice.jsonl` practice. Events in the order of their files."""
    events = read_lines(spark, f"{folder}/*.jsonl", LABEL_EVENT + ", protocol_version string, accepted_at string").withColumn("file", F.col("_metadata.file_name"))
    practice = F.col("file").endswith(".practice.jsonl")
    return events.where((practice if run == "practice" else ~practice) & (F.col("file") != "adjudication.jsonl")).withColumn("run", F.lit(run)).drop("file")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, ACTION)


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a log: a log is a folder of JSON lines that is only ever appended to."""
    events.write.mode("append").json(path)


def read_category_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token, category) of the token dictionary; the first category of a repeated token counts."""
    rows = read_table(spark, path, "token string, category string").where("token is not null and category is not null")
    return rows.groupBy("token").agg(F.min("category").alias("category"))


def token_map(tokens: DataFrame):
    """The dictionary as one map for records.indicated_category: some thousand tokens, gathered on the driver."""
    from itertools import chain

    pairs = [(r.token, r.category) for r in tokens.limit(100_001).collect()]
    if len(pairs) > 100_000:
        raise ValueError("join the dictionary by token: it is too large for a map")
    return F.create_map(*map(F.lit, chain.from_iterable(pairs))) if pairs else F.create_map().cast("map<string,string>")


def write_one(table: DataFrame, path: str, *order: str) -> None:
    """A small report as one CSV with a header, in order."""
    (table.coalesce(1).sortWithinPartitions(*order) if order else table.coalesce(1)).write.mode("overwrite").option("header", True).csv(path)


def count_fields(records: DataFrame, *keys: str) -> DataFrame:
    """By city: records, and how many carry each field."""
    from attesta.functions.records import item_value

    return records.groupBy("city").agg(F.count(F.lit(1)).alias("records"), *(F.count(item_value(F.col("tags"), k)).alias(k) for k in keys))


def parse_gazetteer(rows: DataFrame, feature_classes: tuple[str, ...]) -> DataFrame:
    """Places of a tab-separated gazetteer (id, name, alternate_names, lat, lon, feature_class, feature_code, country,
    population) in the reader's CSV columns; rows of other classes or without coordinates go."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    fine = rows.where(F.col("feature_class").isin(*feature_classes) & lat.between(-90, 90) & lon.between(-180, 180))
    return fine.select(F.lit("geonames").alias("source"), F.col("id").cast("string").alias("place_id"), "name", F.coalesce("alternate_names", F.lit("")).alias("alternate_names"), lat.alias("lat"), lon.alias("lon"), "country", "feature_code", F.coalesce(F.col("population").try_cast("bigint"), F.lit(0)).alias("population"))


def parse_bindings(rows: DataFrame) -> DataFrame:
    """Places of a query service's JSON answers (one string column `body`): id, label and a point as WKT."""
    binding = "array<struct<item:struct<value:string>,itemLabel:struct<value:string>,coord:struct<value:string>>>"
    each = rows.select(F.explode(F.from_json("body", f"struct<results:struct<bindings:{binding}>>")["results"]["bindings"]).alias("b"))
    point = r"Point\(([-0-9.eE]+) ([-0-9.eE]+)\)"
    part = lambda k: F.regexp_extract("b.coord.value", point, k).try_cast("double")
    out = each.select(F.lit("wikidata").alias("source"), F.substring_index("b.item.value", "/", -1).alias("place_id"), F.col("b.itemLabel.value").alias("name"), part(2).alias("lat"), part(1).alias("lon"))
    # a label that only repeats the id is no name
    return out.where("name <> place_id and lat is not null and lon is not null").dropDuplicates(["source", "place_id"])


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", quote="")


def write_by_city(records: DataFrame, path: str) -> None:
    records.repartition("city").sortWithinPartitions("osm_type", "osm_id").write.partitionBy("city").json(path)


def union_tables(*tables: DataFrame) -> DataFrame:
    """Union with missing columns as null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def call_in_batches(rows: DataFrame, client, schema: str) -> DataFrame:
    """Rows through an external client, a batch of rows at a time: client(pandas frame) -> pandas frame."""

    def run(batches):
        for b in batches:
            yield client(b)

    return rows.mapInPandas(run, schema)
