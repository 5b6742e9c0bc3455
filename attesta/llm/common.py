"""What the operators of this subpackage share: tables, the shared folder and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that ends a word; every other code point belongs to one.
SPACES = b" \t\n\x0b\x0c\r"
#: With it, the shuffle files of an execution go as soon as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that the driver and all executors see: below spark.checkpoint.dir, or, only where that is unset
    and all runs in one process (tests), below a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="attesta-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, so a lost executor costs a reread. Its
    shuffle files go, too."""
    spark = df.sparkSession
    to = shared_dir(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(to)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(to)
    out.attesta_path = to
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote, once all that was made of them is written, too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.attesta_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Long texts: so many rows at most go to a Python worker at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Free memory of this process goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """A map function over batches after which a worker, which lives on for other tasks, gives its free memory back."""

    def go(batches) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty. Pure ASCII texts take the short way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of an id and a text; null is a value of its own."""
    told = (doc_id.isNull(), text.isNull(), doc_id, text)
    return F.xxhash64(*told), F.xxhash64(F.lit(1), *told)


def thinned(docs: DataFrame, key: tuple[Column, Column], acts: DataFrame, most_bits: int = 28) -> DataFrame:
    """The rows of docs but those whose key acts(k1, k2, stay) names; of these one row of each key with stay = 1 (the
    least by its columns). A bitmap of the named keys' hashes, of at most 2^most_bits bits (32 MB), is broadcast; rows
    that it clears pass as they are, and only the others are joined. Columns of docs may have any names."""
    acts = saved(acts.select("k1", "k2", F.col("stay").cast("int").alias("stay")), "acts")
    n, one = acts.agg(F.count(F.lit(1)), F.max("stay")).first()
    if not n:
        return docs
    bits = min(most_bits, max(20, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << bits))
    place = F.expr("slot & 32767")
    marks = acts.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(place).alias("bits"))
    marks = F.broadcast(saved(marks, "acts-bits"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key[0].alias("k1"), key[1].alias("k2")).withColumn("slot", F.coalesce(slot, F.lit(-1)))
    rows = rows.join(marks, F.shiftright("slot", 15) == F.col("part"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("hit", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(slot & 7 as int))")) != 0, F.lit(False)))
    maybe = rows.where("hit").select("row", "k1", "k2")
    out = rows.where("not hit").select("row.*").unionByName(maybe.join(acts, ["k1", "k2"], "left_anti").select("row.*"))
    if one:
        alike = maybe.join(acts.where("stay = 1").select("k1", "k2"), ["k1", "k2"], "left_semi")
        out = out.unionByName(alike.groupBy("k1", "k2").agg(F.min("row").alias("row")).select("row.*"))
    return out


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", most_bits: int = 28) -> DataFrame:
    """The rows of docs whose id is not among gone(id), see thinned(). Rows without an id stay."""
    none = F.lit(0).cast("long")
    acts = gone.where("id is not null").select(F.col("id").cast("long").alias("k1"), none.alias("k2"), F.lit(0).alias("stay")).distinct()
    return thinned(docs, (F.col(id_col).cast("long"), F.when(F.col(id_col).isNotNull(), none)), acts, most_bits)
