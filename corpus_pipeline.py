"""A training corpus in five stages, each on all that the one before kept.

Decisions hold for rows, not for ids: a row is known by its doc_id and text, and of rows that agree in both exactly as
many stay as the decision says. So rows without a doc_id, and rows that repeat one, are filtered like any other.

Edge cases, alike in all stages: a null text counts as empty; very long texts are read whole; empty tables pass through
as empty tables; of a document's columns only the usual five are handed on, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import fold_ascii, row_key, saved, table, thinned
from attesta.llm.exact_dedup import exact_dedup
from attesta.llm.merge_dropout import encode_pieces
from attesta.llm.mixing import mixed_rows
from attesta.llm.ngram_join import ngram_join
from attesta.llm.queries import PIECE_MODEL
from attesta.llm.toxicity import clean_rows, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; empty texts are scored, too. Without labels of both kinds nothing goes."""
    return clean_rows(docs.select(*COLUMNS), train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (a null one only where there is no other); of rows that
    repeat it the least by their columns."""
    docs = docs.select(*COLUMNS)
    told = lambda text: row_key(F.col("doc_id"), text)
    judged = exact_dedup(docs).where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.max(F.col("kept").cast("int")).alias("stay"), F.count(F.lit(1)).alias("n"))
    k1, k2 = told(F.col("text_sha256"))
    acts = judged.where("stay < n").select(k1.alias("k1"), k2.alias("k2"), "stay")
    return thinned(docs, told(F.sha2(fold_ascii(F.col("text")), 256)), acts)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays (a null one only where there is no other).
    Rows are joined by a 64-bit hash of doc_id and text instead of their ids."""
    docs = docs.select(*COLUMNS)
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    found = saved(ngram_join(rows, id_col="k1"), "near-components")
    many = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(found.join(many, "component_id", "left_semi").select(F.col("doc_id").alias("k1"), "component_id").distinct(), "near-members")
    named = saved(rows.select("k1", "k2", "doc_id").join(members, "k1"), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")
    first = named.groupBy("component_id").agg(F.min(order).alias("first"))
    keys = named.join(first, "component_id").groupBy("k1", "k2").agg(F.max((F.struct("k1", "k2") == F.struct("first.k1", "first.k2")).cast("int")).alias("stay"), F.count(F.lit(1)).alias("n"))
    return thinned(docs, (k1, k2), keys.where("stay < n").select("k1", "k2", "stay"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (none, once, twice) as the mix takes it, its copies numbered. Sources without words,
    the null source among them, have a target of 0."""
    return mixed_rows(docs.select(*COLUMNS), copy_col="copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, cut with merge-dropout; the copies of a document are cut apart, rows that repeat a doc_id
    and copy alike. An empty text has no pieces."""
    return encode_pieces(docs, PIECE_MODEL, copy_col="copy" if "copy" in docs.columns else None)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Scores of a trained network and segmentations by keyed hashes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
