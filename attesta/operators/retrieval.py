"""Best matches by cosine within groups, in blocks: one matrix product for each pair of blocks, never a row for each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def packed(vectors: DataFrame, group: str, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(g, ids, vs): about `block` vectors of one group a row; null vectors are left out."""
    rows = vectors.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = rows.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    both = dealt.groupBy("g", "part").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("x"))
    return both.select("g", F.col("x.id").alias("ids"), F.col("x.v").alias("vs"))


def _unit(column: pa.ListArray, i: int) -> np.ndarray:
    rows = column[i].values
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def top_matches(queries: DataFrame, entries: DataFrame, k: int, group: str, key: str, vector: str, digits: int = 9) -> DataFrame:
    """(id, other, rank, score): the k entries of a query's group with the highest cosine, itself left out; scores are compared
    rounded to `digits`, ties go to the smaller id; zero vectors score 0. Vectors of a group have one length."""

    def best(batches):
        for b in batches:
            ids, others = b.column(0), b.column(2)
            for i in range(len(b)):
                q_id, e_id = (c[i].values.to_numpy() for c in (ids, others))
                score = _unit(b.column(1), i) @ _unit(b.column(3), i).T
                order = np.round(score, digits) + 0.0
                order[q_id[:, None] == e_id[None, :]] = -np.inf
                n = min(k + 1, order.shape[1])
                # all entries at or above the k-th best score, so that ties are cut by id alone
                least = -np.partition(-order, n - 1, 1)[:, n - 1]
                row, col = np.nonzero((order >= least[:, None]) & (order > -np.inf))
                at = np.lexsort((e_id[col], -order[row, col], row))
                row, col = row[at], col[at]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(q_id[row]), pa.array(e_id[col]), pa.array(order[row, col]), pa.array(score[row, col])], names=["id", "other", "r", "score"])

    one = packed(queries, group, key, vector).select(F.col("g"), F.col("ids").alias("q_ids"), F.col("vs").alias("q"))
    both = one.join(packed(entries, group, key, vector), "g").select("q_ids", "q", "ids", "vs")
    found = both.mapInArrow(best, "id long, other long, r double, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("r").desc(), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "rank", "score")
