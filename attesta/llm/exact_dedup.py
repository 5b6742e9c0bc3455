"""Exact dedup by counting quotient filters.

Each partition packs the fingerprints of its texts into a counting quotient filter: the high bits of a
fingerprint (the quotient) name a run, the low 32 bits (the remainder) are kept sorted inside the run with a
counter. Filters merge without loss, run by run, by merging sorted remainders and adding counters. Fingerprints
whose merged counter is above one route their texts, and only those, to byte verification.

A fingerprint collision only routes a text to verification; it never joins different texts.

Edge cases: a null text counts as empty; very long texts are compared whole; an empty table gives an empty result;
repeated rows form one group. Exactly one row of a group stays: of rows that repeat its largest doc_id any one; a null
doc_id stays only where a group has no other doc_id. Columns of `docs` but the two named may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import fold_ascii, saved

FINGERPRINT_BITS, REMAINDER_BITS = 52, 32
#: Fingerprints that one block of the merged filter holds, on average.
BLOCK_ROWS = 1 << 17


class CountingQuotientFilter:
    """Occupied quotients, the length of each one's run, and the runs' sorted remainders with their counters."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        fp, at = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        n = np.bincount(at, counts, len(fp)).astype(np.uint64) if len(fp) else np.zeros(0, np.uint64)
        quotients, runs = np.unique((fp >> np.uint64(REMAINDER_BITS)).astype(np.uint32), return_counts=True)
        return cls(quotients, runs.astype(np.uint32), (fp & np.uint64(0xFFFFFFFF)).astype(np.uint32), n)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(REMAINDER_BITS)) | self.remainders

    def plus(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters in one: the sorted remainders of each run are merged, equal ones add their counters."""
        mine, theirs = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(mine, theirs)
        same = mine[np.minimum(at, len(mine) - 1)] == theirs if len(mine) else np.zeros(len(theirs), bool)
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        fp, counts = np.insert(mine, at[~same], theirs[~same]), np.insert(counts, at[~same], other.counts[~same])
        high = (fp >> np.uint64(REMAINDER_BITS)).astype(np.uint32)
        first = np.flatnonzero(np.diff(high, prepend=np.uint32(0)).astype(bool) | (np.arange(len(high)) == 0))
        return CountingQuotientFilter(high[first], np.diff(first, append=len(high)).astype(np.uint32), (fp & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All filters in one, two at a time."""
        while len(filters) > 1:
            filters = [a.plus(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) // 2 * 2 :]
        return filters[0]

    def blocks(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut by the highest bits of the quotient."""
        block = self.quotients >> np.uint32(FINGERPRINT_BITS - REMAINDER_BITS - bits)
        ends = np.concatenate([[0], np.cumsum(self.runs, dtype=np.int64)])
        cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist() if len(block) else []
        for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
            s = slice(ends[a], ends[b])
            yield int(block[a]), CountingQuotientFilter(self.quotients[a:b], self.runs[a:b], self.remainders[s], self.counts[s])

    def pack(self) -> list[bytes]:
        return [self.quotients.tobytes(), self.runs.tobytes(), self.remainders.tobytes(), self.counts.tobytes()]

    @classmethod
    def unpack(cls, q: bytes, r: bytes, m: bytes, c: bytes) -> CountingQuotientFilter:
        return cls(np.frombuffer(q, np.uint32), np.frombuffer(r, np.uint32), np.frombuffer(m, np.uint32), np.frombuffer(c, np.uint64))


def fingerprint(text) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FINGERPRINT_BITS)


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in the column fp of `prints`, which has about `rows` rows."""
    bits = min(20, max(4, math.ceil(math.log2(max(1, rows) / BLOCK_ROWS))))

    def build(batches):
        parts = [CountingQuotientFilter.of(b["fp"].to_numpy(np.int64)) for b in batches if len(b)]
        if parts:
            yield pd.DataFrame([[k, *f.pack()] for k, f in CountingQuotientFilter.merged(parts).blocks(bits)], columns=["block", "q", "r", "m", "c"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        f = CountingQuotientFilter.merged([CountingQuotientFilter.unpack(*x) for x in zip(group.q, group.r, group.m, group.c, strict=True)])
        hit = f.counts > 1
        return pd.DataFrame({"fp": f.fingerprints()[hit].astype(np.int64), "n": f.counts[hit].astype(np.int64)})

    filters = prints.select("fp").mapInPandas(build, "block long, q binary, r binary, m binary, c binary")
    return filters.groupBy("block").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256. See the module for the method.

    Only (id, fingerprint, hash) of each row and the texts of repeated fingerprints are shuffled. Texts are compared
    byte for byte as grouping keys, which Spark combines before its shuffle, so a huge group of copies costs one row
    per task. The join that hands each copy its group's result is a sort-merge join whose skewed keys Spark splits.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold_ascii(F.col(text_col)).alias("norm"))
    prints = text.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), fingerprint(F.col("norm")).alias("fp"))
    prints = saved(prints.withColumn("number", F.monotonically_increasing_id()), "dedup-prints")
    repeated = saved(repeated_fingerprints(prints, prints.count()), "dedup-repeated")
    routed = text.withColumn("fp", fingerprint(F.col("norm"))).join(repeated.select("fp"), "fp", "left_semi")
    verified = saved(
        routed.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-groups")
    alone = F.col("group_size").isNull()
    judged = prints.join(verified, "text_sha256", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", "number")
    judged = saved(judged, "dedup-judged")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # where rows repeat the id that stays, one of them does
    ties = judged.where((F.col("group_size") > 1) & stays).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("only")).where("n > 1")
    judged = judged.join(saved(ties.select("text_sha256", "only"), "dedup-ties"), "text_sha256", "left")
    return judged.select("doc_id", "keep_id", "group_size", (stays & (F.col("only").isNull() | (F.col("only") == F.col("number")))).alias("kept"), "text_sha256")
