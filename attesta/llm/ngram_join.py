"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct 5-word shingles. In a global order (estimated frequency, then hash)
two sets with Jaccard similarity of 0.8 or more share at least l of the first n - ceil(0.8 n) + l shingles of each.
Every document picks its own l: a longer prefix scans more postings, but asks for more shared shingles and so
verifies fewer candidates; the l with the least estimated cost wins. Two documents are candidates when they share
min(l, l') prefix shingles, which loses no pair. Candidates are verified on their whole sets.

Of a pair the smaller set must share 8/9 of itself, so only its shorter prefix takes part. A common prefix token counts
only if the tokens before it that have other takers, and all after it, could still make up the similarity; pairs whose
last common prefix token stands too late in either set go before verification.

Frequencies are counted over all documents in a sketch of fixed size (2^SKETCH_BITS counters), whose errors change
the order and so the cost, never the result.

Large groups are never expanded into pairs: documents with equal sets are one node; every node is first paired with
one hub, the node of the posting lists that they share whose prefix is the most common (of a group of near copies the
one with the fewest shingles of its own), verified and joined into components (twice, the second time with hubs of
other components); then only pairs of nodes that are still in different components are
candidates, in full. No pair is verified twice, and only sets of nodes in pairs are made. Components are found by alternating large-star and
small-star steps over tables in the shared folder.

Edge cases: texts without words (or null) have no shingles and link with nothing; texts of fewer than 5 words have
one shingle, the whole sequence; rows that repeat a doc_id count as one node; a row with a null doc_id gets its
n_shingles and a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attesta.llm.common import LOWER, SPACES, UPPER, forget, give_back, saved, small_batches, tidy

WORDS, PERCENT, SKETCH_BITS, BLOCK_BITS, MOST_MATCHES = 5, 80, 21, 15, 4
#: Cost of verifying a candidate, in scanned postings.
VERIFY = 8
#: Rounds of stars before all remaining candidates.
STARS = 2
#: So many ids (8 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes hashed at a time; only a longer word makes a longer piece.
PIECE = 1 << 20
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Hashes words straight from the bytes of many texts, by polynomials over drawn values of the bytes modulo 2^64;
    nothing is kept from batch to batch but the powers of the base. Different words are taken as equal only where
    64 bits agree."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 11):
        value = np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.value = value[np.frombuffer(bytes(range(256)).translate(_FOLD), np.uint8)]
        self.powers, self.inverse = (np.ones(1, np.uint64) for _ in "ab")

    def _room(self, n: int) -> None:
        if n > len(self.powers):
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(max(n, PIECE), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of a buffer that ends in white space: where each begins, and its hash."""
        begins, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(raw):
            stop = min(at + PIECE, len(raw))
            while stop < len(raw) and _IN_WORD[raw[stop - 1]]:  # up to the next white space
                ahead = np.flatnonzero(~_IN_WORD[raw[stop : stop + PIECE]])
                stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + PIECE, len(raw))
            part = raw[at:stop]
            edge = np.flatnonzero(np.diff(_IN_WORD[part].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            first, end = edge[::2], edge[1::2]
            self._room(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.value[part] * self.powers[: len(part)], out=sums[1:])
            hashes.append(_mixed((sums[end] - sums[first]) * self.inverse[first]))
            begins.append(first + at)
            at = stop
        return np.concatenate(begins), np.concatenate(hashes)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Of each text: the sorted hashes (uint64) of its distinct shingles."""
        raw = [(t or "").encode() for t in texts.to_numpy(zero_copy_only=False).tolist()]
        ends = np.cumsum([len(t) + 1 for t in raw])
        begins, h = self.words(np.frombuffer(b"".join(t + b"\n" for t in raw), np.uint8))
        n = np.diff(np.searchsorted(begins, ends), prepend=0)
        s = np.zeros(max(len(h) - WORDS + 1, 0), np.uint64)
        for i in range(WORDS if len(s) else 0):
            s = (s ^ (s >> np.uint64(29))) * np.uint64(self.BASE) + h[i : i + len(s)]
        s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(27)
        out, at = [], 0
        for m in n.tolist():
            if m >= WORDS:
                x = np.sort(s[at : at + m - WORDS + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            else:
                out.append(np.array([xxhash.xxh64_intdigest(h[at : at + m].tobytes(), m)] if m else [], np.uint64))
            at += m
        return out


def sketch_counts(rows: DataFrame) -> np.ndarray:
    """Counts of all shingles by their highest SKETCH_BITS bits."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        shingler, sums = Shingler(), np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            s = shingler.sets(b.column(0))
            if s:
                sums += np.bincount((np.concatenate(s) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        for i, block in enumerate(sums.reshape(-1, 1 << BLOCK_BITS)):  # one at a time: copies of all would triple the memory
            if top := int(block.max()):
                width = 4 if top < 2**31 else 8
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([width], pa.int32()), pa.array([block.astype(f"i{width}").tobytes()], pa.binary())], names=["block", "width", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for width, c in zip(group.width, group.counts, strict=True):
            total += np.frombuffer(c, np.int64 if width == 8 else np.int32)
        return pd.DataFrame({"block": [int(group.block.iloc[0])], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    parts = rows.select("text").mapInArrow(tidy(count), "block int, width int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros((1 << SKETCH_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.int32)
    for r in parts.collect():  # the sketch: of fixed size
        out[r.block] = np.frombuffer(r.counts, np.int32)
    return out.ravel()


def prefix_of(s: np.ndarray, sketch: np.ndarray, noise: float) -> tuple[int, np.ndarray, float]:
    """(l, the prefix, the mean logarithm of its estimated frequencies) of a set."""
    n = len(s)
    need = (PERCENT * n + 99) // 100
    most = min(MOST_MATCHES, need)
    base = n - need
    # by frequency, then hash (s is sorted): only the longest prefix is brought into order
    order = (sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64) << 32) | np.arange(n)
    order = np.sort(np.partition(order, base + most - 1)[: base + most])
    at, f = order & 0xFFFFFFFF, order >> 32
    found = np.cumsum(np.maximum(f - 1 - noise, 0.0))
    cost = [found[base + k - 1] * (1 + VERIFY / k) for k in range(1, most + 1)]
    best = int(np.argmin(cost)) + 1
    return best, s[at[: base + best]], float(np.log1p(f[: base + best]).mean())


def profiles(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """doc_id, n (set size), key (of the set), l, the prefix and how common it is of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(), shared.value
        noise = float(counts.mean())
        for b in batches:
            sets = shingler.sets(b.column(1))
            keys = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            made = [prefix_of(s, counts, noise) if len(s) else (0, s, 0.0) for s in sets]
            flat = np.concatenate([p for _, p, _ in made]) if made else np.zeros(0, np.uint64)
            ends = np.cumsum([0, *(len(p) for _, p, _ in made)]).astype(np.int32)
            columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([x for x, _, _ in made], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), pa.array([x for _, _, x in made], pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "l", "prefix", "common"])

    return rows.mapInArrow(tidy(run), "doc_id long, n long, key binary, l int, prefix array<long>, common float")


def sets_of(rows: DataFrame) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            sets = shingler.sets(b.column(1))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["node", "s"])

    return rows.mapInArrow(tidy(run), "node long, s array<long>")


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in the saved table ids(node), which is broadcast only up to BROADCAST_IDS rows."""
    ids = ids.withColumnRenamed("node", "doc_id")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of a saved table whose sets are similar enough, by their whole sets. Sets in no pair aren't
    shuffled, unless the pairs have more than BROADCAST_IDS nodes on that side."""
    both = pairs
    for side in "ba":
        ids = pairs.select(side).distinct()
        own = sets.select(F.col("node").alias(side), F.col("s").alias(f"s{side}"))
        both = both.join(own.join(F.broadcast(ids), side, "left_semi") if ids.count() <= BROADCAST_IDS else own, side)
    both = both.withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * PERCENT).select("a", "b")


def linked(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """verified() pairs, saved; the sets of their nodes, and of no others, are made anew from the texts for it."""
    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{label}-ends")
    sets = saved(sets_of(with_ids(texts, ends)), f"{label}-sets")
    found = saved(verified(pairs, sets), f"{label}-links")
    forget(ends, sets)
    return found


def untested(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) that stand in none of the tables tested, in either order."""
    for t in tested:
        t = t.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        pairs = pairs.join(t, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of edges (a, b)."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    state = None
    while True:
        print_ = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(print_) == state or not print_[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(print_)
        # large star: larger neighbours go to the smallest node of the neighbourhood
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = saved(sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        forget(before, large)


def similar_sizes(n: str, m: str):
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id. See the module for the method."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    table = saved(profiles(rows, sketch_counts(known)), "ngram-profiles")
    give_back()
    full = table.where("doc_id is not null and n > 0")
    # equal sets are one node, the smallest of their ids
    groups = full.groupBy("key").agg(F.min("doc_id").alias("node"))
    copies = saved(full.select("doc_id", "key").join(full.groupBy("key").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).where("node < last"), "key").where("doc_id > node").select("doc_id", "key").distinct(), "ngram-copies")
    firsts = full.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, ["doc_id", "key"], "left_anti")
    posts = firsts.select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("node"), "n", "l", "common")
    of_token = Window.partitionBy("token")
    posts = posts.withColumn("hub", F.min(F.struct((-F.col("common")).alias("rare"), "node", "n", "l")).over(of_token)).withColumn("c", F.count(F.lit(1)).over(of_token))
    posts = saved(posts.where("c > 1").select("token", "pos", "node", "n", "l", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.l").alias("hub_l")), "ngram-posts")
    fits = similar_sizes("n", "hub_n")
    # stars: every node with that hub of its lists, still in another component, which it shares most lists with
    roots, links, tested = None, None, []
    for turn in range(STARS):
        here = posts.where("node <> hub").where(fits)
        if roots is not None:
            at = roots.withColumnRenamed("node", "x")
            here = here.join(at.select(F.col("x").alias("node"), F.col("root").alias("rn")), "node", "left").join(at.select(F.col("x").alias("hub"), F.col("root").alias("rh")), "hub", "left")
            here = here.where(F.coalesce("rn", "node") != F.coalesce("rh", "hub"))
        stars = here.groupBy("hub", "node").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("l", "hub_l")).alias("need")).where("c >= need")
        stars = untested(stars.select(F.col("hub").alias("a"), F.col("node").alias("b"), "c"), tested)
        best = stars.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("h"))).alias("x"))
        pairs = saved(best.select((-F.col("x.h")).alias("a"), "b"), f"ngram-star{turn}")
        tested.append(pairs)
        found = linked(pairs, known, f"ngram-star{turn}")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    # all candidates in different components
    lists = posts.select("token", "pos", "node", "n", "l").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lists = lists.withColumn("mixed", F.min("root").over(of_token) != F.max("root").over(of_token))
    # q: how many of the node's tokens before this one can be shared with a node of another component at all; the order
    # is global, so a partner that has this token in its prefix has every earlier common token there, too
    before = Window.partitionBy("node").orderBy("pos")
    lists = saved(lists.where("mixed").drop("mixed").withColumn("q", F.row_number().over(before) - 1), "ngram-lists")
    one, two = (lists.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("pos", "node", "n", "l", "root", "q"))) for x in "ab")
    # a is the smaller set: with a partner of its size or more it must share 8/9 of itself, so its prefix is shorter
    short = one.where("pos_a < n_a - floor((8 * n_a + 8) / 9) + l_a")
    bound = 1 + F.least("q_a", "q_b") + F.least(F.col("n_a") - 1 - F.col("pos_a"), F.col("n_b") - 1 - F.col("pos_b"))
    cross = short.join(two, "token").where("(n_a < n_b or n_a = n_b and node_a < node_b) and root_a <> root_b").where(similar_sizes("n_a", "n_b"))
    cross = cross.where(bound * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT)
    cross = cross.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.least("l_a", "l_b")).alias("need"), F.max("pos_a").alias("at_a"), F.max("pos_b").alias("at_b"))
    # what they can share beyond the last common prefix token
    most = F.col("c") + F.least(F.col("n_a") - 1 - F.col("at_a"), F.col("n_b") - 1 - F.col("at_b"))
    cross = cross.where("c >= need").where(most * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT)
    pairs = saved(untested(cross.select("a", "b"), tested), "ngram-cross")
    forget(posts, lists, copies)
    more = linked(pairs, known, "ngram-cross")
    forget(pairs, *tested)
    # components of components
    at = roots.withColumnRenamed("node", "x")
    lifted = more.join(at.select(F.col("x").alias("a"), F.col("root").alias("ra")), "a", "left").join(at.select(F.col("x").alias("b"), F.col("root").alias("rb")), "b", "left")
    upper = components(lifted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    last = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    last = last.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("key", F.coalesce("top", "root").alias("component"))
    out = table.select("doc_id", "n", "key").join(saved(last, "ngram-components"), "key", "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
