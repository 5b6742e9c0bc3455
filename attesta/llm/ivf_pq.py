"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids split the vectors into lists; a vector's residual to its centroid is cut into PARTS pieces and each
piece is replaced by the nearest of 256 codewords. Both codebooks are fitted on a bounded sample of `sample` vectors;
every vector is indexed. A query probes the lists of the centroids with the largest inner products. In each probed
block of a list an asymmetric distance table (query piece by codeword) gives approximate products for all its codes;
all vectors of the best `rerank` distinct codes, of codes tied with the last of these, and of every further code that may
reach the query's floor are scored exactly in double precision on the originals, and each query keeps its k best. The
floor is the k-th best product among the sample, so never above the true one; a code may reach it if its product and
`slack` times the query's length times the code's own coding error do. The slack is that of true neighbours of drawn
queries in the sample, so a block that holds many close neighbours gives them all. Vectors that the codebook can't tell
apart are scored all or not at all. Of equal vectors in a block only those of the k + 1 smallest ids can be among the k best.

Lists are stored as blocks of at most BLOCK vectors and queries as blocks of at most QUERIES, so one work unit is a
bounded pair of blocks however large a list is. There are as many lists as the root of the number of vectors (as far as
the sample allows), and as many are probed as hold `goal` of the true neighbours of TRIED drawn queries among the sample,
by brute force; and always so many that they hold more than k vectors.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; fewer candidates than k are all returned; ties go to the smaller id; rows that repeat an id are one neighbour, by
the best of their vectors, and one query, with the first k of all their results; columns of other names are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import saved
from attesta.llm.tokens import gather

PARTS, WORDS, BLOCK, QUERIES = 16, 256, 4096, 512
#: Queries whose neighbours say how many lists are probed and how far off codes may be; the share of neighbours within that.
TRIED, WITHIN = 400, 0.995


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids by Lloyd's rounds; a centroid without points takes a drawn point."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ c.T - half).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    """Of each row, by its largest component, so that no square is too large or small."""
    most = np.maximum(np.abs(x).max(1), np.finfo(float).tiny)
    return most * np.sqrt(np.square(x / most[:, None]).sum(1))


class Codebooks:
    """Approximate products are of unit queries and of vectors divided by `scale`, in single precision."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.width, self.scale, self.slack = -(-self.dim // PARTS), lengths(sample).max(), 1.0
        self.coarse = kmeans(sample, min(lists, len(sample)), 10, rng)
        rest = self.pieces(sample - self.coarse[nearest(sample, self.coarse)])
        self.words = np.stack([kmeans(rest[:, p], WORDS, 6, rng) for p in range(PARTS)])

    def pieces(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width * PARTS - self.dim))).reshape(len(x), PARTS, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and coding error (with that of single precision) of each vector."""
        at = nearest(x, self.coarse)
        rest = self.pieces(x - self.coarse[at])
        codes = np.stack([nearest(rest[:, p], self.words[p]) for p in range(PARTS)], 1).astype(np.uint8)
        lost = rest - self.words[np.arange(PARTS), codes]
        return at, codes, ((lengths(lost.reshape(len(x), -1)) + 1e-5 * lengths(x)) / self.scale).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(PARTS, queries, WORDS) products of pieces of unit queries and codewords."""
        return np.einsum("qpw,pcw->pqc", self.pieces(q), self.words / self.scale).astype(np.float32)


def units(q: np.ndarray) -> np.ndarray:
    return q / lengths(q)[:, None]


def floors(books: Codebooks, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th best product with vectors x of distinct ids but its own; -inf with fewer. In the units of the
    approximate products."""
    out = np.full(len(q), -np.inf)
    for i in range(0, len(q), 256) if len(x) > k else ():
        score = units(q[i : i + 256]) @ (x / books.scale).T
        score[q_ids[i : i + 256, None] == ids] = -np.inf
        out[i : i + 256] = np.partition(score, len(x) - k, 1)[:, len(x) - k]
    return out


def tuned(books: Codebooks, sample: np.ndarray, q: np.ndarray, k: int, goal: float) -> tuple[int, float]:
    """How many lists, those with the largest products first, hold `goal` of the k true neighbours of queries among the
    sample, and the slack that lets WITHIN of them reach a floor. Of equal vectors one counts, as any list that has one has
    them all, and a query's own vector doesn't."""
    sample = np.unique(sample, axis=0)
    at, codes, error = books.encode(sample)
    k = min(k, len(sample) - 1)
    if k < 1 or not len(q):
        return len(books.coarse), 1.0
    need, off, unit = [], [], units(q)
    for i in range(0, len(q), 100):
        u = unit[i : i + 100]
        score = u @ (sample / books.scale).T
        score[(q[i : i + 100, None, 0] == sample[:, 0]) & np.isclose(score, lengths(q[i : i + 100])[:, None] / books.scale, 1e-12, 0)] = -np.inf
        true = np.argpartition(-score, k - 1, 1)[:, :k]
        products = u @ (books.coarse / books.scale).T
        place = np.argsort(np.argsort(-products, 1, kind="stable"), 1)
        need.append(np.take_along_axis(place, at[true], 1).ravel())
        tables = books.tables(u)
        approx = np.take_along_axis(products, at[true], 1)
        for p in range(PARTS):
            approx += np.take_along_axis(tables[p], codes[true, p].astype(np.int64), 1)
        off.append(((np.take_along_axis(score, true, 1) - approx) / np.maximum(error[true], np.finfo(np.float32).tiny)).ravel())
    return int(np.quantile(np.concatenate(need), goal, method="higher")) + 1, float(np.clip(np.quantile(np.concatenate(off), WITHIN), 0, 1))


def folded(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of which no query can miss another: of equal vectors one row of each of the k + 1 smallest ids (one may be the query's own)."""
    same = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    fresh = np.diff(s, prepend=-1) != 0
    new = fresh | (np.diff(i, prepend=i[:1]) != 0)
    step = np.cumsum(new)
    first = np.maximum.accumulate(np.where(fresh, step, 0))
    return np.sort(order[new & (step - first <= k)])


def search_unit(books: Codebooks, at: int, ids: np.ndarray, codes: np.ndarray, error: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, rerank: int):
    """Of one block of a list, folded and sorted by code, and one block of queries: the k best (query row, id, score) of each
    query, short ones filled with -inf."""
    starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(1)]))
    cells, lens = codes[starts], np.diff(starts, append=len(codes))
    unit, allowed = units(q), np.float32(books.slack) * np.maximum.reduceat(error, starts)
    tables = books.tables(unit)
    approx = np.broadcast_to((unit @ (books.coarse[at] / books.scale)).astype(np.float32)[:, None], (len(q), len(cells))).copy()
    for p in range(PARTS):
        approx += tables[p][:, cells[:, p]]
    m = min(rerank + 1, len(cells))  # one cell may hold but the query itself
    found, score = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
    for a in range(0, len(q), 64):
        part = approx[a : a + 64]
        row, c = np.nonzero((part >= np.partition(part, len(cells) - m, 1)[:, len(cells) - m, None]) | (part + allowed >= floor[a : a + 64, None]))
        row, at_x = np.repeat(row, lens[c]) + a, gather(starts[c], lens[c])
        other = q_ids[row] != ids[at_x]  # a query is not its own neighbour
        row, at_x = row[other], at_x[other]
        exact = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", q[row[i : i + 8192]], x[at_x[i : i + 8192]]) for i in range(0, len(row), 8192))])
        order = np.lexsort((-exact, ids[at_x], row))
        row, at_x, exact = row[order], at_x[order], exact[order]
        once = (np.diff(row, prepend=-1) != 0) | (np.diff(ids[at_x], prepend=ids[at_x][:1]) != 0)  # an id's best vector
        row, at_x, exact = row[once], at_x[once], exact[once]
        order = np.lexsort((ids[at_x], -exact, row))
        row, at_x, exact = row[order], at_x[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < k
        found[row[top], place[top]], score[row[top], place[top]] = ids[at_x[top]], exact[top]
    return found, score


def search(vectors: DataFrame, k: int = 20, every: int = 20, lists: int | None = None, goal: float = 0.97, rerank: int = 24, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    usual = usable(vectors)
    asking = usual.where(F.pmod("vec_id", F.lit(every)) == 0)
    order = F.xxhash64("vec_id"), F.col("vec_id")
    some = usual.orderBy(*order).limit(sample).toPandas()  # bounded
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(some.v.map(len).mode()[0])
    fits = usual.where(F.size("v") == dim)
    some = some[some.v.map(len) == dim]
    drawn = np.stack(some.v.to_numpy()).astype(np.float64)
    tried = asking.where(F.size("v") == dim).orderBy(*order).limit(TRIED).select("v").toPandas()["v"]
    books = Codebooks(drawn, lists or int(min(max(16, fits.count() ** 0.5), max(16, sample // 32))))
    least, books.slack = tuned(books, drawn, np.array(tried.tolist(), np.float64).reshape(-1, dim), k, goal)
    once = np.unique(some.vec_id.to_numpy(), return_index=True)[1]
    known = spark.sparkContext.broadcast((some.vec_id.to_numpy()[once], drawn[once]))  # bounded, too
    shared = spark.sparkContext.broadcast(books)  # of a size that the sample bounds

    def encode(batches) -> Iterator[pd.DataFrame]:
        """List and code of every vector."""
        books = shared.value
        for p in batches:
            if len(p):
                x = np.stack(p.v.to_numpy())
                at, codes, error = books.encode(x)
                yield pd.DataFrame({"list": at.astype(np.int32), "vec_id": p.vec_id, "code": [c.tobytes() for c in codes], "error": [e.tobytes() for e in error], "x": [r.tobytes() for r in x]})

    def ask(batches) -> Iterator[pd.DataFrame]:
        """A row for each list that a query probes."""
        books = shared.value
        for p in batches:
            if len(p):
                x = np.stack(p.v.to_numpy())
                floor = floors(books, *known.value, p.vec_id.to_numpy(), x, k)
                order = np.argsort(-(units(x) @ (books.coarse / books.scale).T), 1, kind="stable")
                n = np.maximum(least, 1 + (np.cumsum(sizes[order], 1) <= k).sum(1))
                take = np.arange(order.shape[1]) < n[:, None]
                row, col = np.nonzero(take)
                yield pd.DataFrame({"list": order[row, col].astype(np.int32), "vec_id": p.vec_id.to_numpy()[row], "floor": [floor[r].tobytes() for r in row], "x": [x[r].tobytes() for r in row]})

    def packed(rows: DataFrame, columns: list[str], most: int, label: str) -> DataFrame:
        """Rows of about `most` vectors of one list: as many blocks as each list's size asks for, dealt by hash."""
        blocks = {r["list"]: -(-r["count"] // most) for r in rows.groupBy("list").count().collect()}  # a row per list
        of_list = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]) if blocks else F.create_map(F.lit(-1), F.lit(1))
        keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(of_list, F.col("list")))).repartition("list", "block").sortWithinPartitions("list", "block")

        def pack(batches) -> Iterator[pd.DataFrame]:
            held, at, n = [], None, 0

            def row() -> list:
                parts = {c: b"".join(h[c] for h in held) for c in columns}
                if "code" in columns:  # once for all the queries that come to a block
                    ids, x = np.frombuffer(parts["ids"], np.int64), np.frombuffer(parts["x"], np.float64).reshape(-1, dim)
                    codes = np.frombuffer(parts["code"], np.uint8).reshape(-1, PARTS)
                    rows = folded(ids, x, k)
                    rows = rows[np.argsort(np.ascontiguousarray(codes[rows]).view(np.dtype((np.void, PARTS))).ravel(), kind="stable")]
                    parts = {"ids": ids[rows].tobytes(), "code": codes[rows].tobytes(), "error": np.frombuffer(parts["error"], np.float32)[rows].tobytes(), "x": x[rows].tobytes()}
                return [at[0], *(parts[c] for c in columns)]

            for p in batches:
                for (lst, block), g in p.groupby(["list", "block"]):
                    if held and ((lst, block) != at or n + len(g) > 2 * most):
                        yield pd.DataFrame([row()], columns=["list", *columns])
                        held, n = [], 0
                    at = (int(lst), int(block))
                    held.append({"ids": g.vec_id.to_numpy(np.int64).tobytes()} | {c: b"".join(g[c]) for c in columns if c != "ids"})
                    n += len(g)
            if held:
                yield pd.DataFrame([row()], columns=["list", *columns])

        return saved(keyed.mapInPandas(pack, "list int, " + ", ".join(f"{c} binary" for c in columns)), label)

    def work(batches) -> Iterator[pd.DataFrame]:
        books = shared.value
        for p in batches:
            for r in p.itertuples(index=False):
                ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.x, np.float64).reshape(-1, dim)
                q_ids, q = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q, np.float64).reshape(-1, dim)
                found, score = search_unit(books, r.list, ids, np.frombuffer(r.code, np.uint8).reshape(-1, PARTS), np.frombuffer(r.error, np.float32), x, q_ids, q, np.frombuffer(r.floor, np.float64), k, rerank)
                yield pd.DataFrame({"query_id": q_ids, "found": [f.tobytes() for f in found], "scores": [s.tobytes() for s in score]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        """The k best of one query's units, at most one unit for each block of its lists."""
        found, score = np.frombuffer(b"".join(g.found), np.int64), np.frombuffer(b"".join(g.scores), np.float64)
        order = np.lexsort((found, -score))
        order = order[score[order] > -np.inf]
        order = order[np.sort(np.unique(found[order], return_index=True)[1])][:k]
        return pd.DataFrame({"query_id": g.query_id.iloc[0], "rank": np.arange(1, len(order) + 1, dtype=np.int32), "vec_id": found[order], "score": score[order]})

    coded = saved(fits.mapInPandas(encode, "list int, vec_id long, code binary, error binary, x binary"), "ivf-coded")
    sizes = np.zeros(len(books.coarse), np.int64)
    for r in coded.groupBy("list").agg(F.count_distinct("vec_id").alias("n")).collect():  # a row per list
        sizes[r["list"]] = r.n
    index = packed(coded, ["ids", "code", "error", "x"], BLOCK, "ivf-index")
    queries = asking.where(F.size("v") == dim).mapInPandas(ask, "list int, vec_id long, floor binary, x binary")
    asked = packed(saved(queries, "ivf-asked"), ["ids", "floor", "x"], QUERIES, "ivf-queries").select("list", F.col("ids").alias("q_ids"), "floor", F.col("x").alias("q"))
    small = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = index.join(asked, "list").repartition(2 * small).mapInPandas(work, "query_id long, found binary, scores binary")
    return best.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
