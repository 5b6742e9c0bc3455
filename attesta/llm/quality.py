"""Quality by weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Eleven overlapping heuristics vote good, bad or nothing on each document. Their votes are counted by pattern over all
documents (at most 2^11 patterns, counted before any shuffle); expectation-maximisation on these counts estimates
each labeller's accuracy (how often it votes what, by truth) and the share of good documents. A pattern's posterior
labels a bounded sample of `sample` documents (the smallest keyed hashes; a threshold on the hash leaves about half as
many more for the sort, however many tasks there are), on which a linear scorer over hashed words and hashed bins of
the heuristics' measures is trained. The scorer then scores every whole document.

No given label is read. Edge cases: null counts as empty; an empty text has no words and every labeller that needs
words abstains; documents on which all labellers abstain have the prior as posterior; one-sided samples give the
posterior share as score; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import small_batches, tidy

BITS = 16
LABELLERS = ("few_words", "indistinct", "one_word", "repeats", "upper", "symbols", "shouts", "long_words", "varied", "sentences", "plain")
_UPPER, _SYMBOLS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"|#{}<>[]=_~^*\\/@$%&+", b".,;:?"


def measures(text: str | None) -> tuple[list[str], tuple[float, ...]]:
    """The words, and: their number, shares of distinct words, of the most common one, of words that repeat the one
    before, marks a word, upper-case letters and symbols by bytes, exclamation marks a word, and mean length."""
    raw = (text or "").encode()
    words = (text or "").split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeated = sum(map(str.__eq__, words, words[1:]))
    share = lambda chars: size - len(raw.translate(None, chars))
    some = len(raw) > 0
    return words, (len(words), len(counts) / n, max(counts.values(), default=0) / n, repeated / n, some * share(_MARKS) / n, some * share(_UPPER) / size, some * share(_SYMBOLS) / size, raw.count(b"!") / n, sum(map(len, words)) / n)


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """1 good, 0 bad, -1 nothing, in the order of LABELLERS."""
    n, distinct, common, again, marks, upper, symbols, shouts, length = m
    if n == 0:
        return (0, *[-1] * (len(LABELLERS) - 1))
    bad = lambda x: 0 if x else -1
    good = lambda x: 1 if x else -1
    return (
        bad(n < 5), bad(n >= 20 and distinct < 0.25), bad(n >= 20 and common > 0.25), bad(n >= 10 and again > 0.1),
        bad(upper > 0.3), bad(symbols > 0.04), bad(shouts > 0.3), bad(length > 20),
        good(n >= 5 and distinct > 0.35 and again < 0.05), good(n >= 5 and 0.02 < marks < 1 and upper < 0.15), good(symbols < 0.01 and shouts < 0.05 and 2 < length < 15),
    )


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of good documents, and p[labeller, truth, vote + 1]: how often each labeller votes so, given the truth."""
    prior = 0.8
    start = np.array([[0.65, 0.3, 0.05], [0.3, 0.02, 0.68]])
    p = np.repeat(start[None], patterns.shape[1], 0)
    for _ in range(rounds):
        good = posterior(patterns, prior, p)
        prior = float(np.clip((good * counts).sum() / max(1, counts.sum()), 0.01, 0.99))
        for truth, weight in ((0, (1 - good) * counts), (1, good * counts)):
            for v in (-1, 0, 1):
                p[:, truth, v + 1] = ((weight[:, None] * (patterns == v)).sum(0) + 3 * start[truth, v + 1]) / (weight.sum() + 3)
    return prior, p


def posterior(patterns: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    """Probability of good for each pattern."""
    ratio = np.log(p[:, 1] / p[:, 0])
    logit = np.log(prior / (1 - prior)) + np.take_along_axis(ratio, patterns.T + 1, 1).sum(0)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Hasher:
    """Hashed features: the words' shares, and one bin of each measure."""

    def __init__(self, most: int = 500_000):
        self.memo, self.most = {}, most

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """Buckets and weights of all documents one after another, their number per document, and the measures."""
        if len(self.memo) > self.most:
            self.memo.clear()
        at, weight, size, seen = [], [], [], []
        for t in texts:
            words, m = measures(t)
            codes = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
            for i in np.flatnonzero(codes < 0).tolist():
                codes[i] = self.memo[words[i]] = zlib.crc32(words[i].lower().encode()) >> (32 - BITS)
            bins = [zlib.crc32(f"{k}={int(np.log2(1 + 64 * x))}".encode()) >> (32 - BITS) for k, x in enumerate(m)]
            at.append(np.concatenate([codes, np.array(bins, np.int64)]))
            weight.append(np.concatenate([np.full(len(codes), 1 / max(1, len(codes))), np.ones(len(bins))]))
            size.append(len(codes) + len(bins))
            seen.append(m)
        return np.concatenate(at), np.concatenate(weight), np.array(size), seen


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(size) - size) if len(size) else np.zeros(0)


def fit_linear(at: np.ndarray, weight: np.ndarray, size: np.ndarray, goal: np.ndarray, epochs: int = 60, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both sides weighing alike, by full-batch Adagrad."""
    w, b = np.zeros(1 << BITS), 0.0
    seen, seen_b, owner = np.full(1 << BITS, 1e-8), 1e-8, np.repeat(np.arange(len(size)), size)
    good = max(1e-6, goal.mean())
    importance = goal / good + (1 - goal) / max(1e-6, 1 - good)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(_sums(weight * w[at], size) + b, -30, 30)))
        d = (p - goal) * importance / len(size)
        g = np.bincount(at, weight * d[owner], 1 << BITS) + 1e-5 * w
        seen += g * g
        seen_b += d.sum() ** 2
        w -= rate * g / np.sqrt(seen)
        b -= rate * d.sum() / np.sqrt(seen_b)
    return w, b


def _smallest(rows: DataFrame, sample: int) -> list[str | None]:
    """The texts of the `sample` smallest keyed hashes."""
    return [r.text for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("text").collect()]


def score_quality(docs: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, posterior, score (0 to 1, higher is better), keep (score >= 0.5)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                p = ",".join(map(str, votes(measures(t)[1])))
                seen[p] = seen.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    found = rows.select("text").mapInArrow(tidy(count), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 2^11 rows
    patterns = np.array([[int(x) for x in r.pattern.split(",")] for r in found], np.int64).reshape(-1, len(LABELLERS))
    prior, acc = em(patterns, np.array([r.n for r in found], np.float64))
    total = sum(r.n for r in found)
    few = rows.where(F.xxhash64("doc_id") < int(-(1 << 63) + 1.5 * sample / total * (1 << 64))) if total > 1.5 * sample else rows
    some = _smallest(few, sample)
    if few is not rows and len(some) < sample:  # ids that repeat: the threshold left too few
        some = _smallest(rows, sample)
    if some:
        at, weight, size, seen = Hasher().of(some)
        w, b = fit_linear(at, weight, size, posterior(np.array([votes(m) for m in seen]), prior, acc))
    else:
        w, b = np.zeros(1 << BITS), 0.0
    model = spark.sparkContext.broadcast((w, b, prior, acc))  # of fixed size

    def score(batches) -> Iterator[pa.RecordBatch]:
        hasher, (w, b, prior, acc) = Hasher(), model.value
        for part in batches:
            if not len(part):
                continue
            at, weight, size, seen = hasher.of(part.column(1).to_pylist())
            s = 1 / (1 + np.exp(-np.clip(_sums(weight * w[at], size) + b, -30, 30)))
            post = posterior(np.array([votes(m) for m in seen]), prior, acc)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(post), pa.array(s), pa.array(s >= 0.5)], names=["doc_id", "posterior", "score", "keep"])

    return rows.mapInArrow(tidy(score), "doc_id long, posterior double, score double, keep boolean")
