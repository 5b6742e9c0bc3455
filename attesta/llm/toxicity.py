"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word is read as a hashed word vector and the mean of hashed vectors of its character 3- and 4-grams. Texts are
cut into overlapping windows of WINDOW words, STRIDE apart, to their very end; in each window two gated recurrent
passes run over the words, attention pools their states and a linear layer scores the pool. A document's score is
that of its highest window. Nothing but the text is read when scoring.

Training is multiple-instance: of a toxic document the highest window counts as toxic, of a clean one all windows
are clean (the highest one and two drawn ones are trained). Word and n-gram vectors start from shrunken log-odds of
their buckets in the sample. The sample is bounded: at most `sample` toxic and twice as many clean labelled documents, those with
the smallest keyed hashes among rows that are not held out; of rows that repeat an id the least text is read.

Edge cases: null and empty texts, and texts of white space, have one empty window and so a score; very long texts are
read to their end; columns of other names are not looked at; a row without a doc_id is scored, and not held out; a labelled
document without a row is left out; contradicting labels of a document count as toxic; without both labels in the
sample every score is 0; an empty table gives an empty result; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import give_back, small_batches, tidy
from attesta.llm.tokens import split_words

WINDOW, STRIDE, HIDDEN, DIM = 64, 48, 8, 4
WORD_BITS, GRAM_BITS = 18, 16
GRAMS = (3, 4)
MARKS = ",.;:!?\"'()"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def word_parts(words: list[str], block: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its bucket, the buckets of its n-grams (one after another) and their number."""
    parts = [_word_parts(words[k : k + block]) for k in range(0, max(1, len(words)), block)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _word_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [f"^{w.lower().strip(MARKS)}$".encode() for w in words]
    bucket = np.array([zlib.crc32(r) >> (32 - WORD_BITS) for r in raw], np.int64)
    lens = np.array([len(r) for r in raw], np.int64)
    b = np.concatenate([np.frombuffer(b"".join(raw), np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    n = int(lens.sum())
    place = np.arange(n) - np.repeat(np.cumsum(lens) - lens, lens)
    left, owner = np.repeat(lens, lens) - place, np.repeat(np.arange(len(raw)), lens)
    found, owners = [], []
    for g in GRAMS:
        h = np.full(n, g, np.uint32)
        for k in range(g):
            h = (h ^ b[k : n + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        ok = left >= g
        found.append((h[ok] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GRAM_BITS))
        owners.append(owner[ok])
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return bucket, np.concatenate(found)[order].astype(np.int32), np.bincount(at, minlength=len(raw))


def windows_of(n: int) -> list[int]:
    """Starts of the windows of n words: the last one reaches the end."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Two gated recurrent passes, attention, a linear layer. `p` holds the dense weights, `words` and `grams` the vectors."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = 2 * DIM, HIDDEN
        f = lambda *s, x=0.3: (r.standard_normal(s) * x).astype(np.float32)
        self.p = {"A": f(2 * h, h), "a": np.zeros(h, np.float32), "v": f(h), "w": f(2 * h), "b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"X{k}": f(d, 3 * h), f"U{k}": f(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.words, self.grams = f(1 << WORD_BITS, DIM, x=0.02), f(1 << GRAM_BITS, DIM, x=0.02)
        self.scale = np.array([1.0, 0.0])

    def vectors(self, bucket: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out, ends = np.empty((len(bucket), 2 * DIM), np.float32), np.concatenate([[0], np.cumsum(counts)])
        for k in range(0, len(bucket), 20_000):
            e = ends[k : k + 20_001]
            sums = np.concatenate([np.zeros((1, DIM)), np.cumsum(self.grams[grams[e[0] : e[-1]]], 0, dtype=np.float64)])
            n = np.diff(e)
            out[k : k + 20_000, DIM:] = np.diff(sums[e - e[0]], axis=0) / np.maximum(n, 1)[:, None]
        out[:, :DIM] = self.words[bucket]
        return out

    def forward(self, pre: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """pre: input parts of the gates by direction, time first (T, B, 3H); mask (T, B, 1). Scores (B) and the tape."""
        t, b, h = mask.shape[0], mask.shape[1], HIDDEN
        states, tape = np.empty((t, b, 2 * h), np.float32), {}
        for o, k in ((0, "f"), (h, "b")):
            s, u, steps = np.zeros((b, h), np.float32), self.p[f"U{k}"], []
            for i in range(t) if k == "f" else range(t - 1, -1, -1):
                x, m, g = pre[k][i], mask[i], s @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + g[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                new = s + m * (1 - z) * (n - s)
                if keep:
                    steps.append((i, s, z, r, n, g[:, 2 * h :]))
                s = states[i, :, o : o + h] = new
            tape[k] = steps
        e = np.tanh(states @ self.p["A"] + self.p["a"])
        q = np.where(mask[..., 0] > 0, e @ self.p["v"], -1e9)
        q = np.exp(q - q.max(0))
        q /= q.sum(0)
        c = (q[..., None] * states).sum(0)
        return c @ self.p["w"] + self.p["b"][0], (states, e, q, c, tape)

    def backward(self, d: np.ndarray, pre: dict, mask: np.ndarray, kept) -> tuple[dict, dict]:
        """Gradients of the dense weights (without X and c) and of `pre`, from those of the scores."""
        states, e, q, c, tape = kept
        p, h = self.p, HIDDEN
        g = {"w": c.T @ d, "b": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["w"]
        ds = q[..., None] * dc
        dq = (states * dc).sum(-1)
        da = q * (dq - (q * dq).sum(0))
        g["v"] = np.einsum("tb,tbh->h", da, e)
        de = da[..., None] * p["v"] * (1 - e * e)
        g["A"], g["a"] = np.einsum("tbs,tbh->sh", states, de), de.sum((0, 1))
        ds = ds + de @ p["A"].T
        out = {}
        for o, k in ((0, "f"), (h, "b")):
            u, gu, dpre, dh = p[f"U{k}"], np.zeros((h, 3 * h), np.float32), np.zeros_like(pre[k]), np.zeros((mask.shape[1], h), np.float32)
            for i, s, z, r, n, gn in reversed(tape[k]):
                dh = dh + ds[i, :, o : o + h]
                m = mask[i]
                dn, dz = dh * m * (1 - z), -dh * m * (n - s)
                pn = dn * (1 - n * n)
                gates = np.concatenate([dz * z * (1 - z), pn * gn * r * (1 - r), pn], 1)
                dpre[i] = gates
                into = gates.copy()
                into[:, 2 * h :] *= r
                gu += s.T @ into
                dh = dh * (1 - m * (1 - z)) + into @ u.T
            g[f"U{k}"], out[k] = gu, dpre
        return g, out


class Reader:
    """Turns texts into windows of word numbers, with a bounded memo of words."""

    def __init__(self, most: int = 60_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.code, self.fresh = {}, []

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW) word numbers, -1 past the end; the text of each window."""
        words, at, lens = split_words(texts)
        own = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        miss = np.array([i for i in np.flatnonzero(own < 0).tolist() if words[i]], np.int64)
        self.fresh = [words[i] for i in miss.tolist()]
        own[miss] = len(self.code) + np.arange(len(miss))
        self.code.update(zip(self.fresh, own[miss].tolist(), strict=True))
        codes = own[at]
        if "" in words:  # white space before or after a text
            real = codes >= 0
            lens = np.diff(np.concatenate([[0], np.cumsum(real)])[np.cumsum(lens)], prepend=0)
            codes = codes[real]
        begins, starts, ends, owner = np.cumsum([0, *lens]), [], [], []
        for i, n in enumerate(lens.tolist()):
            w = windows_of(n)
            starts.extend(begins[i] + x for x in w)
            ends.extend([begins[i + 1]] * len(w))
            owner.extend([i] * len(w))
        at = np.array(starts, np.int64)[:, None] + np.arange(WINDOW)
        inside = at < np.array(ends, np.int64)[:, None]
        padded = np.concatenate([codes, [-1]]).astype(np.int32)
        return padded[np.where(inside, at, len(codes))], np.array(owner, np.int64)


def fit(texts: list[str | None], labels: np.ndarray, steps: int = 200, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Net:
    """A net trained by `steps` gradient steps, as many at every size; without steps only its seeded vectors and drawn
    weights are there. The sample is read whole: all windows of all its texts."""
    net, reader, rng = Net(seed), Reader(1 << 40), np.random.default_rng(seed)
    parts = [(k, *reader.windows(pa.array(texts[k : k + 200], pa.string()))) for k in range(0, len(texts), 200)]
    win, owner = np.concatenate([w for _, w, _ in parts]), np.concatenate([k + o for k, _, o in parts])
    bucket, grams, counts = word_parts(list(reader.code) or [""])
    begin = np.cumsum(counts) - counts
    # shrunken log-odds of word and n-gram buckets over documents
    doc_words = _by_owner(win, owner, len(texts))
    odds = {}
    for name, bits in (("words", WORD_BITS), ("grams", GRAM_BITS)):
        seen = np.zeros((2, 1 << bits))
        for y, ws in zip(labels.tolist(), doc_words, strict=True):
            ws = ws[ws >= 0]
            hit = bucket[ws] if name == "words" else np.concatenate([grams[begin[w] : begin[w] + counts[w]] for w in ws.tolist()] or [np.zeros(0, np.int64)])
            seen[y, np.unique(hit)] += 1
        total = np.bincount(labels, minlength=2)
        odds[name] = (np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))) * (seen.sum(0) / (seen.sum(0) + 4))
        getattr(net, name)[:, 0] = odds[name] / 2
    word_odds = np.concatenate([odds["words"][bucket], [-99.0]])
    score = np.concatenate([word_odds[win[k : k + 4096]].max(1) for k in range(0, len(win), 4096)])
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in net.p.items()}
    sparse = {"words": np.zeros(1 << WORD_BITS, np.float32), "grams": np.zeros(1 << GRAM_BITS, np.float32)}
    step = 0
    while step < steps:
        top = np.full(len(texts), -1)
        order = np.argsort(score, kind="stable")
        top[owner[order]] = order  # the last one, so the highest
        extra = np.flatnonzero(labels[owner] == 0)
        extra = rng.choice(extra, min(len(extra), 2 * int((labels == 0).sum())), replace=False)
        train = rng.permutation(np.unique(np.concatenate([top, extra])))
        for k in range(0, min(len(train), (steps - step) * batch), batch):
            rows = train[k : k + batch]
            w, y = win[rows].T, labels[owner[rows]].astype(np.float32)
            used, at = np.unique(w, return_inverse=True)
            at = at.reshape(w.shape)
            real = used >= 0
            ids = used[real]
            parts = np.concatenate([np.arange(begin[i], begin[i] + counts[i]) for i in ids.tolist()] or [np.zeros(0, np.int64)])
            vec = np.zeros((len(used), 2 * DIM), np.float32)
            vec[real] = net.vectors(bucket[ids], grams[parts], counts[ids])
            mask = (w >= 0).astype(np.float32)[..., None]
            pre = {d: (vec @ net.p[f"X{d}"] + net.p[f"c{d}"])[at] for d in "fb"}
            logit, kept = net.forward(pre, mask, True)
            delta = ((_sigmoid(logit) - y) / len(rows)).astype(np.float32)
            grad, dpre = net.backward(delta, pre, mask, kept)
            dvec = np.zeros_like(vec)
            for d in "fb":
                flat = np.zeros((len(used), 3 * HIDDEN), np.float32)
                np.add.at(flat, at.ravel(), dpre[d].reshape(-1, 3 * HIDDEN))
                grad[f"X{d}"], grad[f"c{d}"] = vec.T @ flat, flat.sum(0)
                dvec += flat @ net.p[f"X{d}"].T
            step += 1
            for name, g in grad.items():
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            _adagrad(net.words, sparse["words"], bucket[ids], dvec[real, :DIM])
            _adagrad(net.grams, sparse["grams"], grams[parts], np.repeat(dvec[real, DIM:] / np.maximum(counts[ids], 1)[:, None], counts[ids], 0))
        score = score_windows(net, win, net.vectors(bucket, grams, counts))
    high = np.full(len(texts), -np.inf)
    np.maximum.at(high, owner, score)
    net.scale = _platt(high, labels)
    return net


def _by_owner(win: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    ends = np.searchsorted(owner, np.arange(n), "right")
    return [np.unique(win[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _adagrad(table: np.ndarray, seen: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float = 0.05) -> None:
    rows, inv = np.unique(at, return_inverse=True)
    sums = np.zeros((len(rows), g.shape[1]), np.float32)
    np.add.at(sums, inv, g)
    seen[rows] += (sums * sums).mean(1)
    table[rows] -= rate * sums / (np.sqrt(seen[rows]) + 1e-4)[:, None]


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = 1.0, 0.0
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(500):
        p = _sigmoid(a * x + b)
        a, b = max(0.05, a - 0.05 * float(((p - goal) * x).mean())), b - 0.05 * float((p - goal).mean())
    return np.array([a, b])


def score_windows(net: Net, win: np.ndarray, vectors: np.ndarray, block: int = 1024) -> np.ndarray:
    pre = {d: np.zeros((len(vectors) + 1, 3 * HIDDEN), np.float32) for d in "fb"}
    for d in "fb":
        np.matmul(vectors, net.p[f"X{d}"], out=pre[d][:-1])
        pre[d] += net.p[f"c{d}"]
        pre[d][-1] = net.p[f"c{d}"]
    return _score(net, win, pre, block)


def _score(net: Net, win: np.ndarray, pre: dict, block: int = 512) -> np.ndarray:
    out, lens = np.empty(len(win), np.float32), (win >= 0).sum(1)
    order = np.argsort(lens, kind="stable")
    for k in range(0, len(win), block):
        rows = order[k : k + block]
        w = win[rows, : max(1, int(lens[rows[-1]]))].T
        out[rows] = net.forward({d: pre[d][w] for d in "fb"}, (w >= 0).astype(np.float32)[..., None])[0]
    return out


class Scorer:
    """Scores texts; the gates' input parts of known words are kept."""

    def __init__(self, net: Net, most: int = 60_000):
        self.net, self.reader, self.most = net, Reader(most), most
        self.clear()

    def clear(self) -> None:
        self.reader.clear()
        self.n, self.pre = 0, {d: np.zeros((4096, 3 * HIDDEN), np.float32) for d in "fb"}
        for d in "fb":
            self.pre[d][-1] = self.net.p[f"c{d}"]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.n > self.most:
            self.clear()
        win, owner = self.reader.windows(texts)
        if new := self.reader.fresh:
            vec = self.net.vectors(*word_parts(new))
            for d in "fb":
                while self.n + len(new) + 1 > len(self.pre[d]):
                    self.pre[d] = np.concatenate([self.pre[d], np.zeros_like(self.pre[d])])
                self.pre[d][-1] = self.net.p[f"c{d}"]  # what -1 reads
                self.pre[d][self.n : self.n + len(new)] = vec @ self.net.p[f"X{d}"] + self.net.p[f"c{d}"]
            self.n += len(new)
        high = np.full(len(texts), -np.inf)
        np.maximum.at(high, owner, _score(self.net, win, self.pre))
        return _sigmoid(self.net.scale[0] * high + self.net.scale[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 1200) -> Net | None:
    """A net from at most `sample` toxic and 2 * `sample` clean documents, none of them held out; None without both labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample is drawn on ids alone; then its bounded list of ids is broadcast to the texts
    there = one.join(texts.select("doc_id"), "doc_id", "left_semi")
    ids = [r for y in (0, 1) for r in there.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample * (2 - y)).collect()]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in ids], "doc_id long, y int")
    one_text = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = sorted(one_text.collect(), key=lambda r: r.doc_id)  # as many as the sample has
    y = np.array([r.y for r in rows], np.int64)
    net = fit([r.text for r in rows], y) if len(set(y.tolist())) == 2 else None
    del rows, ids, y
    give_back()
    return net


def score_toxicity(docs: DataFrame, net: Net | None) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # tables of fixed size

    def run(batches) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            s = scorer.score(b.column(2)) if scorer else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def clean_rows(docs: DataFrame, net: Net | None) -> DataFrame:
    """The whole rows of `docs` that are predicted clean, all columns as they are. Nothing is shuffled or joined."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(net), docs.columns.index("text")  # tables of fixed size

    def run(batches) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            yield b.filter(pa.array(scorer.score(b.column(at)) < 0.5)) if scorer else b

    return docs.mapInArrow(tidy(run), docs.schema)
