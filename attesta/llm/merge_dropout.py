"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is normalised as the model does (a leading blank, blanks as U+2581) and cut into units that no piece of the
vocabulary crosses: a run of blanks with the word after it, and line breaks. In each unit an agenda holds
the candidate merges by score, then position; a merge that comes up is skipped when its keyed hash falls under the
dropout rate, and may come up again with other neighbours. The key is the seed, the unit, the candidate's span and
the occurrence, a keyed hash of document, copy and position: the same text in the same copy of a document is always
cut alike, and each occurrence of a word is drawn anew. Rate 0 gives the model's own segmentation.

A unit's segmentation depends on its skips alone, so those seen are kept as a tree of candidates that branches on
being skipped. All occurrences of a batch walk their trees side by side with their own draws, and an agenda is run only
where a walk leaves the tree. Units over WIDE characters have no tree.

Characters outside the vocabulary, and a literal U+2581, become byte pieces, so decoding gives the text back exactly. A model whose pieces cross words or lines is refused.

Edge cases: null counts as empty and has no pieces; very long texts are encoded whole; repeated rows are cut alike.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import small_batches, tidy
from attesta.llm.tokens import RunTable, gather

BLANK = "▁"
MASK = (1 << 64) - 1
WIDE, BLOCK = 24, 5_000
#: Rows that are encoded at a time: more would only hold more units in memory.
ROWS = 150
#: The unit of a literal U+2581; no other unit holds two line breaks.
MARK = "\n\n"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MergeDropout:
    def __init__(self, model: str, rate: float = 0.1, seed: int = 7, most: int = 150_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.rate, self.seed = rate, seed
        self.limit = int(rate * (1 << 32))
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: sp.get_score(i) for i in plain}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # what each id stands for, as bytes; U+2581 in a piece is a blank
        known = set(plain)
        raw = [pieces[i].replace(BLANK, " ").encode() if i in known else b"" for i in range(n)]
        for b, i in enumerate(self.byte_id):
            raw[i] = bytes([b])
        self.raw_lens = np.array([len(x) for x in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lens) - self.raw_lens
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size, joined = n, [p for p in self.id if len(p) > 1]
        self._joins({self.id[p[:i]] * n + self.id[p[i:]]: self.id[p] for p in joined for i in range(1, len(p)) if p[:i] in self.id and p[i:] in self.id})
        part = np.arange(32, dtype=np.uint64)
        #: What a candidate's (begin, mid, stop), five bits each, adds to the key.
        self.salts = (part[:, None, None] * np.uint64(0xD6E8FEB86659FD93) + part[:, None] * np.uint64(0xE7037ED1A0B428DB) + part * np.uint64(0xA0761D6478BD642F)).ravel()
        self.rank = np.array([sp.get_score(i) for i in range(n)])
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in self.id.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in joined):
            raise ValueError("the model has pieces across words or lines")
        self.units = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
        self.table = RunTable(most)
        self._clear()

    def _joins(self, makes: dict[int, int]) -> None:
        """A hash table from pairs of pieces to the piece that they make; a pair stands at its slot or soon after."""
        bits = max(10, (6 * len(makes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pairs, self.makes = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int64)
        keys, values = np.array(list(makes), np.int64), np.array(list(makes.values()), np.int64)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.pairs[at] < 0
            own = np.zeros(len(keys), bool)
            own[np.unique(at, return_index=True)[1]] = True
            own &= free
            self.pairs[at[own]], self.makes[at[own]] = keys[own], values[own]
            keys, values, at = keys[~own], values[~own], at[~own] + 1
            self.probes += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _clear(self) -> None:
        """Nodes of the trees: a candidate's span, and at 2 * node + (0 kept, 1 skipped) what comes next: a node, -1
        where not seen yet, or -2 - run. A unit's root has the first candidate or the run at 0."""
        self.table.clear()
        self.code: dict = {}
        self.root, self.unit_key, self.long = np.zeros(1024, np.int64), np.zeros(1024, np.uint64), np.zeros(1024, bool)
        self.n_nodes, self.span, self.child = 0, np.zeros(4096, np.int16), np.full(8192, -1, np.int32)

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode()]

    def _key(self, unit: str, variant: int) -> int:
        return ((zlib.crc32(unit.encode(), self.seed) << 20) ^ ((variant + 1) * 0x9E3779B97F4A7C15)) & MASK

    def _skips(self, h):
        """Whether candidates are skipped, from the sums of key and span; on arrays of uint64."""
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)) < np.uint64(self.limit)

    def segment(self, unit: str, variant: int = 0, trace: list | None = None) -> list[int]:
        """Ids of one unit by an agenda; the variant is the occurrence's hash."""
        return self._segment(unit, self._key(unit, variant), trace)

    def _segment(self, unit: str, key: int, trace: list | None = None) -> list[int]:
        """For units that are long or hold characters outside the vocabulary. A trace takes (span, skipped) of each
        candidate that comes up."""
        if unit == MARK:
            return self._bytes(BLANK)
        n, score, limit = len(unit), self.score, self.limit
        begin, end = list(range(n)), list(range(1, n + 1))  # symbol i covers unit[begin[i]:end[i]]; dead ones have end 0
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := score.get(unit[begin[a] : end[b]])) is not None:
                heapq.heappush(agenda, (-s, a, b, end[a], end[b]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, mid, stop = heapq.heappop(agenda)
            if end[a] != mid or end[b] != stop:
                continue
            if limit:
                span = (begin[a] * 0xD6E8FEB86659FD93 + stop * 0xA0761D6478BD642F + mid * 0xE7037ED1A0B428DB) & MASK
                h = (key + span) & MASK
                h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & MASK
                skipped = (h ^ (h >> 32)) & 0xFFFFFFFF < limit
                if trace is not None:
                    trace.append(((begin[a] * 32 + mid) * 32 + stop, skipped))
                if skipped:
                    continue
            end[a], end[b], right[a] = end[b], 0, right[b]
            if right[a] >= 0:
                left[right[a]] = a
            propose(left[a], a)
            propose(a, right[a])
        out: list[int] = []
        i = 0 if n else -1
        while i >= 0:
            piece = unit[begin[i] : end[i]]
            out.extend([self.id[piece]] if piece in self.id else self._bytes(piece))
            i = right[i]
        return out

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, or -1."""
        out = np.full(a.shape, -1, np.int64)
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        pair = a.ravel()[todo] * self.size + b.ravel()[todo]
        at = self._slot(pair)
        for _ in range(self.probes):
            there = self.pairs[at]
            hit = there == pair
            out.ravel()[todo[hit]] = self.makes[at[hit]]
            on = ~hit & (there >= 0)
            todo, pair, at = todo[on], pair[on], at[on] + 1
            if not len(todo):
                break
        return out

    def segment_all(self, units: list[str], variants: list[int]) -> list[list[int]]:
        ids, lens, *_ = self._segment_all(units, np.array([self._key(u, v) for u, v in zip(units, variants, strict=True)], np.uint64))
        ends = np.cumsum(lens).tolist()
        return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _segment_all(self, units: list[str], keys: np.ndarray) -> tuple:
        """Ids of many units, one unit after another, and each unit's number of ids; spans and skips of the candidates that
        came up, and each unit's number of these (left out for units over WIDE characters, which have no tree). The agendas
        of units of up to WIDE known characters advance side by side, a candidate each."""
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        syms = self.of_char[chars]
        starts = np.cumsum(lens) - lens
        known = np.minimum.reduceat(syms, starts) >= 0 if len(units) else np.zeros(0, bool)
        rows = np.flatnonzero(known & (lens <= WIDE))
        found: list[tuple] = []
        alone = np.flatnonzero(~known | (lens > WIDE))
        if len(alone):
            runs, traces = [], []
            for i in alone.tolist():
                traces.append([])
                runs.append(self._segment(units[i], int(keys[i]), traces[-1] if lens[i] <= WIDE else None))
            rest = [x for t in traces for x in t]
            found.append((alone, np.array([x for r in runs for x in r], np.int64), np.array([len(r) for r in runs], np.int64),
                          np.array([x for x, _ in rest], np.int64), np.array([x for _, x in rest], bool), np.array([len(t) for t in traces], np.int64)))
        rows = rows[np.argsort(lens[rows], kind="stable")]
        for k in range(0, len(rows), BLOCK):
            part = rows[k : k + BLOCK]
            found.append((part, *self._side_by_side(keys[part], syms, starts[part], lens[part])))
        if not found:
            return (np.zeros(0, np.int64),) * 5
        who, ids, n, spans, skipped, steps = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(who, kind="stable")
        ids = ids[gather((np.cumsum(n) - n)[order], n[order])]
        at = gather((np.cumsum(steps) - steps)[order], steps[order])
        return ids, n[order], spans[at], skipped[at], steps[order]

    def _side_by_side(self, key, syms, starts, lens) -> tuple:
        u, w, steps = len(lens), int(lens.max()), []
        cols = np.arange(w)
        sym = np.where(cols < lens[:, None], syms[np.minimum(starts[:, None] + cols, len(syms) - 1)], -1)
        begin = np.broadcast_to(cols, (u, w))
        end, nxt, prv = begin + 1, begin + 1, begin - 1
        end, nxt, prv = end.copy(), nxt.copy(), prv.copy()
        made = np.full((u, w), -1, np.int64)
        if w > 1:
            made[:, :-1] = self._join(sym[:, :-1], sym[:, 1:])
        score = np.where(made >= 0, self.rank[made], -np.inf)

        def propose(r, a, b) -> None:
            """Candidate of symbol a and its right neighbour b in the rows r; b may be past the end."""
            ok = b < lens[r]
            bb = np.where(ok, b, 0)
            m = np.where(ok, self._join(sym[r, a], sym[r, bb]), -1)
            made[r, a], score[r, a] = m, np.where(m >= 0, self.rank[m], -np.inf)

        live = np.arange(u)
        while len(live):
            a = score[live].argmax(1)
            go = score[live, a] > -np.inf
            live, a = live[go], a[go]
            if not len(live):
                break
            r, b = live, nxt[live, a]
            if self.limit:
                span = (a * 32 + end[r, a]) * 32 + end[r, b]
                skipped = self._skips(key[r] + self.salts[span])
                steps.append((r, span, skipped))
                score[r[skipped], a[skipped]] = -np.inf
                r, a, b = r[~skipped], a[~skipped], b[~skipped]
            sym[r, a], end[r, a] = made[r, a], end[r, b]
            sym[r, b], score[r, b] = -1, -np.inf
            c = nxt[r, b]
            nxt[r, a] = c
            inner = c < lens[r]
            prv[r[inner], c[inner]] = a[inner]
            propose(r, a, c)
            p = prv[r, a]
            has = p >= 0
            propose(r[has], p[has], a[has])
        if not steps:
            return sym[sym >= 0], (sym >= 0).sum(1), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(u, np.int64)
        rows, spans, skips = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(rows, kind="stable")
        return sym[sym >= 0], (sym >= 0).sum(1), spans[order], skips[order], np.bincount(rows, minlength=u)

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if BLANK in text:  # a literal U+2581: its bytes, so that it does not come back as a blank
            parts = (BLANK + text.replace(BLANK, "\0\0").replace(" ", BLANK)).split("\0\0")
            return [u for i, p in enumerate(parts) for u in ([MARK] if i else []) + self.units.findall(p)]
        return self.units.findall(BLANK + text.replace(" ", BLANK))

    def _nodes(self, n: int) -> int:
        """Room for n further nodes; the number of the first."""
        first, self.n_nodes = self.n_nodes, self.n_nodes + n
        while self.n_nodes > len(self.span):
            self.span, self.child = np.concatenate([self.span, np.zeros_like(self.span)]), np.concatenate([self.child, np.full_like(self.child, -1)])
        return first

    def _codes(self, flat: list[str]) -> np.ndarray:
        """A number for each unit; new units get a root."""
        coded = pa.array(flat, pa.string()).dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = np.fromiter(map(self.code.get, units, repeat(-1)), np.int64, len(units))
        if len(miss := np.flatnonzero(codes < 0)):
            new, first = [units[i] for i in miss.tolist()], len(self.code)
            codes[miss] = np.arange(first, first + len(new))
            self.code.update(zip(new, range(first, first + len(new)), strict=True))
            while len(self.code) > len(self.root):
                self.root, self.unit_key, self.long = (np.concatenate([x, np.zeros_like(x)]) for x in (self.root, self.unit_key, self.long))
            at = slice(first, first + len(new))
            self.root[at] = self._nodes(len(new)) + np.arange(len(new))
            self.unit_key[at] = [zlib.crc32(u.encode(), self.seed) << 20 for u in new]
            self.long[at] = [bool(self.limit) and len(u) > WIDE for u in new]
        return codes[coded.indices.to_numpy()]

    def _runs(self, flat: list[str], codes: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The run of each occurrence: it walks its unit's tree as far as that is known, then the tree is extended."""
        key = self.unit_key[codes] ^ ((draw + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        slot, depth, out = 2 * self.root[codes], np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int64)
        if len(long := np.flatnonzero(self.long[codes])):
            ids, lens, *_ = self._segment_all([flat[i] for i in long.tolist()], key[long])
            out[long] = self.table.add_flat(ids, lens) + np.arange(len(long))
        todo = np.flatnonzero(out < 0)
        while len(todo):
            to = self.child[slot[todo]]
            live = np.flatnonzero(to >= 0)
            while len(live):
                node, i = to[live], todo[live]
                slot[i] = 2 * node.astype(np.int64) + self._skips(key[i] + self.salts[self.span[node]])
                depth[i] += 1
                to[live] = self.child[slot[i]]
                live = live[to[live] >= 0]
            out[todo] = -2 - to
            todo = todo[to == -1]
            if len(todo):
                ends, first = np.unique(slot[todo], return_index=True)
                self._extend([flat[i] for i in todo[first].tolist()], key[todo[first]], ends, depth[todo[first]])
        return out

    def _extend(self, units: list[str], keys: np.ndarray, ends: np.ndarray, depth: np.ndarray) -> None:
        """Adds the paths of occurrences of units, each of which left its tree at another end, so deep."""
        ids, lens, spans, skipped, steps = self._segment_all(units, keys)
        leaf = -2 - (self.table.add_flat(ids, lens) + np.arange(len(units)))
        lens = steps - depth
        rest = gather(np.cumsum(steps) - lens, lens)
        node = self._nodes(len(rest)) + np.arange(len(rest))
        stop = np.cumsum(lens)
        some = lens > 0
        self.child[ends] = leaf
        if len(rest):
            self.child[ends[some]] = node[(stop - lens)[some]]
            self.span[node] = spans[rest]
            to = node + 1
            to[stop[some] - 1] = leaf[some]
            self.child[2 * node + skipped[rest]] = to

    def encode(self, doc_ids: list, texts: list[str | None], copies: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's number of ids. Copies of a document are drawn apart by their numbers."""
        if max(self.table.n, self.n_nodes // 5, self.table.used // 16) > self.table.most:
            self._clear()
        flat, sizes = [], []
        for t in texts:
            units = self._split(t)
            sizes.append(len(units))
            flat.extend(units)
        counts = np.array(sizes, np.int64)
        codes = self._codes(flat)
        keys = np.array([hash_key(d) for d in doc_ids], np.uint64)
        if copies is not None:
            keys += np.array([hash_key(c) for c in copies], np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        place = gather(np.zeros(len(counts), np.int64), counts).astype(np.uint64)
        draw = _mixed(np.repeat(_mixed(keys + np.uint64(self.seed)), counts) + place * np.uint64(0x9E3779B97F4A7C15)) if len(flat) else place
        ids, lens = self.table.expand(self._runs(flat, codes, draw))
        sums = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(sums[np.cumsum(counts)], prepend=0) if len(counts) else counts

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        raw = self.raw[gather(self.raw_starts[ids], self.raw_lens[ids])].tobytes()
        sums = np.concatenate([[0], np.cumsum(self.raw_lens[ids])])
        ends = sums[np.cumsum(lens)].tolist()
        return [raw[a + 1 if b > a and raw[a] == 32 else a : b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def hash_key(doc_id) -> int:
    return 0x5851F42D4C957F2D if doc_id is None else doc_id & MASK


def encode_pieces(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 7, with_ids: bool = True,
                  id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), lossless
    (whether decoding the ids gave the text), and the ids where asked for. Rows of one document that differ in copy_col are drawn apart. Nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        c = MergeDropout(model, rate, seed)  # a task's own: a worker that goes on to other stages doesn't keep it
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, len(whole), ROWS)):
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids, lens = c.encode(doc_ids, texts, b.column(2).to_pylist() if copy_col else None)
            same = [x == (t or "") for x, t in zip(c.decode(ids, lens), texts, strict=True)]
            ends = np.cumsum(lens)
            raw, cut = ids.astype("<u4").tobytes(), list(zip((ends - lens).tolist(), ends.tolist(), strict=True))
            columns = [b.column(0), pa.array(lens, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * e]) for a, e in cut], pa.int64()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "lossless"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(copy_col).cast("long").alias("copy")] if copy_col else []))
    return rows.mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids)
