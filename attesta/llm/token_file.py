"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are dealt by ranges of doc_id and sorted, encoded, and cut into shards at document ends. In each shard
frequent pairs of adjacent symbols are repeatedly replaced by new symbols (nonterminals); a pair never crosses a
document's end, so each document is a slice of the compressed sequence. A shard stores the rules, the length that
each rule expands to, and for each document its slice and token count, so one document, or any range of its tokens,
is decoded without the rest.

Replacing goes on until no pair occurs `least` times in the shard or its symbols of 16 bits (of 32, where the vocabulary
itself is wider) are used up.

A task writes each shard under a name of its own and reports it; the report (manifest) is saved once. Reading
trusts only files that the manifest names, so retried or lost tasks leave no trace in the result.

Edge cases: a null text counts as empty and yields the end id alone; null doc_ids come first; repeated doc_ids keep
all their rows; a document longer than a shard makes a longer shard; an empty table has no shards and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import saved, shared_dir, small_batches, tidy
from attesta.llm.tokens import RunTable, gather

MAGIC = b"RPS1"
SLOT_BITS = 18
SYMBOLS_16 = 1 << 16


def repair(ids: np.ndarray, doc_lens: np.ndarray, first_new: int, least: int = 8, share: int = 16):
    """(sequence, rules of two symbols each, expansion length of each rule, length of each document's slice).

    In turns: all pairs are counted exactly, by sorting, and those of the highest counts (down to a `share` of the
    highest) replaced, until no pair occurs `least` times or the symbols that fit the file's width are used up. Once the
    threshold is down at `least`, a turn looks at the pairs with symbols of the turn before alone; before the end all
    pairs are counted once more."""
    narrow = first_new < SYMBOLS_16
    kind, half = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    seq, lens = ids.astype(kind), doc_lens.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(lens)[lens > 0] - 1] = True
    room = SYMBOLS_16 - first_new if narrow else 1 << 20
    rules: list[np.ndarray] = []
    n_rules, since = 0, None  # the first symbol of the turn before, where only its pairs are looked at
    held, made = np.zeros(1 << SLOT_BITS, kind), np.zeros(1 << SLOT_BITS, kind)

    def slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs * kind(0x9E3779B1)) >> kind(8 * kind().itemsize - SLOT_BITS)).astype(np.intp) if narrow else ((pairs * kind(0x9E3779B97F4A7C15)) >> kind(64 - SLOT_BITS)).astype(np.intp)

    while len(seq) > 1 and n_rules < room:
        fresh = True if since is None else (seq[:-1] >= since) | (seq[1:] >= since)
        at = np.flatnonzero(~last[:-1] & fresh)  # no pair crosses a document's end
        pair = (seq[at] << half) | seq[at + 1]
        keys = np.sort(pair)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        count = np.diff(edge, append=len(keys))
        top = int(count.max()) if len(count) else 0
        if top < least:
            if since is None:
                break
            since = None
            continue
        cut = least if since is not None else max(least, top // share)
        some = np.flatnonzero(count >= cut)
        some = some[np.argsort(-count[some], kind="stable")[: room - n_rules]]
        keys = keys[edge[some]]
        # of pairs in one slot the most frequent; the others wait for a later turn
        own = np.sort(np.unique(slot(keys), return_index=True)[1])
        keys = keys[own]
        held[:], made[:] = 0, 0
        held[slot(keys)], made[slot(keys)] = keys, first_new + n_rules + np.arange(len(keys))
        rules.append(np.stack([keys >> half, keys & kind((1 << int(half)) - 1)], 1).astype(np.int64))
        since = first_new + n_rules if cut == least else None
        n_rules += len(keys)
        where = slot(pair)
        hit = (held[where] == pair) & (made[where] > 0)
        at, new = at[hit], made[where[hit]]
        # of overlapping pairs every second one of each run is replaced
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0
        at, new = at[odd], new[odd]
        seq[at] = new
        last[at] |= last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    size = np.ones(first_new + len(table), np.int64)
    done = 0
    for r in rules:  # a turn's rules use symbols of earlier turns only
        size[first_new + done : first_new + done + len(r)] = size[r].sum(1)
        done += len(r)
    ends = np.flatnonzero(last)
    slices = np.zeros(len(lens), np.int64)
    slices[lens > 0] = np.diff(ends, prepend=-1)
    return seq, table, size[first_new:], slices


def expand(seq: np.ndarray, rules: np.ndarray, first_new: int) -> np.ndarray:
    """Replaces nonterminals by their rules until none is left."""
    seq = seq.astype(np.int64)
    while len(at := np.flatnonzero(seq >= first_new)):
        grow = np.ones(len(seq), np.int64)
        grow[at] = 2
        out = np.repeat(seq, grow)
        first = at + np.arange(len(at))
        out[first], out[first + 1] = rules[seq[at] - first_new].T
        seq = out
    return seq


def pack_shard(doc_ids: list, doc_lens: np.ndarray, ids: np.ndarray, vocab: int, **how) -> bytes:
    seq, rules, size, slices = repair(ids, doc_lens, vocab, **how)
    wide = np.uint16 if vocab + len(rules) <= SYMBOLS_16 else np.uint32
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<4sIIQQQ", MAGIC, np.dtype(wide).itemsize, vocab, len(doc_ids), len(rules), len(seq))
    body = (np.array([d or 0 for d in doc_ids], "<i8"), known, doc_lens.astype("<u4"), slices.astype("<u4"), rules.astype("<u4"), size.astype("<u4"), seq.astype(np.dtype(wide).newbyteorder("<")))
    return head + b"".join(x.tobytes() for x in body)


class Shard:
    """A packed shard; `tokens(i)` and `tokens(i, a, b)` read one document or a range of its tokens."""

    def __init__(self, data: bytes):
        magic, wide, self.vocab, docs, rules, symbols = struct.unpack_from("<4sIIQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sIIQQQ")
        parts = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", docs), ("<u4", 2 * rules), ("<u4", rules), (f"<u{wide}", symbols)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        ids, known, self.lens, self.slices, flat, self.sizes, self.seq = parts
        self.rules = flat.reshape(-1, 2).astype(np.int64)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.begins = np.concatenate([[0], np.cumsum(self.slices, dtype=np.int64)])

    def tokens(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        seq = self.seq[self.begins[doc] : self.begins[doc + 1]].astype(np.int64)
        stop = int(self.lens[doc]) if stop is None else min(stop, int(self.lens[doc]))
        grow = np.ones(len(seq), np.int64)
        new = seq >= self.vocab
        grow[new] = self.sizes[seq[new] - self.vocab]
        ends = np.cumsum(grow)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return expand(seq[a:b], self.rules, self.vocab)[skip : skip + max(0, stop - start)]

    def all_tokens(self) -> np.ndarray:
        """Every rule is expanded once; then the sequence is read off in one pass."""
        flat = np.concatenate([np.arange(self.vocab), expand(self.rules.ravel(), self.rules, self.vocab)])
        lens = np.concatenate([np.ones(self.vocab, np.int64), self.sizes.astype(np.int64)])
        starts = np.cumsum(lens) - lens
        return flat[gather(starts[self.seq], lens[self.seq])]


class WordEncoder:
    """Encodes whole texts with a tokenizer of the tokenizers library.

    Where the tokenizer's normaliser and pre-tokenizer are of the form known to end every token at white space, a
    text's ids are the ids of its blank-separated chunks one after another, and only a batch's different chunks are
    encoded. A chunk of Latin letters with or without ASCII marks after it is one word and one run of marks to that
    pre-tokenizer: the word's lower-case bytes go straight to the library's model; marks, and any other chunk, pass
    through the library's whole encoder.
    Any other tokenizer gets whole texts.
    """

    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    #: The form whose tokens end at white space.
    NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.table = Tokenizer.from_file(path), RunTable(most)
        self.vocab, self.by_chunk = self.tok.get_vocab_size(), self._ends_at_blanks()
        if not self.by_chunk:
            return
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        folds = lambda c: len(c.lower()) == 1 and self.tok.normalizer.normalize_str(c) == c.lower() == pc.utf8_lower(c).as_py()
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and folds(c)]
        #: Lower-case letters below U+0250 whose NFC and lower-case forms are themselves, as the model sees them.
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters if c.lower() == c}
        self.latin = "".join(c for c in letters if ord(c.lower()) in self.letters)
        self.simple = f"^[{self.latin}]+[!-/:-@\\[-`{{-~]*$"
        self._clear()

    def _ends_at_blanks(self) -> bool:
        how = json.loads(self.tok.to_str())
        parts = how["normalizer"]["normalizers"] if (how["normalizer"] or {}).get("type") == "Sequence" else [how["normalizer"]]
        split = {"type": "Split", "pattern": {"Regex": self.SPLIT}, "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        return (
            all(p in self.NORMALIZERS for p in parts) and how["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, level]}
            and how["post_processor"] is None and how["truncation"] is None and how["padding"] is None
            and not any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in how["added_tokens"])
        )

    def _clear(self) -> None:
        self.table.clear()
        self.code: dict = {}  # words, and marks and other chunks behind a zero

    def _numbers(self, distinct: pa.Array, runs, sign: str = "") -> np.ndarray:
        """The runs' numbers of distinct strings; runs(strings) gives the ids of new ones."""
        flat = distinct.to_numpy(zero_copy_only=False).tolist()
        if sign:
            flat = [sign + x for x in flat]
        codes = np.fromiter(map(self.code.get, flat, repeat(-1)), np.int64, len(flat))
        if len(miss := np.flatnonzero(codes < 0)):
            new = [flat[i] for i in miss.tolist()]
            first = self.table.add(runs(new))
            codes[miss] = first + np.arange(len(new))
            self.code.update(zip(new, range(first, first + len(new)), strict=True))
        return codes

    def _words(self, words: list[str]) -> list[list[int]]:
        model, letters = self.tok.model.tokenize, self.letters
        return [[t.id for t in model(w.translate(letters))] for w in words]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _others(self, signed: list[str]) -> list[list[int]]:
        return self._whole([x[1:] for x in signed])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            runs = self._whole(texts.to_pylist())
            return np.array(list(chain.from_iterable(runs)), np.int32), np.array([len(r) for r in runs], np.int64)
        if self.table.n > self.table.most:
            self._clear()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks, counts = coded.dictionary, np.diff(split.offsets.to_numpy()).astype(np.int64)
        simple = pc.match_substring_regex(chunks, self.simple)
        plain = simple.to_numpy(zero_copy_only=False)
        word, mark = np.zeros(len(chunks), np.int64), np.full(len(chunks), self._numbers(pa.array([""]), self._others, "\0")[0])
        easy = chunks.filter(simple)
        low, ends = pc.utf8_lower(pc.utf8_rtrim(easy, self.MARKS)).dictionary_encode(), pc.utf8_ltrim(easy, self.latin).dictionary_encode()
        word[plain] = self._numbers(low.dictionary, self._words)[low.indices.to_numpy()]
        mark[plain] = self._numbers(ends.dictionary, self._others, "\0")[ends.indices.to_numpy()]
        word[~plain] = self._numbers(chunks.filter(pc.invert(simple)), self._others, "\0")
        at = coded.indices.to_numpy()
        ids, lens = self.table.expand(np.stack([word[at], mark[at]], 1).ravel())
        sums = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(sums[2 * np.cumsum(counts)], prepend=0) if len(counts) else counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    out, stops = np.empty(len(ids) + len(lens), ids.dtype), np.cumsum(lens + 1) - 1
    inner = np.ones(len(out), bool)
    inner[stops] = False
    out[stops], out[inner] = end, ids
    return out, lens + 1


MANIFEST = "part int, shard int, file string, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, tokenizer: str, to: str, end: int = 2, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of `docs` below the folder `to`; returns the saved manifest, a row per shard."""
    spark = docs.sparkSession
    small_batches(spark, 1500)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(to)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def shards(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(to)
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        held: list = []

        def cut(number: int) -> pa.RecordBatch:
            doc_ids = [d for h in held for d in h[0]]
            lens, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            data, name = pack_shard(doc_ids, lens, ids, enc.vocab), f"{uuid.uuid4().hex}.rps"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            held.clear()
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "file": name, "n_docs": len(doc_ids), "n_tokens": len(ids), "n_bytes": len(data)}], _schema())

        number, size = 0, 0
        for b in batches:
            ids, lens = with_end(*enc.encode(b.column(1)), end)
            held.append((b.column(0).to_pylist(), lens, ids))
            size += len(ids)
            if size >= shard_tokens:
                yield cut(number)
                number, size = number + 1, 0
        if held:
            yield cut(number)

    def _schema() -> pa.Schema:
        return pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return saved(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(tidy(shards), MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, to: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids themselves (little-endian unsigned 32 bits) of every document."""
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard meets here
    named = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long")).select("file", "base")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rps").load(to).select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content")

    def documents(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(content.as_py())
                ids, ends = s.all_tokens().astype("<u4"), np.cumsum(s.lens, dtype=np.int64)
                raw = ids.tobytes()
                cuts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), s.lens.tolist(), strict=True)]
                columns = [pa.array(s.doc_ids, pa.int64()), pa.array(base + ends - s.lens, pa.int64()), pa.array(s.lens.astype(np.int64)), pa.array(map(zlib.crc32, cuts), pa.int64()), pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.join(named, "file").select("base", "content").mapInArrow(tidy(documents), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Writes `docs` as shards, reads them back: doc_id, start, n_tokens, ids_crc32 of every document."""
    spark = docs.sparkSession
    to = shared_dir(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, tokenizer, to, **how), to).select("doc_id", "start", "n_tokens", "ids_crc32")
