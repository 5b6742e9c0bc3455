"""License scans by patience alignment.

A template and a stretch of text are aligned on anchors, words that occur exactly once in both: the longest
increasing subsequence of their positions is kept, and the gaps between kept anchors are aligned in the same way,
where fewer words stand between and more of them are unique. A gap without anchors matches its equal words at both
ends. Coverage is the share of the template's words that are aligned.

Every whole text is scanned, for short notices, headers of files and whole short licenses (license_texts; callers may give
templates of their own). Compact stretches are found first: an alignment of coverage c shares at least c of the
template's words (with their counts), so windows of twice the template's length, a template's length apart, that share
fewer are left out without loss for matches of up to one template's length. What they leave of the text is then aligned
whole, so a notice is also found however many words were inserted into it, if at least half of its aligned words
still stand beside the word that follows them in the template (which words strewn over a long text don't).

Edge cases: null and empty texts match nothing, very long texts are scanned to their end; a license that occurs several
times in a text gives one row, of its best stretch (ties: the first), with all its disjoint stretches in text order as a
list; licenses that share words may each be found in one place; repeated rows are scanned alike; columns of other names
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import small_batches, tidy
from attesta.llm.license_texts import TEMPLATES

_WORD = re.compile(r"\w+(?:\.\w+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose second numbers increase."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(ends, y)
        before.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [y], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both; a is the template."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((a0 + i, b0 + k))
            i, k = i + 1, k + 1
        tail = []
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            tail.append((a0 + j, b0 + m))
        out.extend(tail)
        if i >= j or k >= m:
            continue
        one, two = Counter(a[i:j]), Counter(b[k:m])
        where = {w: k + x for x, w in enumerate(b[k:m]) if two[w] == 1}
        kept = increasing([(x, where[a[x]]) for x in range(i, j) if one[a[x]] == 1 and a[x] in where])
        if not kept:
            continue
        out.extend((a0 + x, b0 + y) for x, y in kept)
        edges = [(i - 1, k - 1), *kept, (j, m)]
        todo.extend((p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = {name: words_of(t) for name, t in templates.items()}
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        #: The places of words that a template has once.
        self.once = {name: {w: i for i, w in enumerate(t) if self.counts[name][w] == 1} for name, t in self.templates.items()}
        self.all = {w for t in self.templates.values() for w in t}

    def _stretch(self, name: str, words: list[str], low: int, high: int, apart: bool) -> tuple | None:
        """(coverage, first, last, aligned) of a template in words[low:high], if it reaches the least coverage; where a
        match may be spread far apart, half of its words must stand beside their followers."""
        template, need = self.templates[name], self.counts[name]
        n, part = len(template), words[low:high]
        if sum((Counter(part) & need).values()) < self.least * n:
            return None
        pairs = align(template, part, b0=low)
        if not pairs or len(pairs) < self.least * n:
            return None
        if apart and 2 * sum(a + 1 == c and b + 1 == d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False)) < len(pairs) - 1:
            return None
        return len(pairs) / n, pairs[0][1], pairs[-1][1], len(pairs)

    def scan(self, text: str | None) -> Iterator[tuple[str, float, int, int, int, list]]:
        """(license, coverage, first word, last word, words aligned, stretches in text order) of each license that reaches the least coverage."""
        if not text:
            return
        words = words_of(text)
        have = self.all.intersection(words)
        for name, template in self.templates.items():
            need, n = self.counts[name], len(template)
            if not n or sum(c for w, c in need.items() if w in have) < self.least * n:
                continue
            found = []
            hits = [i for i, w in enumerate(words) if w in need]
            windows = {(start * n, min(start * n + 2 * n, len(words))) for i in hits for start in (i // n, max(0, i // n - 1))}
            # copies side by side leave no word of a wide window unique: narrow ones, where words point to one beginning
            slack = n // 8 + 1
            begins: dict[int, Counter] = {}
            for i in hits:
                if (at := self.once[name].get(words[i])) is not None:
                    begins.setdefault((i - at) // slack, Counter())[i - at] += 1
            for k, v in begins.items():
                if 4 * v.total() >= len(self.once[name]):
                    first = max(0, v.most_common(1)[0][0])
                    windows |= {(max(0, (k - 1) * slack), min((k + 2) * slack + n, len(words))), (first, min(first + n, len(words)))}
            for window in sorted(windows):
                todo = [window]
                while todo:  # what a stretch leaves of its window on both sides may hold another
                    low, high = todo.pop()
                    if x := self._stretch(name, words, low, high, False):
                        found.append(x)
                        todo += [(low, x[1]), (x[2] + 1, high)]
            apart: list = []
            for x in sorted(set(found), key=lambda x: (x[2] - x[1] - 2 * x[3], x[1], x[2])):  # many words, close together
                at = bisect_left(apart, x[1], key=lambda y: y[1])
                if (at == 0 or apart[at - 1][2] < x[1]) and (at == len(apart) or x[2] < apart[at][1]):
                    apart.insert(at, x)
            # matches with more inserted words than a window holds, between the others
            edges = [-1, *(e for x in apart for e in (x[1], x[2])), len(words)]
            todo = [(a + 1, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a - 1 > n]
            while todo:
                low, high = todo.pop()
                if x := self._stretch(name, words, low, high, True):
                    apart.append(x)
                    todo += [(low, x[1]), (x[2] + 1, high)]
            if apart:
                yield (name, *min(apart, key=lambda x: (-x[3], x[1])), sorted(apart, key=lambda x: x[1]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and license found: doc_id, license, coverage, first_word, last_word, aligned of the best stretch, and all stretches. Nothing is shuffled."""
    small_batches(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, least)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in scanner.scan(t)]
            four = [("coverage", pa.float64()), *((c, pa.int64()) for c in ("first_word", "last_word", "aligned"))]
            kinds = (pa.int64(), pa.string(), *(k for _, k in four), pa.list_(pa.struct(four)))
            rows = [(*r[:6], [dict(zip((c for c, _ in four), x, strict=True)) for x in r[6]]) for r in rows]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "license", "coverage", "first_word", "last_word", "aligned", "stretches"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, license string, coverage double, first_word long, last_word long, aligned long, "
                           "stretches array<struct<coverage: double, first_word: long, last_word: long, aligned: long>>")
