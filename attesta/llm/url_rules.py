"""URL filters by a sort-merge range join over reversed-host keys.

A host's labels, reversed and each ended by U+0000, make its key, so a rule host and all its subdomains are one
interval of keys. Rules and urls are swept in key order; a stack holds the rules whose interval is open, nested
from the shortest host to the longest. Of the open rules whose path starts the url's path the longest (host and
path together, then host) wins.

Up to `local_rules` rules (checked) each task sorts its own urls and sweeps them with the whole rule list: nothing is
shuffled. Beyond, urls and rules are dealt by key ranges; a rule goes to each range that its interval meets, and a
key that fills several ranges (a hot host) is dealt over them at random.

Edge cases: a null url or one without `://` has host and path empty and fits no rule; then the verdict is
`default`. An empty path fits no rule with a path. Repeated rows are judged alike.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, UPPER


class Rule(NamedTuple):
    action: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_key(host: str) -> str:
    return "".join(f"{x}\0" for x in reversed(host.split(".")))


class Node:
    """All rules of one host."""

    def __init__(self, key: str, rules: Iterable[Rule]):
        self.key = key
        self.by_path = {r.path: r for r in rules}
        self.lengths = sorted({len(p) for p in self.by_path}, reverse=True)

    def fit(self, path: str) -> Rule | None:
        return next((self.by_path[path[:n]] for n in self.lengths if path[:n] in self.by_path), None)


def nodes_of(rules: Iterable[Rule]) -> list[Node]:
    by_key: dict[str, list[Rule]] = {}
    for r in rules:
        by_key.setdefault(host_key(r.host), []).append(r)
    return [Node(k, by_key[k]) for k in sorted(by_key)]


class Sweep:
    """Merges sorted nodes with sorted keys; the stack holds the open nodes, outermost first."""

    def __init__(self, nodes: Iterable[Node], opened: Iterable[Node] = ()):
        self.coming, self.stack = iter(nodes), list(opened)
        self.next = next(self.coming, None)

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def open_at(self, key: str) -> list[Node]:
        while self.next is not None and self.next.key <= key:
            self._close(self.next.key)
            self.stack.append(self.next)
            self.next = next(self.coming, None)
        self._close(key)
        return self.stack


def winner(stack: list[Node], host: str, path: str) -> Rule | None:
    fits = [r for n in stack if (r := n.fit(path)) and (host == r.host or host.endswith(f".{r.host}"))]
    return max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)


def _judge(rows: Iterable[tuple[str, str, str]], sweep: Sweep, default: str) -> Iterator[tuple[str | None, str]]:
    for key, host, path in rows:
        r = winner(sweep.open_at(key), host, path)
        yield (r.host + r.path, r.action) if r else (None, default)


def _local(nodes: list[Node], default: str):
    keys, at = [n.key for n in nodes], {n.key: n for n in nodes}

    def opened(first: str) -> list[Node]:
        ends = [i + 1 for i, c in enumerate(first) if c == "\0"]
        return [at[first[:e]] for e in ends if first[:e] in at and first[:e] < first]

    def run(batches):
        for b in batches:
            host, path = (b.column(c).to_pylist() for c in ("host", "path"))
            key = [host_key(h) for h in host]
            order = sorted(range(len(key)), key=key.__getitem__)
            out: list = [None] * len(key)
            if order:
                first = key[order[0]]
                sweep = Sweep(nodes[bisect_left(keys, first):], opened(first))
                for i, x in zip(order, _judge(((key[i], host[i], path[i]) for i in order), sweep, default), strict=True):
                    out[i] = x
            rule, verdict = pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[*b.schema.names, "rule", "verdict"])

    return run


def _ranges(urls: DataFrame, nodes: list[Node], default: str, ranges: int, sample: int):
    """Urls and rules dealt by key ranges and swept partition by partition."""
    spark, out = urls.sparkSession, f"{urls.schema.simpleString()[7:-1]},rule:string,verdict:string"
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "\0"), F.lit("\0"))
    keyed = urls.withColumn("k", key)
    some = sorted(r.k for r in keyed.select("k").where(F.col("k").isNotNull()).orderBy(F.xxhash64("k", "host", "path")).limit(sample).collect())
    bounds = [some[i * len(some) // ranges] for i in range(1, ranges)] if some else []

    def deal(batches):
        for p in batches:
            lo, hi = [bisect_left(bounds, k) for k in p.k], [bisect_right(bounds, k) for k in p.k]
            p["pid"] = [a + i % (b - a + 1) for i, (a, b) in enumerate(zip(lo, hi, strict=True))]  # equal bounds: a hot key
            yield p

    cols = urls.columns
    dealt = keyed.mapInPandas(deal, f"{keyed.schema.simpleString()[7:-1]},pid:int").withColumn("is_url", F.lit(1)).withColumn("rules", F.lit(None).cast("array<struct<action:string,host:string,path:string>>"))
    rows = [(p, n.key, 0, [tuple(r) for r in n.by_path.values()]) for n in nodes for p in range(bisect_left(bounds, n.key), bisect_left(bounds, n.key[:-1] + "\1") + 1)]
    side = spark.createDataFrame(rows, "pid int, k string, is_url int, rules array<struct<action:string,host:string,path:string>>")
    both = dealt.unionByName(side, allowMissingColumns=True).repartition(ranges, "pid").sortWithinPartitions("pid", "k", "is_url")

    def sweep(batches):
        stack: list[Node] = []
        for p in batches:
            found = []
            for row in p.itertuples(index=False):
                while stack and not row.k.startswith(stack[-1].key):
                    stack.pop()
                if not row.is_url:
                    stack.append(Node(row.k, [Rule(*r.values()) if isinstance(r, dict) else Rule(*r) for r in row.rules]))
                else:
                    r = winner(stack, row.host, row.path)
                    found.append((r.host + r.path, r.action) if r else (None, default))
            q = p.loc[p.is_url == 1, cols].copy()
            q["rule"], q["verdict"] = [x[0] for x in found], [x[1] for x in found]
            yield q

    return both.mapInPandas(sweep, out)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow",
                local_rules: int = 100_000, ranges: int = 32, sample: int = 20_000) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict. See the module for the method."""
    nodes = nodes_of(rules)
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url_host(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(url_path(F.col(url_col)), F.lit("")).alias("path"))
    if len(rules) > local_rules:
        return _ranges(urls, nodes, default, ranges, sample)
    return urls.mapInArrow(_local(nodes, default), f"{urls.schema.simpleString()[7:-1]},rule:string,verdict:string")
