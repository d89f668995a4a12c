"""URL filter: allow and block rules in a trie of host labels and path segments.

A rule has a host and a path. It fits its host and every subdomain when the
URL's path starts with the rule's path; the longest rule wins (more host
labels, then the longer path; block before allow at a tie). Host labels are
stored in reverse, then the path's whole segments, then the rest of the path,
which need not end at a segment. The trie is broadcast: rules are a list that
the caller holds in memory, at most MAX_RULES; ``filter_by_join`` takes rules
of any number as a table.

Defined results: a URL that is null or without ``://`` has an empty host and
path and takes the default verdict; a URL without a path fits no rule, since
every rule's path starts with ``/``; repeated rows are judged one by one; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

MAX_RULES = 1_000_000
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(slots=True)
class Node:
    """A host label or a path segment."""

    hosts: dict[str, Node] = field(default_factory=dict)
    paths: dict[str, Node] = field(default_factory=dict)
    #: Rests of paths that end below this node -> (verdict, rule)
    rests: dict[str, tuple[str, str]] = field(default_factory=dict)


class RuleTrie:
    """rules: (verdict, host, path) with verdict ``allow`` or ``block``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = Node()
        for count, (verdict, host, path) in enumerate(rules, 1):
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules: use filter_by_join")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.hosts.setdefault(label, Node())
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.paths.setdefault(segment, Node())
            if node.rests.get(rest, ("allow",))[0] != "block":
                node.rests[rest] = verdict, host + path

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest rule that fits."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.hosts.get(label)
            if node is None:
                break
            best = self.below(node, path) or best
        return best

    @staticmethod
    def below(node: Node, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while node is not None:
            tail = path[at:]
            for size in sorted({len(r) for r in node.rests}):
                best = node.rests.get(tail[:size], best) if size <= len(tail) else best
            end = path.find("/", at)
            if end < 0:
                break
            node, at = node.paths.get(path[at:end]), end + 1
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].translate(UPPER_TO_LOWER), tail[:stop]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Return (id_col, host, path, rule, verdict), a row for each row."""
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.match(*p) or (default, None) for p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [r for _, r in found], [v for v, _ in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def filter_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """As ``filter_urls``, with rules (verdict, host, path) in a table of any size.

    Each distinct (host, path) meets the rules of its own host suffixes only.
    """
    rest = F.expr(f"CASE WHEN locate('://', `{url_col}`) > 0 THEN substring(`{url_col}`, locate('://', `{url_col}`) + 3) END")
    parts = pages.select(id_col, rest.alias("rest"))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    parts = parts.select(id_col, F.coalesce(lower_ascii(host), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    labels = F.split("host", "[.]")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = rules.select(F.col("verdict").alias("own"), F.col("host").alias("suffix"), F.col("path").alias("start"))
    met = parts.select("host", "path").distinct().withColumn("suffix", F.explode(suffix)).join(own, "suffix").where(F.startswith("path", "start"))
    order = F.struct(F.size(F.split("suffix", "[.]")), F.length("start"), F.col("own"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("own", F.concat("suffix", "start").alias("rule")), order).alias("best"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.own", F.lit(default)).alias("verdict"))
