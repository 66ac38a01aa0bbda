"""URL filters: a trie over reversed host labels, then path segments; the longest rule wins.

A rule is (host, path, verdict). It fits a url whose host is the rule's or a subdomain and whose path starts
with the rule's path. Of the rules that fit, the one with more host labels wins, then the longer path;
of equal rules a block wins. Rules are sent in blocks of bounded size, each one pass over the urls that keeps the best
rule so far; what a block has found is written before the next one, so one block's trie is in memory at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Rules in one broadcast trie; a rule of some 50 bytes takes about 1 KB there.
BLOCK_RULES = 100_000
#: Characters of the rules in one trie, for each rule that a block may have.
RULE_CHARS = 64

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(slots=True)
class Node:
    """One host label or one whole path segment. ends: (what the next segment starts with, rule, verdict)."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class Trie:
    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root = Node()
        for host, path, verdict in sorted(rules, key=lambda r: r[2] == "block"):
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.labels.setdefault(label, Node())
            *whole, part = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            node.ends = [e for e in node.ends if e[0] != part] + [(part, host + path, verdict)]

    def best(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path characters, rule, verdict) of the longest rule that fits."""
        node, depth, found = self.root, 0, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            depth += 1
            found = self._path(node, segments, depth) or found
        return found

    @staticmethod
    def _path(node: Node, segments: list[str], depth: int) -> tuple[int, int, str, str] | None:
        found, at = None, 0
        for segment in segments:
            for part, rule, verdict in node.ends:
                if segment.startswith(part) and (found is None or at + len(part) >= found[1]):
                    found = depth, at + len(part), rule, verdict
            node = node.segments.get(segment)
            if node is None:
                break
            at += len(segment) + 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased: after the first :// up to /, ?, # or the end; path: then up to ? or #."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; rules has host, path and verdict.

    Without a fitting rule, as for a null url, rule is null and the verdict is the default. Rules with a
    null are passed over. Ids don't matter: a null id and rows that repeat one get their own rows. An empty table gives
    none, and an empty table of rules the default. Only the id and url columns are read.
    """
    rules = rules.select("host", "path", "verdict").dropna()
    many, chars = rules.agg(F.count("*"), F.sum(F.length("host") + F.length("path"))).first()
    blocks = max(1, -(-many // block_rules), -(-(chars or 0) // (RULE_CHARS * block_rules)))
    key = F.pmod(F.xxhash64("host", "path"), F.lit(blocks))
    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    names = ["id", "host", "path", "labels", "chars", "rule", "verdict"]
    for n in range(blocks):
        sent = pages.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in rules.where(key == n).collect()]))

        def f(b: pa.RecordBatch, sent=sent, first=not n) -> pa.RecordBatch:
            trie, rows = sent.value, []
            parts = map(split_url, b["url"].to_pylist()) if first else zip(*(b[x].to_pylist() for x in ("host", "path")), strict=True)
            before = [(0, 0, None, default)] * b.num_rows if first else zip(*(b[x].to_pylist() for x in names[3:]), strict=True)
            for (host, path), had in zip(parts, before, strict=True):
                found = trie.best(host, path)
                rows.append((host, path, *(found if found and (had[2] is None or found[:2] > had[:2]) else had)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([b["id"], *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

        out = c.mapped(c.scratch(out) if n else out, f, f"id {kind}, host string, path string, labels int, chars int, rule string, verdict string")
    return out.drop("labels", "chars")
