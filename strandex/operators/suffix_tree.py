"""Suffix trees of short texts, as rows of nodes.

The tree is implicit: a suffix that begins another suffix has no leaf. It is made from the sorted suffixes:
the leaves are those that begin no other, the inner nodes the branchings of neighbouring leaves.
Node 0 is the root; a node's edge is text[start:end) of its parent's link, and its path text[end - depth:end). A text of
n characters takes n log n steps of sorting, n of comparing and gives 2 n rows at most. Spelled edges and paths take up to
n * n / 2 characters each: leave them out for long texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.runtime import ship

SCHEMA = "node_id long, parent_id long, start long, end long, depth long, is_leaf boolean"
SPELLED = ", edge string, path string"


def sorted_suffixes(text: str) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the compared length."""
    rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else []
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        k *= 2
    return order


def shared_lengths(text: str, order: np.ndarray) -> list[int]:
    """How many characters each suffix in order shares with the one before it, in one pass from left to right."""
    n, rank, k = len(text), np.empty(len(order), np.int64), 0
    rank[order] = np.arange(n)
    before = np.concatenate(([-1], order[:-1]))[rank].tolist()
    out = [0] * n
    for s in range(n):
        b = before[s]
        if b < 0:
            k = 0
            continue
        while s + k < n and b + k < n and text[s + k] == text[b + k]:
            k += 1
        out[s] = k
        k = max(k - 1, 0)
    return [out[s] for s in order.tolist()]


def build(text: str) -> list[tuple[int, int | None, int, int, int, bool]]:
    """Rows (node, parent, start, end, depth, is leaf); depth is the path's length."""
    n = len(text)
    out: list[tuple[int, int | None, int, int, int, bool]] = [(0, None, 0, 0, 0, False)]

    order = sorted_suffixes(text)
    leaves: list[tuple[int, int]] = []  # (start, characters shared with the leaf before)
    for s, shared in zip(order.tolist(), shared_lengths(text, order), strict=True):
        if leaves and shared == n - leaves[-1][0]:  # begins this one: no leaf
            shared = min(shared, leaves.pop()[1])
        leaves.append((s, shared))
    # the path to the last leaf: [depth, start of a suffix on that path, children]
    open_: list[list] = [[0, 0, []]]

    def close(shared: int) -> None:
        while open_[-1][0] > shared:
            top = open_.pop()
            if open_[-1][0] < shared:
                open_.append([shared, top[1], []])
            open_[-1][2].append(top)

    for s, shared in leaves:
        close(shared)
        open_.append([n - s, s, []])
    close(0)
    stack = [(0, child) for child in open_[0][2]]
    depth_of = {0: 0}
    while stack:
        parent, (depth, s, children) = stack.pop()
        node = len(out)
        out.append((node, parent, s + depth_of[parent], s + depth, depth, not children))
        depth_of[node] = depth
        stack += [(node, x) for x in reversed(children)]
    return out


def suffix_tree(texts: DataFrame, key: str, text_col: str, spelled: bool = True) -> DataFrame:
    """Nodes of each text's tree, with the key; a NULL text has none, an empty one its root only.

    With spelled each node has its edge and path as text.
    """
    ship(texts.sparkSession)
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, {SCHEMA}{SPELLED * spelled}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for f in frames:
            for k, text in zip(f[key], f["__text"], strict=True):
                if text is not None:
                    rows = build(text)
                    if spelled:
                        rows = [(*r, text[r[2] : r[3]], text[r[3] - r[4] : r[3]]) for r in rows]
                    out = pd.DataFrame([(k, *r) for r in rows], columns=names)
                    out["parent_id"] = out["parent_id"].astype("Int64")
                    yield out

    return texts.select(key, F.col(text_col).alias("__text")).mapInPandas(run, schema)


def from_nested(text: str, nested: list) -> list[tuple[int, int | None, int, int, int, bool]]:
    """Rows as build() gives them from nested (start, end, children), children a list or missing."""
    out: list[tuple[int, int | None, int, int, int, bool]] = [(0, None, 0, 0, 0, False)]
    stack = [(0, 0, x) for x in reversed(nested)]
    while stack:
        parent, depth, (a, b, *rest) = stack.pop()
        b = min(b, len(text))
        node, children = len(out), rest[0] if rest else []
        out.append((node, parent, a, b, depth + b - a, not children))
        stack += [(node, depth + b - a, x) for x in reversed(children)]
    return out


def insert(rows: list[tuple[int, int | None, int, int, int, bool]], parent: int, start: int, end: int) -> list[tuple[int, int | None, int, int, int, bool]]:
    """Rows with a leaf added below a node by hand; the node is a leaf no more."""
    depth = rows[parent][4] + end - start
    out = [(*r[:5], r[5] and r[0] != parent) for r in rows]
    return [*out, (len(rows), parent, start, end, depth, True)]


def child(rows: list[tuple[int, int | None, int, int, int, bool]], text: str, node: int, char: str) -> tuple | None:
    """The child of a node whose edge begins with a character, or None."""
    return next((r for r in rows if r[1] == node and text[r[2] : r[2] + 1] == char), None)


def suffix_links(tree: DataFrame, key: str) -> DataFrame:
    """(key, node_id, link): for each inner node the node whose path is its path without the first character, if there is one."""
    inner = tree.where(~F.col("is_leaf") & (F.col("depth") > 0)).select(key, "node_id", F.substring("path", F.lit(2), F.length("path")).alias("path"))
    return inner.join(tree.select(key, "path", F.col("node_id").alias("link")), [key, "path"]).select(key, "node_id", "link")


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two trees have the same paths with the same leaves, whatever their numbering."""
    x, y = (t.select("path", "is_leaf") for t in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def walk(tree: DataFrame) -> DataFrame:
    """Nodes in pre-order."""
    return tree.orderBy("path")


def leaves(tree: DataFrame) -> DataFrame:
    return tree.where("is_leaf")


def inner(tree: DataFrame) -> DataFrame:
    """Branching nodes, without the root."""
    return tree.where(~F.col("is_leaf") & (F.col("depth") > 0))


def count_overlapping(text: Column, pattern: str) -> Column:
    """How often pattern occurs, overlaps counted: the leaves below its place in the tree with a terminator."""
    if not pattern:
        return F.when(text.isNotNull(), F.lit(0)).cast("bigint")
    from strandex.functions.single import quoted

    return F.regexp_count(text, F.lit(f"(?={quoted(pattern)})")).cast("bigint")


build_suffix_tree_simple = build_suffix_tree_ukkonen = suffix_tree
