"""Hierarchical packing of documents into sequences of several context sizes.

A document is cut into full sequences of CONTEXT tokens and a tail of 1 to CONTEXT - 1. Tails are
routed by their length: to the least context size (a power of two) that holds them. The plan needs only
how many tails there are of each length, CONTEXT - 1 numbers at any corpus size: from the longest
down, a tail opens a window of its context size, and the gap is filled exactly with tails of shorter
tiers; the pattern is repeated as often as its tails last. A tail whose gap nothing fills exactly is
cut into powers of two, at most ten pieces, which fill windows without gaps from the largest down.
So every sequence but the last is full. Each tier's sequences are dealt to the step groups in turn.

Tails are numbered within a length by the task that tokenised them and its count, so numbering
needs sums by task only, and no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .tokens import encoder, public_paths

CONTEXT = 1024
#: The least context size; shorter tails only fill windows.
LEAST_TIER = 128
#: Tokens of one step group.
STEP_TOKENS = 1 << 20


@dataclass
class Plan:
    """Where tails go. segments: by length, rows (first rank, tails a window, windows, sequence, offset)."""

    segments: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)
    cut_from: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXT, np.int64))
    part_rank: np.ndarray = field(default_factory=lambda: np.zeros((CONTEXT, 10), np.int64))
    part_start: np.ndarray = field(default_factory=lambda: np.zeros(10, np.int64))
    #: First sequence, count, length, and rank of the first within its length's sequences.
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    rest: int = 0
    full: int = 0
    steps: int = 1


def fill(gap: int, left: np.ndarray) -> list[int] | None:
    """Lengths that add up to gap, of those left; one or two if possible, else greedily; None if not found."""
    if gap == 0:
        return []
    if left[gap]:
        return [gap]
    for v in range(gap - 1, (gap - 1) // 2, -1):
        if left[v] and left[gap - v] >= 1 + (v == gap - v):
            return [v, gap - v]
    out, had, top = [], left.copy(), gap
    while gap:
        some = np.flatnonzero(had[1 : min(top, gap) + 1])
        if not len(some):
            return None
        top = int(some[-1]) + 1
        n = min(int(had[top]), gap // top)
        out += [top] * n
        had[top] -= n
        gap -= n * top
    return out


def make_plan(counts: np.ndarray, fulls: int, step_tokens: int = STEP_TOKENS) -> Plan:
    """counts: tails of each length 0 to CONTEXT - 1; fulls: full sequences."""
    left, p, seq = counts.copy(), Plan(), 0
    tier_rank: Counter[int] = Counter()
    for r in range(CONTEXT - 1, 0, -1):
        tier = max(LEAST_TIER, 1 << (r - 1).bit_length())
        while left[r]:
            left[r] -= 1
            size, more = tier, fill(tier - r, left) if r > LEAST_TIER // 2 else None
            if more is None:
                size, more = CONTEXT, fill(CONTEXT - r, left)
            left[r] += 1
            if more is None:
                break
            own = Counter([r, *more])
            n = int(min(left[x] // k for x, k in own.items()))
            at = 0
            for x, k in sorted(own.items(), reverse=True):
                p.segments.setdefault(x, []).append((int(counts[x] - left[x]), k, n, seq, at))
                left[x] -= k * n
                at += k * x
            p.runs.append((seq, n, size, tier_rank[size]))
            tier_rank[size] += n
            seq += n
    p.cut_from = counts - left
    at = 0
    for b in range(9, -1, -1):
        has = (np.arange(CONTEXT) >> b) & 1
        p.part_rank[:, b] = np.cumsum(left * has) - left * has
        p.part_start[b] = at
        at += int((left * has).sum()) << b
    for name, n in (("rest", -(-at // CONTEXT)), ("full", fulls)):
        setattr(p, name, seq)
        p.runs.append((seq, n, CONTEXT, tier_rank[CONTEXT]))
        tier_rank[CONTEXT] += n
        seq += n
    total = fulls * CONTEXT + int((counts * np.arange(CONTEXT)).sum())
    p.steps = max(1, -(-total // step_tokens))
    return p


def tokenised(docs: DataFrame, paths: tuple[str, str, str], id_col: str, text_col: str) -> DataFrame:
    """For each row its tokens' count, the CRCs of its full sequences, of its tail and of the tail's parts,
    and the numbers of the tail and of the first full sequence within the task."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(*paths), TaskContext.get().partitionId()
        seen, fulls = Counter(), 0
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                ids = np.append(encode(text), np.uint32(0)).astype("<u4")
                n, raw = len(ids), ids.tobytes()
                whole = n // CONTEXT
                r, at = n % CONTEXT, whole * CONTEXT * 4
                crcs = [zlib.crc32(raw[i * CONTEXT * 4 : (i + 1) * CONTEXT * 4]) for i in range(whole)]
                tail, parts = zlib.crc32(raw[at:]) if r else 0, []
                for k in range(9, -1, -1):
                    if r >> k & 1:
                        parts.append(zlib.crc32(raw[at : at + (4 << k)]))
                        at += 4 << k
                rows.append((n, crcs, r, tail, parts, seen[r], fulls))
                seen[r] += 1
                fulls += whole
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([task] * len(rows), pa.int32()), *cols], ["id", "task", "n", "crcs", "tail", "tail_crc", "part_crcs", "tail_at", "full_at"])

    c.tune(docs.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, task int, n long, crcs array<long>, tail int, tail_crc long, part_crcs array<long>, tail_at long, full_at long")


def pack(docs: DataFrame, paths: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, step_group).

    A null or empty text is the closing id 0 alone. Every id is in exactly one piece; repeated rows are
    packed each. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = c.scratch(tokenised(docs, paths or public_paths(), id_col, text_col))
    by_task = rows.groupBy("task", "tail").agg(F.count("*").alias("many"), F.sum(F.size("crcs")).alias("fulls"))
    by_task = c.scratch(by_task)
    tails = by_task.withColumn("tail_base", F.sum("many").over(Window.partitionBy("tail").orderBy("task")) - F.col("many")).select("task", "tail", "tail_base")
    fulls = by_task.groupBy("task").agg(F.sum("fulls").alias("fulls"))
    # a running sum over tasks in two steps: within groups of tasks, and over the groups
    group = F.expr("task div 1024")
    within = fulls.withColumn("g", group).withColumn("b", F.sum("fulls").over(Window.partitionBy("g").orderBy("task")) - F.col("fulls"))
    groups = within.groupBy("g").agg(F.sum("fulls").alias("t")).withColumn("a", F.sum("t").over(Window.orderBy("g")) - F.col("t"))
    bases = within.join(groups.hint("merge"), "g").select("task", (F.col("a") + F.col("b")).alias("full_base"))
    # all that grows with the input is joined by merging, at every size
    starts = c.scratch(tails.join(bases.hint("merge"), "task"))

    counts, many = np.zeros(CONTEXT, np.int64), 0
    for r in by_task.groupBy("tail").agg(F.sum("many").alias("n"), F.sum("fulls").alias("f")).collect():
        counts[r["tail"]], many = r["n"], many + r["f"]
    counts[0] = 0
    plan = spark.sparkContext.broadcast(make_plan(counts, many, step_tokens))
    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.join(starts.hint("merge"), ["task", "tail"])

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return _pieces(plan.value, b)

    return c.mapped(placed, f, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long")


def _pieces(p: Plan, b: pa.RecordBatch) -> pa.RecordBatch:
    ids, out = b["id"], []
    names = ("n", "crcs", "tail", "tail_crc", "part_crcs", "tail_at", "full_at", "tail_base", "full_base")
    for i, (n, crcs, r, tail_crc, parts, tail_at, full_at, tail_base, full_base) in enumerate(zip(*(b[x].to_pylist() for x in names), strict=True)):
        for k, crc in enumerate(crcs):
            out.append((i, k * CONTEXT, CONTEXT, crc, n, p.full + full_base + full_at + k, 0))
        start, rank = len(crcs) * CONTEXT, tail_base + tail_at
        if not r:
            continue
        if rank < p.cut_from[r]:
            segments = p.segments[r]
            lo, hi = 0, len(segments)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if segments[mid][0] <= rank else (lo, mid)
            first, k, _, seq, at = segments[lo]
            window, slot = divmod(rank - first, k)
            out.append((i, start, r, tail_crc, n, seq + window, at + slot * r))
            continue
        rank -= int(p.cut_from[r])
        sizes = [x for x in range(9, -1, -1) if r >> x & 1]
        for x, crc in zip(sizes, parts, strict=True):
            at = int(p.part_start[x]) + ((int(p.part_rank[r, x]) + rank) << x)
            out.append((i, start, 1 << x, crc, n, p.rest + at // CONTEXT, at % CONTEXT))
            start += 1 << x
    v = np.array(out, np.int64).reshape(-1, 7)
    first = np.array([x[0] for x in p.runs if x[1]] or [0])
    rows = [x for x in p.runs if x[1]] or [(0, 0, CONTEXT, 0)]
    run = np.searchsorted(first, v[:, 5], "right") - 1
    size, rank = np.array([x[2] for x in rows])[run], np.array([x[3] for x in rows])[run]
    step = (rank + v[:, 5] - first[run]) % p.steps
    cols = [ids.take(pa.array(v[:, 0])), *(pa.array(v[:, k]) for k in range(1, 7)), pa.array(size), pa.array(step)]
    return pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"])
