"""Benchmark decontamination by winnowing.

Each item's word k-grams are winnowed: of every W consecutive ones the least hash is kept. With
K + W - 1 = 13 any 13 words that a document shares with an item share a kept fingerprint, so
only around a document's kept fingerprints that an item has too are the 13-word windows compared:
the hit is extended to every window that holds it. Items of fewer words are one window each, which
is looked for at every word. Documents are scanned once for each block of items and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW = 13
K = 7
W = WINDOW - K + 1
#: Bytes of item texts in one broadcast index; more items make more blocks.
BLOCK_BYTES = 16 << 20


class Index:
    """Sorted window hashes of a block of items, by window length, with the items of each."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = c.Words(*c.text_bytes(pa.array(texts, pa.string())), c.ALNUM)
        self.ids = ids
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        if len(w.hash) >= WINDOW:
            g, ok = w.grams(WINDOW)
            found[WINDOW] = [(g[ok], w.doc[: len(g)][ok])]
        for i in np.flatnonzero((w.count > 0) & (w.count < WINDOW)):
            x = w.hash[w.first[i] : w.first[i + 1]]
            found.setdefault(len(x), []).append((c.gram_hashes(x, len(x)), np.array([i])))
        for n, parts in found.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate(p) for p in zip(*parts, strict=True)], names="h,i"))
            keys, first = np.unique(pairs.h, return_index=True)
            self.by_length[n] = keys, np.append(first, len(pairs)), np.ascontiguousarray(pairs.i)
        g, ok = w.grams(K)
        pick = c.winnowed((g[ok] >> np.uint64(32)).astype(np.uint32), w.doc[: len(g)][ok], W)
        self.fingerprints = np.unique(g[ok][pick])

    def windows(self, w: c.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, key number) of each window of an item that the words hold."""
        out = []
        for n, (keys, _, _) in self.by_length.items():
            if n == WINDOW:
                g, ok = w.grams(K)
                at = np.flatnonzero(ok)
                at = at[c.winnowed((g[at] >> np.uint64(32)).astype(np.uint32), w.doc[at], W)]
                at = at[_member(g[at], self.fingerprints)]
                at = np.unique((at[:, None] - np.arange(W)).ravel())
                at = at[(at >= 0) & (at + n <= len(w.hash))]
                at = at[w.doc[at] == w.doc[at + n - 1]]
                h = np.zeros(len(at), np.uint64)
                if len(at):
                    h = c.gram_hashes(w.hash[at[:, None] + np.arange(n)].T, n)[0]
            else:
                h, ok = w.grams(n)
                at = np.flatnonzero(ok)
                h = h[at]
            hit = _member(h, keys)
            out.append((at[hit], np.full(hit.sum(), n), np.searchsorted(keys, h[hit])))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def hits(index: Index, col: pa.Array) -> tuple[c.Words, np.ndarray, list[list]]:
    """The words of each text, which of them are hit, and each text's items."""
    w = c.Words(*c.text_bytes(col), c.ALNUM)
    at, n, key = index.windows(w)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    items: list[set] = [set() for _ in range(len(col))]
    for d, m, x in {*zip(w.doc[at].tolist(), n.tolist(), key.tolist(), strict=True)}:
        _, first, item = index.by_length[m]
        items[d].update(index.ids[i] for i in item[first[x] : first[x + 1]].tolist())
    return w, np.cumsum(cover[:-1]) > 0, [sorted(x) for x in items]


def indexes(bench: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """An index for each block of items; the number of blocks follows the items' bytes."""
    items = bench.select(c.id_column(bench, id_col)[0].alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        yield Index([r[0] for r in rows], [r[1] for r in rows])


def _runs(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of hit words within a row."""
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = hit[1:] & hit[:-1] & (doc[1:] == doc[:-1])
    return np.flatnonzero(hit & ~np.concatenate(([False], joined))), np.flatnonzero(hit & ~np.concatenate((joined, [False]))) + 1


def with_hits(docs: DataFrame, bench: DataFrame, text_col: str, item_col: str, item_text_col: str, block_bytes: int) -> tuple[DataFrame, list[str]]:
    """docs with four more columns, and their names: counts of words and hit words, item ids, runs of hit words.

    Each block of items is one pass, which adds to what was found before.
    """
    names = docs.columns
    state = [c.unused(docs, x) for x in ("_words", "_hit", "_items", "_spans")]
    _, kind, arrow = c.id_column(bench, item_col)
    none, zero = F.array().cast("array<long>"), F.lit(0).cast("long")
    found = docs.select(*names, *(x.alias(y) for x, y in zip((zero, zero, F.array().cast(f"array<{kind}>"), none), state, strict=True)))
    for k, index in enumerate(indexes(bench, item_col, item_text_col, block_bytes)):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        found = c.scratch(found) if k else found

        def f(b: pa.RecordBatch, sent=sent, first=not k) -> pa.RecordBatch:
            w, hit, items = hits(sent.value, b[text_col])
            if not first:
                for i, (spans, had) in enumerate(zip(b[state[3]].to_pylist(), b[state[2]].to_pylist(), strict=True)):
                    for x, y in zip(spans[::2], spans[1::2], strict=True):
                        hit[w.first[i] + x : w.first[i] + y] = True
                    items[i] = sorted({*items[i], *had})
            start, end = _runs(hit, w.doc)
            d, n = w.doc[start], len(w.count)
            flat = np.stack((start - w.first[d], end - w.first[d]), 1).ravel()
            n_hit = np.bincount(w.doc[hit], minlength=n).astype(np.int64)
            cols = [pa.array(w.count), pa.array(n_hit), pa.array(items, pa.list_(arrow)), c.list_array(flat, 2 * np.bincount(d, minlength=n), pa.int64())]
            return pa.RecordBatch.from_arrays([*(b[x] for x in names), *cols], [*names, *state])

        found = c.mapped(found, f, found.schema, text_col)
    return found, state


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for each row of docs.

    items: the ids of items with a window in the text, ascending; spans: the runs of hit words as
    first and last + 1, flat, words counted from 0. Null and empty texts have no words. Items that
    repeat an id are joined; items with a null id or no words are passed over. An empty benchmark hits
    nothing.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, state = with_hits(texts, bench, "text", item_col, item_text_col, block_bytes)
    return found.select("id", *(F.col(x).alias(y) for x, y in zip(state, ("n_words", "n_hit", "items", "spans"), strict=True)))


def uncontaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    found, state = with_hits(docs, bench, text_col, item_col, item_text_col, block_bytes)
    return found.where(~is_contaminated(F.col(state[0]), F.col(state[1]))).select(docs.columns)


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def items_digest(items):
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)
