"""Document fingerprints by winnowing.

A rolling hash runs over the UTF-8 bytes of a text; of each W consecutive K-byte hashes the least is
kept, the rightmost of equal ones, with its position. Any two texts that share W + K - 1 bytes in a
row keep an equal hash there. A text of fewer than K bytes is one gram; an empty text keeps nothing.

A fingerprint is the base64 of 5 bytes for each kept hash: the gap from the kept position before
(less than 256, as W is) and the hash as little-endian 32 bits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

K, W = 12, 24
#: Documents of one range of ids; ranges are sorted and read one after another.
RANGE_ROWS = 1000
#: At most so many ranges; beyond, ranges grow, are sorted on disk and still read as streams.
MAX_RANGES = 4096


def selected(buf: np.ndarray, off: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of each kept gram, rows and positions ascending.

    A row longer than a hashing window is cut into windows that overlap by w + k - 2 bytes: each window
    of w grams lies in one of them whole, so memory follows the window and not the text.
    """
    out, i, rows = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint32),)], 0, len(off) - 1
    while i < rows:
        lo, end = int(off[i]), int(off[i + 1])
        if end - lo <= c.WINDOW:
            j = max(i + 1, int(np.searchsorted(off, lo + c.WINDOW, "right")) - 1)
            d, p, h = _selected(buf[lo : off[j]], off[i : j + 1] - lo, k, w)
            out.append((d + i, p - (off[i:j] - lo)[d], h))
            i = j
            continue
        parts = []
        for a in range(lo, end - (w + k - 2), c.WINDOW - (w + k - 2)):
            b = min(a + c.WINDOW, end)
            _, p, h = _selected(buf[a:b], np.array([0, b - a]), k, w)
            parts.append((p + a - lo, h))
        p, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        p, first = np.unique(p, return_index=True)
        out.append((np.full(len(p), i), p, h[first]))
        i += 1
    d, p, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return d, p, h


def _selected(buf: np.ndarray, off: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - k + 1, (size > 0).astype(np.int64)))
    first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(size)))))[:-1]
    start = np.arange(len(doc)) - first[doc] + off[doc]
    end = np.minimum(start + k, off[doc + 1])
    s = c.prefix_hashes(c.BYTE_VALUE[buf])
    h = (c.mix((s[end] - s[start]) * c.powers(len(buf) + 1)[1][start]) >> np.uint64(32)).astype(np.uint32)
    pick = c.winnowed(h, doc, w)
    return doc[pick], start[pick], h[pick]


def encoded(rows: int, doc: np.ndarray, pos: np.ndarray, h: np.ndarray) -> list[str]:
    raw = np.zeros((len(doc), 5), np.uint8)
    gap = pos.copy()
    gap[1:] -= np.where(doc[1:] == doc[:-1], pos[:-1], 0)
    raw[:, 0] = gap
    raw[:, 1:] = h.astype("<u4").view(np.uint8).reshape(-1, 4)
    data, at = raw.tobytes(), np.searchsorted(doc, np.arange(rows + 1)) * 5
    return [base64.b64encode(data[at[i] : at[i + 1]]).decode() for i in range(rows)]


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a fingerprint."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 5)
    return np.cumsum(raw[:, 0].astype(np.int64)), raw[:, 1:].copy().view("<u4").ravel()


def likeness(rows: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard likeness of the hash sets of rows of a and b, each (row, hash); 1 for two empty sets."""
    x, y = (np.unique((d.astype(np.uint64) << np.uint64(32)) | h) for d, h in (a, b))
    both = np.intersect1d(x, y, assume_unique=True)
    nx, ny, n = (np.bincount((v >> np.uint64(32)).astype(np.int64), minlength=rows) for v in (x, y, both))
    union = nx + ny - n
    return np.where(union == 0, 1.0, n / np.maximum(union, 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row, repeated ones each; a null text counts as empty and an empty table gives none. Ids are of
    any type. Nothing is shuffled."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["id"], pa.array(encoded(b.num_rows, *selected(*c.text_bytes(b["text"]))), pa.string())], ["id", "fingerprint"])

    return c.mapped(texts, f, f"id {texts.schema['id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (range, id, text, guest) so that each range, sorted by guest, id and text, ends with its successor.

    Ranges of ids hold about range_rows rows, by approximate quantiles of all ids, and at most
    MAX_RANGES are made. The first document of each range also goes, as a guest, to the range before;
    the very first one to the last. The driver gets the ranges' bounds and first ids only.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = min(max(1, -(-texts.count() // range_rows)), MAX_RANGES)
    key = F.coalesce("id", F.lit(-(2**63)))
    bounds = []
    if n > 1:
        cuts = texts.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]
        bounds = sorted({*cuts})
    limits = F.array(*map(F.lit, bounds)).cast("array<long>")
    placed = texts.withColumn("range", F.size(F.filter(limits, lambda b: b <= key)))
    firsts = [(r[0], r[1]) for r in placed.groupBy("range").agg(F.min(key)).orderBy("range").collect()]
    heads = docs.sparkSession.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "head long, before int")
    own, guest = F.struct("range", F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest"))
    return (
        placed.join(F.broadcast(heads), key == F.col("head"), "left")
        .select("id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"))
        .select("to.range", "id", "text", "to.guest")
    )


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each text's fingerprint beside that of the text with its second half taken from the next document.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Null
    texts count as empty; two empty fingerprints are alike (1). Rows go by id, a whole number, null first, and rows
    with equal ids by text, so repeated rows follow one another, in one range. An empty table gives none. Sorted ranges
    are read as a stream that looks one row ahead.
    """

    def digest(rows: list[tuple]) -> pa.RecordBatch:
        own = np.array([r[3] == 0 and q[0] == r[0] for r, q in zip(rows, rows[1:], strict=False)] + [False])
        texts = [r[2] for r in rows]
        half = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - n] + u[:n] if o else "" for t, n, u, o in zip(texts, half, [*texts[1:], ""], own.tolist(), strict=True)]
        n = len(rows)
        a, e = (selected(*c.text_bytes(pa.array(x, pa.string()))) for x in (texts, edited))
        near_edited = likeness(n, (a[0], a[2]), (e[0], e[2]))
        later = a[0] > 0
        near_next = likeness(n, (a[0], a[2]), (a[0][later] - 1, a[2][later]))
        cols = [
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(encoded(n, *a), pa.string()),
            pa.array(encoded(n, *e), pa.string()),
            pa.array(near_edited),
            pa.array(near_next),
        ]
        out = pa.RecordBatch.from_arrays(cols, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        return out.filter(pa.array(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[tuple] = []
        for b in batches:
            for part in c.sliced(b):
                rows = ahead + list(zip(*(col.to_pylist() for col in part.columns), strict=True))
                if len(rows) > 1:
                    yield digest(rows)
                ahead = rows[-1:]

    c.tune(docs.sparkSession)
    rows = with_next(docs, id_col, text_col, range_rows)
    return rows.repartition("range").sortWithinPartitions("range", "guest", "id", "text").mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
