"""What the training-data operators share: batches, scratch tables, word hashing.

Texts are handled as the bytes of an Arrow string column, so whole batches are hashed
by vector operations and no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandex.runtime import scratch, scratch_scope, ship  # noqa: F401  the operators take them from here

#: Rows of one Arrow batch.
BATCH_ROWS = 256
#: Bytes of text worked on at once; vector operations take up to some 200 bytes for each of these.
WINDOW = 1 << 18

_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD1342543DE82EF95)
#: The first 0 to 8 of eight bytes.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tune(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches, as documents can be long, and sends the package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def sliced(b: pa.RecordBatch, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of about WINDOW bytes of text, a row at least."""
    if text_col not in b.schema.names:
        yield b
        return
    at = np.cumsum(pc.fill_null(pc.binary_length(b[text_col]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + WINDOW, "right")))
        yield b.slice(i, j - i)
        i = j


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text_col: str = "text") -> DataFrame:
    """Applies f to the Arrow batches of df, cut so that memory doesn't grow with the texts' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, text_col):
                if (out := f(part)) is not None:
                    yield out

    tune(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_column(df: DataFrame, name: str) -> tuple[Column, str, pa.DataType]:
    """An id column, its type's name in Spark, and its type in Arrow. Whole numbers become long; other types stay."""
    kind = df.schema[name].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
    return F.col(name).cast(kind), kind.simpleString(), to_arrow_type(kind)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; null counts as empty."""
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = pc.fill_null(col, b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def _word_table(is_separator: Callable[[int], bool]) -> np.ndarray:
    """Byte -> the byte with A-Z lower-cased, or 0 for what separates words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[i for i in range(256) if is_separator(i)]] = 0
    return t


#: Words are runs of 0-9, a-z and all from U+0080.
ALNUM = _word_table(lambda b: b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)
#: Words are runs of all but space and U+0009 to U+000D. NUL stays a letter, as 255, which UTF-8 doesn't use.
SPACED = _word_table(lambda b: b == 0x20 or 9 <= b <= 13)
SPACED[0] = 255

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, p in (("up", _P), ("down", _P_INV)):
            v = np.full(n, p, np.uint64)
            v[0] = 1
            _powers[name] = np.multiply.accumulate(v)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i], times the base's power -i, the polynomial hash of values i to j."""
    up, _ = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=s[1:])
    return s


class Words:
    """The words of a batch: start, end (bytes in the batch), doc (row), hash, and count by row."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray):
        parts, at, n = [], 0, len(buf)
        edge = np.unique(off)
        while at < n:
            end = min(at + WINDOW, n)
            if end < n:  # cut between words or rows
                cuts = edge[np.searchsorted(edge, at, "right") : np.searchsorted(edge, end, "right")]
                if len(cuts):
                    end = int(cuts[-1])
                else:
                    until = int(edge[np.searchsorted(edge, at, "right")])
                    gap = np.flatnonzero(table[buf[at:end]] == 0)
                    if len(gap):
                        end = at + int(gap[-1]) + 1
                    else:  # a word longer than the window
                        while end < until and table[buf[end]]:
                            end = min(end + WINDOW, until)
                            gap = np.flatnonzero(table[buf[at:end]] == 0)
                            if len(gap):
                                end = at + int(gap[0]) + 1
                                break
            parts.append(self._hashed(buf[at:end], edge, at, table))
            at = end
        cat = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]
        self.start, self.end, self.hash = cat
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(off) - 1).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    @staticmethod
    def _hashed(raw: np.ndarray, edge: np.ndarray, at: int, table: np.ndarray):
        x = table[raw]
        inside = x != 0
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[edge[np.searchsorted(edge, at) : np.searchsorted(edge, at + len(raw))] - at] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[edge[np.searchsorted(edge, at, "right") : np.searchsorted(edge, at + len(raw), "right")] - at - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start + at, end + at, spelled(x, start, end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and which of them lie within one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return gram_hashes(self.hash, k), self.doc[:n] == self.doc[k - 1 :]


def spelled(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs x[start:end], none of which holds a 0.

    Each 8 bytes are scrambled with their place, and what they give is summed. Equal sums need values that
    cancel by chance: unlike a polynomial's, they have no regular texts that collide. Runs of up to 8 bytes and equal
    length never collide.
    """
    padded = np.concatenate((x, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(x) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = mix(mix(eight[start] & _LOW[np.minimum(size, 8)]) + np.uint64(_P))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        first = np.cumsum(more) - more
        own = np.repeat(long, more)
        k = np.arange(1, len(own) + 1) - np.repeat(first, more)
        at = start[own] + 8 * k
        parts = mix(mix(eight[at] & _LOW[np.minimum(end[own] - at, 8)]) + np.uint64(_P) * (k + 1).astype(np.uint64))
        h[long] += np.add.reduceat(parts, first)
    return mix(h + size.astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, put together from those of runs of 1, 2, 4, .. values."""
    n, size, taken, g = len(h) - k + 1, 1, 0, None
    while size <= k:
        if k & size:
            own = h[taken : taken + n]
            g, taken = own if g is None else mix(g * _Q + own), taken + size
        size *= 2
        if size <= k:
            h = mix(h[: len(h) - size // 2] * _Q + h[size // 2 :])
    return mix(g + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of w values."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def winnowed(keys: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing selects among the grams of each row.

    keys: a 32-bit hash of each gram; doc: its row, ascending. The least hash of each window of w
    grams is kept, the rightmost of equal ones; a row of fewer grams is one window. Any two rows that
    share w consecutive grams select one of them alike.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    key = (keys.astype(np.uint64) << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    picks = []
    if n >= w:
        mins = sliding_min(key, w)
        picks.append(mins[doc[: len(mins)] == doc[w - 1 :]])
    if (short := sizes < w).any():
        picks.append(np.minimum.reduceat(key, starts)[short])
    picked = np.zeros(n, bool)
    picked[(low - (np.concatenate(picks) & low)).astype(np.int64)] = True
    return np.flatnonzero(picked)


def mod_sampled(g: np.ndarray, doc: np.ndarray, t: int, k: int, w: int) -> np.ndarray:
    """Starts of k-word grams that mod-sampling selects in each row, one at least in any k + w - 1 words.

    g: 32-bit hashes of the t-word grams; doc: the row of each word, ascending; t is k modulo w. In each window of
    k + w - 1 words the least t-gram is found, the rightmost of equal ones, and its place modulo w is taken. Equal windows
    take the same place. For k much over w that selects about one place in w, where winnowing takes two in w + 1.
    """
    span = k + w - 1
    n = len(doc) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    key = (g.astype(np.uint64) << np.uint64(32)) | (low - np.arange(len(g), dtype=np.uint64))
    least = (low - (sliding_min(key, span - t + 1)[:n] & low)).astype(np.int64)
    start, picked = np.arange(n), np.zeros(len(doc), bool)
    picked[(start + (least - start) % w)[doc[:n] == doc[span - 1 :]]] = True
    return np.flatnonzero(picked)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and each row's count."""
    off = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))
