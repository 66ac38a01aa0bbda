"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its score is linear in its own features and in those of the line before
and after; a 2 x 2 matrix scores neighbouring states. Forward-backward gives each line's marginal; a
document's raw quality is their mean weighted by the lines' lengths, and a logistic curve fitted to the
training documents' labels turns that into the score.

Labels mark documents, so the lines' states are latent. They start as their document's label, which each line's own features
are fitted to, without its neighbours: those would only tell the document. Then rounds alternate:
the chain's own posterior, moved no further than until the length-weighted share of good lines is at least GOOD_SHARE in a
document of label 1 and at most BAD_SHARE in one of label 0, gives each line's expected state, and the weights are fitted to
those. So a bad document may keep good lines, and neighbours may differ.

Training takes about SAMPLE labelled documents, chosen by a hash of the id, of at most SAMPLE_LINES lines
each; both bounds are parameters. The model is some 100 numbers. Scoring reads whole texts, line by line: memory follows
a batch or the longest line, and 150 bytes for each line of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Expected documents of the training sample, and lines of each at most.
SAMPLE, SAMPLE_LINES = 4000, 400
#: Of a document's length, what lines of label 1 take at least where its label is 1, and at most where it is 0.
GOOD_SHARE, BAD_SHARE = 0.9, 0.5
#: Rounds of expectation, and steps of the weights in each.
ROUNDS, ROUND_STEPS = 5, 20

#: Classes of bytes, in order: separator, lower case, upper case, digit, sentence punctuation, pipe,
#: other symbol, non-ASCII.
CLASSES = 8
CLASS = np.full(256, 6, np.uint8)
CLASS[:33] = 0
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 7
CLASS[[ord(x) for x in ".,;:'\"-?()"]] = 4
CLASS[ord("|")] = 5

FEATURES = 14


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each non-empty line."""
    cuts = np.flatnonzero(buf == 10)
    start = np.union1d(cuts + 1, off[:-1])
    start = start[start < len(buf)]
    end = np.append(start[1:], len(buf))
    end = end - (buf[end - 1] == 10)
    keep = end > start
    start, end = start[keep], end[keep]
    return np.searchsorted(off, start, "right") - 1, start, end


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, length in bytes) of each non-empty line of a string column."""
    buf, off = c.text_bytes(col)
    parts, at = [], 0
    while at < len(buf):
        end = min(at + c.WINDOW, len(buf))
        if end < len(buf):  # cut after a line, the first one however long it is
            ends = np.flatnonzero(buf[at:end] == 10)
            rows = off[(off > at) & (off <= end)]
            last = max(int(ends[-1]) + 1 + at if len(ends) else 0, int(rows[-1]) if len(rows) else 0)
            while not last:
                more = np.flatnonzero(buf[end : end + c.WINDOW] == 10)
                last = int(more[0]) + 1 + end if len(more) else 0
                end += c.WINDOW
                rows = off[(off > at) & (off <= min(end, len(buf)))]
                last = min(x for x in (last or len(buf) + 1, int(rows[0]) if len(rows) else len(buf) + 1)) % (len(buf) + 1)
            end = last
        i = int(np.searchsorted(off, at, "right")) - 1
        j = int(np.searchsorted(off, end, "left"))
        own = np.clip(off[i : j + 1], at, end) - at
        parts.append((*_line_features(buf[at:end], own), i))
        at = end
    if not parts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0)
    x, size, line_hash = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
    row = np.concatenate([p[1] + p[4] for p in parts])
    order = np.lexsort((line_hash, row))
    same = np.zeros(len(row), bool)
    eq = (row[order][1:] == row[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    same[order[1:]] |= eq
    same[order[:-1]] |= eq
    x[:, -1] = same
    return x, row, size


def _line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, length, hash of words) of each non-empty line; the last feature, whether it repeats, stays 0."""
    row, start, end = lines_of(buf, off)
    n, size = len(row), (end - start).astype(np.float64)
    if not n:
        return np.zeros((0, FEATURES), np.float32), row, size, np.zeros(0, np.uint64)
    w = c.Words(buf, off, c.SPACED)
    of_word = np.searchsorted(start, w.start, "right") - 1
    kind = CLASS[buf]
    counts = [np.add.reduceat(kind == k, start, dtype=np.int64) for k in range(1, CLASSES)]  # line ends are in class 0
    words = np.maximum(np.bincount(of_word, minlength=n), 1)
    order = np.lexsort((w.hash, of_word))
    a, b = of_word[order], w.hash[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    different = np.bincount(a[first], minlength=n)
    marked = (kind[w.end - 1] == 6) | (kind[w.end - 1] == 5)
    shouted = (kind[w.start] == 2) & (kind[np.minimum(w.start + 1, w.end - 1)] == 2)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mix(w.hash + c.mix(w.start.astype(np.uint64) - start[of_word].astype(np.uint64))), dtype=np.uint64)))
    at = np.searchsorted(w.start, np.stack((start, end)))
    f = [
        *(k / size for k in counts),
        np.log1p(size) / 8,
        np.log1p(words) / 6,
        size / words / 10,
        different / words,
        np.bincount(of_word, marked, minlength=n) / words,
        np.bincount(of_word, shouted, minlength=n) / words,
        np.zeros(n),
    ]
    return np.stack(f, 1).astype(np.float32), row, size, sums[at[1]] - sums[at[0]]


def chain_inputs(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each line's features and their squares, beside those of its neighbours in the document, and a constant."""
    x = np.concatenate((x, x * x), 1)
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        inner = (row[1:] == row[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * inner, x[1:] * inner
    return np.concatenate((x, before, after, np.ones((len(x), 1), np.float32)), 1)


def forward_backward(s: np.ndarray, row: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of state 1: a from the lines up to each one, b from those after it; and for each but a row's
    first line the probabilities of (state before, own state) as columns 00, 01, 10, 11.

    s: each line's own log odds; t: log weights of neighbouring states. Lines of all rows move in step.
    """
    n = len(s)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    first = first[np.argsort(-size, kind="stable")]
    size = np.sort(size)[::-1]
    a, b = s.astype(np.float64).copy(), np.zeros(n)
    longest = int(size[0]) if n else 0
    active = [first[: int(np.searchsorted(-size, -k, "left"))] for k in range(longest)]
    for k in range(1, longest):
        i = active[k] + k
        p = a[i - 1]
        a[i] += np.logaddexp(p + t[1, 1], t[0, 1]) - np.logaddexp(p + t[1, 0], t[0, 0])
    for k in range(longest - 1, 0, -1):
        i = active[k] + k
        p = s[i] + b[i]
        b[i - 1] = np.logaddexp(p + t[1, 1], t[1, 0]) - np.logaddexp(p + t[0, 1], t[0, 0])
    later = np.flatnonzero(np.concatenate(([False], row[1:] == row[:-1]))) if n else np.zeros(0, np.int64)
    p, q = a[later - 1], s[later] + b[later]
    pair = np.stack((np.full(len(p), t[0, 0]), t[0, 1] + q, t[1, 0] + p, t[1, 1] + p + q), 1)
    pair = np.exp(pair - pair.max(1, keepdims=True)) if len(pair) else pair
    return a, b, pair / pair.sum(1, keepdims=True) if len(pair) else pair


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def shares(good: np.ndarray, row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """Each row's mean of good, weighted by size; NaN for a row without lines."""
    total = np.bincount(row, size, minlength=rows)
    return np.divide(np.bincount(row, good * size, minlength=rows), total, out=np.full(rows, np.nan), where=total > 0)


def expected(s: np.ndarray, row: np.ndarray, size: np.ndarray, t: np.ndarray, labels: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of state 1 and the sum of all pairs', of the posterior that is closest to the chain's with
    shares as the labels ask: a row whose share is wrong gets the least constant on its lines' log odds that mends it."""
    rows = len(labels)
    low, high = np.zeros(rows), np.where(labels == 1, 20.0, -20.0)
    now = np.zeros(rows)
    for _ in range(steps + 1):
        a, b, pair = forward_backward(s + now[row], row, t)
        share = shares(sigmoid(a + b), row, size, rows)
        right = np.isnan(share) | np.where(labels == 1, share >= GOOD_SHARE, share <= BAD_SHARE)
        low, high = np.where(right, low, now), np.where(right, now, high)
        now = np.where(high == 0, 0.0, (low + high) / 2)
    now = high
    a, b, pair = forward_backward(s + now[row], row, t)
    return sigmoid(a + b), pair.sum(0)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.5

    def logits(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Each line's own log odds, as chain_inputs() would give them, without its wide rows."""
        w = self.weights / self.scale
        own, before, after = w[:-1].reshape(3, -1)
        x = np.concatenate((x, x * x), 1)
        s = x @ own + (w[-1] - self.mean @ w)
        if len(x) > 1:
            inner = row[1:] == row[:-1]
            s[1:] += (x[:-1] @ before) * inner
            s[:-1] += (x[1:] @ after) * inner
        return s

    def marginals(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How likely each line is good."""
        a, b, _ = forward_backward(self.logits(x, row), row, self.trans)
        return sigmoid(a + b)

    def raw(self, x: np.ndarray, row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
        """Length-weighted mean marginal of each row's lines; NaN for a row without lines."""
        return shares(self.marginals(x, row), row, size, rows)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        p = np.clip(raw, 1e-6, 1 - 1e-6)
        out = sigmoid(self.curve[0] * np.log(p / (1 - p)) + self.curve[1])
        return np.where(np.isnan(raw), self.prior, out)


def fit(x: np.ndarray, row: np.ndarray, size: np.ndarray, labels: np.ndarray, steps: int = 200, decay: float = 1e-3, rate: float = 0.05) -> Model:
    """labels: 0 or 1 for each row. Adam steps on the penalised log likelihood of the lines' states, which are the
    documents' labels for half of the steps and then what expected() makes of the chain, round after round."""
    rows, y = len(labels), labels[row].astype(np.float64)
    v = chain_inputs(x, row)
    mean, scale = v.mean(0), np.maximum(v.std(0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    v = (v - mean) / scale
    m = Model(np.zeros(v.shape[1]), np.zeros((2, 2)), mean, scale)
    later = np.flatnonzero(np.concatenate(([False], row[1:] == row[:-1])))
    seen = np.zeros(4)
    np.add.at(seen, (2 * y[later - 1] + y[later]).astype(int), 1)
    n = max(len(y), 1)
    theta, g1, g2 = np.zeros(v.shape[1] + 4), 0.0, 0.0
    first = max(steps - ROUNDS * ROUND_STEPS, steps // 2)
    alone = np.zeros(len(theta))
    alone[: 2 * FEATURES] = alone[-5] = 1
    for k in range(1, steps + 1):
        m.weights, m.trans = theta[:-4], theta[-4:].reshape(2, 2)
        if k > first and (k - first) % ROUND_STEPS == 1:
            y, seen = expected(v @ m.weights, row, size, m.trans, labels)
        a, b, pair = forward_backward(v @ m.weights, row, m.trans)
        g = np.concatenate((v.T @ (y - sigmoid(a + b)), seen - pair.sum(0))) / n - decay * theta
        g *= alone if k <= first else 1
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
        theta = theta + rate * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.999**k)) + 1e-8)
    m.weights, m.trans = theta[:-4], theta[-4:].reshape(2, 2)
    raw = m.raw(x, row, size, rows)
    some = ~np.isnan(raw)
    m.prior = float((labels.sum() + 1) / (rows + 2))
    m.curve = logistic_curve(np.clip(raw[some], 1e-6, 1 - 1e-6), labels[some])
    return m


def logistic_curve(p: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit labels to log odds, by Newton steps with a small penalty."""
    x = np.stack((np.log(p / (1 - p)), np.ones(len(p))), 1)
    w = np.array([0.5, 0.0])
    for _ in range(50):
        q = sigmoid(x @ w)
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, x.T @ (labels - q) - 1e-2 * w), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model | None:
    """A model from labels (id, 0 or 1) where learn holds; None if no labelled text is there.

    A label that is null or neither 0 nor 1 is passed over; an id labelled differently has its least label.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    many = known.count()
    if not many:
        return None
    # about `sample` rows, whatever the size of labels: small enough to broadcast
    chosen = known.where(F.pmod("h", F.lit(2**30)) < min(1.0, sample / many) * 2**30)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").where("text is not null")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x, row, size = line_features(b["text"])
        at = np.searchsorted(row, np.arange(b.num_rows + 1))
        data = [np.concatenate((x[i:j], size[i:j, None]), 1).astype("<f4").tobytes() if 0 < j - i <= sample_lines else None for i, j in zip(at, at[1:], strict=False)]
        out = pa.RecordBatch.from_arrays([b["h"], b["label"], pa.array(data, pa.binary())], ["h", "label", "lines"])
        return out.filter(pa.array([d is not None for d in data]))

    found = sorted(c.mapped(texts, f, "h long, label int, lines binary").collect(), key=lambda r: (r["h"], r["lines"]))
    if not found:
        return None
    parts = [np.frombuffer(r["lines"], "<f4").reshape(-1, FEATURES + 1) for r in found]
    flat = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(flat[:, :-1], row, flat[:, -1].astype(np.float64), np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: how likely label 1 is. Texts without a non-empty line, null ones too, get the
    share of label 1 in the training sample; without a model every score is 0.5. Ids don't matter: a null id and rows that
    repeat one get their own rows. An empty table gives none."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return texts.select("id", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        out = m.scores(m.raw(*line_features(b["text"]), b.num_rows))
        return pa.RecordBatch.from_arrays([b["id"], pa.array(out)], ["id", "score"])

    return c.mapped(texts, f, f"id {texts.schema['id'].dataType.simpleString()}, score double")


def lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, start, end, good) for each non-empty line: its number among those, its bytes in the text, and how likely
    it is good. Null and empty texts have none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = c.text_bytes(b["text"])
        x, row, _ = line_features(b["text"])
        _, start, end = lines_of(buf, off)
        first = np.searchsorted(row, np.arange(b.num_rows))
        cols = [b["id"].take(pa.array(row)), *map(pa.array, (np.arange(len(row)) - first[row], start - off[row], end - off[row], sent.value.marginals(x, row)))]
        return pa.RecordBatch.from_arrays(cols, ["id", "line", "start", "end", "good"])

    return c.mapped(texts, f, f"id {texts.schema['id'].dataType.simpleString()}, line long, start long, end long, good double")
