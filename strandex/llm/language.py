"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters are hashed to BUCKETS. Document frequencies come from all texts that may be
learnt from; the weights from at most about PER_LANGUAGE of them a language, chosen by a hash of the id.
Training follows the regularised leader by coordinate with elastic-net penalties, so weights that don't
pay are exactly zero; a temperature fitted on an eighth of the sample, left out of training, calibrates
the scores. The model is a few arrays of fixed size (BUCKETS x languages).

A text in none of the learnt languages is still likeliest in one of them, and the calibrated score can be high. What tells
it is the evidence, what its n-grams alone say for the best language, uncalibrated and without the languages' biases:
accepted() wants a share of the evidence that left-out texts have in the middle. Texts in several learnt languages have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Expected texts of each language in the training sample.
PER_LANGUAGE = 600
#: Texts counted at once.
ROWS = 32
UNKNOWN = "und"


def characters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, A-Z and the letters from U+00C0 to U+00DE lower-cased, and offsets."""
    buf, off = c.text_bytes(col)
    points = np.frombuffer(bytes(buf).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").copy()
    starts = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points[upper] += 32
    return points, starts[off]


def gram_counts(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of each row: (rows, BUCKETS)."""
    rows = len(off) - 1
    doc = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, np.diff(off))
    x = points.astype(np.uint32)
    out = np.zeros(rows * BUCKETS, np.int64)
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x9E3779B1) + x[n - 1 :]
        if n in ORDERS:
            b = ((h * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)) >> np.uint32(18)).astype(np.int64)
            own = doc[: len(h)] == doc[n - 1 :]
            out += np.bincount((doc[: len(h)] + b)[own], minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def text_counts(col: pa.Array) -> np.ndarray:
    """gram_counts() of a string column. A text longer than a window is counted in parts, so memory doesn't follow its length."""
    buf, off = c.text_bytes(col)
    if len(buf) <= 2 * c.WINDOW:
        return gram_counts(*characters(col))
    out = np.zeros((len(col), BUCKETS), np.int64)
    for i in range(len(col)):
        at, end = int(off[i]), int(off[i + 1])
        begin = at
        while at < end:
            to = min(at + c.WINDOW, end)
            while to < end and buf[to] & 0xC0 == 0x80:  # between characters
                to += 1
            before = at
            for _ in range(max(ORDERS) - 1):  # grams that begin in the part before
                if before > begin:
                    before -= 1
                    while buf[before] & 0xC0 == 0x80:
                        before -= 1
            for sign, x, y in ((1, before, to), (-1, before, at)):
                if y > x:
                    out[i] += sign * gram_counts(*characters(pa.array([bytes(buf[x:y])]).cast(pa.string())))[0]
            at = to
    return out


def _slices(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in c.sliced(b):
        for i in range(0, whole.num_rows, ROWS):
            part = whole.slice(i, ROWS)
            yield part, text_counts(part["text"])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Share of the left-out texts that are told right; 0 if there are none.
    accuracy: float = 0.0
    #: The middle of the best languages' evidence in left-out texts, or in the texts learnt from if none is left out.
    usual: float = 0.0

    def values(self, counts: np.ndarray) -> np.ndarray:
        """TF-IDF rows of unit length from counts (rows, buckets)."""
        v = np.log1p(counts, dtype=np.float32) * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)

    def evidence(self, counts: np.ndarray) -> np.ndarray:
        """What a text's n-grams say for each language."""
        return self.values(counts) @ self.weights

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        return softmax((evidence + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, langs) and biases by FTRL-proximal steps over sparse rows (buckets, values)."""
    z, n = np.zeros((BUCKETS + 1, langs)), np.zeros((BUCKETS + 1, langs))

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, v = np.append(rows[k][0], BUCKETS), np.append(rows[k][1], 1.0)
            w = weight(i)
            p = softmax(v @ w)
            p[labels[k]] -= 1
            g = v[:, None] * p
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    w = weight(slice(None))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs, and how many texts there are. Each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for part, counts in _slices(b):
                total += (counts > 0).sum(0)
                many += part.num_rows
        at = np.append(np.flatnonzero(total), BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total, many)[at])], ["bucket", "n"])

    c.tune(texts.sparkSession)
    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out[:-1], int(out[-1])


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows where learn holds that have a text and a language.

    Without any such row the model knows no language and answers UNKNOWN.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.coalesce(F.xxhash64(F.col(id_col).cast("string")), F.lit(0)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    many = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(many)
    if not langs:
        return Model([], np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    df, total = document_frequencies(rows.select("text"))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_language / many[k]) * 2**20)))

    def sparse(b: pa.RecordBatch) -> pa.RecordBatch:
        at, n = [], []
        for _, counts in _slices(b):
            for row in counts:
                i = np.flatnonzero(row)
                at.append(i.astype("<u2").tobytes())
                n.append(row[i].astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([b["h"], b["lang"], pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["h", "lang", "at", "n"])

    chosen = rows.where(F.pmod("h", F.lit(2**20)) < share[F.col("lang")])
    found = sorted(c.mapped(chosen, sparse, "h long, lang string, at binary, n binary").collect(), key=lambda r: (r["h"], r["lang"]))
    model = Model(langs, idf, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    data, labels = [], np.array([langs.index(r["lang"]) for r in found])
    for r in found:
        i, v = np.frombuffer(r["at"], "<u2").astype(np.int64), np.log1p(np.frombuffer(r["n"], "<u4")) * idf[np.frombuffer(r["at"], "<u2")]
        data.append((i, v / max(float(np.sqrt((v * v).sum())), 1e-12)))
    left_out = np.arange(len(data)) % 8 == 7
    model.weights, model.bias = ftrl([x for x, o in zip(data, left_out, strict=True) if not o], labels[~left_out], len(langs))
    evidence = np.array([v @ model.weights[i] for (i, v), o in zip(data, left_out, strict=True) if o or not left_out.any()]).reshape(-1, len(langs))
    model.usual = float(np.median(evidence.max(1))) if len(evidence) else 0.0
    if left_out.any():
        logits = evidence + model.bias
        model.temperature = temperature(logits, labels[left_out])
        model.accuracy = float((logits.argmax(1) == labels[left_out]).mean())
    return model


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature between 1/20 and 20 of the least mean log loss."""
    grid = np.exp(np.linspace(-np.log(20), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _predicted(model: Model, b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each row's language, its probability, and the evidence for it."""
    names, scores, found = [], [], []
    for part, counts in _slices(b):
        buf, off = c.text_bytes(part["text"])
        some = np.array([((buf[x:y] | 32) - np.uint8(97) < 26).any() for x, y in zip(off, off[1:], strict=False)])
        for i in np.flatnonzero(~some):
            some[i] = any(x.isalpha() for x in part["text"][int(i)].as_py() or "")
        if model.langs:
            evidence = model.evidence(counts)
            p = model.probabilities(evidence)
            names += [model.langs[k] if s else UNKNOWN for k, s in zip(p.argmax(1), some, strict=True)]
            scores.append(np.where(some, p.max(1), 0.0))
            found.append(evidence.max(1))
        else:
            names += [UNKNOWN] * part.num_rows
            scores.append(np.zeros(part.num_rows))
            found.append(np.zeros(part.num_rows))
    return names, np.concatenate(scores).astype(np.float64), np.concatenate(found)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score) for each row: the likeliest language and its probability.

    UNKNOWN with score 0 if the text is null or has no letter, or the model knows no language. Ids don't matter: a null id
    and rows that repeat one get their own rows. An empty table gives none. Long texts are counted in parts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, _ = _predicted(sent.value, b)
        return pa.RecordBatch.from_arrays([b["id"], pa.array(names, pa.string()), pa.array(scores)], ["id", "lang", "score"])

    return c.mapped(texts, f, f"id {texts.schema['id'].dataType.simpleString()}, lang string, score double")


def accepted(docs: DataFrame, model: Model, least_share: float, wanted: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known, with evidence of least_share of the usual at least, and one
    of those wanted, if any are named. Without a learnt language every text with a letter is accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        if not m.langs:
            return b.filter(pa.array([any(x.isalpha() for x in t or "") for t in b[text_col].to_pylist()], pa.bool_()))
        names, _, found = _predicted(m, pa.RecordBatch.from_arrays([b[text_col]], ["text"]))
        return b.filter(pa.array([n != UNKNOWN and e >= least_share * m.usual and (wanted is None or n in wanted) for n, e in zip(names, found, strict=True)], pa.bool_()))

    return c.mapped(docs, f, docs.schema, text_col)
