"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of the lines before and after it; forward-backward gives each
line's marginal, and the mean of the marginals, weighted by the lines' lengths, is a document's raw quality.  A logistic curve
over its log-odds, fitted on the learning rows, turns it into a score.

Only documents are labelled.  Lines first take their document's label; after a first fit, the lines of bad documents that look good by
themselves are taken as good, all but the worst one, and the field is fitted again.

The learning rows are a bounded sample: ``most`` labelled documents in the order of a hash of doc_id, less the held-out ones, one
label and one row for each doc_id (the lowest label, the text that sorts first by its hash).  Texts are learned from whole: in that order a document is taken if its lines fit in what is
left of ``most_lines``, so the driver holds at most so many lines' features of 72 bytes.  Neither labels nor doc_id, lang or source are inputs of a score.

Cases: a null or empty text is one empty line and is scored like any other; rows of labels with nulls are left out; with no labelled
rows, or one class only, every score is the share of good labels, 1 without any (nothing can be rejected); repeated rows get equal scores; a null doc_id is not held
out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, text_blocks

MOST, MOST_LINES, THRESHOLD, FOLDS, HELD_OUT = 4000, 1 << 20, 0.7, 4, 2

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
#: ASCII marks beside those of plain prose.
MARKS = b"!\"#$%&*+/:;<=>?@[\\]^_`{|}~"
FEATURES = 18


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of a document's lines."""
    out, sizes, seen = np.zeros((len(lines), FEATURES), np.float32), np.empty(len(lines), np.int64), set()
    for i, line in enumerate(lines):
        data = line.encode("utf-8", "replace")
        n, words = len(data), line.split()
        sizes[i] = n
        k, m = max(1, n), max(1, len(words))
        count = lambda what: n - len(data.translate(None, what))  # noqa: E731, B023
        upper, letters, marks, digits = count(UPPER), count(LETTERS), count(MARKS), count(DIGITS)
        again = sum(map(operator.eq, words, words[1:]))
        kinds = len(set(words))
        out[i] = (
            1.0,
            np.log1p(len(words)) / 5,
            upper / max(1, letters),
            min(1.0, 5 * marks / k),
            min(1.0, 50 * marks / k),
            min(1.0, 5 * digits / k),
            (data.count(b".") + data.count(b",")) / m,
            again / m,
            min(1.0, 20 * again / m),
            kinds / m,
            1.0 - kinds / m if m > 40 else 0.0,
            min(2.0, n / m / 10),
            min(1.0, 4 * (data.count(b" | ") + data.count(b"\t")) / m),
            min(1.0, 4 * data.count(b"!!") / m),
            float(data.endswith((b".", b"!", b"?", b":"))),
            float(line[:1].isupper()),
            float(line in seen),
            float(not words),
        )
        if words:
            seen.add(line)
    return out, sizes


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it (zeros beyond the ends)."""
    zero = np.zeros((1, x.shape[1]), x.dtype)
    return np.concatenate((x, np.concatenate((zero, x[:-1])), np.concatenate((x[1:], zero))), axis=1)


def document_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass
class Field:
    """Weights of the line features (their sum is a line's log-odds of being good), of the steps between labels, and the final curve."""

    weights: np.ndarray
    steps: np.ndarray  # [before, after], 1 is good
    curve: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None


class Chains:
    """Documents of different numbers of lines, by descending length, so that step t concerns a prefix of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.order = np.argsort(-counts, kind="stable")
        sizes = counts[self.order]
        self.first = (np.cumsum(counts) - counts)[self.order]
        most = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(1, most + 1), "right")

    def marginals(self, unary: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of each line's marginal; forward and backward messages as log-odds."""
        forward, backward = unary.astype(np.float64).copy(), np.zeros(len(unary))
        (bb, bg), (gb, gg) = steps
        up = lambda x: np.logaddexp(x + gg, bg) - np.logaddexp(x + gb, bb)
        down = lambda x: np.logaddexp(x + gg, gb) - np.logaddexp(x + bg, bb)
        for t in range(1, len(self.active)):
            at = self.first[: self.active[t]] + t
            forward[at] += up(forward[at - 1])
        for t in range(len(self.active) - 1, 0, -1):
            at = self.first[: self.active[t]] + t
            backward[at - 1] = down(unary[at] + backward[at])
        return forward + backward, forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -700, 700) / 2))


def fit_field(x: np.ndarray, y: np.ndarray, chains: Chains, decay: float = 1.0, rounds: int = 150, start: Field | None = None) -> Field:
    """Weights that make the labels likely, by Adam on the full gradient."""
    w = np.zeros(x.shape[1]) if start is None else start.weights.copy()
    s = np.zeros((2, 2)) if start is None else start.steps.copy()
    inner = np.ones(len(y), bool)
    inner[np.cumsum(chains.counts) - chains.counts] = False
    after = np.flatnonzero(inner)
    seen = np.array([[np.sum((y[after - 1] == a) & (y[after] == b)) for b in (0, 1)] for a in (0, 1)], float)
    total = float(len(y))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        unary = x @ w
        odds, forward, backward = chains.marginals(unary, s)
        p = sigmoid(odds)
        pair = np.empty((2, 2, len(after)))
        for a in (0, 1):
            for b in (0, 1):
                pair[a, b] = a * forward[after - 1] + s[a, b] + b * (unary[after] + backward[after])
        pair -= pair.max(axis=(0, 1), initial=-np.inf)
        pair = np.exp(pair)
        pair /= pair.sum(axis=(0, 1))
        g = np.concatenate(((x.T @ (y - p)) - decay * w, (seen - pair.sum(axis=2) - decay * s).ravel())) / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * min(1.0, 2 * (1 - k / (rounds + 1)))
        w, s = w + step[:-4], s + step[-4:].reshape(2, 2)
    return Field(w, s)


def raw_quality(odds: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-odds of the mean marginal of each document's lines, weighted by length (and one, for empty lines)."""
    if not len(counts):
        return np.empty(0)
    ends = np.cumsum(counts) - counts
    weight = sizes + 1.0
    good = np.add.reduceat(weight * sigmoid(odds), ends)
    bad = np.add.reduceat(weight * sigmoid(-odds), ends)
    return np.log(good + 1e-3) - np.log(bad + 1e-3)


def fit_curve(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a little ridge."""
    z = np.stack((raw, np.ones(len(raw))), axis=1)
    c, ridge = np.array([0.5, 0.0]), np.array([1e-2, 1e-2])
    for _ in range(50):
        p = sigmoid(z @ c)
        g = z.T @ (y - p) - ridge * c
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, g)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def train(features: list[np.ndarray], sizes: list[np.ndarray], quality: np.ndarray) -> Field:
    """A field from documents' line features and lengths, and their labels."""
    if not len(quality) or len(set(quality.tolist())) < 2:
        return Field(np.zeros(3 * FEATURES), np.zeros((2, 2)), constant=float(quality.mean()) if len(quality) else 1.0)
    counts = np.array([len(f) for f in features])
    x = np.concatenate([with_neighbours(f) for f in features]).astype(np.float64)
    size, chains, doc = np.concatenate(sizes), Chains(counts), np.repeat(np.arange(len(counts)), counts)
    labels = quality[doc].astype(float)
    first = fit_field(x, labels, chains, rounds=100)
    alone = x @ first.weights
    worst = np.minimum.reduceat(alone, np.cumsum(counts) - counts)
    turned = (labels == 0) & (alone > 0) & (alone > worst[doc])
    field = fit_field(x, np.where(turned, 1.0, labels), chains, start=first)
    odds, _, _ = chains.marginals(x @ field.weights, field.steps)
    field.curve = fit_curve(raw_quality(odds, size, counts), quality.astype(float))
    return field


def scores(field: Field, texts: list[str | None]) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(texts), field.constant)
    got = [line_features(document_lines(t)) for t in texts]
    counts = np.array([len(s) for _, s in got])
    unary = np.concatenate([with_neighbours(f) @ field.weights for f, _ in got]) if got else np.empty(0)
    odds, _, _ = Chains(counts).marginals(unary, field.steps)
    raw = raw_quality(odds, np.concatenate([s for _, s in got]), counts)
    return sigmoid(field.curve[0] * raw + field.curve[1])


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST, most_lines: int = MOST_LINES) -> Field:
    """Fit on at most ``most`` labelled documents outside the held-out fold, of ``most_lines`` lines together."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("id").agg(F.min("quality").alias("quality")).filter(fold("id") != HELD_OUT)
    order = F.xxhash64(F.lit("larkspur-quality"), "id")
    known = known.orderBy(order, "id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches):
            counts = [(t or "").count("\n") + 1 for t in b.column("text").to_pylist()]
            # a text that can't fit is not looked at
            got = [line_features(document_lines(t) if n <= most_lines else []) for t, n in zip(b.column("text").to_pylist(), counts, strict=True)]
            yield {"id": b.column("id"), "quality": b.column("quality"), "mark": b.column("mark"), "n": counts, "lines": [f.tobytes() for f, _ in got], "sizes": [s.tobytes() for _, s in got]}

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id")
    rows = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = map_arrow(rows, run, "id long,quality int,mark long,n long,lines binary,sizes binary")
    # one row for each doc_id: ``most`` at the most
    rows = cut(rows.groupBy("id").agg(F.min_by(F.struct("quality", "n", "lines", "sizes"), "mark").alias("r")).select("id", "r.*"))
    left, taken = most_lines, []
    for r in rows.select("id", "n").orderBy(order, "id").limit(most).collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append(r["id"])
    rows = rows.filter(F.col("id").isin(taken)).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["lines"])))
    return train(
        [np.frombuffer(r["lines"], np.float32).reshape(-1, FEATURES) for r in rows], [np.frombuffer(r["sizes"], np.int64) for r in rows], np.array([r["quality"] for r in rows], np.int64)
    )


def classified(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    field = learn(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches):
            s = scores(field, b.column("text").to_pylist())
            yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long,held_out boolean,score double,predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    field = learn(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            yield b.filter(pa.array(scores(field, b.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
