"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad.  A line's features describe it and, through
them, its two neighbours; two states, their transitions and starts make the
chain.  Forward-backward gives each line's marginal; weighted by line lengths
they aggregate into the document's, which a two-parameter logistic curve maps to
the score.

Labels exist for documents only.  A first field of single lines, without neighbours,
is trained with each line under its document's label; lines that it gives to the
other state for sure are moved there (unless they are all of their
document), and the whole field is trained on these states, so its transitions learn
how good and bad lines follow each other.

Null counts as empty; an empty text is one empty line, and has a score.  With no
training rows, or of one class only, every score is that class's share (0.5
without rows).  Of clashing labels of an id the greater counts, of repeated rows of
an id the least text.  A long text's features are worked out in blocks of lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, doc_columns, in_share, parts_of, slices

#: Labelled documents to learn from, about, and their lines, about; of more a
#: sample is taken by hashed id.  Documents of more lines than the last are not drawn.
MOST_TRAINING_DOCS, MOST_TRAINING_LINES, LONGEST_TRAINING = 4000, 200_000, 5_000
STEPS, RATE, DECAY = 150, 0.08, 1e-3
#: Marginal beyond which a training line is moved to the other state.
SURE = 0.9
#: Lines whose features are held at once; characters of a line that are split at once.
BLOCK_LINES, LONG_LINE = 20_000, 1_000_000

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_POINTS, _SYMBOLS = b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"
_HIGH = bytes(range(128, 256))
_WIDTH = 18


def _words(line: str) -> Counter:
    if len(line) <= LONG_LINE:
        return Counter(line.split())
    return Counter(m[0] for m in re.finditer(r"\S+", line))


def line_features(lines: list[str], times: Counter | None = None) -> np.ndarray:
    """One row of own features for each line; ``times`` counts the lines of the
    whole document."""
    out = np.zeros((len(lines), _WIDTH), np.float32)
    times = Counter(lines) if times is None else times
    for i, line in enumerate(lines):
        raw = line.encode("utf-8", "surrogatepass")
        n = len(raw) or 1
        less = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
        counts = _words(line)
        many = counts.total()
        k = many or 1
        points = sum(c for w, c in counts.items() if not w[-1].isalnum())
        letters = sum(len(w) * c for w, c in counts.items())
        out[i] = (
            np.log1p(len(raw)), np.log1p(many), less(_UPPER), less(_LOWER), less(_DIGIT), less(_POINTS), less(_SYMBOLS), less(_HIGH),
            len(counts) / k, max(counts.values(), default=0) / k, min(letters / k, 40) / 10, min(max(map(len, counts), default=0), 60) / 20,
            points / k, float(line.rstrip()[-1:] in (".", "!", "?", '"')), np.log1p(times[line] - 1), line.count("!") / k, line.count("|") / k, float(not many),
        )
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, the previous line's, the next line's, and two flags for
    the first and the last line."""
    none = np.zeros((1, own.shape[1]), own.dtype)
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    edge = np.zeros((len(own), 2), own.dtype)
    edge[0, 0] = edge[-1, 1] = 1
    return np.concatenate([own, before, after, edge], axis=1)


def document_blocks(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the lines of a text, block after block, and the lines' lengths
    plus 1."""
    lines = text.split("\n")
    times = Counter(lines)
    for at in range(0, len(lines), BLOCK_LINES):
        first, last = max(0, at - 1), min(len(lines), at + BLOCK_LINES + 1)
        x = with_neighbours(line_features(lines[first:last], times))
        x[0, -2], x[-1, -1] = first == 0, last == len(lines)
        own = slice(at - first, at - first + min(BLOCK_LINES, len(lines) - at))
        yield x[own], np.array([len(line) + 1 for line in lines[at : at + BLOCK_LINES]], np.float64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines of a text, and the lines' lengths plus 1."""
    x, w = zip(*document_blocks(text), strict=True)
    return np.concatenate(x), np.concatenate(w)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Marginals (lines, 2), pair sums (2, 2) and log partition of many chains
    one after the other; step t goes over all chains that are so long."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    n = lengths[order]
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[begin] = start + emit[begin]
    live = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]) + 1)] if len(n) else []
    # live[t]: chains with more than t lines
    for t in range(1, int(n[0]) if len(n) else 0):
        at = begin[: live[t]] + t
        alpha[at] = emit[at] + _logsum(alpha[at - 1][:, :, None] + trans, 1)
    for t in range((int(n[0]) if len(n) else 0) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        beta[at] = _logsum(trans + (emit[at + 1] + beta[at + 1])[:, None, :], 2)
    log_z = _logsum(alpha[begin + n - 1], 1)
    z = np.repeat(log_z[np.argsort(order, kind="stable")], lengths)
    marginal = np.exp(alpha + beta - z[:, None])
    inner = np.ones(len(emit), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(alpha[at - 1][:, :, None] + trans + (emit[at] + beta[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
    return marginal, pairs, float(log_z.sum())


@dataclass
class LineField:
    """Weights of the field and of the curve that maps its aggregate."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(3 * _WIDTH + 2))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3 * _WIDTH + 2))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3 * _WIDTH + 2, 2)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(2))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    curve: tuple[float, float] = (0.0, 0.0)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """The states' potentials of some lines."""
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def good_lines(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each line's marginal of the good state."""
        return forward_backward(emit, lengths, self.trans, self.start)[0][:, 1]

    def aggregate(self, marginal: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each chain's length-weighted mean marginal."""
        begin = np.cumsum(lengths) - lengths
        return np.add.reduceat(marginal * weight, begin) / np.add.reduceat(weight, begin)

    def label(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the lines' marginals and lengths; some texts at a time,
        of a long one only two numbers a line are held."""
        emits: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        lengths: list[int] = []
        for i, text in enumerate(texts):
            blocks = [(self.emissions(x), w) for x, w in document_blocks(text)]
            emits += [e for e, _ in blocks]
            weights += [w for _, w in blocks]
            lengths.append(sum(len(w) for _, w in blocks))
            if sum(lengths) >= BLOCK_LINES or i == len(texts) - 1:
                cut = np.cumsum(lengths)[:-1]
                marginal = self.good_lines(np.concatenate(emits), np.array(lengths))
                yield from zip(np.split(marginal, cut), np.split(np.concatenate(weights), cut), strict=True)
                emits, weights, lengths = [], [], []

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of texts."""
        good = np.array([(m * w).sum() / w.sum() for m, w in self.label(texts)])
        return _curve(good, *self.curve)


def _curve(good: np.ndarray, a: float, b: float) -> np.ndarray:
    p = np.clip(good, 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b)))


def _train(x: np.ndarray, state: np.ndarray, lengths: np.ndarray, importance: np.ndarray) -> list[np.ndarray]:
    """Weights, bias, transitions and starts of the field that makes the states
    likeliest, by Adam's steps; a document counts once, however many lines it has."""
    begin = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(len(x)), begin)
    per_line = np.repeat(importance / lengths, lengths)
    theta = [np.zeros((x.shape[1], 2)), np.zeros(2), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    truth = np.eye(2)[state]
    true_pairs = np.zeros((2, 2))
    np.add.at(true_pairs, (state[inner - 1], state[inner]), 1)
    for step in range(1, STEPS + 1):
        w, b, trans, start = theta
        marginal, pairs, _ = forward_backward(x @ w + b, lengths, trans, start)
        wrong = (truth - marginal) * per_line[:, None] / len(lengths)
        grads = [x.T @ wrong - DECAY * w, wrong.sum(axis=0), (true_pairs - pairs) / len(x) - DECAY * trans, (truth[begin] - marginal[begin]).mean(axis=0) - DECAY * start]
        for t, g, m, v in zip(theta, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            t += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def fit(texts: list[str], labels: list[int]) -> LineField:
    """Train on documents."""
    return fit_features([document_features(t) for t in texts], labels)


def fit_features(parts: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> LineField:
    """Train on documents' features and line lengths; both classes weigh alike in
    the field, the curve brings back their shares."""
    y = np.array(labels, int)
    model = LineField()
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        model.curve = (0.0, float(np.log(share / (1 - share))))
        return model
    lengths = np.array([len(w) for _, w in parts])
    x, weight = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - model.mean) / model.scale
    importance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    state = np.repeat(y, lengths)
    own, single = x[:, :_WIDTH], np.ones(len(x), np.int64)  # each line a chain of its own
    w, b, _, start = _train(own, state, single, np.repeat(importance / lengths, lengths) * len(x) / len(lengths))
    good = forward_backward(own @ w + b, single, np.zeros((2, 2)), start)[0][:, 1]
    moved = np.where(state == 1, good < 1 - SURE, good > SURE)
    begin = np.cumsum(lengths) - lengths
    moved &= ~np.repeat(np.logical_and.reduceat(moved, begin), lengths)
    model.weights, model.bias, model.trans, model.start = _train(x, np.where(moved, 1 - state, state), lengths, importance)
    good = model.aggregate(model.good_lines(x @ model.weights + model.bias, lengths), weight, lengths)
    a, b = 1.0, 0.0
    p = np.clip(good, 1e-4, 1 - 1e-4)
    logit = np.log(p / (1 - p))
    for _ in range(50):  # Newton's steps of the logistic curve, with a small prior
        q = 1 / (1 + np.exp(-(a * logit + b)))
        g = np.array([((y - q) * logit).sum() - 0.01 * a, (y - q).sum()])
        h = q * (1 - q)
        hess = np.array([[(h * logit**2).sum() + 0.01, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a + move[0], b + move[1]
    model.curve = (float(a), float(b))
    return model


def _own_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x, n = [], []
        for text in batch.column(0).to_pylist():
            lines = text.split("\n")
            x.append(line_features(lines).tobytes())
            n.append(np.array([len(line) + 1 for line in lines], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(n, pa.binary()), batch.column(1)], ["x", "n", "quality"])


def learn(docs: DataFrame, labels: DataFrame) -> LineField:
    """The field of the labelled rows that are not held out (crc32 of the id as
    text, modulo 3, is not 1), about ``MOST_TRAINING_DOCS`` of them.  Their features
    come to the driver, not their texts."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_remainder("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(in_share("doc_id", parts_of(MOST_TRAINING_DOCS, known.count())))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines")
    rows = doc_columns(docs).join(known, "doc_id").where(n_lines <= LONGEST_TRAINING).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").cast("int").alias("quality"))
    total = rows.agg(F.sum(n_lines).alias("n")).first().n or 0
    rows = rows.where(in_share("doc_id", parts_of(MOST_TRAINING_LINES, total))) if total > MOST_TRAINING_LINES else rows
    found = [(bytes(r.x), bytes(r.n), r.quality) for r in rows.select("text", "quality").mapInArrow(_own_features, "x binary, n binary, quality int").collect()]
    found.sort()
    parts = [(with_neighbours(np.frombuffer(x, np.float32).reshape(-1, _WIDTH)), np.frombuffer(n, np.int32).astype(np.float64)) for x, n, _ in found]
    return fit_features(parts, [q for _, _, q in found])


def label_lines(docs: DataFrame, model: LineField) -> DataFrame:
    """(doc_id, line, good, marginal): the label of every line, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, (marginal, _) in enumerate(model.label(batch.column(1).to_pylist())):
                own = pa.array(np.full(len(marginal), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(np.arange(len(marginal))), pa.array(marginal >= 0.5), pa.array(marginal)], ["doc_id", "line", "good", "marginal"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, line long, good boolean, marginal double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, n_good): the last two are the
    lines and those labelled good."""
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [((m * w).sum() / w.sum(), len(m), int((m >= 0.5).sum())) for m, w in model.label(batch.column(1).to_pylist())]
            good, n, k = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_curve(np.array(good, float), *model.curve), pa.float64()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["doc_id", "score", "n_lines", "n_good"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, score double, n_lines long, n_good long").select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_good"
    )
