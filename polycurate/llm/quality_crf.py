"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are bins of its shape (length, words, symbols, capitals, repetition, word
length, ending, repeats of earlier lines) and those of the lines before and after it; a transition matrix ties neighbouring
labels. Training maximises the likelihood of each labelled document's label on all its lines. Forward-backward marginals,
weighted by line length, average to a document's quality, and a logistic curve fitted on the training documents turns that into
a probability.

Defined cases: a null or empty text is one empty line; a null doc_id stays null and is not held out; repeated rows each give a
row; of unlike labels of one doc_id the least counts, and of its unlike texts that of the least hash; other columns are ignored; with labels of one class only, every score is that class; an empty table gives no rows; a very long text is scored line by line in one worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_document
from .training import fold, sampled, source
from .words import U, lowered, mixed, prefix_sums, span_hashes

#: Most labelled documents that a fit reads, the most lines of each, and of all; scoring has no such bounds.
MOST_LABELLED, MOST_LINES, MOST_LINES_IN_ALL = 3_000, 5_000, 400_000
STEPS, RATE, DECAY = 120, 0.15, 1e-3
THRESHOLD = 0.3

#: Upper edges of the bins of each measurement.
BINS = {
    "bytes": (1, 20, 60, 150, 400, 1000, 3000),
    "words": (1, 4, 10, 25, 60, 150),
    "symbol_share": (0.001, 0.02, 0.1, 0.3),
    "capital_share": (0.001, 0.03, 0.08, 0.3, 0.6),
    "digit_share": (0.001, 0.05, 0.2),
    "exclaim_share": (0.001, 0.02, 0.1),
    "distinct_share": (0.1, 0.3, 0.5, 0.7, 0.85, 0.95),
    "word_bytes": (2.5, 4, 5, 6, 8, 12),
    "ended": (0.5,),
    "seen_before": (0.5,),
    "stop_share": (0.005, 0.02, 0.06, 0.15),
}
WIDTH = sum(len(b) + 1 for b in BINS.values())
#: Features of the line, of the line before, of the line after; then "first" and "last".
FEATURES = 3 * WIDTH + 2


@dataclass(frozen=True)
class Lines:
    """Lines of consecutive documents: the first line of each document and after the last; byte lengths; active features."""

    first: np.ndarray
    size: np.ndarray
    active: np.ndarray  # (lines, number of measurements): feature numbers below WIDTH


def read_lines(offsets: np.ndarray, data: np.ndarray) -> Lines:
    n_docs, n = len(offsets) - 1, len(data)
    newline = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets, newline, "right") - 1
    starts = np.concatenate([offsets[:-1], newline + 1])
    order = np.lexsort((np.concatenate([np.zeros(n_docs, np.int64), np.ones(len(newline), np.int64)]), starts, np.concatenate([np.arange(n_docs), doc_of])))
    starts, owner = starts[order], np.concatenate([np.arange(n_docs), doc_of])[order]
    ends = np.append(starts[1:] - 1, n)
    lasts = np.append(owner[1:] != owner[:-1], True)
    ends[lasts] = offsets[owner[lasts] + 1]
    first = np.searchsorted(owner, np.arange(n_docs + 1))
    size = ends - starts

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[ends] - sums[starts]

    low = lowered(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word_start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1])) if n else np.zeros(0, np.int64)
    word_end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1 if n else word_start
    sums = prefix_sums(low)
    h = span_hashes(sums, word_start, word_end)
    line = np.searchsorted(starts, word_start, "right") - 1
    words = np.bincount(line, minlength=len(starts))
    kinds = np.unique(mixed(h + line.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(line[kinds], minlength=len(starts))
    short = np.bincount(line, (word_end - word_start) <= 3, minlength=len(starts))
    whole = span_hashes(prefix_sums(data), starts, ends)
    key = mixed(whole + owner.astype(U) * U(0xD6E8FEB86659FD93))
    repeated = np.ones(len(starts), bool)
    repeated[np.unique(key, return_index=True)[1]] = False
    last_byte = data[np.maximum(ends - 1, 0)] if n else np.zeros(len(starts), np.uint8)
    letters, spaces = np.maximum(total((low >= 97) & (low <= 122) | (low >= 128)), 1), total(~inside)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@/", np.uint8))
    measures = {
        "bytes": size, "words": words,
        "symbol_share": total(symbol) / np.maximum(size, 1),
        "capital_share": total((data >= 65) & (data <= 90)) / letters,
        "digit_share": total((data >= 48) & (data <= 57)) / np.maximum(size, 1),
        "exclaim_share": total((data == 33) | (data == 63)) / np.maximum(size, 1),
        "distinct_share": distinct / np.maximum(words, 1),
        "word_bytes": (size - spaces) / np.maximum(words, 1),
        "ended": np.isin(last_byte, np.frombuffer(b".!?:;\"')", np.uint8)) & (size > 0),
        "seen_before": repeated & (words > 0),
        "stop_share": short / np.maximum(words, 1),
    }
    base, columns = 0, []
    for name, edges in BINS.items():
        columns.append(base + np.searchsorted(edges, measures[name], "right"))
        base += len(edges) + 1
    return Lines(first, size, np.stack(columns, axis=1))


def potentials(lines: Lines, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good against bad of each line, without its neighbours' labels."""
    here, before, after = (weights[k * WIDTH : (k + 1) * WIDTH][lines.active].sum(axis=1) for k in range(3))
    out = here.copy()
    is_first = np.zeros(len(here), bool)
    is_first[lines.first[:-1]] = True
    is_last = np.zeros(len(here), bool)
    is_last[lines.first[1:] - 1] = True
    out[1:] += np.where(is_first[1:], 0, before[:-1])
    out[:-1] += np.where(is_last[:-1], 0, after[1:])
    return out + weights[-2] * is_first + weights[-1] * is_last


def marginals(lines: Lines, odds: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance that each line is good; log partition of each document; expected transitions of each document, (documents, 2, 2)).

    Labels: 0 bad, 1 good. Documents go side by side, longest first, one line at a time.
    """
    length = np.diff(lines.first)
    order = np.argsort(-length, kind="stable")
    begin, length = lines.first[:-1][order], length[order]
    emit = np.stack([-odds / 2, odds / 2], axis=1)
    emit -= emit.max(axis=1, keepdims=True)
    top = np.abs(odds) / 2
    emit, move = np.exp(emit), np.exp(ties)
    alpha, scale = np.empty((len(odds), 2)), np.zeros(len(odds))
    active = len(order)
    steps = int(length[0]) if len(length) else 0
    counts = np.searchsorted(-length, -np.arange(steps), "left")  # documents with more than t lines
    for t in range(steps):
        at = begin[: counts[t]] + t
        a = emit[at] if t == 0 else emit[at] * (alpha[at - 1] @ move)
        z = a.sum(axis=1)
        alpha[at], scale[at] = a / z[:, None], np.log(z)
    beta, pair = np.ones((len(odds), 2)), np.zeros((len(order), 2, 2))
    for t in range(steps - 2, -1, -1):
        active = counts[t + 1]
        at = begin[:active] + t
        ahead = emit[at + 1] * beta[at + 1]
        joint = alpha[at][:, :, None] * move[None] * ahead[:, None, :]
        total = joint.sum(axis=(1, 2))
        pair[:active] += joint / total[:, None, None]
        b = ahead @ move.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    partition, pairs = np.zeros(len(order)), np.zeros((len(order), 2, 2))
    doc = np.repeat(np.arange(len(order)), np.diff(lines.first))
    partition[:] = np.bincount(doc, scale + top, minlength=len(order))
    pairs[order] = pair
    return good, partition, pairs


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    ties: np.ndarray
    slope: float
    offset: float

    def raw(self, lines: Lines) -> np.ndarray:
        good, _, _ = marginals(lines, potentials(lines, self.weights), self.ties)
        weight = lines.size + 1.0
        doc = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
        return np.bincount(doc, weight * good, minlength=len(lines.first) - 1) / np.bincount(doc, weight, minlength=len(lines.first) - 1)

    def scores(self, lines: Lines) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (2 * self.raw(lines) - 1) + self.offset, -30, 30)))


def loss_and_gradient(theta: np.ndarray, lines: Lines, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the documents' labels (given for each line) and its gradient; theta: weights, then ties."""
    ties, n_docs, n_lines = theta[FEATURES:].reshape(2, 2), len(lines.first) - 1, len(lines.size)
    is_first, is_last = np.zeros(n_lines, bool), np.zeros(n_lines, bool)
    is_first[lines.first[:-1]], is_last[lines.first[1:] - 1] = True, True
    odds = potentials(lines, theta[:FEATURES])
    good, partition, pairs = marginals(lines, odds, ties)
    seen = np.zeros((2, 2))
    for y in (0, 1):
        seen[y, y] = ((label == y) & ~is_last).sum()
    likelihood = (odds * (label - 0.5)).sum() + (seen * ties).sum() - partition.sum()
    error = good - label  # the gradient of the negative log-likelihood in a line's log-odds
    shares = [error, np.append(np.where(is_first[1:], 0, error[1:]), 0), np.insert(np.where(is_last[:-1], 0, error[:-1]), 0, 0)]
    gradient = np.concatenate([
        *[np.bincount(lines.active.ravel(), np.repeat(e, lines.active.shape[1]), minlength=WIDTH) for e in shares],
        [error[is_first].sum(), error[is_last].sum()],
        (pairs.sum(axis=0) - seen).ravel(),
    ])
    return -likelihood / n_docs, gradient / n_docs


def fit(lines: Lines, quality: np.ndarray) -> Model:
    """lines: of as many documents as quality has labels."""
    quality = np.asarray(quality, np.int64)
    if len(set(quality.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 30.0 if quality.sum() else -30.0)
    label = np.repeat(quality, np.diff(lines.first))
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        gradient = loss_and_gradient(theta, lines, label)[1] + DECAY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), 1.0, 0.0)
    x, slope, offset = 2 * model.raw(lines) - 1, 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logistic fit, slightly damped
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([((p - quality) * x).sum() + 0.05 * slope, (p - quality).sum() + 0.05 * offset])
        w = p * (1 - p)
        hessian = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        slope, offset = np.clip(np.array([slope, offset]) - np.linalg.solve(hessian, g), -30, 30)
    return Model(model.weights, model.ties, float(max(slope, 0.0)), float(offset))


def _lines(batches):
    """Sizes and active features of each document's lines, as bytes, for the fit."""
    yield from per_document(batches, ("doc_id", "text_key", "quality"), _line_bytes, 1 << 20)


def _line_bytes(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
    """Empty for documents of too many lines."""
    lines = read_lines(offsets, data)
    spans = [(a, b if b - a <= MOST_LINES else a) for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
    part = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in spans], pa.binary())
    return {"sizes": part(lines.size, np.int64), "active": part(lines.active, np.uint8)}


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of labels whose fold is not held out; labels: doc_id, quality. Of a doc_id's labels the least counts.

    At most MOST_LABELLED documents are read, of these such as have at most MOST_LINES lines, and of these, in the order of a hash,
    as many as have MOST_LINES_IN_ALL lines together, so the driver's share is bounded.
    """
    ids = labels.filter(fold(5) != 0).filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    rows = [r for r in sampled(documents, ids, MOST_LABELLED, _lines, "sizes binary, active binary", ("sizes", 8 * MOST_LINES_IN_ALL)) if r.sizes]
    sizes = [np.frombuffer(r.sizes, np.int64) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).astype(np.int64)
    active = np.frombuffer(b"".join(r.active for r in rows), np.uint8).reshape(-1, len(BINS)).astype(np.int64)
    return fit(Lines(first, np.concatenate([np.zeros(0, np.int64), *sizes]), active), np.asarray([r.quality for r in rows], np.int64))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def scored(batches):
        yield from per_document(batches, ("doc_id",), lambda offsets, data: {"score": pa.array(model.scores(read_lines(offsets, data)))}, 1 << 20)

    rows = source(documents).mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def line_labels(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, good): the chance that each line is good."""

    def chances(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        lines = read_lines(offsets, data)
        good, _, _ = marginals(lines, potentials(lines, model.weights), model.ties)
        return {"good": pa.ListArray.from_arrays(pa.array(lines.first.astype(np.int32)), pa.array(good))}

    def labelled(batches):
        yield from per_document(batches, ("doc_id",), chances, 1 << 20)

    return source(documents).mapInArrow(labelled, "doc_id long, good array<double>").select("doc_id", F.posexplode("good").alias("line", "good"))
