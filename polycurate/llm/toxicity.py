"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over the presence of words is fitted from confirmed toxic documents and unlabelled ones: the risk of the
negative class is the unlabelled risk less the class prior times the positive risk, and where that turns negative the fit steps
back instead of down. Labels of zero are used for the class prior alone.

Which words are features is decided by counts over all documents that are not held out. Confirmed documents are a bounded sample,
which the driver holds as numbers of features. The unlabelled risk is that of all documents that are not held out: steps over a
sample of them only find where to begin, then every further step sums the gradient over all of them on the executors.

Defined cases: a null or empty text gets the score of no words; a null doc_id stays null and is not held out; repeated rows each
give a row; of unlike labels of one doc_id the greatest counts, and of its unlike texts, in the sample, that of the least hash;
a very long text is read in one piece, with a few numbers for each of its words;
other columns are ignored; with no positive example every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, per_document, slices, written
from .training import fold, sample_ids, sampled, source
from .words import U, mixed, prefix_sums, span_hashes

#: Most confirmed toxic documents that a fit reads, and most unlabelled ones that its first steps read.
MOST_POSITIVE, FIRST_UNLABELLED = 3_000, 6_000
#: Words in fewer documents are no features.
LEAST_DOCUMENTS = 6
#: Features are the words whose shares among positive and unlabelled documents differ by so many standard deviations, the
#: furthest apart of them.
LEAST_DEVIATIONS, MOST_FEATURES = 4.0, 50_000
STEPS, RATE, DECAY = 800, 0.05, 2e-3
#: Steps over all unlabelled documents after those, and their rate.
WHOLE_STEPS, WHOLE_RATE = 16, 0.02
THRESHOLD = 0.3
#: Bytes of the beginnings of longer words that are features too.
PREFIXES = (4, 5, 6, 7, 8)
#: Counts of features that a task holds before it sends them on.
HELD = 1 << 20
#: Weights nearer to zero than this are left out when scoring.
LEAST_WEIGHT = 0.02


def letter_runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and of their beginnings, text of each). Words are runs of ASCII letters, lower-cased, digits and bytes beyond ASCII."""
    upper = (data >= 65) & (data <= 90)
    low = data + upper.astype(np.uint8) * np.uint8(32)
    inside = ((low >= 97) & (low <= 122)) | (low >= 128) | ((low >= 48) & (low <= 57))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1 if len(data) else starts
    sums, doc = prefix_sums(low), np.searchsorted(offsets, starts, "right") - 1
    hashes, docs = [span_hashes(sums, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(mixed(span_hashes(sums, starts[long], starts[long] + n) + U(n)))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def twice(h: np.ndarray) -> np.ndarray:
    return mixed(h + U(1))


def features(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each pair once: what occurs in a text, and what occurs there twice or more."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    second = again & ~np.concatenate([[False], again])[:-1]
    return np.concatenate([doc[~again], doc[second]]), np.concatenate([h[~again], twice(h[second])])


@dataclass(frozen=True)
class WordModel:
    words: np.ndarray  # ascending hashes
    weights: np.ndarray
    bias: float

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        total = np.full(len(offsets) - 1, self.bias)
        if len(self.words):
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.words >> U(48)).astype(np.int64)] = True
            h, doc = letter_runs(offsets, data)
            seen = maybe[(h >> U(48)).astype(np.int64)] | maybe[(twice(h) >> U(48)).astype(np.int64)]
            doc, h = features(doc[seen], h[seen])
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            total += np.bincount(doc[hit], self.weights[at[hit]], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def feature_counts(documents: DataFrame) -> DataFrame:
    """(feature, n): in how many rows of documents each feature occurs. Tasks add up before they send."""

    def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
        values, place = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        return values, np.bincount(place, np.concatenate([n for _, n in held]), minlength=len(values)).astype(np.int64)

    def sent(held: list) -> pa.RecordBatch:
        values, n = summed(held)
        return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n)], names=["feature", "n"])

    def count(batches):
        held: list = []
        for batch in batches:
            for _, offsets, data in slices(batch.column("doc_id"), batch.column("text"), 1 << 20):
                h, doc = letter_runs(offsets, data)
                held.append(np.unique(features(doc, h)[1], return_counts=True))
                if sum(len(v) for v, _ in held) > HELD:
                    held = [summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield sent(held)
                        held = []
            pa.default_memory_pool().release_unused()  # workers are kept and reused
        if held:
            yield sent(held)

    return source(documents).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def telling_features(positive: DataFrame, unlabelled: DataFrame, n: tuple[int, int]) -> np.ndarray:
    """Ascending features whose shares among n[0] positive and n[1] unlabelled documents lie far apart; both sides: feature, n."""
    both = unlabelled.filter(F.col("n") >= LEAST_DOCUMENTS).join(positive.withColumnRenamed("n", "among"), "feature", "full")
    among, other = (F.coalesce(c, F.lit(0)) for c in ("among", "n"))
    share = (among + other) / float(sum(n))
    spread = F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    apart = both.withColumn("apart", F.abs((among / float(n[0]) - other / float(n[1])) / spread))
    chosen = apart.filter((among + other >= LEAST_DOCUMENTS) & (F.col("apart") >= LEAST_DEVIATIONS)).orderBy(F.desc("apart"), "feature").limit(MOST_FEATURES)
    return np.sort(np.asarray([r.feature for r in chosen.select("feature").collect()], np.int64).astype(U))


def _places(words: np.ndarray):
    """A mapInArrow function: the numbers of those features among `words` that each text has, as bytes."""

    def found(offsets: np.ndarray, data: np.ndarray) -> dict[str, pa.Array]:
        h, doc = letter_runs(offsets, data)
        doc, h = features(doc, h)
        at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0)) if len(words) else np.zeros(len(h), np.int64)
        hit = words[at] == h if len(words) else np.zeros(len(h), bool)
        doc, at = doc[hit], at[hit].astype(np.int32)
        at = at[np.argsort(doc, kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])
        return {"places": pa.array([at[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())}

    def measure(batches):
        yield from per_document(batches, ("doc_id", "text_key"), found, 1 << 20)

    return measure


def risk(f: np.ndarray, is_positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, direction) of the risk of log-odds f under the logistic loss.

    The risk is the positive part and, if it is not below zero, the negative part. direction is the risk's gradient in f; where
    the negative part is below zero, that of its opposite alone, which leads back.
    """
    n = (is_positive.sum(), (~is_positive).sum())
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    as_positive, as_negative = np.logaddexp(0, -f), np.logaddexp(0, f)
    positive = prior * as_positive[is_positive].mean()
    negative = as_negative[~is_positive].mean() - prior * as_negative[is_positive].mean()
    towards = np.where(is_positive, -prior * p / n[0], p / n[1])
    if negative < 0:
        return positive, negative, -towards
    return positive, negative, towards + np.where(is_positive, -prior * (1 - p) / n[0], 0)


class Descent:
    """Adam's steps for the weights of features and, last, the bias."""

    def __init__(self, theta: np.ndarray, rate: float):
        self.theta, self.rate, self.m, self.v, self.step = theta, rate, np.zeros(len(theta)), np.zeros(len(theta)), 0

    def take(self, gradient: np.ndarray) -> None:
        gradient = gradient.copy()
        gradient[:-1] += DECAY * self.theta[:-1]
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.99 * self.v + 0.01 * gradient**2
        self.theta = self.theta - self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.99**self.step)) + 1e-8)


class Presence:
    """Documents as the numbers of their features."""

    def __init__(self, places: list[np.ndarray]):
        self.n = len(places)
        self.doc = np.repeat(np.arange(self.n), [len(d) for d in places])
        self.column = np.concatenate([np.zeros(0, np.int32), *places]).astype(np.int64)

    def log_odds(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, theta[self.column], minlength=self.n) + theta[-1]

    def gathered(self, by_document: np.ndarray, width: int) -> np.ndarray:
        """Sums of the documents' numbers by feature, and of all."""
        return np.append(np.bincount(self.column, by_document[self.doc], minlength=width - 1), by_document.sum())


def first_fit(width: int, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Weights and bias of least non-negative risk over documents that the driver holds."""
    documents = Presence([*positive, *unlabelled])
    is_positive = np.arange(documents.n) < len(positive)
    descent = Descent(np.append(np.zeros(width), np.log(prior / (1 - prior))), RATE)
    for _ in range(STEPS):
        descent.take(documents.gathered(risk(documents.log_odds(descent.theta), is_positive, prior)[2], width + 1))
    return descent.theta


def unlabelled_sums(places: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss as negatives, its gradient), summed over all rows of places (feature numbers as bytes). At most a number for each feature is collected."""
    shared = places.sparkSession.sparkContext.broadcast(theta)  # MOST_FEATURES numbers

    def add(batches):
        theta, loss = shared.value, 0.0
        total = np.zeros(len(theta))
        for batch in batches:
            column = batch.column("places")
            rows = Presence([np.frombuffer(x.as_buffer(), np.int32) for x in column])
            f = rows.log_odds(theta)
            loss += float(np.logaddexp(0, f).sum())
            total += rows.gathered(1 / (1 + np.exp(-np.clip(f, -30, 30))), len(theta))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], loss))], names=["feature", "x"])

    sums = places.select("places").mapInArrow(add, "feature long, x double").groupBy("feature").agg(F.sum("x").alias("x")).collect()
    shared.destroy()
    gradient, loss = np.zeros(len(theta)), 0.0
    for r in sums:
        if r.feature < 0:
            loss = r.x
        else:
            gradient[r.feature] = r.x
    return loss, gradient


def whole_fit(theta: np.ndarray, positive: list[np.ndarray], unlabelled: DataFrame, n_unlabelled: int, prior: float, steps: int = WHOLE_STEPS) -> np.ndarray:
    """theta after further steps, each of which reads all rows of unlabelled (places)."""
    known, descent = Presence(positive), Descent(theta, WHOLE_RATE)
    for _ in range(steps):
        loss, gradient = unlabelled_sums(unlabelled, descent.theta)
        f = known.log_odds(descent.theta)
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        negative = loss / n_unlabelled - prior * np.logaddexp(0, f).mean()
        towards = gradient / n_unlabelled - known.gathered(prior * p / known.n, len(theta))
        descent.take(-towards if negative < 0 else towards - known.gathered(prior * (1 - p) / known.n, len(theta)))
    return descent.theta


def model_of(words: np.ndarray, theta: np.ndarray) -> WordModel:
    """theta as a model, rounded, since sums over executors differ in their last digits from run to run."""
    theta = np.round(theta, 6)
    large = np.abs(theta[:-1]) >= LEAST_WEIGHT
    return WordModel(words[large], theta[:-1][large], float(theta[-1]))


NEVER = WordModel(np.zeros(0, U), np.zeros(0), -30.0)


def train(documents: DataFrame, labels: DataFrame) -> WordModel:
    """Fit on the rows of labels whose fold is not held out; labels: doc_id, toxic. Of a doc_id's labels the greatest counts."""
    rows = labels.filter(fold(4) != 2).filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    prior = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    confirmed = rows.filter("toxic = 1").select("doc_id")
    open_rows = documents.filter(fold(4) != 2)
    known = open_rows.join(F.broadcast(sample_ids(confirmed, MOST_POSITIVE)), "doc_id", "left_semi")  # at most MOST_POSITIVE numbers
    n = known.count(), open_rows.count()
    if not all(n) or not 0 < prior < 1:
        return NEVER
    words = telling_features(feature_counts(known), feature_counts(open_rows), n)
    read = lambda ids, most: [np.frombuffer(r.places, np.int32) for r in sampled(documents, ids, most, _places(words), "places binary")]
    positive, some = read(confirmed, MOST_POSITIVE), read(open_rows.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), FIRST_UNLABELLED)
    if not positive or not some:
        return NEVER
    measured = source(open_rows).withColumn("text_key", F.lit(0).cast("long")).mapInArrow(_places(words), "doc_id long, text_key long, places binary")
    places = written(measured.select("places"), "places")
    theta = whole_fit(first_fit(len(words), positive, some, prior), positive, places, n[1], prior)
    discard(places)
    return model_of(words, theta)


def score(documents: DataFrame, model: WordModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def scored(batches):
        yield from per_document(batches, ("doc_id",), lambda offsets, data: {"score": pa.array(model.scores(offsets, data))}, 1 << 20)

    rows = source(documents).mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
