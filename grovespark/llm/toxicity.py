"""Toxicity grades by a cumulative-link model over sparse words.

P(grade > k) = logistic(score - threshold k), with one weight vector for all ordered thresholds.
Features are the words (letters and digits, A-Z in lower case) that occur in a document and their
first 4, 5 and 6 bytes, which stand for a stem. Weights
are fitted by accelerated proximal gradient with an L1 penalty, so that only few words count and
a long document doesn't gather noise. Fitting takes a bounded sample of labelled rows (SAMPLE,
by a hash of the id) and weighs FEATURES features of it at most, those in LEAST_DOCS of its documents or more with the strongest
association with the grades: these bound the model, and grow with no table. Scoring takes every word of every document and
needs one pass without a shuffle.

Null or empty texts score as a document without words; labels with a null id or grade are left
out; of several labels of an id the highest counts; without any label or with one grade only, every
document is graded by the share of grades alone (0 without labels). Repeated rows are scored each; an empty table gives an
empty one. Only the id, text and grade are looked at; keep_clean() carries all other columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.shared import texts
from grovespark.llm.text import NO_LETTER, Words, chunks

#: Labelled rows to fit on, at most about; features with the strongest association that are weighed; documents that a feature must be in.
SAMPLE, FEATURES, LEAST_DOCS = 8_000, 4_000, 8
#: Lengths of the stems, in bytes.
STEMS = (4, 5, 6)
#: Expected severity from which a document is rejected.
REJECT = 0.5


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; as many as grades less one

    def severity(self, score: np.ndarray) -> np.ndarray:
        """The expected grade: the sum of P(grade > k)."""
        if not len(self.thresholds):
            return np.zeros(len(score))
        return _sigmoid(score[:, None] - self.thresholds[None, :]).sum(1)

    def score(self, part: Words) -> np.ndarray:
        """The score of each document of part: the weights of its features, each once."""
        score = np.zeros(len(part))
        if not len(self.words) or not len(part.hashes):
            return score
        docs, found = [], []
        for hashes in (part.hashes, *[part.prefixes(k) for k in STEMS]):
            maybe = np.flatnonzero(self.sieve()[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            hit = self.words[at] == hashes[maybe]
            found.append(at[hit])
            docs.append(np.searchsorted(part.first, maybe[hit], "right") - 1)
        pairs = np.unique(np.concatenate(docs) * len(self.words) + np.concatenate(found))
        np.add.at(score, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return score

    def sieve(self) -> np.ndarray:
        """Which first 20 bits some feature has: most words are passed over by one look-up."""
        if "_sieve" not in self.__dict__:
            self._sieve = np.zeros(1 << 20, bool)
            self._sieve[(self.words >> np.uint64(44)).astype(np.int64)] = True
        return self._sieve


def features(part: Words) -> list[np.ndarray]:
    """For each document the sorted hashes of its features."""
    columns = np.stack([part.hashes, *[part.prefixes(k) for k in STEMS]])
    return [np.unique(columns[:, part.first[i] : part.first[i + 1]]) for i in range(len(part))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[np.ndarray], grades: np.ndarray, l1: float = 3e-4, steps: int = 400) -> OrdinalModel:
    """rows: the distinct feature hashes of each document; grades from 0."""
    top = int(grades.max(initial=0))
    if top == 0:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    share = np.array([np.clip(np.mean(grades > k), 1e-4, 1 - 1e-4) for k in range(top)])
    thresholds = np.log((1 - share) / share)
    every = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    words, counts = np.unique(every, return_counts=True)
    kept = counts >= LEAST_DOCS
    # association with the grades, as a deviation in units of its spread
    centred = np.repeat(grades - grades.mean(), [len(r) for r in rows])
    place = np.searchsorted(words, every)
    strength = np.abs(np.bincount(place, centred, len(words))) / np.sqrt(counts)
    if kept.sum() > FEATURES:
        kept &= strength >= np.sort(strength[kept])[-FEATURES]
    words = words[kept]
    if not len(words):
        return OrdinalModel(words, np.zeros(0), thresholds)
    hit = kept[place]
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit]
    col = (np.cumsum(kept) - 1)[place[hit]]
    n = len(rows)
    low, high = np.append(-np.inf, thresholds), np.append(thresholds, np.inf)

    def slopes(w, low, high):
        s = np.bincount(doc, w[col], n)
        a, b = _sigmoid(low[grades] - s), _sigmoid(high[grades] - s)
        p = np.maximum(b - a, 1e-12)
        return s, a + b - 1, p, a * (1 - a) / p, b * (1 - b) / p

    w = v = np.zeros(len(words))
    # steps by a diagonal bound of the curvature: a rare word may move far at once
    rate = 4 * n / np.maximum(1, np.bincount(col, np.bincount(doc, minlength=n)[doc], len(words)))
    t, last = 1.0, np.inf
    for _ in range(steps):
        _, slope, p, da, db = slopes(v, low, high)
        loss = -np.log(p).mean() + l1 * np.abs(v).sum()
        if loss > last * 1.0001:
            rate, t, v = rate / 2, 1.0, w
        last = min(loss, last)
        gradient = -np.bincount(col, slope[doc], len(words)) / n
        step = v - rate * gradient
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        tt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / tt * (new - w)
        w, t = new, tt
        up = np.array([db[grades == k].sum() - da[grades == k + 1].sum() for k in range(top)]) / n
        thresholds = np.maximum.accumulate(thresholds + 0.5 * up / (share * (1 - share)))
        low, high = np.append(-np.inf, thresholds), np.append(thresholds, np.inf)
    used = np.flatnonzero(w)
    return OrdinalModel(words[used], w[used], thresholds)


def fit_labels(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on a sample of at most about so many labelled documents. labels: doc_id and the grade column."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(grade)).cast("int").alias("grade"))
    n = graded.count()
    if n > sample:
        graded = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    taken = texts(docs).join(F.broadcast(graded), "doc_id")  # about `sample` rows at most

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column("text"), NO_LETTER):
                grades = batch.column("grade")[part.low : part.low + len(part)]
                yield pa.RecordBatch.from_arrays([grades, pa.array([x.tobytes() for x in features(part)], pa.binary())], ["grade", "words"])

    got = taken.mapInArrow(words, "grade int, words binary").toArrow()
    rows = [np.frombuffer(x, np.uint64) for x in got.column("words").to_pylist()]
    return fit(rows, np.maximum(0, np.array(got.column("grade").to_pylist(), np.int64)))


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (expected grade), toxic (severity >= REJECT) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch.column("text"), NO_LETTER):
                severity = m.severity(m.score(part))
                ids = batch.column("doc_id")[part.low : part.low + len(part)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(severity), pa.array(severity >= REJECT)], ["doc_id", "severity", "toxic"])

    return texts(docs).mapInArrow(score, "doc_id long, severity double, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs, with all their columns, whose severity is under REJECT; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch.column("text"), NO_LETTER):
                severity = m.severity(m.score(part))
                yield batch.slice(part.low, len(part)).filter(pa.array(severity < REJECT))

    return docs.mapInArrow(clean, docs.schema)
