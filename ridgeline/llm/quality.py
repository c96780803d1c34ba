"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text.

Grades from labels: 0 toxic, 1 low quality, 2 good.  One weight vector w is shared by all grades and
ordered thresholds t1 < t2 cut its scores: P(grade <= k) = 1 / (1 + exp(f(x) - t_k+1)).  That
gives an expected grade and the tail probability P(grade = 2), by which documents are selected.

Features: each distinct word of a document, ASCII letters in lower case and other ASCII characters
but digits left out, hashed; and its rates of words that end in symbols, of words without a letter
or digit, of words in capitals and of words that repeat the one before, each in ten ranges, with a value of 4.  Fitted
by FTRL-proximal steps whose L1 term drops words that tell nothing.

Fitted on ``sample`` labelled documents at most, those of least hash of doc_id (broadcast, 20,000
rows by default); every document is scored, by its whole text.  Null text is empty.  A doc_id that
is labelled twice counts twice.  Without labels of two grades nothing is rejected: expected grade 2, probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import U64, PrefixHash, Words, arrow_texts, byte_codes, mix, splits

BITS, SAMPLE, KEEP, STYLE = 18, 20_000, 0.5, 4
RANGES = np.array([0.002, 0.01, 0.03, 0.07, 0.12, 0.2, 0.35, 0.55, 0.8])
#: Codes by byte: capitals as small letters; other ASCII than letters and digits counts as nothing.
CODES = byte_codes(31)
CODES[65:91] = CODES[97:123]
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
CODES[~_WORD] = 0


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of a block by document: each word once, each rate's range STYLE times, for its weight."""
    w = Words(buf, offs)
    docs = len(offs) - 1
    n = np.diff(w.first)
    doc = np.repeat(np.arange(docs), n)
    if len(doc):
        solid = np.concatenate([[0], np.cumsum(_WORD[buf])])
        upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
        small = np.concatenate([[0], np.cumsum((buf >= 97) & (buf <= 122))])
        count = lambda sums: sums[w.end] - sums[w.start]
        # Leading symbols would shift the powers: the hash is taken from the first solid byte on.
        at = np.flatnonzero(_WORD[buf])
        begin = w.start if not len(at) else np.minimum(at[np.minimum(np.searchsorted(at, w.start), len(at) - 1)], w.end)
        begin = np.maximum(begin, w.start)
        h = mix(PrefixHash(CODES[buf]).span(begin, w.end))
        word = (h >> U64(64 - BITS)).astype(np.int64)
        blank = count(solid) == 0
        loud = (count(upper) >= 2) & (count(small) == 0)
        ends = ~_WORD[buf[w.end - 1]] & ~_WORD[buf[np.maximum(w.end - 2, w.start)]] & ~blank
        echo = np.zeros(len(doc), bool)
        echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        pair = np.unique((doc[~blank] << BITS) | word[~blank])
        rates = [np.bincount(doc, x, docs) / np.maximum(n, 1) for x in (ends, blank, loud, echo)]
    else:
        pair, rates = np.zeros(0, np.int64), [np.zeros(docs)] * 4
    styles = np.stack([np.searchsorted(RANGES, r) + 10 * k for k, r in enumerate(rates)], axis=1)
    all_doc = np.concatenate([pair >> BITS, np.repeat(np.arange(docs), 4 * STYLE)])
    all_feature = np.concatenate([pair & (1 << BITS) - 1, np.repeat(styles.ravel(), STYLE) + (1 << BITS)])
    order = np.argsort(all_doc, kind="stable")
    return all_doc[order], all_feature[order]


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def scores(self, buf, offs) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the top grade, by document."""
        doc, feature = features(buf, offs)
        f = np.bincount(doc, self.weights[feature], len(offs) - 1)
        above = 1 / (1 + np.exp(np.clip(self.cuts[None, :] - f[:, None], -50, 50)))
        return above.sum(axis=1), above[:, -1]


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, epochs: int | None = None, rate: float = 0.5, l1: float | None = None, l2: float = 1.0, batch: int = 64) -> Model | None:
    """FTRL-proximal on rows of features; None if there are fewer than two grades.

    Unless given, l1 is a 750th of the rows, 8 at most, and epochs cover 40,000 rows, 8 at least.
    """
    seen = np.unique(grades)
    epochs = max(8, -(-40_000 // len(rows))) if epochs is None else epochs
    l1 = min(8.0, len(rows) / 750) if l1 is None else l1
    if len(seen) < 2:
        return None
    size = (1 << BITS) + 40
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    share = np.array([(grades <= k).mean() for k in range(2)]).clip(0.01, 0.99)
    cuts = np.log(share / (1 - share))
    cuts[1] = max(cuts[1], cuts[0] + 0.1)
    pace = np.zeros(2)
    r = np.random.default_rng(7)
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            lens = np.array([len(rows[i]) for i in ids])
            flat = np.concatenate([rows[i] for i in ids])
            own = np.repeat(np.arange(len(ids)), lens)
            f = np.bincount(own, w[flat], len(ids))
            y = grades[ids]
            edge = np.concatenate([[-60], cuts, [60]])
            hi = 1 / (1 + np.exp(np.clip(f - edge[y + 1], -50, 50)))
            low = 1 / (1 + np.exp(np.clip(f - edge[y], -50, 50)))
            p = np.maximum(hi - low, 1e-9)
            slope = 1 - hi - low  # of -log P by f
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, slope[own], len(touched))
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / rate
            z[touched] += g - sigma * w[touched]
            n[touched] += g * g
            big = np.abs(z[touched]) > l1
            w[touched] = np.where(big, -(z[touched] - np.sign(z[touched]) * l1) / ((0.1 + np.sqrt(n[touched])) / rate + l2), 0)
            for k in range(2):
                d = -(hi * (1 - hi) / p)[y == k].sum() + (low * (1 - low) / p)[y == k + 1].sum()
                pace[k] += d * d
                cuts[k] -= 0.1 * d / (1 + np.sqrt(pace[k]))
            cuts[1] = max(cuts[1], cuts[0] + 0.1)
    return Model(w, cuts)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most ``sample`` labelled documents."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    some = labels.select(F.col("doc_id").alias("_id"), grade.cast("int").alias("_grade")).filter("_grade is not null and _id is not null")
    some = F.broadcast(some.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(some, F.col("doc_id") == F.col("_id")).select("doc_id", "_grade", "text")

    def run(batches):
        for batch in batches:
            buf, offs = arrow_texts(batch.column(2))
            for lo, hi in splits(offs, 1 << 20):
                doc, feature = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                feature = feature.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([feature[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "grade", "features"])

    got = rows.mapInArrow(run, "doc_id long, grade int, features binary").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("features", "ascending")])
    return fit_rows([np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()], got.column("grade").to_numpy().astype(np.int64)) if got.num_rows else None


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail_probability, keep."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return docs.select("doc_id", F.lit(2.0).alias("expected_grade"), F.lit(1.0).alias("tail_probability"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches):
        for batch in batches:
            buf, offs = arrow_texts(batch.column(1))
            for lo, hi in splits(offs, 1 << 20):
                grade, tail = sent.value.scores(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(grade), pa.array(tail), pa.array(tail >= keep)], ["doc_id", "expected_grade", "tail_probability", "keep"])

    return docs.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows whose document the model keeps, with all their columns."""
    model = fit(docs, labels, sample)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            buf, offs = arrow_texts(batch.column(at))
            for lo, hi in splits(offs, 1 << 20):
                _, tail = sent.value.scores(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield batch.slice(lo, hi - lo).filter(pa.array(tail >= keep))

    return docs.mapInArrow(run, docs.schema)
