"""Language ID of mixed texts: Viterbi over per-word scores with a switching penalty.

Learned from labelled documents: for each language, counts of hashed byte 4-grams of words (small
letters, one space around each word), and of the scripts of its words.  The script of a word, by
code-point ranges, narrows the candidates to languages that use it; the word's score for a
candidate is its mean log probability of n-grams times their number's root, to temper their
dependence.  Viterbi labels the words of a document, with ``penalty`` for each switch, which gives
spans of one language each.  Words without letters follow their neighbours.

A document's language is the one with most letters' bytes in its spans, and its score their share.  Null
text, and text without a letter, is ``und`` with score 0 and no spans; so is all text when nothing is
labelled.  Counting covers all training documents; its result is at most languages times 2**BITS counts,
which the driver gathers and sends to all: the number of languages is taken to be in the hundreds.
Scripts that no range lists are one, "Other".  Whole texts are read, a very long one in a part of its
own; repeated rows count and are labelled each; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import Words, arrow_texts, splits
from ridgeline.llm.simhash import lower

BITS, PENALTY, SPREAD = 16, 6.0, 0.5
#: First and last code points of scripts' letters, in order.
RANGES = (
    (0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xC0, 0x24F, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x531, 0x58F, "Armenian"),
    (0x5D0, 0x5F4, "Hebrew"), (0x620, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xB80, 0xBFF, "Tamil"), (0xE01, 0xE7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x3041, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7A3, "Hangul"),
)
SCRIPTS = ["", *dict.fromkeys(r[2] for r in RANGES), "Other"]
_TABLE: list[np.ndarray] = []


def script_of(cp: np.ndarray) -> np.ndarray:
    """Number of the script of each code point: any letter (Unicode L*) out of the ranges is "Other"; 0: no letter."""
    if not _TABLE:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        table = np.full(0x110000, SCRIPTS.index("Other"), np.int8)
        for first, last, name in RANGES:
            table[first : last + 1] = SCRIPTS.index(name)
        _TABLE.append(np.where(letter, table, 0).astype(np.int8))
    return _TABLE[0][cp]


def script_bytes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Script number at each character's first byte, 0 elsewhere, and the bytes of letters, at their first ones."""
    out, size = np.zeros(len(buf), np.int8), np.zeros(len(buf), np.int8)
    out[((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122))] = SCRIPTS.index("Latin")
    pad = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
    for low, high, extra, mask in ((0xC2, 0xDF, 1, 31), (0xE0, 0xEF, 2, 15), (0xF0, 0xF4, 3, 7)):
        at = np.flatnonzero((buf >= low) & (buf <= high))
        cp = pad[at] & mask
        for k in range(1, extra + 1):
            cp = cp << 6 | pad[at + k] & 63
        out[at] = script_of(cp)
        size[at] = (out[at] > 0) * (extra + 1)
    size[(out > 0) & (buf < 128)] = 1
    return out, size


class Text:
    """Words of a block: n-gram features by place, script and letters' bytes by word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        buf = lower(buf)
        latin = np.zeros(len(buf), bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf = buf + latin.astype(np.uint8) * np.uint8(0x20)
        w = Words(buf, offs)
        self.first = w.first
        flat, self.begin = w.flat(buf)
        pad = np.concatenate([[32], flat, [32, 32]]).astype(np.uint32)
        gram = pad[:-3] | pad[1:-2] << 8 | pad[2:-1] << 16 | pad[3:] << 24
        gram ^= gram >> 15
        gram = gram * np.uint32(0x9E3779B1)
        self.feature = (gram >> np.uint32(32 - BITS))[: len(flat)].astype(np.int64)
        codes, size = script_bytes(flat)
        sums = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        self.letters = sums[self.begin[1:]] - sums[self.begin[:-1]]
        # A word's script is that of its first letter.
        at = np.flatnonzero(codes)
        first = np.searchsorted(at, self.begin[:-1])
        inside = (first < len(at)) & (self.letters > 0)
        self.script = np.where(inside, codes[at[np.minimum(first, len(at) - 1)]], 0).astype(np.int64) if len(at) else np.zeros(len(self.begin) - 1, np.int64)
        self.start, self.end = w.start, w.end


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # languages x 2**BITS log probabilities
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, t: Text) -> np.ndarray:
        """Words x languages: 0 for the best candidate, less for the others."""
        n = np.diff(t.begin)
        out = np.empty((len(n), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.table[k][t.feature], t.begin[:-1]) if len(n) else 0
        out *= (np.maximum(n, 1) ** (SPREAD - 1))[:, None].astype(np.float32)
        out[~self.allowed[t.script]] = -1e4
        out -= out.max(axis=1, keepdims=True)
        out[t.script == 0] = 0
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; documents are first[d]:first[d + 1], all done at once."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    label = np.zeros(len(scores), np.int16)
    came, best_of = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    sizes, begin = n[order], first[:-1][order]
    steps = int(n.max(initial=0))
    # How many documents have over t words.
    counts = np.searchsorted(-sizes, -np.arange(steps), side="left")
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(steps):
        m = counts[t]
        at = begin[:m] + t
        if t:
            v = value[:m]
            top = v.argmax(axis=1)
            reach = v[np.arange(m), top] - penalty
            jump = v < reach[:, None]
            came[at], best_of[at] = jump, top
            value[:m] = np.where(jump, reach[:, None], v)
        value[:m] += scores[at]
    if steps:
        last = value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            m = counts[t]
            at = begin[:m] + t
            label[at] = last[:m]
            if t:
                last[:m] = np.where(came[at, last[:m]], best_of[at], last[:m])
    return label


def train(docs: DataFrame) -> Model | None:
    """Learns from text and lang of the rows given; rows without either teach nothing."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            buf, offs = arrow_texts(batch.column(0))
            for lo, hi in splits(offs, 1 << 20):
                names, lang = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
                t = Text(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                word = np.repeat(lang, np.diff(t.first))
                place = np.repeat(word, np.diff(t.begin))
                lettered = np.repeat(t.script > 0, np.diff(t.begin))
                for k, name in enumerate(names.tolist()):
                    own = held.setdefault(name, np.zeros((1 << BITS) + len(SCRIPTS), np.int64))
                    own[: 1 << BITS] += np.bincount(t.feature[(place == k) & lettered], minlength=1 << BITS)
                    own[1 << BITS :] += np.bincount(t.script[word == k], minlength=len(SCRIPTS))
        for name, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "feature", "n"])

    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    got = rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), (1 << BITS) + len(SCRIPTS)))
    number = {x: k for k, x in enumerate(langs)}
    counts[[number[x] for x in got.column("lang").to_pylist()], got.column("feature").to_numpy()] = got.column("n").to_numpy()
    grams, scripts = counts[:, : 1 << BITS] + 0.5, counts[:, 1 << BITS :]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    allowed = (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= 0.001).T
    allowed[~allowed.any(axis=1)] = True
    allowed[0] = True
    return Model(langs, table, allowed)


def predict(docs: DataFrame, model: Model | None, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans: array of (start, length, lang), in bytes of the text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = "doc_id long, lang_pred string, score double, spans array<struct<start:long,length:long,lang:string>>"

    def run(batches):
        m = sent.value
        for batch in batches:
            buf, offs = arrow_texts(batch.column(1))
            docs_n = len(offs) - 1
            parts, scores = [], []
            for lo, hi in splits(offs, 1 << 20) if m else []:
                t = Text(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                scores.append(m.word_scores(t))
                parts.append((np.diff(t.first), t.letters, t.start + offs[lo], t.end + offs[lo]))
                del t
            if not parts:
                none = pa.array([[]] * docs_n, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * docs_n, pa.string()), pa.array([0.0] * docs_n, pa.float64()), none], ["doc_id", "lang_pred", "score", "spans"])
                continue
            n, letters, start, end = (np.concatenate([p[k] for p in parts]) for k in range(4))
            first = np.concatenate([[0], np.cumsum(n)])
            label = viterbi(np.concatenate(scores), first, penalty)
            del scores
            doc = np.repeat(np.arange(docs_n), n)
            share = np.bincount(doc * len(m.langs) + label, letters, docs_n * len(m.langs)).reshape(docs_n, -1)
            total, best = share.sum(axis=1), share.argmax(axis=1)
            speaks = total > 0
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
            new &= speaks[doc]
            head = np.flatnonzero(new)
            stop = np.append(np.flatnonzero((label[1:] != label[:-1]) | (doc[1:] != doc[:-1])) + 1, len(label)) if len(label) else head
            stop = stop[np.searchsorted(stop, head, side="right")] if len(head) else head
            d = doc[head]
            names = pa.array(m.langs, pa.string())
            spans = pa.StructArray.from_arrays([pa.array(start[head] - offs[d], pa.int64()), pa.array(end[stop - 1] - start[head], pa.int64()), names.take(pa.array(label[head]))], ["start", "length", "lang"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(d, minlength=docs_n))]), pa.int32()), spans)
            pred = [m.langs[b] if s else "und" for b, s in zip(best.tolist(), speaks.tolist(), strict=True)]
            score = np.where(speaks, share.max(axis=1) / np.maximum(total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), lists], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def held_out(doc_id):
    """Whether crc32 of the doc_id as text leaves remainder 1 by 3; false without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def evaluate(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all: doc_id, held_out, lang_pred, score, spans."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model, penalty).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "spans")
