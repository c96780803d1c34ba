"""Substring dedup on words: a de Bruijn graph of ``width``-word windows, compacted along repeats.

The edges are the windows of 20 words.  They are dealt to buckets by *minimizer* (the 10-word string
of least hash in the window), in runs that share one, as in compacting assemblers.

1. Minimizers are counted; blocks learn which of theirs occur again and which are hot.
2. Runs whose minimizer occurs again go to its bucket.  There equal windows are one edge, and its
   first occurrence (smallest doc_id, CRC-32 of text, start) is its source.  Consecutive edges of
   a run whose sources are consecutive too are a piece.  Windows of a minimizer in over ``hot`` runs are
   dealt one by one, with the BLAKE2b digest of their words; each one's source is found by partial
   aggregation, so that no passage gathers in one task.
3. Pieces are rows (block, word, length, source block, source word).  Joins of each piece with its
   predecessor and with its successor on the same diagonal leave the heads and the tails of
   nonbranching paths; the k-th head of a diagonal and its k-th tail are joined to a path.
4. Source coordinates verify the paths: both ends' blocks digest the words of the span (SHA-256), and
   the digests are joined and compared.  If any differ, hashes of windows collided, and all is done
   again with another seed; so a word goes only where the words are equal.

Windows with a source are removed.  Within a block, equal runs are compared word by word.  Words are
``[^\\x20\\x09-\\x0D]+``, unchanged; null text has none.  A null doc_id comes first; rows with equal doc_id are
ordered by CRC-32 of text, repeated rows by place; a very long text is a block of its own; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import rounds
from ridgeline.llm.kernels import U64, PrefixHash, Words, mix, same_bytes, sliding_min
from ridgeline.llm.rounds import Block, Corpus, first_of_each, numbers, packed
from ridgeline.sources.scratch import Scratch

WIDTH, GRAM, HOT = 20, 10, 1024
SEEDS = (21, 22, 23, 24)
BASE2 = 0xD1342543DE82EF95
#: Words of more bytes are hashed one by one.
LONG = 512


class Text:
    """The words of a block, and the block's text with one space after each word: word k begins at total[k]."""

    def __init__(self, b: Block):
        self.words = Words(b.buf, b.offs)
        self.flat, self.total = self.words.flat(b.buf)
        self.data = self.flat.tobytes()

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, at, side="right") - 1

    def digest(self, at: np.ndarray, n: np.ndarray, make) -> np.ndarray:
        """128 bits of make (a hash of bytes) over words at to at + n of each span."""
        a, z = self.total[at].tolist(), self.total[at + n].tolist()
        return np.frombuffer(b"".join(make(self.data[x:y]).digest()[:16] for x, y in zip(a, z, strict=True)), np.int64).reshape(-1, 2)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words at a equal those at b."""
        size = self.total[a + n] - self.total[a]
        out = size == self.total[b + n] - self.total[b]
        out[out] = same_bytes(self.flat, self.total[a[out]], self.flat, self.total[b[out]], size[out])
        return out

    def word_codes(self, seed: int) -> np.ndarray:
        """A hash of each word: eight bytes after the other are mixed in, all words at once; very long words by XXH64."""
        start, lens = self.total[:-1], np.diff(self.total) - 1
        lanes = np.ndarray(len(self.data), "<u8", self.data + bytes(8), strides=(1,))
        h = mix(lens.astype(U64) + U64(seed))
        todo, k = np.flatnonzero(lens <= LONG), 0
        while len(todo):
            left = np.minimum(lens[todo] - k, 8).astype(U64)
            keep = ~U64(0) >> (U64(64) - U64(8) * left)
            h[todo] = mix((h[todo] ^ (lanes[start[todo] + k] & keep)) * U64(0x9E3779B97F4A7C15))
            k += 8
            todo = todo[lens[todo] > k]
        for i in np.flatnonzero(lens > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[start[i] : start[i] + lens[i]], seed)
        return h


class Edges(Text):
    """Windows of a block by word index, and the runs of windows that share a minimizer.

    first: a run's first window, n: windows.  reps: runs that go on; spare: runs whose words the block
    has earlier, at twin.
    """

    def __init__(self, b: Block, width: int, gram: int, seed: int, trust: int = 64):
        super().__init__(b)
        w, self.width, self.trust = self.words, width, trust
        codes = self.word_codes(seed)
        self.one, self.two = PrefixHash(codes), PrefixHash(mix(codes), BASE2)
        grams, low = self.one.every(gram), U64(0xFFFFFFFF)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U64), width - gram + 1)
        n = np.diff(w.first)
        flow = np.zeros(len(w.start) + 2, np.int32)
        np.add.at(flow, w.first[:-1][n >= width], 1)
        np.add.at(flow, w.first[1:][n >= width] - width + 1, -1)
        at = np.flatnonzero(np.cumsum(flow)[: len(least)])
        anchor = (least[at] & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1)
        begins = np.flatnonzero(new)
        self.first, self.n = at[begins], np.diff(np.append(begins, len(at)))
        self.key = grams[anchor[begins]]
        self.doc = self.doc_of(self.first)
        end = self.first + self.n + width - 1
        content = mix(self.one.span(self.first, end) + self.n.astype(U64)), mix(self.two.span(self.first, end))
        order, lead = first_of_each(content, (self.first, b.rank[self.doc]))
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))] if len(order) else order
        rest, twin = order[~lead], head[~lead]
        equal = (self.n[rest] == self.n[twin]) & self.same(self.first[rest], self.first[twin], np.minimum(self.n[rest], self.n[twin]) + width - 1)
        self.spare, self.twin = rest[equal], twin[equal]
        self.reps = np.sort(np.concatenate([order[lead], rest[~equal]]))

    def windows(self, runs: np.ndarray) -> np.ndarray:
        n = self.n[runs]
        return np.repeat(self.first[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window; ``trust`` bits of the first and none of the second are kept in tests of collisions."""
        one, two = mix(self.one.span(at, at + self.width)), mix(self.two.span(at, at + self.width))
        return (one, two) if self.trust == 64 else (one & U64((1 << self.trust) - 1), two & U64(0))

    def hot(self, b: Block, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of hot minimizers: the block's first of each, the others, and each other's first, compared by words."""
        at = self.windows(self.reps[np.isin(self.key[self.reps], keys)])
        order, lead = first_of_each((mix(self.one.span(at, at + self.width)),), (at, b.rank[self.doc_of(at)]))
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))] if len(order) else order
        rest, twin = at[order[~lead]], at[head[~lead]]
        equal = self.same(rest, twin, np.full(len(rest), self.width))
        return np.concatenate([at[order[lead]], rest[~equal]]), rest[equal], twin[equal]


def pieces_of(x: dict) -> pa.Table:
    """A bucket's runs -> rows of pieces: windows in a row that have sources in a row."""
    n = x["n"].astype(np.int64)
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    place = np.empty(len(n), np.int64)  # the order of runs; windows of a run are in order as they stand
    place[np.lexsort((x["local"], x["block"], x["start"], x["tie"], x["doc"]))] = np.arange(len(n))
    start, local = x["start"][run].astype(np.int64) + within, x["local"][run].astype(np.int64) + within
    order, lead = first_of_each((x["_two"], x["_one"]), (place[run], start, x["tie"][run], x["doc"][run]))
    source = np.empty(len(run), np.int64)
    source[order] = order[lead][np.cumsum(lead) - 1]
    again = source != np.arange(len(run))
    on = np.zeros(len(run), bool)
    on[1:] = again[1:] & again[:-1] & (run[1:] == run[:-1]) & (x["block"][run[source[1:]]] == x["block"][run[source[:-1]]]) & (local[source[1:]] == local[source[:-1]] + 1)
    begin = np.flatnonzero(again & ~on)
    end = np.flatnonzero(again & ~np.append(on[1:], False)) + 1
    of = source[begin]
    return pa.Table.from_batches([rounds.one(block=x["block"][run[begin]], at=local[begin], n=end - begin, sblock=x["block"][run[of]], sat=local[of], sdoc=x["doc"][run[of]], sstart=start[of])])


PIECE = "block long, at long, n long, sblock long, sat long, sdoc long, sstart long"


def compact(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Pieces joined end to end where both the text and its source go on: a row a path, of the same columns."""
    line = ["block", "sblock", "diagonal"]
    p = scratch.keep(pieces.withColumn("diagonal", F.col("at") - F.col("sat")).withColumn("end", F.col("at") + F.col("n")))
    heads = p.join(p.select(*line, F.col("end").alias("at")), [*line, "at"], "left_anti")
    tails = p.select(*line, "end").join(p.select(*line, F.col("at").alias("end")), [*line, "end"], "left_anti")
    # Paths of a diagonal don't overlap: heads and tails alternate.
    number = lambda c: F.row_number().over(Window.partitionBy(*line).orderBy(c))
    paths = heads.drop("end", "n").withColumn("k", number("at")).join(tails.withColumn("k", number("end")), [*line, "k"])
    return scratch.keep(paths.select("block", "at", (F.col("end") - F.col("at")).alias("n"), "sblock", "sat", "sdoc", "sstart"))


def verified(corpus: Corpus, paths: DataFrame, width: int) -> bool:
    """Whether the words of every path equal those at its source."""

    def digests(number, b, spans):
        at, n = numbers(spans, "at"), numbers(spans, "n")
        if len(at):
            d = Text(b).digest(at, n + width - 1, hashlib.sha256)
            yield rounds.one(block=np.full(len(at), number), at=at, n=n, d1=d[:, 0].copy(), d2=d[:, 1].copy())

    spans = paths.select("block", "at", "n").unionByName(paths.select(F.col("sblock").alias("block"), F.col("sat").alias("at"), "n")).distinct()
    known = corpus.scratch.keep(corpus.each(digests, "block long, at long, n long, d1 long, d2 long", corpus.by_block(spans, "spans", "at", "n")))
    source = known.select(F.col("block").alias("sblock"), F.col("at").alias("sat"), "n", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    both = paths.select("block", "at", "n", "sblock", "sat").join(known, ["block", "at", "n"]).join(source, ["sblock", "sat", "n"])
    fine = both.filter("d1 <> e1 or d2 <> e2").isEmpty()
    corpus.scratch.drop(known)
    return fine


def find(corpus: Corpus, width: int, gram: int, hot: int, seed: int, trust: int) -> tuple[DataFrame, DataFrame]:
    """(flags of blocks, paths) under one seed."""
    edges = lambda b: Edges(b, width, gram, seed, trust)

    def keys(b: Block) -> np.ndarray:
        e = edges(b)
        return e.key[e.reps]

    def question(number, b, shared, _):
        e = edges(b)
        runs = e.reps[np.isin(e.key[e.reps], packed(shared))]
        one, two = e.hashes(e.windows(runs))
        doc = e.doc[runs]
        return dict(key=e.key[runs], block=np.full(len(runs), number), n=e.n[runs].astype(np.uint8), size=e.n[runs].astype(np.uint8), doc=b.ids[doc], tie=b.ties[doc], start=(e.first[runs] - e.words.first[doc]).astype(np.uint32), local=e.first[runs].astype(np.uint32), _one=one, _two=two)

    def hottest(number, b, _, hot):
        hot = packed(hot)
        if len(hot):
            e = edges(b)
            at, _, _ = e.hot(b, hot)
            doc = e.doc_of(at)
            d = e.digest(at, np.full(len(at), width), lambda x: hashlib.blake2b(x, digest_size=16))
            yield rounds.one(block=np.full(len(at), number), d1=d[:, 0].copy(), d2=d[:, 1].copy(), doc=b.ids[doc], tie=b.ties[doc].astype(np.int64), start=at - e.words.first[doc], at=at)

    flags = corpus.shared(keys, hot)
    pieces = corpus.deal(question, pieces_of, PIECE, flags)
    some = flags.filter("size(hot) > 0")
    if not some.isEmpty():
        windows = corpus.each(hottest, "block long, d1 long, d2 long, doc long, tie long, start long, at long", some)
        again = corpus.least_of_each(windows, ["d1", "d2"], ["doc", "tie", "start", "block", "at"])
        pieces = pieces.unionByName(again.select("block", "at", F.lit(1).cast("long").alias("n"), F.col("first.block").alias("sblock"), F.col("first.at").alias("sat"), F.col("first.doc").alias("sdoc"), F.col("first.start").alias("sstart")))
    return flags, compact(pieces, corpus.scratch)


def sources(b: Block, e: Edges, hot, paths) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the block, the source (doc_id, word) of the window that starts there; word -1: it has none."""
    doc, word = np.zeros(len(e.words.start) + 1, np.int64), np.full(len(e.words.start) + 1, -1, np.int64)
    n = numbers(paths, "n")
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(numbers(paths, "at"), n) + within
    doc[at], word[at] = np.repeat(numbers(paths, "sdoc"), n), np.repeat(numbers(paths, "sstart"), n) + within

    def copy(to, of):
        own = word[of] < 0
        d = e.doc_of(of)
        doc[to] = np.where(own, b.ids[d], doc[of])
        word[to] = np.where(own, of - e.words.first[d], word[of])

    hot = packed(hot)
    if len(hot):
        _, rest, twin = e.hot(b, hot)
        copy(rest, twin)
    copy(e.windows(e.spare), e.windows(e.twin))
    return doc, word


def report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, trust: int = 64, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and spans: array of (start, words, source_doc, source_start).

    A span is a maximal repeated path in the document, in words, with the place where it occurs first.
    """
    scratch = Scratch(docs.sparkSession)
    corpus = Corpus(docs.select("doc_id", "text"), scratch, **sizes)
    for seed in SEEDS:
        flags, paths = find(corpus, width, gram, hot, seed, trust)
        if verified(corpus, paths, width):
            break
        scratch.drop(flags, paths)
        trust = 64
    else:
        raise ArithmeticError("hashes of windows collided under every seed")

    def each(_, b: Block, hot, paths):
        e = Edges(b, width, gram, seed)
        doc, word = sources(b, e, hot, paths)
        w = e.words
        again = word[:-1] >= 0
        edge = np.diff(again.astype(np.int8), prepend=0, append=0)
        flow = np.zeros(len(w.start) + width + 1, np.int32)
        np.add.at(flow, np.flatnonzero(edge == 1), 1)
        np.add.at(flow, np.flatnonzero(edge == -1) + width - 1, -1)
        gone = np.cumsum(flow)[: len(w.start)] > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        lens = np.diff(e.total)
        kept = e.flat[np.repeat(~gone, lens)].tobytes()
        size = np.concatenate([[0], np.cumsum(np.where(gone, 0, lens))])[w.first].tolist()
        sha = [hashlib.sha256(kept[x : max(x, y - 1)]).hexdigest() for x, y in zip(size[:-1], size[1:], strict=True)]
        mine = e.doc_of(np.arange(len(w.start)))
        on = np.zeros(len(again), bool)
        on[1:] = again[1:] & again[:-1] & (mine[1:] == mine[:-1]) & (doc[1:-1] == doc[:-2]) & (word[1:-1] == word[:-2] + 1)
        begin = np.flatnonzero(again & ~on)
        end = np.flatnonzero(again & ~np.append(on[1:], False)) + 1
        d = mine[begin]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(b.ids)))]), pa.int32()), pa.StructArray.from_arrays([pa.array(begin - w.first[d], pa.int64()), pa.array(end - begin + width - 1, pa.int64()), pa.array(doc[begin], pa.int64(), mask=doc[begin] == rounds.LEAST), pa.array(word[begin], pa.int64())], ["start", "words", "source_doc", "source_start"]))
        yield rounds.one(doc_id=b.table.column("doc_id").cast(pa.int64()).combine_chunks(), n_words=np.diff(w.first), n_removed=sums[w.first[1:]] - sums[w.first[:-1]], kept_sha256=pa.array(sha, pa.string()), spans=lists)

    found = corpus.by_block(paths, "paths", "at", "n", "sdoc", "sstart")
    return corpus.each(each, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,words:long,source_doc:long,source_start:long>>", flags.select("block", "hot"), found)


def repeated_paths(spans: DataFrame) -> DataFrame:
    """The repeated paths of a report: source_doc, source_start, words, and how often each occurs again."""
    return spans.select(F.explode("spans").alias("s")).groupBy("s.source_doc", "s.source_start", "s.words").agg(F.count("*").alias("copies"))
