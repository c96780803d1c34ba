"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised, each ending in ``END``, and packed in groups of about ``group`` tokens of one
partition, without a shuffle.  A document's full windows are cut off first.  The rests are divided
among q windows by differencing: partial partitions start as one document each; the two of largest
imbalance are merged, the largest windows of one with the smallest of the other, until one is
left.  That gives windows of nearly equal length.  q windows hold all but a few tokens each, as
what is over is cut off before and stored in sequences whose length is a power of two, which
need no padding.  If a window exceeds the capacity nevertheless, the window count rises.

Words are tokenised once a worker where the tokenizer drops white space, lower-cases and splits marks off: a
text's ids are then those of its words.  That is probed when it is loaded; whole texts are tokenised otherwise.
A very long text is tokenised as one part and cut like any other.  sequence_id is (partition, sequence in it).  Null text is empty
and gives the final id alone; rows with equal doc_id are packed each; an empty table gives none.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ridgeline.llm.kernels import PrefixHash, Words, arrow_texts, byte_codes, mix, same_bytes, splits

CAPACITY, END, GROUP, ROOM = 4096, 2, 2 << 20, 4
KNOWN_WORDS = 300_000
CODES = byte_codes(61)
#: Texts that tell whether a tokenizer works by words.
PROBES = ("The quick  Brown\tFOX, it's 3.14!", " a-b_c (x) [y] e.g. ...wow?! ", "Ünï çodé\nline two; <b>tag</b> #1 100%", "tabs\t\tand\x0bmore\x0c end.", "A.B.C. co-op don't U.S.A", "")


class WordIds(dict):
    """Numbers of words; ids of each word's tokens by number.  Number 0 is END."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.final = {i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")}
        self.by_words = True
        self.forget()
        self.by_words = self.probe()
        self.forget()

    def probe(self) -> bool:
        """Whether ids of these texts are those of their words: so it is for tokenizers that lower-case, drop white space and split marks off."""
        texts = [x.encode() for x in PROBES]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        ids, at = self.encode(np.frombuffer(b"".join(texts), np.uint8), offs)
        return all(ids[a : b - 1].tolist() == e.ids for a, b, e in zip(at[:-1], at[1:], self.whole(PROBES), strict=True))

    def whole(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def forget(self):
        self.clear()
        self.new, self.ids, self.ends, self.used = [], np.full(1 << 16, END, np.uint32), np.zeros(1 << 16, np.int64), 1
        self.ends[0] = 1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with their END, and where each document's begin."""
        if not self.by_words:
            data = buf.tobytes()
            rows = [[*e.ids, END] for e in self.whole([data[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])]
            return np.fromiter(chain.from_iterable(rows), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        if len(self) > KNOWN_WORDS:
            self.forget()
        w = Words(buf, offs)
        if b"<" not in buf.tobytes():  # special tokens are cased
            buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
        split_marks(w, buf, offs)
        # Words of equal hash are compared with the first of them; the dictionary is asked once for each.
        lens = w.end - w.start
        _, some, which = np.unique(mix(PrefixHash(CODES[buf]).span(w.start, w.end) + lens.astype(np.uint64)), return_index=True, return_inverse=True)
        if not ((lens == lens[some][which]).all() and same_bytes(buf, w.start, buf, w.start[some][which], lens).all()):
            some = which = np.arange(len(lens))
        data = buf.tobytes()
        own = [self[data[a:b]] for a, b in zip(w.start[some].tolist(), w.end[some].tolist(), strict=True)]
        self.learn()
        numbers = np.insert(np.array(own, np.int64)[which], w.first[1:], 0)
        end = self.ends[numbers]
        begin = np.where(numbers > 0, self.ends[numbers - 1], 0)
        n = end - begin
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat((begin - total[:-1]).astype(np.int32), n) + np.arange(total[-1], dtype=np.int32)]
        return ids, total[w.first + np.arange(len(offs))]

    def learn(self) -> None:
        """Tokenises the words that are new: words of letters many at a time, as each ends with its one token that ends a word."""
        texts = [x.decode() for x in self.new]
        rows: list = [None] * len(texts)
        plain = [k for k, x in enumerate(texts) if x.isalpha() and x.lower().isalpha()]
        for lo in range(0, len(plain), 8192):
            part = plain[lo : lo + 8192]
            groups = [part[k : k + 64] for k in range(0, len(part), 64)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = e.ids
                cut = [k + 1 for k, x in enumerate(ids) if x in self.final]
                if len(cut) == len(group) and cut[-1] == len(ids):
                    for k, a, b in zip(group, [0, *cut[:-1]], cut, strict=True):
                        rows[k] = ids[a:b]
        rest = [k for k, x in enumerate(rows) if x is None]
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                rows[k] = e.ids
        if rows:
            self.add(rows)
        self.new = []

    def add(self, rows: list[list[int]]) -> None:
        ends = self.ends[self.used - 1] + np.cumsum([len(x) for x in rows])
        begin, stop = int(self.ends[self.used - 1]), int(ends[-1])
        while stop > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while self.used + len(rows) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        self.ids[begin:stop] = np.fromiter(chain.from_iterable(rows), np.uint32, stop - begin)
        self.ends[self.used : self.used + len(rows)] = ends
        self.used += len(rows)


_MARK, _SOLID = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = True


def split_marks(w: Words, buf: np.ndarray, offs: np.ndarray) -> None:
    """Makes marks at the end of a word a word of their own where an ASCII letter or digit precedes them.

    The tokenizer never joins the two, so ids stay the same and fewer words differ.
    """
    if not len(w.start):
        return
    last = np.maximum.accumulate(np.where(_MARK[buf], 0, np.arange(len(buf), dtype=np.int32)))[w.end - 1]
    cut = last[(last >= w.start) & (last < w.end - 1) & _SOLID[buf[last]]] + 1
    w.start, w.end = np.sort(np.concatenate([w.start, cut])), np.sort(np.concatenate([w.end, cut]))
    w.first = np.searchsorted(w.start, offs)


def differencing(sizes: list[int], q: int) -> list[list[int]]:
    """Divides items among q windows by Karmarkar-Karp multiway differencing."""
    held: list[list[int]] = [[i] for i in range(len(sizes))]
    # A partial partition: its windows that aren't empty, as (sum, number in held), ascending.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    if q == 1 or not heap:
        return [list(range(len(sizes)))] + [[] for _ in range(q - 1)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - q
        if len(b) == 1:
            s, k = b[0]
            if over > 0:
                low, j = a.pop(0)
                held[j] += held[k]
                s, k = low + s, j
            insort(a, (s, k))
        else:
            out = []
            # Largest of a with smallest of b: the overlap is of a's smallest with b's smallest reversed.
            m = max(over, 0)
            low_a, low_b = a[:m], b[:m]
            for (s, k), (t, j) in zip(low_a, reversed(low_b), strict=True):
                held[k] += held[j]
                out.append((s + t, k))
            a = sorted(out + a[m:] + b[m:])
        heapq.heappush(heap, (-(a[-1][0] - (a[0][0] if len(a) == q else 0)), tie, a))
    return [held[k] for _, k in heap[0][2]] + [[] for _ in range(q - len(heap[0][2]))]


def powers(n: int) -> list[int]:
    """Powers of two that sum to n, largest first, none above the capacity."""
    return [CAPACITY] * (n // CAPACITY) + [1 << k for k in range(CAPACITY.bit_length() - 2, -1, -1) if n % CAPACITY >> k & 1]


def arrange(lengths: list[int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of every document once."""
    out, rests = [], []
    for d, n in enumerate(lengths):
        full = n // CAPACITY
        out += [[(d, k * CAPACITY, CAPACITY)] for k in range(full)]
        if n % CAPACITY:
            rests.append((n % CAPACITY, d, full * CAPACITY))
    rests.sort(reverse=True)
    total = sum(n for n, _, _ in rests)
    # What is over q windows with a few tokens of room each is cut off the largest rests.
    q = total // CAPACITY
    room = ROOM * q + 256
    if room >= CAPACITY * q // 2:
        q = 0
    over = max(0, total - (q * CAPACITY - room)) if q else total
    if q:
        over -= over % 256
    items, cut, left = [], [], over
    for n, d, at in rests:
        take = min(n, left)
        left -= take
        if take:
            cut.append((d, at + n - take, take))
        if n > take:
            items.append((n - take, d, at))
    sizes = [n for n, _, _ in items]
    bins = differencing(sizes, q) if q else []
    while any(sum(sizes[i] for i in b) > CAPACITY for b in bins):  # the window count rises
        q += 1
        bins = differencing(sizes, q)
    out += [[(items[i][1], items[i][2], items[i][0]) for i in b] for b in bins if b]
    cut.reverse()
    for size in powers(over):
        seq = []
        while size:
            d, at, n = cut.pop()
            take = min(n, size)
            seq.append((d, at, take))
            size -= take
            if n > take:
                cut.append((d, at + take, n - take))
        out.append(seq)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True, group: int = GROUP) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids unless with_ids is false.

    tokenizer: a file of the tokenizers library, on every executor.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def rows(ids: list, doc_ids: list, first_seq: int) -> tuple[pa.RecordBatch, int]:
        seqs = arrange([len(x) for x in ids])
        flat = [(d, at, n, s, o) for s, seq in enumerate(seqs) for (d, at, n), o in zip(seq, np.cumsum([0, *(p[2] for p in seq[:-1])]).tolist(), strict=True)]
        raw = [x.tobytes() for x in ids]
        cols = [pa.array([doc_ids[d] for d, *_ in flat], pa.int64())] + [pa.array([f[k] for f in flat], pa.int64()) for k in (1, 2)]
        cols += [pa.array([zlib.crc32(raw[d][4 * a : 4 * (a + n)]) for d, a, n, _, _ in flat], pa.int64()), pa.array([len(ids[f[0]]) for f in flat], pa.int64()), pa.array([first_seq + f[3] for f in flat], pa.int64()), pa.array([f[4] for f in flat], pa.int64())]
        if with_ids:
            cols.append(pa.array([ids[d][a : a + n].astype(np.int32) for d, a, n, _, _ in flat], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names), len(seqs)

    def run(batches):
        known = WordIds(tokenizer)
        seq = TaskContext.get().partitionId() << 40
        ids, doc_ids, held = [], [], 0
        for batch in batches:
            buf, offs = arrow_texts(batch.column(1))
            keys = batch.column(0).to_pylist()
            for lo, hi in splits(offs, 3 << 19):
                got, at = known.encode(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                ids += [got[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                doc_ids += keys[lo:hi]
                held += len(got)
                if held >= 2 * group:
                    n, part = 0, 0
                    while part < group:
                        part += len(ids[n])
                        n += 1
                    out, used = rows(ids[:n], doc_ids[:n], seq)
                    yield out
                    ids, doc_ids, held, seq = ids[n:], doc_ids[n:], held - part, seq + used
        if ids:
            yield rows(ids, doc_ids, seq)[0]

    kind = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>" * with_ids
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)
