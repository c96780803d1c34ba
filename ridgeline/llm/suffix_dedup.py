"""Suffix-array dedup: removes every byte covered by a 100-byte string that also starts earlier.

Equal windows of ``width`` bytes hold the same *anchor*, the ``gram``-byte string of least hash in
them, at the same offset.  So only one suffix in about 26 has to be sorted, the one at an anchor,
and anchors meet those of equal content.

1. Anchors are counted; blocks learn which of theirs occur again and which are hot.
2. For an anchor that occurs again, a block sends its context (the windows it is the anchor of).  The
   bucket sorts the contexts' suffixes, rightwards from the anchor and leftwards from it, by
   mergesort.  Two suffixes are compared by their longest common prefix, found by binary search over
   prefix polynomial hashes.  Neighbours' common prefixes are then verified byte by byte; on a
   collision the sort is done again with another base.  Windows are equal where both common
   extensions suffice; all but the earliest go.
3. Contexts of an anchor that over ``hot`` of them share are split into their windows, each a suffix cut at
   100 bytes.  A block compares its own byte by byte and sends one of each, with the BLAKE2b digest
   of its bytes (128 bits); the earliest of each digest is found by partial aggregation.

Rows are ordered by (doc_id, CRC-32 of text), a null doc_id first; null text is empty; matches
never cross rows; an empty table gives an empty table.  All other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import rounds
from ridgeline.llm.kernels import BASE, U64, PrefixHash, byte_codes, mix, same_bytes, sliding_min
from ridgeline.llm.rounds import Block, Corpus, first_of_each
from ridgeline.sources.scratch import Scratch

WIDTH, GRAM, HOT = 100, 50, 1024
CODES = byte_codes(11)
BASES = (BASE, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


class Anchors:
    """Runs of windows that share an anchor, and which of them are the block's first of their content.

    first: a run's first window (byte position), n: windows, off: anchor's offset in the first window.
    reps: runs that go on; spare: runs whose whole content the block has earlier.
    """

    def __init__(self, b: Block, width: int = WIDTH, gram: int = GRAM):
        self.hashes = PrefixHash(CODES[b.buf])
        low = U64(0xFFFFFFFF)
        rank = self.hashes.ranks(gram)
        rank &= ~low
        rank |= np.arange(len(rank), dtype=U64)
        least = sliding_min(rank, width - gram + 1)
        # Runs end where the anchor changes, and at documents' ends.
        long = np.diff(b.offs) >= width
        stop = b.offs[1:][long] - width + 1
        begins = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, b.offs[:-1][long], stop]))
        of = np.searchsorted(stop, begins, side="right")  # the document, of the long ones, whose windows come next
        begins, of = begins[of < len(stop)], of[of < len(stop)]
        inside = begins >= b.offs[:-1][long][of]
        self.first, self.n = begins[inside], np.diff(np.append(begins, stop[-1:]))[inside]
        anchor = (least[self.first] & low).astype(np.int64)
        self.off = anchor - self.first
        self.key = mix(self.hashes.span(anchor, anchor + gram))
        self.doc = b.doc_of(self.first)
        span = self.n + width - 1
        self.content = mix(self.hashes.span(self.first, self.first + span) + mix(self.n.astype(U64) * U64(256) + self.off.astype(U64)))
        order, lead = first_of_each((self.content,), (self.first, b.rank[self.doc]))
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))] if len(order) else order
        rest = order[~lead]
        equal = same_bytes(b.buf, self.first[rest], b.buf, self.first[head[~lead]], span[rest])
        self.spare = rest[equal]
        self.reps = np.sort(np.concatenate([order[lead], rest[~equal]]))


def contexts(number: int, b: Block, a: Anchors, which: np.ndarray, width: int) -> dict:
    """Rows of runs that go on, each with the bytes of its windows."""
    span = (a.n[which] + width - 1).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(span)])
    flat = np.repeat(a.first[which] - begin[:-1], span) + np.arange(begin[-1])
    doc = a.doc[which]
    return dict(key=a.key[which], block=np.full(len(which), number), doc=b.ids[doc], tie=b.ties[doc], start=(a.first[which] - b.offs[doc]).astype(np.uint32), local=a.first[which].astype(np.uint32), off=a.off[which].astype(np.uint8), n=a.n[which].astype(np.uint8), size=span.astype(np.uint16), _text=b.buf[flat])


def hot_windows(b: Block, a: Anchors, hot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of hot anchors: the block's first of each content, and the others, compared with it byte by byte."""
    runs = a.reps[np.isin(a.key[a.reps], hot)]
    n = a.n[runs]
    at = np.repeat(a.first[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())
    order, lead = first_of_each((mix(a.hashes.span(at, at + width)),), (at, b.rank[b.doc_of(at)]))
    head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))] if len(order) else order
    rest = order[~lead]
    equal = same_bytes(b.buf, at[rest], b.buf, at[head[~lead]], np.full(len(rest), width))
    return np.concatenate([at[order[lead]], at[rest[~equal]]]), at[rest[equal]]


def hot_rows(number: int, b: Block, a: Anchors, hot: np.ndarray, width: int) -> pa.RecordBatch:
    """A row for each different window of hot anchors, with the BLAKE2b digest of its bytes."""
    at, _ = hot_windows(b, a, hot, width)
    doc = b.doc_of(at)
    digest = np.frombuffer(b"".join(hashlib.blake2b(b.data[x : x + width], digest_size=16).digest() for x in at.tolist()), np.int64).reshape(-1, 2)
    return rounds.one(block=np.full(len(at), number), d1=digest[:, 0].copy(), d2=digest[:, 1].copy(), doc=b.ids[doc], tie=b.ties[doc].astype(np.int64), start=at - b.offs[doc], local=at)


def common(h: PrefixHash, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common prefixes of the suffixes at i and j, up to most: binary search over hashes."""
    lo, hi = np.zeros_like(most), most.copy()
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (lo + hi + 1) >> 1
        equal = h.span(i, i + mid) == h.span(j, j + mid)
        lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
    return lo


def suffix_sort(buf: np.ndarray, pos: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes within groups (equal values, adjacent) and gives each one's common prefix with the one before it.

    pos, length: a suffix is buf[pos:pos+length].  A bottom-up mergesort of all groups at once: each
    round ranks every suffix in the run that its own run is merged with, by binary search.
    """
    n = len(pos)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))[np.cumsum(new) - 1]
    for base in BASES:
        h = PrefixHash(CODES[buf], base)

        def before(i, j, h=h):
            """Whether suffix i sorts before suffix j; a prefix comes first."""
            li, lj = length[i], length[j]
            l = common(h, pos[i], pos[j], np.minimum(li, lj))
            short = (l == li) | (l == lj)
            ci = buf[np.minimum(pos[i] + l, len(buf) - 1)]
            cj = buf[np.minimum(pos[j] + l, len(buf) - 1)]
            return np.where(short, li < lj, ci < cj)

        order, run = np.arange(n), 1
        while (live := np.flatnonzero(size > run)).size:
            t = live - begin[live]
            mine = t // run
            other = np.minimum((mine ^ 1) * run, size[live])
            lo = begin[live] + other
            hi = begin[live] + np.minimum(other + run, size[live])
            start, left, me = lo.copy(), mine % 2 == 0, order[live]
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) >> 1
                x, y, first = me[todo], order[mid], left[todo]
                # Of the left run: those of the right run that sort before it; of the right: those of the left that don't sort after it.
                ahead = np.where(first, True, False)
                if first.any():
                    ahead[first] = before(y[first], x[first])
                if not first.all():
                    ahead[~first] = ~before(x[~first], y[~first])
                lo[todo] = np.where(ahead, mid + 1, lo[todo])
                hi[todo] = np.where(ahead, hi[todo], mid)
            to = begin[live] + (mine // 2) * 2 * run + t % run + (lo - start)
            order = order.copy()
            order[to] = me
            run *= 2
        lcp = np.zeros(n, np.int64)
        inner = np.flatnonzero(~new)
        i, j = order[inner - 1], order[inner]
        lcp[inner] = common(h, pos[i], pos[j], np.minimum(length[i], length[j]))
        if same_bytes(buf, pos[i], buf, pos[j], lcp[inner]).all():
            lcp[new] = -1
            return order, lcp
    raise ArithmeticError("prefix hashes collided under every base")


def repeated(x: dict[str, np.ndarray], width: int) -> np.ndarray:
    """For each context, a bit for each of its windows that starts earlier elsewhere."""
    n = x["n"].astype(np.int64)
    span = n + width - 1
    begin = np.cumsum(span) - span
    x["text"] = x.pop("_text")
    x["content"] = mix(PrefixHash(CODES[x["text"]]).span(begin, begin + span) + mix(x["n"].astype(U64) * U64(256) + x["off"].astype(U64)))
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((x["local"], x["block"], x["start"], x["tie"], x["doc"]))] = np.arange(len(n))
    order, lead = first_of_each((x["content"], x["key"]), (rank,))
    head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    rest = np.flatnonzero(~lead)
    equal = (n[order[rest]] == n[head[rest]]) & (x["off"][order[rest]] == x["off"][head[rest]])
    equal[equal] = same_bytes(x["text"], begin[order[rest[equal]]], x["text"], begin[head[rest[equal]]], span[order[rest[equal]]])
    masks = np.zeros(len(n), U64)
    every = ((U64(1) << n.astype(U64)) - U64(1)).astype(U64)
    masks[order[rest[equal]]] = every[order[rest[equal]]]
    lead[rest[~equal]] = True
    reps = order[lead]
    _, inverse, count = np.unique(x["key"][reps], return_inverse=True, return_counts=True)
    reps = reps[count[inverse] > 1]  # sorted by key
    if not len(reps):
        return masks
    off, key, m = x["off"][reps].astype(np.int64), x["key"][reps], len(reps)
    ends = np.cumsum(span[reps])
    own = ends - span[reps]
    text = x["text"][np.repeat(begin[reps] - own, span[reps]) + np.arange(ends[-1])]
    at = own + off
    right, rl = suffix_sort(text, at, span[reps] - off, key)
    left, ll = suffix_sort(text[::-1], len(text) - at, off, key)
    found = np.zeros(m, U64)
    for o in range(int(off.max()) + 1):
        have = np.flatnonzero((o <= off) & (o > off - n[reps]))
        if len(have) < 2:
            continue
        gr, gl = np.empty(m, np.int64), np.empty(m, np.int64)
        gr[right] = np.cumsum(rl < width - o)
        gl[left] = np.cumsum(ll < o)
        pair = gr[have] * (m + 1) + gl[have]
        s, fresh = first_of_each((pair,), (rank[reps[have]],))
        again = have[s[~fresh]]
        found[again] |= U64(1) << (off[again] - o).astype(U64)
    masks[reps] = found
    return masks


def answer(x: dict, width: int) -> pa.Table:
    masks = repeated(x, width)
    at = np.flatnonzero(masks)
    at = at[np.argsort(x["block"][at], kind="stable")]
    block = x["block"][at]
    parts = np.split(at, np.flatnonzero(block[1:] != block[:-1]) + 1) if len(at) else []
    found = [rounds.dump(local=x["local"][p], n=x["n"][p], mask=masks[p]) for p in parts]
    return pa.Table.from_batches([rounds.one(block=pa.array([int(x["block"][p[0]]) for p in parts], pa.int64()), found=pa.array(found, pa.binary()))])


def covered(b: Block, hot, found, again, width: int, gram: int) -> np.ndarray:
    """Which bytes of the block go."""
    a = Anchors(b, width, gram)
    gone = np.zeros(len(b.buf) + width + 1, bool)  # by window
    n = a.n[a.spare]
    gone[np.repeat(a.first[a.spare] - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
    hot = rounds.packed(hot)
    if len(hot):
        gone[hot_windows(b, a, hot, width)[1]] = True
        gone[rounds.numbers(again)] = True
    for payload in found.as_py() or []:
        got = rounds.load(payload)
        at = got["local"].astype(np.int64)
        for bit in range(int(got["n"].max(initial=0))):
            gone[at[(got["mask"] >> U64(bit)) & U64(1) == 1] + bit] = True
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    flow = np.zeros(len(b.buf) + 2 * width + 2, np.int32)
    np.add.at(flow, np.flatnonzero(edge == 1), 1)
    np.add.at(flow, np.flatnonzero(edge == -1) + width - 1, -1)
    return np.cumsum(flow)[: len(b.buf)] > 0


def mark(docs: DataFrame, scratch: Scratch, each, schema, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, **sizes) -> DataFrame:
    """Runs the rounds; each(block, mask of removed bytes) makes the rows of a block."""
    corpus = Corpus(docs, scratch, **sizes)

    def keys(b: Block) -> np.ndarray:
        a = Anchors(b, width, gram)
        return a.key[a.reps]

    def question(number, b, shared, _):
        a = Anchors(b, width, gram)
        return contexts(number, b, a, a.reps[np.isin(a.key[a.reps], rounds.packed(shared))], width)

    def hottest(number, b, _, hot):
        hot = rounds.packed(hot)
        if len(hot):
            yield hot_rows(number, b, Anchors(b, width, gram), hot, width)

    flags = corpus.shared(keys, hot)
    found = corpus.deal(question, lambda x: answer(x, width), "block long, found binary", flags)
    found = found.groupBy("block").agg(F.collect_list("found").alias("found"))
    some = flags.filter("size(hot) > 0")
    again = flags.select("block", F.array().cast("array<long>").alias("again")).filter("false")
    if not some.isEmpty():
        windows = corpus.each(hottest, "block long, d1 long, d2 long, doc long, tie long, start long, local long", some)
        again = corpus.least_of_each(windows, ["d1", "d2"], ["doc", "tie", "start", "block", "local"])
        again = again.groupBy("block").agg(F.collect_list("local").alias("again"))
    return corpus.each(lambda _, b, hot, found, again: iter([each(b, covered(b, hot, found, again, width, gram))]), schema, flags.select("block", "hot"), found, again)


def spans_of(b: Block, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed runs of the block: start, end, document; runs end with their document."""
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    start, end = edge[:-1] == 1, edge == -1
    cut = b.offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(gone))]
    cut = cut[gone[cut - 1] & gone[cut]]
    start[cut] = True
    end[cut] = True
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    return start, end, b.doc_of(start)


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and removed: array of (start, length) in bytes."""

    def each(b: Block, gone: np.ndarray) -> pa.RecordBatch:
        start, end, doc = spans_of(b, gone)
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[b.offs[1:]] - sums[b.offs[:-1]]
        kept = b.buf[~gone].tobytes()
        at = (b.offs - sums[b.offs]).tolist()
        sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
        count = np.bincount(doc, minlength=len(b.ids))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.StructArray.from_arrays([pa.array(start - b.offs[doc], pa.int64()), pa.array(end - start, pa.int64())], ["start", "length"]))
        return pa.RecordBatch.from_arrays([b.table.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(np.diff(b.offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), lists], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    scratch = Scratch(docs.sparkSession)
    return mark(docs.select("doc_id", "text"), scratch, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,length:long>>", **kw)


def dedup(docs: DataFrame, **kw) -> DataFrame:
    """The table with its texts cut: whole characters are removed, so that texts stay UTF-8.

    n_chars, if there, is set anew.  Rows stay, also those whose text is cut wholly; a null text stays null.
    """
    fields = docs.schema

    def each(b: Block, gone: np.ndarray) -> pa.RecordBatch:
        # A character goes if all its bytes do.
        lead = (b.buf & 0xC0) != 0x80
        if len(b.buf):
            begins = np.flatnonzero(lead)
            whole = np.minimum.reduceat(gone.astype(np.uint8), begins).astype(bool)
            gone = np.repeat(whole, np.diff(np.append(begins, len(b.buf))))
        sums = np.concatenate([[0], np.cumsum(gone)])
        text = pa.LargeStringArray.from_buffers(len(b.ids), pa.py_buffer((b.offs - sums[b.offs]).astype(np.int64).tobytes()), pa.py_buffer(b.buf[~gone].tobytes()))
        old = b.table.column("text").combine_chunks()
        if old.null_count:
            import pyarrow.compute as pc

            text = pc.if_else(pc.is_valid(old), text, pa.scalar(None, pa.large_string()))
        t = b.table.set_column(b.table.schema.get_field_index("text"), b.table.schema.field("text"), text.cast(pa.string()))
        if "n_chars" in t.column_names:
            import pyarrow.compute as pc

            f = t.schema.field("n_chars")
            t = t.set_column(t.schema.get_field_index("n_chars"), f, pc.utf8_length(t.column("text")).cast(f.type))
        return t.combine_chunks().to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)

    return mark(docs, Scratch(docs.sparkSession), each, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]), **kw)
