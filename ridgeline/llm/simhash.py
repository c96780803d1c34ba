"""SimHash near-dedup: 64-bit fingerprints, linked at ``most`` (4) or fewer differing bits.

Fuzzy hashing with the binary Golay code (23, 12, 7).  A fingerprint is cut into three segments of 22,
21 and 21 bits.  If two fingerprints differ in at most 4 bits, then by the pigeonhole principle
some two segments together differ in at most 2.  The code is perfect: every 23-bit word lies
within 3 bits of one codeword, and the words one bit away decode to six codewords at most.  So
the keys of a pair of segments are the codeword indices that the pair, or the pair with one bit
flipped, decodes to: two pairs that differ in 2 bits share the word half way.  A fingerprint has
about 29 keys of 24 bits; those that share one are compared.

Equal fingerprints are merged before anything is compared.  A bucket of keys answers with a
spanning forest of its links, never with all pairs.  Keys are counted first, by cells of their hashes: one that over
``dense`` fingerprints may share goes to no bucket.  Those fingerprints are done another exact way: all
words within 2 bits of them are dealt out, and fingerprints within 4 bits of each other share one.

Null and empty texts, and texts without words, have fingerprint zero.  Whole texts are hashed, a
megabyte at a time, so a very long one is a part of its own.  Rows with equal doc_id, and repeated
rows, each count.  component_id is null where no row of a group has a doc_id.  An empty table gives an
empty one.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import rounds
from ridgeline.llm.kernels import U64, Words, arrow_texts, fresh, mix, splits
from ridgeline.operators.graphs import forest
from ridgeline.sources.scratch import Scratch, components, salted_join

#: The generator polynomial of the binary Golay code, and the segments' widths.
GOLAY, SEGMENTS = 0b110001110101, (22, 21, 21)
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Text with single spaces between words; each shingle's start and end in it, and how many each document has.

    A document of fewer words has one shingle, the whole sequence; one without words has none.
    """
    w = Words(buf, offs)
    n = np.diff(w.first)
    flat, total = w.flat(buf)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    word = np.repeat(w.first[:-1] - begin[:-1], many) + np.arange(begin[-1])
    last = np.minimum(word + size, np.repeat(w.first[1:], many)) - 1
    return flat.tobytes(), total[word], total[last + 1] - 1, many


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each shingle, and how many each document has."""
    data, start, end, many = shingles(lower(buf), offs, size)
    h64 = xxhash.xxh64_intdigest
    return np.fromiter((h64(data[a:b], 42) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start)), many


def fingerprints(buf: np.ndarray, offs: np.ndarray, size: int, tables: int = 1) -> np.ndarray:
    """SimHashes of each document, a column a table: a bit is set if it is in over half of the shingles' hashes.

    The first table's hash is XXH64, the others' are mixed from it.
    """
    h, many = shingle_hashes(buf, offs, size)
    out = np.zeros((len(many), tables), U64)
    have = np.flatnonzero(many)
    if not len(have):
        return out
    # Sums of bits in byte lanes, over runs of 255 shingles of a document at most.
    pieces = -(-many[have] // 255)
    begin = np.cumsum(many[have]) - many[have]
    first = np.cumsum(pieces) - pieces
    cut = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    bits = np.empty((len(have), 64), bool)
    for t in range(tables):
        own = mix(h + U64(t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if t else h
        raw = own.astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(SPREAD[raw[:, k]], cut).view(np.uint8).reshape(-1, 8)
            bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(lanes.astype(np.int64), first, axis=0) > many[have][:, None]
        out[have, t] = np.packbits(bits, axis=1).view(">u8").ravel().astype(U64)
    return out


def in_parts(column, make) -> np.ndarray:
    """make(buf, offs) over a column of texts, about a megabyte at a time."""
    buf, offs = arrow_texts(column)
    parts = [make(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in splits(offs, 1 << 20)]
    return np.concatenate(parts) if parts else make(buf, offs)


class Golay:
    """Decodes 23-bit words to the index (12 bits) of the one codeword within 3 bits."""

    def __init__(self):
        rest = np.array([self.remainder(1 << k) for k in range(23)])
        self.error = np.zeros(2048, np.int64)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                self.error[np.bitwise_xor.reduce(rest[list(bits)]) if bits else 0] = sum(1 << b for b in bits)
        self.tables = [np.array([np.bitwise_xor.reduce([rest[8 * k + b] for b in range(8) if v >> b & 1 and 8 * k + b < 23] or [0]) for v in range(256)]) for k in range(3)]

    @staticmethod
    def remainder(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GOLAY << (k - 11)
        return v

    def index(self, v: np.ndarray) -> np.ndarray:
        syndrome = self.tables[0][v & 255] ^ self.tables[1][v >> 8 & 255] ^ self.tables[2][v >> 16]
        return (v ^ self.error[syndrome]) >> 11


_GOLAY: list[Golay] = []


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) of all keys of all fingerprints, each key once."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    code, at = _GOLAY[0], 0
    near, mine = [], []
    for width in SEGMENTS:
        v = (fp >> U64(at)).astype(np.int64) & ((1 << width) - 1)
        at += width
        mine.append(code.index(v))
        near.append(np.stack([mine[-1], *(code.index(v ^ (1 << b)) for b in range(width))], axis=1))
    found, rows = [], []
    for p, (a, b) in enumerate(combinations(range(3), 2)):
        k = np.sort(np.concatenate([mine[a][:, None] << 12 | near[b], near[a] << 12 | mine[b][:, None]], axis=1), axis=1)
        new = np.ones(k.shape, bool)
        new[:, 1:] = k[:, 1:] != k[:, :-1]
        found.append(k[new] | p << 24)
        rows.append(np.nonzero(new)[0])
    return np.concatenate(found), np.concatenate(rows)


@dataclass(frozen=True)
class Rule:
    """Two nodes link if in some of ``tables`` their fingerprints differ in ``most`` bits at most, and their proofs in ``verify``."""

    tables: int = 1
    most: int = 4
    verify: int | None = None
    dense: int = 65536

    def near(self, x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether entries i and j, of the same table, link."""
        ok = np.bitwise_count(x["fp"][i] ^ x["fp"][j]) <= self.most
        return ok if self.verify is None else ok & (np.bitwise_count(x["proof"][i] ^ x["proof"][j]) <= self.verify)


@dataclass
class Nodes:
    """Distinct fingerprints: fp (nodes x tables), proof, and the numbers of the nodes."""

    fp: np.ndarray
    proof: np.ndarray
    node: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, tables: int) -> Nodes:
        col = lambda name: batch.column(name).to_numpy()
        return cls(np.stack([col(f"f{t}").view(U64) for t in range(tables)], axis=1), col("proof").view(U64), col("node"))


def spread_out(x: dict, group: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a group of entries as all pairs would: breadth first, each one's distances to those not yet met."""
    left, a, b = group, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step, front = front[:64], front[64:]
            near = rule.near(x, step[:, None], left[None, :])
            hit = near.any(axis=0)
            a.append(left[hit])
            b.append(step[near[:, hit].argmax(axis=0)])
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)


#: Bytes of an entry: a key of a node.
ENTRY = 28
#: Up to this many nodes of a key are compared in pairs at once, over all keys of a bucket.
FEW = 48


def bucket_links(payloads: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a bucket, as two arrays of nodes.  An entry is a key of a node, with the fingerprint of the key's table and the proof."""
    x = rounds.together(payloads)
    order = np.argsort(x["key"], kind="stable")
    x = {k: v[order] for k, v in x.items()}
    key = x["key"]
    nodes, at = np.unique(x["node"], return_inverse=True)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cuts, len(key)))
    links: list = []
    root = np.arange(len(nodes))

    def settled() -> np.ndarray:
        joined = [at[np.concatenate([p[k] for p in links])] if links else np.zeros(0, np.int64) for k in (0, 1)]
        return forest(len(nodes), np.concatenate([np.arange(len(nodes)), joined[0]]), np.concatenate([root, joined[1]]))

    for g in np.flatnonzero(size > FEW):
        links.append(spread_out(x, np.arange(cuts[g], cuts[g] + size[g]), rule))
    rest = np.repeat(np.where(size <= FEW, size, 0), size) - (np.arange(len(key)) - np.repeat(cuts, size))  # entries of the group from here on
    for d in range(1, FEW):
        i = np.flatnonzero(rest > d)
        if not len(i):
            break
        near = rule.near(x, i, i + d)
        links.append((i[near], i[near] + d))
        if sum(len(p) for p, _ in links) > 4_000_000:
            root, links = settled(), []
    root = settled()
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def node_keys(n: Nodes, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, fingerprint) of all keys of all tables: the table is in the bits above 26."""
    found = [keys_of(n.fp[:, t]) for t in range(rule.tables)]
    return np.concatenate([(k + (t << 26)).astype(np.uint32) for t, (k, _) in enumerate(found)]), np.concatenate([r for _, r in found]), np.concatenate([n.fp[r, t] for t, (_, r) in enumerate(found)])


def dealt(nodes: DataFrame, rule: Rule, make, buckets: int) -> DataFrame:
    """Links a, b of nodes that share a key.  make(nodes) -> (keys, rows of the nodes, fingerprints of the keys' tables)."""

    def send(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 20000):
                n = Nodes.of(batch.slice(lo, 20000), rule.tables)
                key, row, fp = make(n)
                for bucket, at in rounds.by_bucket(mix(key.astype(U64)), buckets):
                    # As many bytes an entry at any number of buckets.
                    payload = rounds.dump(key=key[at], fp=fp[at], proof=n.proof[row[at]], node=n.node[row[at]])
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], ["bucket", "payload"])

    def run(table: pa.Table) -> pa.Table:
        a, b = bucket_links(table.column("payload").to_pylist(), rule)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return nodes.mapInArrow(send, "bucket int, payload binary").groupBy("bucket").applyInArrow(run, "a long, b long")


class Dense:
    """Which keys over ``dense`` nodes may share: keys are counted by cells of their hash, so many that one holds a 16th of that on average.

    A key of a cell with more is done as a dense one.  The list of such cells is at most a 16th of all, whatever the input.
    """

    def __init__(self, nodes: DataFrame, n: int, rule: Rule):
        self.bits = max(10, math.ceil(math.log2(max(1, 29 * rule.tables * n * 16 / rule.dense))))
        self.cells = np.zeros(0, np.int64)

        def count(batches):
            for batch in batches:
                cell, n = np.unique(self.of(node_keys(Nodes.of(batch, rule.tables), rule)[0]), return_counts=True)
                yield rounds.one(cell=cell, n=n.astype(np.int64))

        got = nodes.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > rule.dense).select("cell").toArrow()
        self.cells = np.sort(got.column("cell").to_numpy())

    def of(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(U64) + U64(1)) >> U64(64 - self.bits)).astype(np.int64)

    def holds(self, key: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(key), bool)
        cell = self.of(key)
        return self.cells[np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)] == cell


def link_table(nodes: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """Links a, b that connect by chains all nodes (node, f0, f1, ..., proof) that the rule links."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.count()
    hot = Dense(nodes, n, rule)

    def cool(x: Nodes):
        key, row, fp = node_keys(x, rule)
        keep = ~hot.holds(key)
        return key[keep], row[keep], fp[keep]

    per_node = 29 * rule.tables * ENTRY
    links = scratch.keep(dealt(nodes, rule, cool, max(parts, math.ceil(per_node * n / rounds.BUCKET_BYTES))))
    if not len(hot.cells):
        return links
    if rule.most % 2:
        raise ValueError("dense keys need an even number of bits")
    flips = np.array([sum(1 << b for b in bits) for k in range(rule.most // 2 + 1) for bits in combinations(range(64), k)], U64)

    def middles(x: Nodes):
        """Words half way: nodes of a dense key within ``most`` bits share one.  The table is in the lowest 3 bits of the key."""
        keys, rows, fps = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for t in range(rule.tables):
            key, row = keys_of(x.fp[:, t])
            row = np.unique(row[hot.holds((key + (t << 26)).astype(np.uint32))])
            keys.append((mix((x.fp[row, t][:, None] ^ flips).ravel()) & ~U64(7)) | U64(t))
            rows.append(np.repeat(row, len(flips)))
            fps.append(np.repeat(x.fp[row, t], len(flips)))
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(fps)

    spread = max(parts, math.ceil(n * len(flips) * ENTRY / rounds.BUCKET_BYTES))
    # Words are equal but for 3 bits of their hash; what shares a key by chance is compared like the rest.
    return links.unionByName(scratch.keep(dealt(nodes, rule, middles, spread)))


def cluster(docs: DataFrame, size: int = 4, most: int = 4, dense: int = 65536) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""

    def run(batches):
        for batch in batches:
            fp = in_parts(batch.column(1), lambda buf, offs: fingerprints(buf, offs, size)[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "f0"])

    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f0 long"))
    nodes = table.groupBy("f0").agg(F.min("doc_id").alias("least"))
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "f0", F.lit(0).cast("long").alias("proof"), "least"))
    placed = components_of(nodes, scratch, Rule(1, most, None, dense))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = salted_join(placed, least, "component", "node").select("f0", "component_id")
    return table.join(by_fp, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def components_of(nodes: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """The nodes with column component, the smallest node reachable."""
    links = link_table(nodes.select("node", *(f"f{t}" for t in range(rule.tables)), "proof"), scratch, rule)
    found = components(links, scratch)
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def dedup(docs: DataFrame, size: int = 2, tables: int = 6, most: int = 4, proof_size: int = 4, verify: int = 12, dense: int = 65536) -> DataFrame:
    """The table with one row of each group of near-duplicates: the least by doc_id (null last), CRC-32 of text and place.

    Fingerprints of 2-word shingles in six tables find candidates, within ``most`` bits in any one; a
    fingerprint of 4-word shingles proves them, within ``verify`` bits.  Texts whose sets of 5-word
    shingles have a Jaccard index of 0.8 are found with a probability of about 0.95.
    Rows are told apart by themselves: rows that share a doc_id with different texts are decided each.
    """
    scratch = Scratch(docs.sparkSession)
    at = docs.columns.index("text")
    fps = [f"f{t}" for t in range(tables)]
    names = dict(zip(["tie", "proof", *fps, "row"], fresh(docs, "tie", "proof", *fps, "row"), strict=True))

    def run(batches):
        for batch in batches:
            buf, offs = arrow_texts(batch.column(at))
            data = buf.tobytes()
            tie = [zlib.crc32(data[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            proof = in_parts(batch.column(at), lambda buf, offs: fingerprints(buf, offs, proof_size)[:, 0])
            fp = in_parts(batch.column(at), lambda buf, offs: fingerprints(buf, offs, size, tables))
            more = [pa.array(tie, pa.int64()), pa.array(proof.view(np.int64)), *(pa.array(np.ascontiguousarray(fp[:, t]).view(np.int64)) for t in range(tables))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(names[k] for k in ("tie", "proof", *fps))])

    longs = [T.StructField(names[k], T.LongType()) for k in ("tie", "proof", *fps)]
    made = docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), *longs]))
    numbered = scratch.keep(made.withColumn(names["row"], F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col(names["tie"]).alias("tie"), F.col(names["row"]).alias("row"))
    nodes = numbered.groupBy(*(F.col(names[k]).alias(k) for k in ("proof", *fps))).agg(F.min(first).alias("first"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    placed = components_of(nodes, scratch, Rule(tables, most, verify, dense))
    stay = placed.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(names["row"]))
    # The list grows with the input: it is merged at every size, never broadcast.
    return numbered.select(*docs.columns, names["row"]).join(stay.hint("merge"), names["row"], "left_semi").select(*docs.columns)
