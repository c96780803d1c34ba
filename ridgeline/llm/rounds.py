"""Blocks of documents that ask and answer each other by rows.

The corpus is cut into *blocks* of whole documents, written once.  Texts stay where they are but for
one join a round; what moves is keys, and arrays of what belongs to them.

* ``deal`` sends rows of keys to buckets, packed by block and bucket.  Packs go to a thousand
  buckets at most in a step; where there are more, each is dealt on in packs made anew from many
  blocks, so that packs stay large and their number is in proportion to the input.
* ``shared`` deals each block's different keys with their counts.  The blocks get back those that occur
  again, and those that are *hot*, in more places than one task should hold.
* Hot keys go another way: what belongs to them is dealt by finer keys, one row a block and key, and
  the least row of each is found by partial aggregation (``least_of_each``), so that no passage, however
  common, gathers in a task.

Blocks merge their own repeats before they send.  All tables between steps are written (``Scratch``), so a
lost executor costs a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import arrow_texts, splits
from ridgeline.sources.scratch import Scratch, salted_join

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 2 << 20
#: Buckets that packs go to in one step, and the bytes of packs that are dealt on at once.
FAN, AGAIN_BYTES = 1024, 32 << 20
LEAST = np.iinfo(np.int64).min


class Block:
    """Some rows of the documents table.  table: all columns; buf, offs: their texts (null: empty).

    ids, ties: the order of rows is (doc_id, CRC-32 of the text); a null id comes first.
    """

    def __init__(self, packed: bytes):
        self.table = pa.ipc.open_stream(packed).read_all()
        self.buf, self.offs = arrow_texts(self.table.column("text"))
        ids = self.table.column("doc_id").cast(pa.int64())
        self.ids = ids.fill_null(int(LEAST)).to_numpy()
        data = self.buf.tobytes()
        self.data = data
        self.ties = np.array([zlib.crc32(data[a:b]) for a, b in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True)], np.uint32)
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.lexsort((self.ties, self.ids))] = np.arange(len(self.ids))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Index of the document that holds each byte position."""
        return np.searchsorted(self.offs, at, side="right") - 1


def pack_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offs = arrow_texts(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in splits(offs, most):
            part = batch.slice(lo, hi - lo)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema))
            yield pa.RecordBatch.from_arrays([pa.array([int(offs[hi] - offs[lo])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n_bytes", "packed"])


def one(**columns) -> pa.RecordBatch:
    """A batch of numpy arrays or Arrow arrays."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def packed(scalar) -> np.ndarray:
    """A list of packed 64-bit numbers as one array; null is empty."""
    return np.frombuffer(b"".join(scalar.as_py() or []), np.uint64)


def numbers(scalar, name: str | None = None) -> np.ndarray:
    """A list of numbers, or a field of a list of structs, as an array; null is empty."""
    values = scalar.values
    if values is None:
        return np.zeros(0, np.int64)
    return (values if name is None else values.field(name)).to_numpy(zero_copy_only=False)


class Corpus:
    """Blocks of a documents table, and the number of buckets that suits their size."""

    def __init__(self, docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN):
        self.schema, self.scratch, self.fan = docs.schema, scratch, fan
        made = docs.mapInArrow(lambda it: pack_blocks(it, block_bytes), "n_bytes long, packed binary")
        self.blocks = scratch.keep(made.select(F.monotonically_increasing_id().alias("block"), "n_bytes", "packed"), "none")
        total = self.blocks.agg(F.sum("n_bytes")).first()[0] or 0
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(parts, math.ceil(total / bucket_bytes))

    def each(self, make: Callable[..., Iterator[pa.RecordBatch]], schema, *tables: DataFrame) -> DataFrame:
        """make(number, block, a value for each further column of the tables) for all blocks.  tables: a row a block, or none."""
        df = self.blocks.select("block", "packed")
        for t in tables:
            df = df.join(t, "block", "left")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from make(batch.column(0)[i].as_py(), Block(batch.column(1)[i].as_buffer()), *(c[i] for c in batch.columns[2:]))

        return df.mapInArrow(run, schema)

    def shared(self, keys: Callable[[Block], np.ndarray], hot: int) -> DataFrame:
        """block, shared, hot: lists of packed numbers: the block's keys that occur more than once, and those in more than ``hot`` places.

        A key takes 20 bytes of a bucket for each block that has it, so a key of all blocks is what bounds their number.
        """

        def rows(number, b):
            u, n = np.unique(keys(b), return_counts=True)
            return dict(key=u, block=np.full(len(u), number), n=n.astype(np.uint32), size=np.zeros(len(u), np.uint8))

        def count(x):
            _, which = np.unique(x["key"], return_inverse=True)
            total = np.bincount(which, x["n"])[which]
            order = np.argsort(x["block"][total > 1], kind="stable")
            block, key, often = (v[total > 1][order] for v in (x["block"], x["key"], total > hot))
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else np.zeros(1, np.int64)
            parts = [(key[i:j], often[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return pa.Table.from_batches([one(block=block[cuts[:-1]], shared=pa.array([k[~h].tobytes() for k, h in parts], pa.binary()), hot=pa.array([k[h].tobytes() for k, h in parts], pa.binary()))])

        found = self.deal(rows, count, "block long, shared binary, hot binary")
        full = lambda c: F.collect_list(F.when(F.length(c) > 0, F.col(c))).alias(c)
        out = self.scratch.keep(found.groupBy("block").agg(full("shared"), full("hot")))
        self.scratch.drop(found)
        return out

    def deal(self, question: Callable[..., dict], answer: Callable[[dict], pa.Table], schema: str, *tables: DataFrame) -> DataFrame:
        """question(number, block, ...) -> arrays by row, among them key; answer(a bucket's arrays) -> rows of schema."""
        buckets, per = self.buckets, math.ceil(self.buckets / self.fan)

        def packs(x: dict, per: int):
            to = ((x["key"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) // per
            order = np.argsort(to, kind="stable")
            x, to = take(x, order), to[order]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
            flat = np.concatenate([[0], np.cumsum(x["size"], dtype=np.int64)])[cuts].tolist()
            rows = cuts.tolist()
            parts = [{k: v[flat[i] : flat[i + 1]] if k[0] == "_" else v[rows[i] : rows[i + 1]] for k, v in x.items()} for i in range(len(rows) - 1)]
            return one(bucket=pa.array(to[cuts[:-1]], pa.int32()), payload=pa.array([dump(**p) for p in parts], pa.binary()))

        def split(batches):
            held, size, of = [], 0, None
            for batch in batches:
                for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if held and (bucket != of or size > AGAIN_BYTES):
                        yield packs(together(held), 1)
                        held, size = [], 0
                    held.append(payload.as_py())
                    of, size = bucket, size + len(held[-1])
            if held:
                yield packs(together(held), 1)

        def serve(table: pa.Table) -> pa.Table:
            return answer(together(table.column("payload").to_pylist()))

        kind = "bucket int, payload binary"
        dealt = self.each(lambda *a: iter([packs(question(*a), per)]), kind, *tables)
        if per > 1:
            dealt = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(split, kind)
        return self.scratch.keep(dealt.groupBy("bucket").applyInArrow(serve, schema))

    def least_of_each(self, rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        """rows that aren't the least of their kind, with that one's columns in the struct ``first``."""
        rows = self.scratch.keep(rows)
        least = rows.groupBy(*by).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        both = salted_join(rows, least, by, "block")
        return both.filter(F.struct(*(F.col(f"first.{c}") for c in order)) != F.struct(*order))

    def by_block(self, rows: DataFrame, name: str, *columns: str) -> DataFrame:
        """block, and a list of structs of the columns of its rows."""
        return rows.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))


def by_bucket(keys: np.ndarray, buckets: int, per: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its keys), for each bucket, or each ``per`` of them, that has some."""
    to = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) // per
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(to[part[0]]), part


def take(x: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """Some rows.  An array whose name starts with _ holds ``size`` items for each row."""
    out = {k: v[at] for k, v in x.items() if k[0] != "_"}
    if len(out) < len(x):
        size = x["size"].astype(np.int64)
        begin, n = np.cumsum(size) - size, size[at]
        flat = np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out |= {k: v[flat] for k, v in x.items() if k[0] == "_"}
    return out


def dump(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed payload."""
    head = repr([(k, v.dtype.str, len(v)) for k, v in arrays.items()]).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(v).tobytes() for v in arrays.values())
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def load(payload: bytes) -> dict[str, np.ndarray]:
    import ast

    body = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(body[:4], "little")
    out = {}
    for name, kind, n in ast.literal_eval(body[4:at].decode()):
        out[name] = np.frombuffer(body, kind, n, at)
        at += out[name].nbytes
    return out


def together(payloads: list[bytes]) -> dict[str, np.ndarray]:
    """All payloads' arrays concatenated."""
    parts = [load(x) for x in payloads]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def first_of_each(keys: tuple[np.ndarray, ...], rank: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by keys, then by rank (each last key first, as in lexsort); which start a group."""
    order = np.lexsort((*rank, *keys))
    lead = np.ones(len(order), bool)
    if len(order):
        lead[1:] = False
        for k in keys:
            s = k[order]
            lead[1:] |= s[1:] != s[:-1]
    return order, lead
