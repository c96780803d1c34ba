"""Numpy kernels over a block of texts held as one byte buffer.

A *block* is some whole documents, concatenated: ``buf`` (uint8) and ``offs`` (int64, one more
than documents).  Everything here is vectorised over the block; nothing crosses a document.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 mod 8: the longest period modulo 2**64


def fresh(df, *names: str) -> list[str]:
    """Column names like those given that the table doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"{name}_"
        have.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the good high bits of a polynomial hash over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit codes."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inv, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS: dict[int, _Powers] = {}


class PrefixHash:
    """Prefix polynomial hashes modulo 2**64: the hash of any span in O(1).

    ``span(a, b)`` depends on the items of [a, b) only, not on where they stand.
    """

    def __init__(self, codes: np.ndarray, base: int = BASE):
        powers = _POWERS.setdefault(base, _Powers(base))
        up, self.down = powers.upto(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.multiply(codes, up[: len(codes)], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the spans [a, b)."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def every(self, width: int) -> np.ndarray:
        """Mixed hashes of all spans of that width."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)

    def ranks(self, width: int) -> np.ndarray:
        """Numbers of all spans of that width whose upper halves put them in a pseudo-random order."""
        n = max(0, len(self.sums) - width)
        out = self.sums[width : width + n] - self.sums[:n]
        out *= self.down[:n]
        out ^= out >> U64(29)
        out *= U64(0xBF58476D1CE4E5B9)
        return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive items, by doubling."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


def same_bytes(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, lens: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Whether left[a:a+len] equals right[b:b+len], pair by pair."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(lens, dtype=np.int64)
    lo = 0
    while lo < len(a):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + step, side="right")))
        n = lens[lo:hi].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        bad = left[np.repeat(a[lo:hi], n) + within] != right[np.repeat(b[lo:hi], n) + within]
        if bad.any():
            out[lo + np.unique(np.repeat(np.arange(hi - lo), n)[bad])] = False
        lo = hi
    return out


def is_space(buf: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block.

    start, end: byte bounds of each word.  first: index of each document's first word, with one
    entry more at the end.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~is_space(buf)
        step = np.diff(inside)
        begins, ends = step[:-1] == 1, step == -1
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        both = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word ends with its document
        begins[both] = True
        ends[both] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offs)

    def flat(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words, each followed by one space, and where each begins (with the total at the end)."""
        lens = self.end - self.start + 1
        total = np.concatenate([[0], np.cumsum(lens)])
        out = np.full(int(total[-1]), 32, np.uint8)
        body = np.ones(len(out), bool)
        body[total[1:] - 1] = False
        flow = np.zeros(len(buf) + 1, np.int8)
        flow[self.start] += 1
        flow[self.end] -= 1
        out[body] = buf[np.cumsum(flow[:-1], dtype=np.int8) > 0]
        return out, total


def splits(offs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of whole documents of about that many bytes, one document at least."""
    out, lo, n = [], 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out


def arrow_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]
