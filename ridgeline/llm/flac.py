"""Media columns: FLAC files of 8-bit mono samples, encoded and decoded in numpy.

A file is the stream header, a STREAMINFO block with the MD5 of the samples, a SEEKTABLE with one
point a frame, and frames of ``BLOCK`` samples (the last may be shorter).  A frame is a
constant, a verbatim or a predicted subframe: a linear predictor (the fixed ones of order 0 to
3, or quantised LPC coefficients, which the decoder takes up to order 32) with Rice-coded residuals in
partitions; the encoder takes what is shortest.  The decoder verifies the CRC-8 of
each frame's header, its CRC-16 and the MD5 of all samples, and returns PCM blocks with their
sample offsets.

Many frames are done at once: step t of a loop handles sample (or byte) t of every frame, and
the seek table says where frames begin.  A file without one is read frame by frame.  Texts are
stored as their UTF-8 bytes, null as empty, padded with spaces to a positive multiple of 192.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import arrow_texts, splits

PAD, BLOCK, RATE, PARTITIONS = 192, 1152, 8000, 2  # 2**2 partitions where the block divides
#: Fixed values of the format: predictor coefficients of the fixed orders.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = (v << 1 ^ poly if v >> (bits - 1) & 1 else v << 1) & ((1 << bits) - 1)
        out.append(v)
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


#: CRC-16 of a state after two bytes, by state xor those bytes.
CRC16_2 = ((CRC16[np.arange(65536) >> 8] << 8 & 0xFFFF) ^ CRC16[(CRC16[np.arange(65536) >> 8] >> 8) ^ (np.arange(65536) & 255)]).astype(np.uint16)


def shift_by(zeros: int) -> np.ndarray:
    """CRC-16 of every state after so many zero bytes."""
    v = np.arange(65536).astype(np.uint16)
    for _ in range(zeros // 2):
        v = CRC16_2[v]
    return v


SHIFT = shift_by(64)


def crc16(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[start:end], span by span: chunks of 64 bytes are done at once, then joined."""
    n = end - start
    head = n % 64  # the first chunk is the odd one, so that all others are whole
    chunks = n // 64
    state = np.zeros(len(n), np.int64)
    for t in range(int(head.max(initial=0))):
        live = np.flatnonzero(head > t)
        state[live] = (state[live] << 8 & 0xFFFF) ^ CRC16[(state[live] >> 8) ^ buf[start[live] + t]]
    first = np.concatenate([[0], np.cumsum(chunks)])
    at = np.repeat(start + head - first[:-1] * 64, chunks) + np.arange(first[-1]) * 64
    words = buf[at[:, None] + np.arange(64)].view(">u2").T.astype(np.uint16)
    part = np.zeros(len(at), np.uint16)
    for word in words:
        part = CRC16_2[part ^ word]
    state = state.astype(np.uint16)
    for k in range(int(chunks.max(initial=0))):
        live = np.flatnonzero(chunks > k)
        state[live] = SHIFT[state[live]] ^ part[first[live] + k]
    return state.astype(np.int64)


def crc8(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-8 of the first n bytes of each row."""
    state = np.zeros(len(rows), np.int64)
    for t in range(int(n.max(initial=0))):
        live = n > t
        state[live] = CRC8[state[live] ^ rows[live, t]]
    return state


def coded_number(v: int) -> bytes:
    """A frame number in the extended UTF-8 coding."""
    return chr(v).encode("utf-8", "surrogatepass") if v < 0x110000 else bytes([0xF8 | v >> 24, *(0x80 | v >> s & 0x3F for s in (18, 12, 6, 0))])


def encode_blocks(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of rows of samples (signed, all of one length) without their CRC-16, with their frame numbers."""
    rows, n = samples.shape
    x = samples.astype(np.int32)
    p = PARTITIONS
    while n % (1 << p) or n >> p <= 4:
        p -= 1
    parts, size = 1 << p, n >> p
    # The fixed order of least absolute residuals, then the best Rice parameter of each partition.
    order, least, chosen, r = np.zeros(rows, np.int64), np.abs(x).sum(axis=1), x.copy(), x
    for o in range(1, 4 if n > 16 else 1):
        r = r.copy()
        r[:, o:] = r[:, o:] - r[:, o - 1 : -1]
        total = np.abs(r[:, o:]).sum(axis=1)
        win = total < least
        order[win], least[win], chosen[win] = o, total[win], r[win]
    col = np.arange(n)
    warm = col[None, :] < order[:, None]
    u = np.where(chosen >= 0, 2 * chosen, -2 * chosen - 1)
    u[warm] = 0
    sums = u.reshape(rows, parts, size)
    count = np.broadcast_to(np.full(parts, size), (rows, parts)).copy()
    count[:, 0] -= order
    guess = np.maximum(0, np.frexp(sums.sum(axis=2) / count)[1] - 1)
    cost, k_of = np.full((rows, parts), 1 << 40), np.zeros((rows, parts), np.int64)
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, 9)
        c = (sums >> k[:, :, None].astype(np.int32)).sum(axis=2) + (k + 1) * count
        better = c < cost
        cost, k_of = np.where(better, c, cost), np.where(better, k, k_of)
    plain = cost.sum(axis=1) + 8 * order + 6 + 4 * parts >= 8 * n
    same = (x == x[:, :1]).all(axis=1)
    out: list[bytes] = [b""] * rows
    code = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5}.get(n, 7)
    tail = b"" if code != 7 else (n - 1).to_bytes(2, "big")
    table = CRC8.tolist()
    for r, (number, is_same, is_plain) in enumerate(zip(numbers, same.tolist(), plain.tolist(), strict=True)):
        head = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + coded_number(number) + tail
        crc = 0
        for byte in head:
            crc = table[crc ^ byte]
        out[r] = head + bytes([crc])
        if is_same:
            out[r] += bytes([0, int(samples[r, 0]) & 255])
        elif is_plain:
            out[r] += b"\x02" + samples[r].tobytes()
    rice = np.flatnonzero(~same & ~plain)
    if not len(rice):
        return out
    # Every field is up to 10 bits that end at ``end``; the zeros of a unary part need no writing.
    order, warm, m = order[rice], warm[rice], len(rice)
    k = np.repeat(k_of[rice], size, axis=1)
    u = u[rice]
    width = np.where(warm, 8, (u >> k) + k + 1)
    # In order: subframe header (8), warm-up, method and partition order (6), and before each partition's residuals its parameter (4).
    lead = np.zeros((m, n), np.int64)
    lead[:, 0] = 8
    lead[np.arange(m), order] += 10
    lead[:, size::size] += 4
    end = np.cumsum(lead + width, axis=1)
    length = -(-end[:, -1] // 8)
    base = np.concatenate([[0], np.cumsum(length)])
    end += base[:-1, None] * 8
    first = (end - width)[np.arange(m), order]
    value = np.where(warm, x[rice] & 255, u & (1 << k) - 1 | 1 << k)
    fields = [(end.ravel(), value.ravel(), np.where(warm, 8, k + 1).ravel())]
    fields.append((base[:-1] * 8 + 8, 8 + order << 1, np.full(m, 8)))
    fields.append((first, np.int64(p << 4) | k_of[rice, 0], np.full(m, 10)))
    for j in range(1, parts):
        fields.append((end[:, j * size] - width[:, j * size], k_of[rice, j], np.full(m, 4)))
    packed = np.zeros(base[-1] + 3)
    for stop, v, w in fields:
        at = stop - w
        v = v << (24 - (at & 7) - w)
        at >>= 3
        for byte in range(3):
            packed += np.bincount(at + byte, v >> (16 - 8 * byte) & 255, len(packed))
    packed = packed.astype(np.uint8).tobytes()
    for i, (r, a, b) in enumerate(zip(rice.tolist(), base[:-1].tolist(), base[1:].tolist(), strict=True)):
        out[r] += packed[a:b]
    return out


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """FLAC files of payloads, whose bytes are the samples plus 128."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum([0, *map(len, payloads)])
    where: dict[int, list[tuple[int, int]]] = {}
    for d, size in enumerate(map(len, payloads)):
        for k in range(-(-size // block)):
            where.setdefault(min(block, size - k * block), []).append((d, k))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    for n, some in where.items():
        step = max(1, (1 << 20) // n)
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            at = np.array([ends[d] + k * block for d, k in part])
            x = (raw[at[:, None] + np.arange(n)] ^ 128).view(np.int8)
            for (d, k), frame in zip(part, encode_blocks(x, [k for _, k in part]), strict=True):
                frames[d][k] = frame
    flat = b"".join(f + b"\0\0" for own in frames for f in own)
    buf = np.frombuffer(flat, np.uint8).copy()
    size = np.array([len(f) + 2 for own in frames for f in own], np.int64)
    stop = np.cumsum(size)
    crc = crc16(buf, stop - size, stop - 2)
    buf[stop - 2], buf[stop - 1] = crc >> 8, crc & 255
    data, out, f = buf.tobytes(), [], 0
    for p, own in zip(payloads, frames, strict=True):
        sizes = size[f : f + len(own)].tolist()
        begin = int(stop[f - 1]) if f else 0
        f += len(own)
        body = data[begin : begin + sum(sizes)]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, offset = b"", 0
        for k, s in enumerate(sizes):
            points += (k * block).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(block, len(p) - k * block).to_bytes(2, "big")
            offset += s
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + body)
    return out


class Damaged(ValueError):
    """A file that isn't FLAC of the supported kind, or whose checksums fail."""


def number_length(first: np.ndarray) -> np.ndarray:
    """Bytes of a coded number by its first byte."""
    return np.select([first < 0x80, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC], [1, 2, 3, 4, 5], 6)


def decode_frames(buf: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples (signed) of the frames that begin at start, and where each frame ends.  limit: ends of their files."""
    pad = np.concatenate([buf, np.zeros(64, np.uint8)])
    head = pad[start[:, None] + np.arange(24)].astype(np.int64)
    if not ((head[:, 0] == 0xFF) & (head[:, 1] == 0xF8) & (head[:, 3] >> 1 & 7 == 1) & (head[:, 3] >> 4 == 0)).all():
        raise Damaged("frame header: not a mono frame of 8 bits of a fixed block size")
    code = head[:, 2] >> 4
    size = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)], 0)
    at = 4 + number_length(head[:, 4])
    rows = np.arange(len(start))
    size = np.where(code == 6, head[rows, at] + 1, np.where(code == 7, (head[rows, at] << 8) + head[rows, np.minimum(at + 1, 23)] + 1, size))
    at = at + np.select([code == 6, code == 7], [1, 2], 0) + np.select([head[:, 2] & 15 == 12, (head[:, 2] & 15 == 13) | (head[:, 2] & 15 == 14)], [1, 2], 0)
    if (size == 0).any() or (crc8(head, at) != head[rows, at]).any():
        raise Damaged("frame header: its CRC-8 differs")
    at = start + at + 1
    kind = pad[at].astype(np.int64)
    if (kind & 0x81).any():
        raise Damaged("subframe header")
    kind >>= 1
    at = at + 1
    n = len(start)
    out = np.zeros((n, int(size.max(initial=0))), np.int64)
    end = at.copy()
    constant, verbatim = kind == 0, kind == 1
    out[constant] = pad[at[constant]].view(np.int8)[:, None]
    end[constant] += 1
    for r in np.flatnonzero(verbatim).tolist():
        own = pad[at[r] : at[r] + size[r]].view(np.int8)
        out[r, : len(own)] = own
        end[r] += size[r]
    coded = np.flatnonzero(~constant & ~verbatim)
    if len(coded):
        end[coded] = decode_rice(pad, at[coded], kind[coded], size[coded], coded, out)
    if (end + 2 > limit).any() or (crc16(pad, start, end) != (pad[end].astype(np.int64) << 8) + pad[end + 1]).any():
        raise Damaged("frame: its CRC-16 differs")
    return [out[r, : size[r]] for r in range(n)], end + 2


def decode_rice(pad, at, kind, size, rows, out) -> np.ndarray:
    """Predicted subframes, all at once, sample by sample; returns where each ends."""
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, kind - 8)
    if ((~lpc) & ((order < 0) | (order > 4))).any():
        raise Damaged("subframe: reserved type")
    words = np.lib.stride_tricks.as_strided(pad, (len(pad) - 7, 8), (1, 1))
    most = len(words) - 1

    def peek(pos):
        """57 bits or more from a bit position, left-aligned in 64."""
        byte = np.minimum(pos >> 3, most)
        return np.ascontiguousarray(words[byte]).view(">u8").ravel().astype(np.uint64) << (pos & 7).astype(np.uint64)

    def take(pos, width):
        return (peek(pos) >> (64 - width).astype(np.uint64)).astype(np.int64) * (width > 0)

    pos = at * 8
    eight = np.full(len(pos), 8)
    coef = np.zeros((len(pos), 32), np.int64)
    shift = np.zeros(len(pos), np.int64)
    for o in range(1, 5):
        coef[(order == o) & ~lpc, :o] = FIXED[o]
    for t in range(int(order.max(initial=0))):
        live = np.flatnonzero(order > t)
        v = take(pos[live], eight[live])
        out[rows[live], t] = v - ((v & 128) << 1)
        pos[live] += 8
    some = np.flatnonzero(lpc)
    if len(some):
        width = take(pos[some], np.full(len(some), 4)) + 1
        shift[some] = take(pos[some] + 4, np.full(len(some), 5))
        pos[some] += 9
        for t in range(int(order[some].max())):
            live = order[some] > t
            w = width[live]
            v = take(pos[some][live], w)
            coef[some[live], t] = v - ((v >> (w - 1)) << w)
            pos[some[live]] += w
    two, four = np.full(len(pos), 2), np.full(len(pos), 4)
    method = take(pos, two)
    if (method > 1).any():
        raise Damaged("subframe: reserved residual coding")
    plen = method + 4
    per = size >> take(pos + 2, four)
    pos += 6
    k, raw = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)
    todo = np.argsort(-size, kind="stable")
    top = int(order.max(initial=0))
    taps, shifted = top, lpc.any()  # as many former samples as the largest order needs
    sizes = size[todo]
    for t in range(int(size.max(initial=0))):
        live = todo[: int(np.searchsorted(-sizes, -t, side="left"))]
        if t <= top:
            live = live[order[live] <= t]
        new = live[(t % per[live] == 0) | (order[live] == t)]
        if len(new):
            w = plen[new]
            k[new] = take(pos[new], w)
            pos[new] += w
            raw[new] = k[new] == (1 << w) - 1
            for r in new[raw[new]].tolist():
                one = np.array([pos[r]])
                k[r] = take(one, np.array([5]))[0]
                pos[r] += 5
        p, kk = pos[live], k[live]
        v = peek(p)
        q = 0
        go = v >> np.uint64(12) == 0
        escaped = raw[live] if raw.any() else None
        if escaped is not None:
            go &= ~escaped
        if go.any():  # a long unary part: 52 bits were all zero
            q = np.zeros(len(live), np.int64)
        while go.any():
            q[go] += 52
            p[go] += 52
            if (p[go] >> 3 > most).any():
                raise Damaged("subframe: it doesn't end")
            v[go] = peek(p[go])
            go &= v >> np.uint64(12) == 0
        lead = 52 - np.frexp((v >> np.uint64(12)).astype(np.float64))[1]
        # The rest of the field is in the bits at hand unless it lies far on.
        near = lead + 1 + kk <= 57
        u = (v << (lead + 1).astype(np.uint64) >> (63 - kk).astype(np.uint64) >> np.uint64(1)).astype(np.int64)
        if not near.all():
            far = ~near
            u[far] = take(p[far] + lead[far] + 1, kk[far])
        p += lead + 1
        u |= q + lead << kk
        r = (u >> 1) ^ -(u & 1)
        if escaped is not None and escaped.any():
            p = np.where(escaped, pos[live], p)
            e = take(p[escaped], kk[escaped])
            r[escaped] = e - ((e >> np.maximum(kk[escaped] - 1, 0) & 1) << kk[escaped])
        pos[live] = p + kk
        mine = rows[live]
        guess = np.zeros(len(live), np.int64)
        for j in range(min(t, taps)):
            guess += coef[live, j] * out[mine, t - 1 - j]
        out[mine, t] = r + (guess >> shift[live] if shifted else guess)
    return (pos + 7) >> 3


def parse(data: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]], int]:
    """Block size, samples, MD5, seek points and start of the frames of a file."""
    if data[:4] != b"fLaC":
        raise Damaged("not a FLAC file")
    at, info, points = 4, None, []
    while True:
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if kind & 127 == 0:
            info = body
        elif kind & 127 == 3:
            points = [tuple(int.from_bytes(body[o + a : o + b], "big") for a, b in ((0, 8), (8, 16), (16, 18))) for o in range(0, n, 18)]
            points = [p for p in points if p[0] != (1 << 64) - 1]
        if kind & 128:
            break
    if info is None:
        raise Damaged("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise Damaged("not mono of 8 bits")
    return int.from_bytes(info[:2], "big"), packed & (1 << 36) - 1, info[18:34], points, at


def decode(files: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each file its PCM blocks: (sample offset, unsigned samples).  Raises Damaged if a checksum fails."""
    infos = [parse(f) for f in files]
    base = np.cumsum([0, *map(len, files)])
    buf = np.frombuffer(b"".join(files), np.uint8)
    out: list[list[tuple[int, bytes]]] = [[] for _ in files]
    whole = [sum(p[2] for p in i[3]) == i[1] for i in infos]
    by_seek = [(d, p[0], base[d] + infos[d][4] + p[1]) for d in range(len(files)) if whole[d] for p in infos[d][3]]
    if by_seek:
        for lo in range(0, len(by_seek), 8192):
            part = by_seek[lo : lo + 8192]
            blocks, _ = decode_frames(buf, np.array([x[2] for x in part]), np.array([base[x[0] + 1] for x in part]))
            for (d, sample, _), x in zip(part, blocks, strict=True):
                out[d].append((sample, (x.astype(np.uint8) ^ 128).tobytes()))
    for d, (_, total, _, _, first) in enumerate(infos):
        at, sample = base[d] + first, 0
        while not (out[d] and sample == 0) and sample < total:  # no seek points: frame after frame
            blocks, end = decode_frames(buf, np.array([at]), np.array([base[d + 1]]))
            out[d].append((sample, (blocks[0].astype(np.uint8) ^ 128).tobytes()))
            sample, at = sample + len(blocks[0]), int(end[0])
        pcm = b"".join(x for _, x in out[d])
        if len(pcm) != total or hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 128).tobytes()).digest() != infos[d][2]:
            raise Damaged("the samples' number or MD5 differs")
    return out


def padded(text: bytes) -> bytes:
    return text + b" " * (max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def feature(pcm: bytes) -> str:
    """Mean level, mean absolute step, and share of samples below and above the middle, of the samples read back."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64)
    steps = np.abs(np.diff(x)).sum()
    return f"n={len(x)};mean={int(x.sum()) * 1000 // len(x)};step={int(steps) * 1000 // max(1, len(x) - 1)};low={int((x < 64).sum())};high={int((x >= 128).sum())}"


def batches_of(batches, column: int, most: int = 4 << 20):
    """(lists of the batch's rows, their bytes) in parts of about ``most`` bytes."""
    for batch in batches:
        buf, offs = arrow_texts(batch.column(column))
        data = buf.tobytes()
        for lo, hi in splits(offs, most):
            yield batch.slice(lo, hi - lo), [data[a:b] for a, b in zip(offs[lo:hi].tolist(), offs[lo + 1 : hi + 1].tolist(), strict=True)]


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a FLAC file."""

    def run(batches):
        for rows, texts in batches_of(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([padded(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def blocks(stored: DataFrame) -> DataFrame:
    """doc_id, sample_offset, pcm: the PCM blocks of a table with doc_id and media."""

    def run(batches):
        for rows, files in batches_of(batches, 1):
            flat = [(i, at, pcm) for i, own in zip(rows.column(0).to_pylist(), decode(files), strict=True) for at, pcm in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, pcm binary")


def digest(stored: DataFrame) -> DataFrame:
    """From media: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for rows, files in batches_of(batches, 2):
            pcm = [b"".join(x for _, x in own) for own in decode(files)]
            cols = [[len(x) for x in pcm], [hashlib.sha256(x).hexdigest() for x in pcm], [zlib.crc32(x[-16:]) for x in pcm], [len(f) for f in files], [hashlib.sha256(f).hexdigest() for f in files], [feature(x) for x in pcm]]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
