import hashlib
import random
import zlib

import numpy as np
import pytest

from ridgeline.llm import flac


def payloads(seed):
    r = random.Random(seed)
    texts = [b"", b"a", b"a" * 1500, bytes(r.randrange(256) for _ in range(5000)), "çé über ".encode() * 900, b"\x00\xff" * 4000, b"a" * 1152 + b"b", bytes([0] * 700 + [255] * 700)]
    return [flac.padded(t) for t in texts] + [flac.padded(bytes(97 + int(abs(r.gauss(0, 6))) for _ in range(r.randrange(9000)))) for _ in range(30)]


def test_round_trip_and_offsets():
    p = payloads(1)
    for block in (flac.BLOCK, 4608, 192, 500):
        for own, x in zip(flac.decode(flac.encode(p, block)), p):
            at = 0
            for offset, pcm in own:
                assert offset == at
                at += len(pcm)
            assert b"".join(pcm for _, pcm in own) == x


def strip_seek_table(f):
    out, at = f[:4], 4
    while True:
        kind, n = f[at], int.from_bytes(f[at + 1 : at + 4], "big")
        if kind & 127 != 3:
            out += bytes([kind]) + f[at + 1 : at + 4 + n]
        at += 4 + n
        if kind & 128:
            break
    return out[:4] + b"\x80" + out[5:] + f[at:]


def test_without_seek_table():
    p = payloads(2)[:8]
    assert [b"".join(x for _, x in own) for own in flac.decode([strip_seek_table(f) for f in flac.encode(p)])] == p


def test_every_damage_is_seen():
    r = random.Random(3)
    f = flac.encode([flac.padded(b"the quick brown fox " * 300)])[0]
    for _ in range(60):
        k = r.randrange(len(f) - 700, len(f))
        bad = bytearray(f)
        bad[k] ^= 1 << r.randrange(8)
        with pytest.raises((flac.Damaged, IndexError)):
            flac.decode([bytes(bad)])
    with pytest.raises(flac.Damaged):
        flac.decode([b"RIFF" + f[4:]])


def bits(*fields):
    s = "".join(format(v & (1 << w) - 1, f"0{w}b") if w else v for v, w in fields)
    s += "0" * (-len(s) % 8)
    return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8))


def file_of(subframe, samples):
    head = bytes([0xFF, 0xF8, 0x74, 2, 0]) + (len(samples) - 1).to_bytes(2, "big")
    head += bytes([int(flac.crc8(np.frombuffer(head, np.uint8)[None, :].astype(np.int64), np.array([len(head)]))[0])])
    frame = head + subframe
    buf = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(buf, np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = (len(samples)).to_bytes(2, "big") * 2 + b"\0" * 6 + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def test_lpc_escape_and_long_unary():
    coefs, shift = (7, -3), 2
    samples, res = [5, -4], []
    for e in (1, -2, 60, 0, 3, -1):
        guess = (coefs[0] * samples[-1] + coefs[1] * samples[-2]) >> shift
        nxt = max(-120, min(120, guess + e))
        res.append(nxt - guess)
        samples.append(nxt)
    head = [(0, 1), (32 + 1, 6), (0, 1), (5, 8), (-4, 8), (4 - 1, 4), (shift, 5), (7, 4), (-3, 4)]
    rice = [(0, 2), (0, 4), (0, 4)] + [("0" * (2 * e if e >= 0 else -2 * e - 1) + "1", 0) for e in res]
    escaped = [(1, 2), (0, 4), (31, 5), (9, 5)] + [(e, 9) for e in res]
    for tail in (rice, escaped):
        (own,) = flac.decode([file_of(bits(*head, *tail), samples)])
        assert (np.frombuffer(own[0][1], np.uint8) ^ 128).view(np.int8).tolist() == samples


def test_query_shape(spark):
    texts = ["abc", None, "", "é" * 700, "abc"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = flac.media(df)
    out = sorted(flac.digest(stored).collect(), key=lambda r: r.doc_id)
    for r, t in zip(out, texts):
        want = flac.padded((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert out[0][1:] == out[4][1:] and out[1][1:] == out[2][1:]
    assert sum(len(r.pcm) for r in flac.blocks(stored).collect()) == sum(r.payload_bytes for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert flac.digest(flac.media(empty)).collect() == []


class Bits:
    def __init__(self, data):
        self.v, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n):
        self.left -= n
        return self.v >> self.left & (1 << n) - 1

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if v >> n - 1 else v

    def unary(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def plain_crc(data, poly, bits):
    c = 0
    for x in data:
        c ^= x << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> bits - 1 else c << 1) & (1 << bits) - 1
    return c


def plain_decode(data):
    """A decoder of mono 8-bit FLAC by the format's text, a bit at a time: independent of the module."""
    assert data[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + n]
        at += 4 + n
    total, out = int.from_bytes(info[10:18], "big") & (1 << 36) - 1, []
    while len(out) < total:
        b = Bits(data[at:])
        size0 = b.left
        assert b.take(14) == 0b11111111111110
        b.take(2)
        block, rate = b.take(4), b.take(4)
        b.take(8)
        first = b.take(8)
        for _ in range(0 if first < 128 else f"{first:08b}".index("0") - 1):
            b.take(8)
        n = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}.get(block)
        n = b.take(8) + 1 if block == 6 else b.take(16) + 1 if block == 7 else n
        if rate == 12:
            b.take(8)
        elif rate in (13, 14):
            b.take(16)
        head = (size0 - b.left) // 8
        assert plain_crc(data[at : at + head], 0x07, 8) == b.take(8)
        assert b.take(1) == 0
        kind, wasted = b.take(6), b.take(1)
        assert not wasted
        if kind == 0:
            x = [b.signed(8)] * n
        elif kind == 1:
            x = [b.signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 16 else kind - 31
            x = [b.signed(8) for _ in range(order)]
            if kind >= 32:
                width, shift = b.take(4) + 1, b.signed(5)
                coefs = [b.signed(width) for _ in range(order)]
            else:
                shift, coefs = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            width = 4 + b.take(2)
            parts = b.take(4)
            for p in range(1 << parts):
                count = (n >> parts) - (order if p == 0 else 0)
                k = b.take(width)
                raw = b.take(5) if k == (1 << width) - 1 else None
                for _ in range(count):
                    if raw is not None:
                        e = b.signed(raw) if raw else 0
                    else:
                        u = b.unary() << k | b.take(k)
                        e = u >> 1 ^ -(u & 1)
                    x.append(e + (sum(c * v for c, v in zip(coefs, reversed(x[len(x) - order :]))) >> shift))
        out += x
        used = -(-(size0 - b.left) // 8)
        assert plain_crc(data[at : at + used], 0x8005, 16) == int.from_bytes(data[at + used : at + used + 2], "big")
        at += used + 2
    assert hashlib.md5(bytes(v & 255 for v in out)).digest() == info[18:34]
    return bytes(v + 128 for v in out)


def test_files_and_features_by_an_independent_decoder(spark):
    r = random.Random(12)
    texts = ["", "a", "aaaa" * 300, "".join(r.choice("the quick brown fox ") for _ in range(9000)), "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(700)), "é" * 192]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {x.doc_id: x for x in flac.media(df).collect()}
    got = {x.doc_id: x for x in flac.digest(flac.media(df)).collect()}
    for k, t in enumerate(texts):
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        data = bytes(stored[k].media)
        assert plain_decode(data) == payload
        assert got[k].media_sha256 == hashlib.sha256(data).hexdigest() and got[k].media_bytes == len(data)
        steps = sum(abs(a - b) for a, b in zip(payload, payload[1:]))
        assert got[k].feature == f"n={len(payload)};mean={sum(payload) * 1000 // len(payload)};step={steps * 1000 // max(1, len(payload) - 1)};low={sum(x < 64 for x in payload)};high={sum(x >= 128 for x in payload)}"
        assert got[k].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[k].tail_crc32 == zlib.crc32(payload[-16:])
