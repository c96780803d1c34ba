import hashlib
import random

import pytest

from ridgeline.llm import suffix_dedup

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], KIND).repartition(parts)


def brute(rows, width):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "be", "çé", "delta", "the", "of", "ab" * 9, "x"]
    make = lambda k: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(k))
    common = make(30)
    texts = []
    for i in range(n):
        t = make(r.randrange(80))
        if i % 3 == 0:
            t += common[r.randrange(20) :] + make(5)
        if i % 7 == 0 and texts:
            t = r.choice(texts)
        if i % 5 == 0 and texts:
            s = r.choice(texts)
            a = r.randrange(len(s) + 1)
            t = t + s[a : a + 300] + t[:150]
        texts.append(t)
    texts += ["", None, "a" * 700, "a" * 350, "ab" * 300, "z" * 99, "z" * 100, "z" * 100, "z" * 101]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("hot,block", [(1024, 4000), (3, 4000), (0, 900), (1024, 1 << 20)])
def test_matches_brute_force(spark, hot, block):
    rows = corpus(hot + block)
    assert got(suffix_dedup.report(frame(spark, rows), hot=hot, block_bytes=block)) == brute(rows, 100)


def test_long_text_and_empty_table(spark):
    rows = [(1, "the cat sat on the mat 0123456789 " * 30000), (0, "the cat sat on the mat 0123456789 " * 4)]
    assert got(suffix_dedup.report(frame(spark, rows))) == brute(rows, 100)
    assert got(suffix_dedup.report(frame(spark, []))) == []
    assert suffix_dedup.dedup(frame(spark, [])).collect() == []


def test_dedup_keeps_columns_and_whole_characters(spark):
    shared = "".join(chr(256 + k) for k in range(80))
    rows = [(0, "a" + shared, "x", 7), (1, "b" + shared[:60] + "tail", "y", 8), (2, None, "z", 9), (None, "q" + shared, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_chars long")
    out = {r.block: r for r in suffix_dedup.dedup(df).collect()}
    assert out["n"].text == "q" + shared and out["x"].text == "a" and out["y"].text == "btail"
    assert out["z"].text is None and out["z"].doc_id == 2 and out["y"].n_chars == 5


def test_repeated_rows(spark):
    rows = [(5, "w" * 40 + "0123456789" * 20)] * 3
    out = got(suffix_dedup.report(frame(spark, rows, 1)))
    assert sorted(x[2] for x in out)[1:] == [240, 240] and sorted(x[2] for x in out)[0] < 240


def test_bytes_that_polynomial_hashes_confuse(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, "x" + a[:1024]), (2, "y" + b[:1024]), (3, "z" + a[:1024]), (4, "q" + b + "r")]
    for hot in (1024, 0):
        assert got(suffix_dedup.report(frame(spark, rows), hot=hot, block_bytes=900)) == brute(rows, 100)


def test_packs_dealt_twice(spark):
    rows = corpus(8, 40)
    assert got(suffix_dedup.report(frame(spark, rows), block_bytes=1500, bucket_bytes=400, fan=5)) == brute(rows, 100)
