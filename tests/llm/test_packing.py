import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import packing

KIND = "doc_id long, text string, length int"


def whole_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check(rows, pieces, cap=4096):
    want = whole_ids([t for _, t in rows])
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    pool = {}
    for (i, _), ids in zip(rows, want):
        pool.setdefault(i, []).append(ids)
    for i, many in pool.items():
        got = sorted(by_doc[i], key=lambda p: p.start)
        assert len(many) == 1
        assert [x for p in got for x in p.ids] == many[0] and all(p.doc_tokens == len(many[0]) for p in got)
        at = 0
        for p in got:
            assert p.start == at and p.length == len(p.ids) > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= cap
        padding += 0 if at & (at - 1) == 0 else cap - at
    return padding / sum(p.length for p in pieces)


def test_round_trip(spark):
    r = random.Random(3)
    odd = ["(x)-y.", "a.b,", "A!!", "é.", "x…", "it's.", "U.S.A.", "3.5%", "don't!", "a_", "b|", "…!", "Äpfel x", "can't", "<|endoftext|>", "!!..", "日本", "é", "　a", "1234", "ΣΑΣ", "\x85b", "don’t\x1cstop"]
    make = lambda n: " ".join(r.choice(odd) if r.random() < 0.1 else "w" + str(r.randrange(10**4)) for _ in range(n))
    rows = [(i, make(int(r.paretovariate(0.8) * 20) % 4000)) for i in range(300)] + [(400, None), (401, ""), (402, " \n "), (403, make(9000))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], KIND).repartition(1)
    assert check(rows, packing.pack(df, group=40000).collect()) < 0.02
    assert packing.pack(spark.createDataFrame([], KIND)).collect() == []


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "a b", 0)], KIND)
    out = packing.pack(df, with_ids=False).collect()
    assert sum(p.length for p in out) == 9 and "ids" not in out[0]


@pytest.mark.parametrize("seed", range(6))
def test_differencing_divides_evenly(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 4096) for _ in range(r.randrange(1, 400))]
    q = max(1, len(sizes) // r.randrange(3, 9))
    bins = packing.differencing(sizes, q)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and len(bins) == q
    if q > 1 and len(sizes) >= 5 * q:
        sums = [sum(sizes[i] for i in b) for b in bins]
        assert max(sums) - min(sums) < 600


def test_arrange_small():
    for lengths in ([1], [4096], [4097], [5000] * 3, [3, 9], []):
        seqs = packing.arrange(lengths)
        assert sum(n for s in seqs for _, _, n in s) == sum(lengths)


def test_a_tokenizer_that_keeps_white_space(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["Two  spaces, A Cap and\n\n lines", "", "x" * 50, "tab\tbed " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {}
    for r in sorted(packing.pack(df, tokenizer=path).collect(), key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in enumerate(texts)}
    assert packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).by_words and not packing.WordIds(path).by_words


def test_the_window_count_rises(monkeypatch):
    monkeypatch.setattr(packing, "ROOM", 0)
    r = random.Random(1)
    for _ in range(30):
        lengths = [r.randrange(1300, 2900) for _ in range(r.randrange(8, 60))]
        seqs = packing.arrange(lengths)
        assert all(sum(n for _, _, n in s) <= packing.CAPACITY for s in seqs)
        seen = sorted((d, at, n) for s in seqs for d, at, n in s)
        for d, n in enumerate(lengths):
            own = [x for x in seen if x[0] == d]
            assert own[0][1] == 0 and sum(x[2] for x in own) == n and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
